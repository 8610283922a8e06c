"""What the corpus operators share: word splitting, tables in the shared folder, distributed prefix sums."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The characters that separate words; everything else belongs to one.
SPACES = " \t\n\x0b\x0c\r"
#: Bits that marked() broadcasts at most.
BITS = 1 << 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once for the row however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The maximal runs of characters other than SPACES, in order; none for null."""
    flat = F.coalesce(text, F.lit(""))
    for space in SPACES[1:]:
        flat = F.replace(flat, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(flat, " "), "")


def ascii_lower(text: Column) -> Column:
    """Only A-Z change, whatever the locale."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def free_name(df: DataFrame, name: str) -> str:
    """name, behind as many underscores as it takes to be no column of df."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one for a session on this machine alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="terrasieve-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut, and a lost executor costs no recomputation.

    The table goes when the driver's interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def drop() -> None:
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001  the session may have ended already
            pass

    atexit.register(drop)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, once: bool = False) -> DataFrame:
    """written(), cut by key as joins cut their rows: joins and aggregations on key leave these rows where they are. once: one row of each key."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the shuffle that leaves out repeats cuts by key as well
    (df.dropDuplicates([key]) if once else df.repartition(parts, key)).write.bucketBy(parts, key).option("path", path).format("parquet").saveAsTable(name)

    def drop() -> None:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001  the session may have ended already
            pass

    atexit.register(drop)
    return spark.table(name)


def marked(df: DataFrame, ids: DataFrame, name: str, seed: int = 0) -> DataFrame:
    """df and name: true where doc_id, a whole number, is among ids, and for few others, that share the hash of one of ids; false for the rest.

    What is broadcast are BITS bits at most, so no row of df is shuffled.
    """
    at = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")), F.lit(BITS))
    part, bits = free_name(df, "_part"), free_name(df, "_bits")
    spots = ids.select(F.shiftright(at, 15).alias(part), (at % 32768).alias("_spot"))
    # cut by part before they are gathered: the bits of a part are made once
    maps = spots.repartition(part).groupBy(part).agg(F.bitmap_construct_agg("_spot").alias(bits))
    spot = (at % 32768).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(spot, 3) + 1, F.lit(1))), 16, 10).cast("long")
    found = df.withColumn(part, F.shiftright(at, 15)).join(F.broadcast(maps), part, "left")
    return found.withColumn(name, F.coalesce(F.getbit(byte, spot % 8) == 1, F.lit(False))).drop(part, bits)


def having(df: DataFrame, ids: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of df whose doc_id is among ids, exactly; only rows that marked() can't leave out are shuffled."""
    name = free_name(df, "_marked")
    return marked(df, ids, name, seed).where(F.col(name)).drop(name).join(ids.select("doc_id"), "doc_id", "left_semi").select(*df.columns)


def spread_sample(df: DataFrame, rows: int, files: int = 8) -> DataFrame:
    """About rows rows of a table, from at most files of its files, spread evenly; for estimates only.

    Reading stays bounded however large the table is. A frame without files is sampled as it is.
    """
    names = sorted(df.inputFiles())
    if len(names) > files:
        names = [names[i * len(names) // files] for i in range(files)]
        df = df.sparkSession.read.schema(df.schema).parquet(*names)
    return df.orderBy(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c, kind in df.dtypes if kind in ("bigint", "int")] or [F.lit(0)])).limit(rows)


def prefix_sums(df: DataFrame, group: str, order: list[str], value: str, before: str, per_group: DataFrame | None = None) -> DataFrame:
    """Adds before: the sum of value over the rows of the same group that come earlier by order.

    The rows are range-partitioned by (group, order), so a group that holds most rows is cut over many
    partitions; only one sum per (group, partition) meets in a window. group must not be null, and order should be
    total within a group (rows that tie take any order among themselves). per_group holds more columns by group: they
    are joined to those sums, so the rows themselves are joined once.
    """
    placed = written(df.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = placed.groupBy(group, "_part").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    if per_group is not None:
        sums = sums.join(per_group, group)
    within = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_run", F.coalesce(F.sum(value).over(within), F.lit(0)))
        .join(sums, [group, "_part"])
        .withColumn(before, F.col("_base") + F.col("_run"))
        .drop("_part", "_run", "_base")
    )


class Known(dict):
    """value[key] is made by make(key) the first time and kept; emptied by fresh() when it holds more than most keys."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def fresh(self) -> Known:
        if len(self) > self.most:
            self.clear()
        return self


_HELD: dict = {}


def tidy() -> None:
    """Gives memory that isn't used any more back to the system.

    Caches and what makes their values refer to each other, so they stay until the garbage is collected; Arrow's pool and the C heap
    keep what is freed for as long as the Python worker lives.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim:
        trim(0)


def tidied(read: Callable) -> Callable:
    """read, a function over a task's batches; what it has freed goes back to the system when the task ends, not when the worker does."""

    @wraps(read)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from read(batches)
        finally:
            tidy()

    return run


def sole(make: Callable) -> Callable:
    """make, its last result kept for all tasks of a Python worker until another operator's takes its place.

    Spark gives the workers of one stage to the next, so caches of operators that have ended would pile up there.
    """

    @wraps(make)
    def held(*args):
        key = (make.__module__, make.__qualname__, args)
        if key not in _HELD:
            if _HELD:
                _HELD.clear()
                tidy()
            _HELD[key] = make(*args)
        return _HELD[key]

    return held


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % folds).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, trained_on: Column, rows: int) -> DataFrame:
    """doc_id, text, y of at most rows labelled documents (those with the least hash of their id) that trained_on admits.

    labels must have doc_id; only labels 0 and 1 count, and a document labelled twice counts once, with the larger label. Of rows
    that repeat a doc_id the least text counts.
    """
    chosen = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & trained_on).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = written(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "sample")
    # at most rows ids and labels
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return written(found.groupBy("doc_id", "y").agg(F.min("text").alias("text")), "labelled")
