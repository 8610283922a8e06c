"""MinHash near-duplicates with tensored banding.

Two collections of TABLES half keys each are computed, a half key being ROWS minhashes. A table key is a pair of half keys,
one from either collection: TABLES**2 tables of 2 * ROWS minhashes cost 2 * TABLES * ROWS minhashes. A pair at the
threshold 0.75 misses all tables with probability below 4e-4, at 0.8 below 3e-5.

Texts with equal shingle sets are one class first, however many copies there are. Only half keys that two classes share
can be part of a shared table key, so half keys are counted first and table keys are formed from what is left; of groups with
the same members one stays. Links are then found in STAR_ROUNDS rounds: each group of a table key proposes its members
with its most central one (in a second round with that of the rest), so a group of n gives n proposals; groups that are one
component after that are done. In the others, members of different components meet in blocks, on signatures held in arrays, each pair at the
first table key it shares; the groups of one half key of the first collection travel together, so a class goes once a half key and not once a table; pairs whose signatures agree enough are sent on, as arrays, to cells of a grid over the classes,
where each class's set arrives once for a cell. No group is capped. Every proposal is confirmed on the full shingle sets.
Components come from label propagation over tables; nothing but counts reaches the driver.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; a text with one to four
words has one shingle; equal texts are linked; rows that repeat a doc_id with another text are documents of their own; a row
without doc_id is linked like others, its component_id is the least doc_id reachable, null if there is none, and it isn't kept
(keep_one() keeps one row of a component without ids); an empty table gives an empty result; extra columns are not
read, and keep_one() returns them unchanged; very long texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StructField, StructType

from terrasieve.llm.common import Known, bucketed, free_name, having, marked, sole, tidied, written

WORDS = 5
PERCENT = 75
TABLES = 16
ROWS = 3
#: More minhashes, of a byte each, that only sharpen the estimate.
MORE = 96
#: Signatures that agree in less than this share of places are not confirmed: 3.8 standard deviations below 0.75.
AGREE = 0.63
#: Rows of one side of a block comparison.
BLOCK = 1000
#: Shingles of the classes that share a row or column of the grid of confirmations.
CELL = 1 << 18
STAR_ROUNDS = 1
CACHE_WORDS = 400_000

_RANDOM = np.random.default_rng(20240229)
_MIX = _RANDOM.integers(0, 2**64, WORDS + 1, dtype=np.uint64) | np.uint64(1)
_HALVES = 2 * TABLES * ROWS
_A = (_RANDOM.integers(0, 2**32, _HALVES + MORE, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_B = _RANDOM.integers(0, 2**32, _HALVES + MORE, dtype=np.uint64).astype(np.uint32)[:, None]
PRINT = ["n_shingles", "f1", "f2"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """The distinct shingles of a text as sorted 64-bit hashes. Hashes of words are kept, at most CACHE_WORDS of them."""

    def __init__(self) -> None:
        self.known = Known(lambda w: int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little"), CACHE_WORDS)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count
        v = np.array(list(map(self.known.fresh().__getitem__, words)), np.uint64)
        if not len(v):
            return v
        if len(v) < WORDS:
            return mixed((v * _MIX[: len(v)]).sum(keepdims=True) + _MIX[WORDS:] * np.uint64(len(v)))
        n = len(v) - WORDS + 1
        total = v[:n] * _MIX[0]
        for k in range(1, WORDS):
            total += v[k : k + n] * _MIX[k]
        return np.unique(mixed(total))


@sole
def worker_shingles() -> Shingles:
    """One cache for all tasks of a Python worker."""
    return Shingles()


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """Two longs that tell sets apart."""
    return np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), np.int64)


def half_keys(shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
    """2 * TABLES longs, each of ROWS minhashes of 16 bits, and MORE minhashes of a byte."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(least, (x[at : at + 2048] * _A + _B).min(axis=1), out=least)
    halves = np.zeros((2 * TABLES, 4), np.uint16)
    halves[:, :ROWS] = least[:_HALVES].astype(np.uint16).reshape(-1, ROWS)
    return halves.ravel().view(np.int64), least[_HALVES:].astype(np.uint8).tobytes()


def lanes_of(halves: pa.Array, more: pa.Array) -> np.ndarray:
    """The minhashes of a row each."""
    flat = np.ascontiguousarray(halves.flatten().to_numpy(zero_copy_only=False), np.int64).view(np.uint16)
    rest = np.frombuffer(b"".join(more.to_pylist()), np.uint8).reshape(-1, MORE)
    return np.concatenate([flat.reshape(-1, 2 * TABLES, 4)[:, :, :ROWS].reshape(-1, _HALVES), rest], axis=1)


def list_column(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate([*arrays, np.array([], np.int64)]).astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def signatures(docs: DataFrame) -> DataFrame:
    """row (a number of its own), doc_id, n_shingles, f1 and f2 (a 128-bit fingerprint of the set), halves and more, of each document's whole text."""

    @tidied
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles_of = worker_shingles()
        for batch in batches:
            counts, prints, halves, more = [], [], [], []
            for text in batch.column(1):
                s = shingles_of(text.as_py())
                counts.append(len(s))
                prints.append(fingerprint(s))
                own, rest = half_keys(s) if len(s) else (np.array([], np.int64), b"")
                halves.append(own)
                more.append(rest)
            two = np.array(prints, np.int64).reshape(-1, 2)
            columns = [batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1]), list_column(halves), pa.array(more, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *PRINT, "halves", "more"])

    signed = docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, f1 long, f2 long, halves array<long>, more binary")
    return written(signed.withColumn("row", F.monotonically_increasing_id()), "signatures")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """n_shingles, f1, f2 and shingles of each document, and its columns beside text, all of them long."""
    others = [c for c in docs.columns if c != "text"]

    @tidied
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles_of = worker_shingles()
        for batch in batches:
            sets = [shingles_of(t.as_py()) for t in batch.column(0)]
            two = np.array([fingerprint(s) for s in sets], np.int64).reshape(-1, 2)
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1]), list_column([s.view(np.int64) for s in sets])]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], names=[*others, *PRINT, "shingles"])

    schema = "n_shingles long, f1 long, f2 long, shingles array<long>"
    return docs.select("text", *others).mapInArrow(cut, ", ".join([*[f"{c} long" for c in others], schema]))


def shared_halves(halves: DataFrame) -> DataFrame:
    """The rows (rep, i, a) whose half key another class has too."""
    counts = halves.groupBy("i", "a").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c")
    return halves.join(counts, ["i", "a"])


def table_groups(classes: DataFrame) -> DataFrame:
    """key, table and rep: the members of each table key that several classes share; of groups with the same members that of the first table stays.

    The second collection is looked at only for classes that share a half key of the first. For any two classes the group of
    the first table they share stays: a group with the same members belongs to a table that they share too.
    """
    side = lambda of, first: of.select("rep", F.posexplode(F.slice("halves", first + 1, TABLES)).alias("i", "a"))
    one = written(shared_halves(side(classes, 0)), "halves")
    two = shared_halves(side(classes.join(one.select("rep").distinct(), "rep", "left_semi"), TABLES))
    pairs = one.join(two.select("rep", F.col("i").alias("j"), F.col("a").alias("b")), "rep")
    table = (F.col("i") * TABLES + F.col("j")).alias("table")
    tables = written(pairs.select(F.xxhash64("i", "j", "a", "b").alias("key"), table, "rep"), "tables")
    sizes = tables.groupBy("key", "table").agg(F.count(F.lit(1)).alias("_c"), F.min("rep").alias("_lo"), F.max("rep").alias("_hi"), F.bit_xor(F.xxhash64("rep")).alias("_x")).where("_c > 1")
    chosen = sizes.groupBy("_c", "_lo", "_hi", "_x").agg(F.min_by("key", "table").alias("key")).select("key")
    return tables.join(chosen, "key")


def agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (x, y) whose set sizes allow the threshold and whose signatures agree enough."""

    @tidied
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = lanes_of(batch.column(2), batch.column(3)) == lanes_of(batch.column(4), batch.column(5))
            yield batch.select([0, 1]).filter(pa.array(same.mean(axis=1) >= AGREE))

    side = lambda name: classes.select(F.col("rep").alias(name), F.col("n_shingles").alias(f"n{name}"), F.col("halves").alias(f"h{name}"), F.col("more").alias(f"m{name}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    both = both.where(100 * F.least("nx", "ny") >= PERCENT * F.greatest("nx", "ny"))
    return both.select("x", "y", "hx", "mx", "hy", "my").mapInArrow(keep, "x long, y long")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets meet the threshold."""
    both = pairs.join(sets.select(F.col("id").alias("x"), F.col("shingles").alias("sx")), "x").join(sets.select(F.col("id").alias("y"), F.col("shingles").alias("sy")), "y")
    common = both.select("x", "y", F.size(F.array_intersect("sx", "sy")).alias("c"), (F.size("sx") + F.size("sy")).alias("n"))
    return common.where(100 * F.col("c") >= PERCENT * (F.col("n") - F.col("c"))).select("x", "y")


def components(links: DataFrame) -> DataFrame:
    """id, comp: the least id reachable, for ids that have links. Labels spread to neighbours and then skip along labels of labels."""
    edges = written(links.union(links.select(F.col("y"), F.col("x"))).toDF("x", "y").distinct(), "edges")
    labels = written(edges.groupBy(F.col("x").alias("id")).agg(F.least(F.min("y"), F.min("x")).alias("comp")), "labels")
    while True:
        heard = edges.join(labels.select(F.col("id").alias("y"), F.col("comp").alias("c")), "y").groupBy(F.col("x").alias("id")).agg(F.min("c").alias("c"))
        near = labels.join(heard, "id").select("id", F.col("comp").alias("old"), F.least("comp", "c").alias("comp"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("further"))
        new = near.join(jump, "comp", "left").select("id", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp"))
        new = written(new, "labels")
        labels = new.drop("old")
        if new.where("old <> comp").isEmpty():
            return labels


def plans(rows: DataFrame) -> DataFrame:
    """How dealt() cuts each key: main (its largest component), nm (blocks of main alone, 0 for none), no (other blocks), made (rows)."""
    sizes = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("_m"))
    sizes = sizes.groupBy("key").agg(F.sum("_m").alias("c"), F.max(F.struct("_m", "comp")).alias("_top"))
    blocks_of = lambda n: F.ceil(n / BLOCK).cast("long")
    most, rest = F.col("_top._m"), F.col("c") - F.col("_top._m")
    apart = most * blocks_of(rest) + rest * (blocks_of(most) + blocks_of(rest))  # rows, if the largest component has its own blocks
    whole = F.col("c") * blocks_of(F.col("c"))
    cut = (rest > 0) & (F.col("c") > BLOCK) & (apart < whole)
    main, others = F.when(cut, blocks_of(most)).otherwise(0), F.when(cut, blocks_of(rest)).otherwise(blocks_of(F.col("c")))
    return sizes.select("key", F.col("_top.comp").alias("main"), main.cast("long").alias("nm"), others.alias("no"), F.when(cut, apart).otherwise(whole).alias("made"))


def packs(rows: DataFrame) -> DataFrame:
    """key, first, tables (bits), rep and comp: the rows (key, table, half, rep, comp), a row for each class and half key.

    half is the half key of the first collection, number first, that a group's members share; tables are the numbers of the second collection under
    which a class is in groups of that half key. Where dealt() would make more rows of a half key than of its groups, these keep their keys.
    """
    first, bit = F.floor(F.col("table") / TABLES).cast("int"), F.expr(f"shiftleft(1L, CAST(table % {TABLES} AS INT))")
    joined = written(rows.groupBy(F.col("half").alias("key"), "rep", "comp").agg(F.min(first).alias("first"), F.bit_or(bit).alias("tables")), "halves")
    single = plans(rows).join(rows.groupBy("key").agg(F.min("half").alias("half")), "key").groupBy("half").agg(F.sum("made").alias("single"))
    dear = plans(joined).join(single.withColumnRenamed("half", "key"), "key").where("made > single").select("key")
    dear = written(dear, "dear")
    if dear.isEmpty():
        return joined
    own = rows.join(dear.select(F.col("key").alias("half")), "half", "left_semi")
    own = own.select("key", first.alias("first"), bit.alias("tables"), "rep", "comp")
    return joined.join(dear, "key", "left_anti").select(*own.columns).unionByName(own)


def dealt(rows: DataFrame) -> DataFrame:
    """pair and side of the rows (key, rep, comp and others), a row for each pair of blocks that a row belongs to.

    A group of more than BLOCK rows is cut into blocks by a hash, and each pair of blocks is a group of its own. Where that makes fewer rows, the
    group's largest component has blocks of its own, which don't meet one another: only pairs of different components are looked for.
    """
    per = plans(rows).drop("made")
    placed = rows.join(per, "key").withColumn("_in", (F.col("nm") > 0) & (F.col("comp") == F.col("main"))).withColumn("nb", F.col("nm") + F.col("no"))
    block = F.pmod(F.xxhash64("rep"), F.when(F.col("_in"), F.col("nm")).otherwise(F.col("no"))) + F.when(F.col("_in"), F.col("no")).otherwise(0)
    placed = placed.withColumn("b", block).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("_in"), F.col("no")).otherwise(F.col("nb")) - 1)))
    # side 0: the block with itself; 1 and 2: the two blocks of a pair
    return placed.select(
        "key", (F.least("b", "o") * F.col("nb") + F.greatest("b", "o")).alias("pair"), *[c for c in rows.columns if c != "key"],
        F.when(F.col("b") == F.col("o"), 0).when(F.col("b") < F.col("o"), 1).otherwise(2).alias("side"),
    )


def blocks(rows: DataFrame, near: DataFrame, cells: int) -> DataFrame:
    """Pairs of different components whose sizes and signatures agree, from the rows of packs() and the classes near.

    Rows hold arrays: bx and by (the cell of the pairs), x and y (classes, a pair each) and members (distinct classes).
    Packs are dealt(), and the groups of table keys found in them. A pair counts at the first table it shares.
    """

    @tidied
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the group at the end of a batch goes on in the next
        last = None

        def pairs(group: list[tuple], first: int) -> Iterator[pa.RecordBatch]:
            rep, comp, tables, n, side, lanes = (np.concatenate([g[k] for g in group]) for k in range(6))
            if (comp == comp[0]).all():
                return
            halves = lanes[:, :_HALVES].reshape(len(rep), 2 * TABLES, ROWS)
            quick = np.ascontiguousarray(lanes[:, _HALVES:].astype(np.uint8))
            xs, ys = [], []
            for j in range(TABLES):
                here = np.flatnonzero(tables >> j & 1)
                order = np.lexsort(halves[here, TABLES + j].T)
                here = here[order]
                seconds = halves[here, TABLES + j]
                for own in np.split(here, np.flatnonzero((seconds[1:] != seconds[:-1]).any(axis=1)) + 1):
                    if len(own) < 2 or (comp[own] == comp[own[0]]).all():
                        continue
                    for k, r in enumerate(own[:-1]):
                        other = own[k + 1 :]
                        other = other[(comp[other] != comp[r]) & ((side[other] != side[r]) | (side[r] == 0))]
                        other = other[100 * np.minimum(n[other], n[r]) >= PERCENT * np.maximum(n[other], n[r])]
                        # first on MORE places alone, at a looser limit
                        other = other[np.count_nonzero(quick[other] == quick[r], axis=1) >= (AGREE - 0.15) * MORE]
                        other = other[(lanes[other] == lanes[r]).mean(axis=1) >= AGREE]
                        if len(other):
                            same = (halves[other] == halves[r]).all(axis=2)
                            other = other[same[:, :TABLES].argmax(axis=1) * TABLES + same[:, TABLES:].argmax(axis=1) == first * TABLES + j]
                            xs.append(np.full(len(other), rep[r]))
                            ys.append(rep[other])
            if not sum(map(len, xs)):
                return
            x, y = np.concatenate(xs), np.concatenate(ys)
            bx, by = (mixed(v.view(np.uint64)) % np.uint64(cells) for v in (x, y))
            x, y, bx, by = np.where(bx <= by, x, y), np.where(bx <= by, y, x), np.minimum(bx, by).astype(np.int64), np.maximum(bx, by).astype(np.int64)
            order = np.lexsort((by, bx))
            ends = np.flatnonzero(np.diff(bx[order]) | np.diff(by[order])) + 1
            parts = np.split(order, ends)
            columns = [pa.array(b[[p[0] for p in parts]]) for b in (bx, by)]
            lists = [list_column([f(p) for p in parts]) for f in (lambda p: x[p], lambda p: y[p], lambda p: np.unique(np.concatenate([x[p], y[p]])))]
            yield pa.RecordBatch.from_arrays([*columns, *lists], names=["bx", "by", "x", "y", "members"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1, 2)], axis=1)
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5, 6, 7)] + [lanes_of(batch.column(8), batch.column(9))]
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and tuple(key[a]) != last:
                    yield from pairs(held, int(last[2]))
                    held = []
                held.append(tuple(c[a:b] for c in columns))
                last = tuple(key[a])
        if held:
            yield from pairs(held, int(last[2]))

    near = near.select("rep", "n_shingles", "halves", "more")
    placed = dealt(rows).join(near, "rep").select("key", "pair", "first", "rep", "comp", "tables", "n_shingles", "side", "halves", "more")
    placed = placed.repartition("key", "pair").sortWithinPartitions("key", "pair")
    return placed.mapInArrow(compare, "bx long, by long, x array<long>, y array<long>, members array<long>")


def confirmed_cells(found: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (x, y) among the pairs of blocks(): each cell meets its members' full sets once, so pairs are never rows.

    A pair whose members other links of the cell join already is skipped: it can't change a component.
    """

    def check(pairs: pa.Table, full: pa.Table) -> pa.Table:
        held = {i: np.asarray(s.values).view(np.uint64) for i, s in zip(full.column("id").to_pylist(), full.column("shingles").combine_chunks(), strict=True)}
        x, y = (np.concatenate([np.asarray(c.values) for c in pairs.column(n).combine_chunks()]).tolist() for n in ("x", "y"))
        parent: dict[int, int] = {}
        links: list[tuple[int, int]] = []

        def root(m: int) -> int:
            while parent.setdefault(m, m) != m:
                parent[m] = m = parent[parent[m]]
            return m

        for k, l in zip(x, y, strict=True):
            if root(k) != root(l):
                few, many = sorted((held[k], held[l]), key=len)
                common = np.count_nonzero(many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few)
                if 100 * common >= PERCENT * (len(few) + len(many) - common):
                    parent[root(k)] = root(l)
                    links.append((min(k, l), max(k, l)))
        return pa.table({"x": pa.array([f[0] for f in links], pa.int64()), "y": pa.array([f[1] for f in links], pa.int64())})

    members = found.select(F.col("bx").alias("mx"), F.col("by").alias("my"), F.explode("members").alias("id")).distinct()
    return found.groupBy("bx", "by").cogroup(members.join(sets, "id").groupBy("mx", "my")).applyInArrow(check, "x long, y long")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """text of the documents with the doc_ids of ids, and what else ids holds. Most others are left out before texts are shuffled."""
    texts = marked(docs.where("doc_id is not null").select("doc_id", "text"), ids, "_marked").where("_marked").drop("_marked")
    return texts.join(ids, "doc_id").select("text", *[c for c in ids.columns if c != "doc_id"])


def sets_of(docs: DataFrame, near: DataFrame) -> DataFrame:
    """id (rep) and shingles of the classes near, cut by id.

    A doc_id that is the least one of a single class takes its rep along, so its set goes straight to its place; other sets (of ids that repeat with
    other texts, or of rows without one) find their class by fingerprint.
    """
    near = near.select(*PRINT, "rep", "low")
    lows = near.where("low is not null").groupBy(F.col("low").alias("doc_id")).agg(F.count(F.lit(1)).alias("_c"), F.min("rep").alias("id"), *[F.min(c).alias(f"_{c}") for c in PRINT])
    lows = written(lows, "lows")
    sets = shingle_sets(texts_of(docs, lows.where("_c = 1").drop("_c")))
    sets = sets.where(" and ".join(f"{c} = _{c}" for c in PRINT)).select("id", "shingles")  # an id may have other texts too
    shared, without = lows.where("_c > 1").select("doc_id"), near.where("low is null")
    if not (shared.isEmpty() and without.isEmpty()):
        texts = texts_of(docs, shared).unionByName(docs.where("doc_id is null").select("text"))
        classes = near.join(shared.withColumnRenamed("doc_id", "low"), "low", "left_semi").select(*near.columns).unionByName(without)
        sets = sets.unionByName(shingle_sets(texts).join(classes, PRINT).select(F.col("rep").alias("id"), "shingles"))
    return bucketed(sets, "sets", "id", once=True)


def linked(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_shingles, f1, f2 of each document, component (a number, equal for linked documents) and component_id."""
    signed = signatures(docs)
    classes = signed.where("n_shingles > 0").groupBy(*PRINT).agg(F.min("row").alias("rep"), F.min("doc_id").alias("low"), F.min_by(F.struct("halves", "more"), "row").alias("_k"))
    classes = written(classes.select(*PRINT, "rep", "low", "_k.halves", "_k.more"), "classes")
    rows = table_groups(classes)
    # the text that others were copied from is in the most groups, so it leads
    rows = written(rows, "groups")
    rows = written(rows.join(rows.groupBy("rep").agg(F.count(F.lit(1)).alias("weight")), "rep"), "groups")
    near = written(classes.join(rows.select("rep").distinct(), "rep", "left_semi"), "near")
    # full sets are joined by id twice: they are cut by it once
    sets = sets_of(docs, near)
    empty = rows.select(F.col("rep").alias("x"), F.col("rep").alias("y")).limit(0)
    links, comps = empty, empty.select(F.col("x").alias("id"), F.col("y").alias("comp"))
    tried, led = empty, None
    for _ in range(STAR_ROUNDS):
        labelled = rows.join(comps, rows.rep == comps.id, "left").select("key", "rep", "weight", F.coalesce("comp", "rep").alias("comp"))
        choice = labelled if led is None else labelled.join(led, "key").where("comp <> led")
        central = F.struct("weight", -F.col("rep"))
        lead = written(choice.groupBy("key").agg(F.max_by("rep", central).alias("y"), F.max_by("comp", central).alias("cy")), "leaders")
        pairs = labelled.join(lead, "key").where("comp <> cy").select(F.least("rep", "y").alias("x"), F.greatest("rep", "y").alias("y")).distinct()
        pairs = written(agreeing(pairs.join(tried, ["x", "y"], "left_anti"), near), "pairs")
        links, tried = written(links.union(confirmed(pairs, sets)), "links"), tried.union(pairs)
        comps = components(links)
        hubs = lead.select("key", F.col("y").alias("hub")) if led is None else led.select("key", "hub")
        led = hubs.join(comps, hubs.hub == comps.id, "left").select("key", "hub", F.coalesce("comp", "hub").alias("led"))
    labelled = rows.join(comps, rows.rep == comps.id, "left").select("key", "table", "rep", F.coalesce("comp", "rep").alias("comp"))
    open_groups = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("rep").alias("_one"), F.min("table").alias("_table")).where("lo < hi")
    first = F.floor(F.col("_table") / TABLES).cast("int")  # the first half key is that of any member
    half = open_groups.join(near.select(F.col("rep").alias("_one"), "halves"), "_one").select("key", F.xxhash64(first, F.get("halves", first)).alias("half"))
    rest = written(labelled.join(half, "key"), "open")
    cells = 1 + (near.agg(F.sum("n_shingles")).first()[0] or 0) // CELL
    found = written(blocks(packs(rest), near, cells), "pairs")
    links = written(links.union(confirmed_cells(found, sets)), "links")
    comps = components(links)
    met = near.join(comps, near.rep == comps.id).select("rep", "low", "comp")
    lows = met.groupBy("comp").agg(F.min("low").alias("_low"))
    named = classes.select(*PRINT, "rep", "low").join(met.select("rep", "comp"), "rep", "left").join(lows, "comp", "left")
    named = named.select(*PRINT, F.coalesce("comp", "rep").alias("component"), F.coalesce("_low", "low").alias("_low"))
    out = signed.drop("halves", "more").join(named, PRINT, "left")
    return out.select("row", "doc_id", *PRINT, F.coalesce("component", "row").alias("component"), F.when(F.col("n_shingles") > 0, F.col("_low")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links), kept (doc_id is component_id)."""
    return linked(docs).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def kept_once(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id occurs once and is kept, by the ids of all rows (doc_id, _c: rows, _kept).

    Texts stay where they are: a row is kept as it is read if its id shares no hash with one that isn't. Of the others only those whose id shares a
    second hash with one of the kept ids among them are shuffled, to be told apart by id.
    """
    alone = F.col("_kept") & (F.col("_c") == 1)
    others, name = ids.where(~alone), free_name(docs, "_other")
    told = marked(docs.where("doc_id is not null"), others, name)
    unsure = written(marked(ids.where(alone).select("doc_id"), others, "_other").where("_other").select("doc_id"), "unsure")
    clear = told.where(~F.col(name)).select(*docs.columns)
    return clear.unionByName(having(told.where(F.col(name)).select(*docs.columns), unsure, 1))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: one with its least doc_id, or any where no row has an id. Rows without shingles stay.

    Ids that occur once are kept by id; only rows that repeat an id, or have none, are read again to be told apart.
    """
    found = written(linked(docs).withColumn("_kept", F.col("doc_id").eqNullSafe(F.col("component_id")) | (F.col("n_shingles") == 0)), "linked")
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_c"), F.max("_kept").alias("_kept"))
    ids = written(ids, "ids")
    once = kept_once(docs, ids)
    again = ids.where("_kept and _c > 1").select("doc_id")
    if again.isEmpty() and found.where("doc_id is null").isEmpty():
        return once
    rest = having(docs, again).unionByName(docs.where("doc_id is null"))
    text = docs.columns.index("text")
    new = ["_n", "_f1", "_f2"]

    @tidied
    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles_of = worker_shingles()
        for batch in batches:
            sets = [shingles_of(t.as_py()) for t in batch.column(text)]
            two = np.array([fingerprint(s) for s in sets], np.int64).reshape(-1, 2)
            columns = [batch.column(k) for k in range(batch.num_columns)] + [pa.array([len(s) for s in sets], pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, names=[*[f"c{k}" for k in range(batch.num_columns)], *new])

    # columns go by number, so that names of docs can't clash
    held = [StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema.fields)]
    told = rest.toDF(*[f.name for f in held]).mapInArrow(printed, StructType([*held, *[StructField(n, LongType()) for n in new]]))
    sets = found.where("n_shingles > 0").select(F.col("n_shingles").alias("_n"), F.col("f1").alias("_f1"), F.col("f2").alias("_f2"), "component", "component_id").distinct()
    own = F.col(f"c{docs.columns.index('doc_id')}").eqNullSafe(F.col("component_id"))
    order = F.xxhash64(*[F.col(f.name) for f in held if not isinstance(f.dataType, MapType)])
    first = told.join(sets, new).where(own).withColumn("_rank", F.row_number().over(Window.partitionBy("component").orderBy(order))).where("_rank = 1")
    names = [F.col(f.name).alias(c) for f, c in zip(held, docs.columns, strict=True)]
    return once.unionByName(first.select(*names)).unionByName(told.where("_n = 0").select(*names))
