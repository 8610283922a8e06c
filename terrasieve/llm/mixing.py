"""Mixing sources to target weights, by words.

Each document gets a hash-random place in its source. Sources are range-sorted by it, distributed prefix sums give
each document the words before it, and the source is cut at its exact budget; a budget above the source's size takes
whole epochs first. Everything is built-in column functions.

Defined results: a null source is a source of its own and comes last; null and empty texts have size 0 and are taken
0 words; a source of only such texts has target 0; repeated rows are documents of their own; very long texts are sized
whole; ties in place go by doc_id and size; extra columns are not read by mix() and returned unchanged by mixed_documents(); an
empty table gives an empty result. The place depends on doc_id and seed alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasieve.llm.common import prefix_sums, words_of, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0


def source_key(source: Column) -> Column:
    """Never null; sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("v"), source.cast("string")), F.lit("w"))


def place(doc_id: Column, seed: int = 0) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def water_level(sources: DataFrame, total: float) -> float:
    """Words per weight at which the targets least(cap, level * weight) add up to total.

    sources has weight and cap. Each round closes the sources that the level would overfill, so it ends; a round
    brings two sums to the driver, not the sources.
    """
    closed, level = -1, 0.0
    while True:
        full = F.col("cap") <= level * F.col("weight") if closed >= 0 else F.lit(False)
        row = sources.agg(
            F.sum(F.when(full, 1).otherwise(0)).alias("n"),
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("caps"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weights"),
        ).first()
        if (row["n"] or 0) == closed or not row["weights"]:
            return level
        closed, level = row["n"], (total - row["caps"]) / row["weights"]


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """A row for each source key: source_size and target."""
    sizes = sized.groupBy("_source").agg(F.sum("size").alias("source_size")).withColumn("_one", F.lit(1))
    ranked = prefix_sums(sizes.withColumn("_all", F.lit(0)), "_all", ["_source"], "_one", "_rank")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights)).cast("int"))
    ranked = written(ranked.select("_source", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("cap")), "sources")
    total = share * float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = water_level(ranked, total)
    return ranked.select("_source", "source_size", F.least("cap", level * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, and before (words of the source's earlier documents), epochs, rest, taken.

    epochs is how often the whole source is taken, rest the words taken from one more pass; a document's share of
    that pass is what of its words lies below rest.
    """
    sized = docs.select("doc_id", "source", source_key(F.col("source")).alias("_source"), F.size(words_of(F.col("text"))).cast("long").alias("size"))
    sized = written(sized.withColumn("_place", place(F.col("doc_id"), seed)), "sizes")
    run = prefix_sums(sized, "_source", ["_place", "doc_id", "size"], "size", "before", targets(sized, weights, share, most))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    run = run.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1))).cast("long")).otherwise(0))
    run = run.withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    part = F.least(F.greatest(F.col("rest") - F.col("before"), F.lit(0)), F.col("size"))
    return run.withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long")).drop("_source", "_place")


def digest(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents as often as the mix takes them: whole epochs, and once more where the cut leaves at least half of the document.

    Columns are those of docs, whatever their names; repeated copies are equal rows. Texts stay whole, and where they are: what meets them is a row for
    each source, with its epochs and the last place that is taken once more. Rows that share that place may be taken in part; these few
    are ranked.
    """
    counted = mix(docs, **options)
    again = (2 * (F.col("taken") - F.col("epochs") * F.col("size")) >= F.col("size")) & (F.col("size") > 0)
    rows = written(counted.select(source_key(F.col("source")).alias("_src"), "doc_id", "size", "epochs", again.alias("again")), "times")

    def order(doc_id: Column, size: Column) -> Column:  # that of mix()
        return F.struct(place(doc_id, options.get("seed", 0)).alias("place"), doc_id.alias("doc_id"), size.alias("size"))

    own = order(F.col("doc_id"), F.col("size"))
    sources = written(rows.groupBy("_src").agg(F.max("epochs").alias("_epochs"), F.max(F.when(F.col("again"), own)).alias("_last")), "sources")
    tied = rows.join(sources, "_src").where(own == F.col("_last")).groupBy("_src").agg(F.count(F.lit(1)).alias("_rows"), F.sum(F.col("again").cast("long")).alias("_most"))
    sources = written(sources.join(tied.where("_most < _rows").select("_src", "_most"), "_src", "left"), "sources")
    held = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    doc_id, source, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "source", "text"))
    sized = held.withColumn("_src", source_key(source)).withColumn("_size", F.size(words_of(text)).cast("long"))
    met = sized.withColumn("_own", order(doc_id, F.col("_size"))).join(sources, "_src")
    edge = F.col("_most").isNotNull() & F.coalesce(F.col("_own") == F.col("_last"), F.lit(False))
    more = (F.col("_size") > 0) & F.coalesce(F.col("_own") <= F.col("_last"), F.lit(False))
    out = met.where(~edge).withColumn("_times", F.col("_epochs") + more.cast("long"))
    if not sources.where("_most is not null").isEmpty():
        rank = F.row_number().over(Window.partitionBy("_src").orderBy(F.xxhash64(text)))
        out = out.unionByName(met.where(edge).withColumn("_times", F.col("_epochs") + (rank <= F.col("_most")).cast("long")))
    copies = out.where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    return copies.select(*held.columns).toDF(*docs.columns)


ORACLE_SQL = """
WITH s AS (
  SELECT doc_id, coalesce('v' || source, 'w') AS src,
         CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
         md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents),
g AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(CASE (row_number() OVER (ORDER BY src) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight
  FROM s GROUP BY src),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM g),
f AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS caps,
         sum(weight) OVER (ORDER BY cap / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM c),
l AS (SELECT coalesce(min_by((total - caps) / weights, cap / weight) FILTER (WHERE (total - caps) / weights * weight < cap), 0.0) AS level FROM f),
t AS (SELECT src, source_size, least(cap, level * weight) AS target FROM c, l),
r AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS budget,
         coalesce(sum(size) OVER (PARTITION BY src ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM s JOIN t USING (src))
SELECT doc_id, size, source_size, target,
       CAST((budget // greatest(source_size, 1)) * size
            + least(greatest(budget - (budget // greatest(source_size, 1)) * source_size - before, 0), size) AS BIGINT) AS taken
FROM r
"""
