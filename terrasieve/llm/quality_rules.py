"""Quality rules as a short-circuit cascade.

Each rule's cost and rejection rate are measured on a bounded sample; the cascade then tries rules by
rejections per second of cost, and a text that one rule rejects is not looked at by the later ones. The
verdict is the same for every order, so timing noise can't change a result.

Defined results: a null or empty text has no words and is rejected (too_few_words); very long texts are read whole;
repeated rows are judged each on their own; extra columns are kept by judge() and must not be named like
those it adds (failed_rule, kept), or they are replaced. Everything is built-in column functions.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasieve.llm.common import let, spread_sample, words_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
SAMPLE_ROWS = 200
_PLACE_BITS = 31
_PLACE = (1 << _PLACE_BITS) - 1


def n_symbols(text: Column) -> Column:
    """Characters of SYMBOLS in the text."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{SYMBOLS}]+", "")).cast("long")


def lines_with_words(text: Column) -> Column:
    """The newline-separated lines that hold a word."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.filter(lines, lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def n_duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(lines_with_words(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeated_words(words: Column) -> Column:
    """Words in three-word windows that occur at least twice in the text, the first occurrence included.

    Windows are told apart by a 64-bit hash. Its upper bits and the window's position, packed into one long, are
    sorted, so equal ones become neighbours: n log n for a text of n words. Where upper bits agree and the rest
    does not, the whole array is looked through, which is rare.
    """

    def covered(windows: Column) -> Column:
        hashes = F.transform(windows, lambda x: F.xxhash64(x["0"], x["1"], x["2"]))

        def positions(hashed: Column) -> Column:
            place = lambda x: x.bitwiseAND(F.lit(_PLACE)).cast("int")
            packed = F.sort_array(F.transform(hashed, lambda h, i: h.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i.cast("long"))))

            def repeated(x: Column, others: list[Column]) -> Column:
                full = F.get(hashed, place(x))
                near = [F.coalesce(F.shiftright(x.bitwiseXOR(y), _PLACE_BITS) == 0, F.lit(False)) for y in others]
                same = [F.coalesce(F.get(hashed, place(y)) == full, F.lit(False)) for y in others]
                anywhere = F.size(F.filter(hashed, lambda y: y == full)) > 1
                return (near[0] | near[1]) & (same[0] | same[1] | anywhere)

            return let(
                packed,
                lambda s: F.sort_array(
                    F.transform(F.filter(s, lambda x, i: repeated(x, [F.get(s, i - 1), F.get(s, i + 1)])), place)
                ),
            )

        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        count = lambda p: F.aggregate(
            p,
            start,
            lambda a, x: F.struct((a["n"] + x + 3 - F.greatest(a["end"], x)).alias("n"), (x + 3).alias("end")),
            lambda a: a["n"],
        )
        return let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(positions(h), count)),
        )

    n = F.size(words)
    zipped = F.arrays_zip(
        F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0))).alias("0"),
        F.slice(words, F.lit(2), F.greatest(n - 2, F.lit(0))).alias("1"),
        F.slice(words, F.lit(3), F.greatest(n - 2, F.lit(0))).alias("2"),
    )
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(covered(zipped))


def base_columns(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), all long."""
    return let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            n_symbols(text).alias("n_symbols"),
            n_duplicate_lines(text).alias("n_dup_lines"),
            n_repeated_words(w).alias("n_repeat_words"),
        ),
    )


def n_of_class(text: Column, letters: str) -> Column:
    """Characters of a class of regular expressions."""
    return F.length(F.regexp_replace(text, f"[^{letters}]+", ""))


@dataclass(frozen=True)
class Rule:
    """rejects(text, words) is a boolean column; text is never null, words are its words."""

    name: str
    rejects: Callable[[Column, Column], Column]


#: The base rules, on whole texts.
BASE_RULES = (
    Rule("too_few_words", lambda text, words: F.size(words) < MIN_WORDS),
    Rule("repeated_words", lambda text, words: 100 * n_repeated_words(words) > 50 * F.size(words)),
)
#: Rules beyond the base, for running prose in any language; each is linear in the text.
STYLE_RULES = (
    Rule("symbols", lambda text, words: 10 * n_symbols(text) > F.size(words)),
    Rule("exclamations", lambda text, words: 4 * n_of_class(text, "!") > F.size(words)),
    Rule("capitals", lambda text, words: 10 * n_of_class(text, r"\p{Lu}") > 3 * F.length(F.array_join(words, ""))),
    Rule("few_letters", lambda text, words: 10 * n_of_class(text, r"\p{L}") < 6 * F.length(F.array_join(words, ""))),
    Rule("duplicate_lines", lambda text, words: let(lines_with_words(text), lambda x: 2 * (F.size(x) - F.size(F.array_distinct(x))) > F.size(x))),
    Rule("word_length", lambda text, words: let(F.length(F.array_join(words, "")), lambda n: (n < 2 * F.size(words)) | (n > 15 * F.size(words)))),
)


@dataclass(frozen=True)
class Measured:
    name: str
    seconds: float
    rejected: float

    @property
    def gain(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def measure(sample: DataFrame, rules: tuple[Rule, ...]) -> list[Measured]:
    """Each rule's seconds and rejection rate over sample, which must be bounded; it is held while rules run.

    A first pass fills the cache and counts rejections; the second is timed, less what a pass without a rule takes.
    """
    sample = sample.select("text").persist()
    try:
        flags = [F.avg(first_failed([r]).isNotNull().cast("double")).alias(r.name) for r in rules]
        rates = sample.agg(F.count(F.lit(1)).alias("_n"), *flags).first()
        if not rates["_n"]:
            return [Measured(r.name, 0.0, 0.0) for r in rules]

        def seconds(flag: Column) -> float:
            began = time.perf_counter()
            sample.agg(F.max(flag)).first()
            return time.perf_counter() - began

        idle = min(seconds(F.size(words_of(F.col("text")))) for _ in range(2))
        return [Measured(r.name, max(seconds(first_failed([r])) - idle, 1e-4), rates[r.name]) for r in rules]
    finally:
        sample.unpersist()


def ordered(rules: tuple[Rule, ...], figures: list[Measured]) -> list[Rule]:
    """The rules by rejections per second, the most first; ties by name."""
    gain = {m.name: m.gain for m in figures}
    return sorted(rules, key=lambda r: (-gain[r.name], r.name))


def first_failed(rules: list[Rule], text: str = "text") -> Column:
    """The name of the first rule that rejects, else null. CASE stops there: later rules aren't evaluated."""

    def chain(row: Column) -> Column:
        cases = F.when(F.lit(False), "")
        for rule in rules:
            cases = cases.when(F.coalesce(rule.rejects(row["text"], row["words"]), F.lit(False)), rule.name)
        return cases

    whole = F.coalesce(F.col(text), F.lit(""))
    return let(F.struct(whole.alias("text"), words_of(whole).alias("words")), chain)


def plan(docs: DataFrame, rules: tuple[Rule, ...], rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules in the order that a bounded sample of docs suggests."""
    return ordered(rules, measure(spread_sample(docs.select("doc_id", "text"), rows), rules))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + STYLE_RULES, rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with failed_rule (null if none) and kept."""
    return docs.withColumn("failed_rule", first_failed(plan(docs, rules, rows))).withColumn("kept", F.col("failed_rule").isNull())


def digest(docs: DataFrame, rules: tuple[Rule, ...] = STYLE_RULES, rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: the base counts, base_failed, and kept; style rules run only where the base passed."""
    order = plan(docs, rules, rows)
    counted = docs.select("doc_id", "text", F.inline(F.array(base_columns(F.col("text")))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        F.when(failed, False).otherwise(first_failed(order).isNull()).alias("kept"),
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
b AS (
  SELECT rid, doc_id, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines
  FROM t),
g AS (SELECT rid, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM t WHERE len(w) >= 3)),
c AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, k) AS c FROM g),
r AS (SELECT rid, count(DISTINCT p + o) AS n FROM c, (SELECT unnest([0, 1, 2]) AS o) WHERE c > 1 GROUP BY rid),
f AS (SELECT b.*, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, n_words < 50 OR 100 * coalesce(n, 0) > 50 * n_words AS base_failed FROM b LEFT JOIN r USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 4 * length(regexp_replace(t, '[^!]+', '', 'g')) > n_words
            OR 10 * length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) > 3 * word_chars OR 10 * length(regexp_replace(t, '[^\p{L}]+', '', 'g')) < 6 * word_chars
            OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM f
"""
