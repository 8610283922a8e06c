"""Best-fit packing planned on a histogram of lengths.

Documents are tokenized once; only their lengths are counted. Best fit runs on the counts (at most max_tokens
distinct lengths), so its cost doesn't grow with the corpus. The plan gives, for ranges of ranks within a length, the
sequences and offsets; pieces take their places by joining on rank within length.

Defined results: a null or empty text is its end mark alone; a document longer than max_tokens is cut into pieces of
max_tokens, the last one shorter; equal rows are pieces of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrasieve.llm.common import Known, sole, tidied, written

MAX_TOKENS = 2048
CACHE_WORDS = 1_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Pre-tokenization of the word-end vocabulary as its file states it (fixed value), and the same on the characters of _PLAIN.
_STATED = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^ \\t\\n\\r\\x0b\\x0ca-zà-öø-ÿß0-9]+")
#: Any character outside of ASCII (controls other than white space too) and the Latin-1 letters, or the start of a special token.
_OTHER = re.compile("[^\\t-\\r -~À-ÖØ-öø-ÿ]|<\\|")


class WordIds:
    """Ids of whole texts.

    Where the tokenizer's own file says that it lower-cases, cuts by _STATED and marks word ends, each distinct piece
    of a text of plain characters is encoded once, and the ids of the others are looked up; every other text goes
    to the tokenizer as a whole. The cache is emptied when full.
    """

    def __init__(self, path: str, most: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        steps = [n["type"] for n in (said["normalizer"] or {}).get("normalizers", [])]
        cuts = [c.get("pattern", {}).get("Regex") for c in (said["pre_tokenizer"] or {}).get("pretokenizers", [])]
        end = said["model"].get("end_of_word_suffix")
        self.known = steps == ["NFC", "Replace", "Lowercase"] and cuts == [_STATED, None] and bool(end)
        if self.known:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(end)]] = True
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.number = Known(self.numbered, self.most)
        self.new: list[str] = []
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)
        self.used = 0

    def numbered(self, piece: str) -> int:
        self.new.append(piece)
        return len(self.number)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def add(self, pieces: list[str]) -> None:
        ids = self.whole(" ".join(pieces))
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(pieces):  # a piece without a marked end: one by one then
            each = [self.whole(p) for p in pieces]
            ids, last = np.concatenate(each), np.cumsum([len(x) for x in each]) - 1
        more = len(pieces)
        n = len(self.number) - more
        while n + more > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.starts))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        first = np.concatenate([[0], last[:-1] + 1])
        self.starts[n : n + more], self.lengths[n : n + more] = self.used + first, last + 1 - first
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def __call__(self, text: str | None) -> np.ndarray:
        """The ids, then 0."""
        if not text:
            return np.zeros(1, "<u4")
        if not self.known or _OTHER.search(text):
            return np.concatenate([self.whole(text), [0]]).astype("<u4")
        pieces = _PIECES.findall(text.lower())
        if len(self.number) > self.most:
            self.clear()
        at = list(map(self.number.__getitem__, pieces))
        if self.new:
            self.add(self.new)
            self.new = []
        index = np.array(at, np.int64)
        lengths, starts = self.lengths[index], self.starts[index]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        out = np.zeros(total + 1, "<u4")
        out[:-1] = self.ids[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]
        return out


@sole
def word_ids(path: str) -> WordIds:
    """One cache for all tasks of a Python worker."""
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""

    @tidied
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = ids_of(text.as_py())
                for k, start in enumerate(range(0, len(ids), max_tokens)):
                    part = ids[start : start + max_tokens]
                    rows.append((doc_id, k, start, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=list(names))

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def plan(counts: dict[int, int], capacity: int = MAX_TOKENS) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over counts: rows (length, first rank, rank after the last, per sequence, first sequence, offset).

    A group is a number of sequences with equal contents. Each length fills the fullest groups that still take it; a
    group is split at most once for a length, so there are at most three new groups for each length, whatever the
    counts.
    """
    groups: dict[int, list[list]] = defaultdict(list)  # by room left: [number, contents]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = next((r for r in range(length, capacity) if groups.get(r)), capacity)
            per = min(room // length, left)
            if room == capacity:
                group = [left // per, []]
            else:
                group = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                if group[0] * per > left:  # the rest of the group stays as it is
                    fits = left // per
                    groups[room].append([group[0] - fits, group[1]])
                    group = [fits, group[1]]
            groups[room - per * length].append([group[0], [*group[1], (length, per)]])
            left -= group[0] * per
    rows, taken, sequence = [], defaultdict(int), 0
    for room in sorted(groups):
        for number, contents in groups[room]:
            offset = 0
            for length, per in contents:
                first = taken[length]
                taken[length] = first + number * per
                rows.append((length, first, taken[length], per, sequence, offset))
                offset += length * per
            sequence += number
    return rows


def pack(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, max_tokens).withColumn("_part", F.spark_partition_id()), "pieces")
    blocks = written(cut.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_count")), "lengths")
    counts = {r["length"]: r["n"] for r in blocks.groupBy("length").agg(F.sum("_count").alias("n")).collect()}  # max_tokens rows at most
    planned = spark.createDataFrame(plan(counts, max_tokens), "_length long, _first long, _after long, _per long, sequence_id long, offset long")
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_base", F.coalesce(F.sum("_count").over(earlier), F.lit(0))).drop("_count")
    within = Window.partitionBy("length", "_part").orderBy("doc_id", "piece")
    ranked = cut.withColumn("_rank", F.row_number().over(within) - 1).join(blocks, ["length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_base"))
    # the plan's size is bounded by max_tokens alone
    met = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_after"))
    at = F.col("_rank") - F.col("_first")
    return ranked.join(F.broadcast(planned), met).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence_id") + F.floor(at / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.col("offset") + (at % F.col("_per")) * F.col("length")).cast("long").alias("offset"),
    )
