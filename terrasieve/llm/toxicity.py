"""Toxicity by the nearest labelled examples.

Terms are beginnings of lower-case words, so inflected and compound forms meet; those that go with the label (a
chi-squared test on the sample) make up the vocabulary, without a limit to their number. Over all terms the nearest texts are those on the
same subject, toxic or not, and the score is far worse (README). A document's nearest examples by exact TF-IDF cosine come from a block-max inverted index: blocks
of examples are visited by falling upper bound until none can still hold a nearer one. The examples vote with their
cosine as weight; an isotonic curve, fitted on the examples' own votes with each left out, calibrates the vote. The
nearest examples and the matching terms are the evidence.

At most SAMPLE_ROWS labelled documents are used for fitting; all texts are scored, whole.

Defined results: texts without a term of the vocabulary (null and empty ones too) get the share of label 1 among such
examples, and an example without one is no neighbour of any text, as its cosine is 0; ties in cosine go to the smaller doc_id; of
labelled rows that repeat a doc_id the least text counts; very long texts are scored whole; without labels of both classes all scores are the share of label 1
(0 without any); repeated rows get equal scores; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from terrasieve.llm.common import Known, fold_of, labelled_sample, sole, tidied

SAMPLE_ROWS = 8000
MIN_DOCUMENTS = 4
CHI_SQUARED = 20.0
#: Lengths of the beginnings of words that are terms.
STEM = range(3, 9)
NEAREST = 15
BLOCK = 64
#: So many blocks are visited before the first look at the bounds, then twice as many each time.
VISITED = 4
CACHE_WORDS = 400_000
#: Words whose stems are kept; each has several.
CACHE_STEMS = 100_000
#: Texts with the same terms as often have the same neighbours; so many are kept by a Python worker.
CACHE_TEXTS = 50_000
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def bare_of(word: bytes) -> str:
    """The word in lower case, without punctuation at either end."""
    bare = word.decode().lower().strip(string.punctuation)
    return bare if bare.isalnum() else _EDGES.sub("", bare)


def stems_of(word: bytes) -> list[str]:
    """The word in lower case, without punctuation at either end, cut to each of the STEM lengths it has; a shorter word whole."""
    bare = bare_of(word)
    return list(dict.fromkeys(bare[:k] for k in STEM)) if bare else []


@sole
def worker_stems() -> Known:
    """One cache for all tasks of a Python worker."""
    return Known(stems_of, CACHE_STEMS)


def stem_counts(sample: DataFrame) -> DataFrame:
    """term, a (documents of label 1 that have it), df, summed for each partition of the sample."""

    @tidied
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_stems()
        a, df = Counter(), Counter()
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                stems = {s for w in set((text.as_py() or "").encode().split()) for s in known.fresh()[w]}
                df.update(stems)
                if y:
                    a.update(stems)
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array([a[t] for t in df], pa.int64()), pa.array(list(df.values()), pa.int64())], names=["term", "a", "df"])

    return sample.select("y", "text").mapInArrow(read, "term string, a long, df long")


def telling_terms(counts: DataFrame, n: int, positive: int) -> list[tuple[str, int]]:
    """(term, documents) of terms that occur more in label 1 than chance explains, the most telling first.

    Of stems that begin with one another only the most telling stays, so a word has one term at most.
    """
    counted = counts.groupBy("term").agg(F.sum("a").cast("double").alias("a"), F.sum("df").cast("double").alias("df")).where(F.col("df") >= MIN_DOCUMENTS)
    expected = F.col("df") * positive / n
    spread = expected * (1 - positive / n) * (1 - F.col("df") / n) * n / max(n - 1, 1)
    chi = counted.where(F.col("a") > expected).withColumn("chi", (F.col("a") - expected) ** 2 / F.greatest(spread, F.lit(1e-9)))
    found = chi.where(F.col("chi") >= CHI_SQUARED).orderBy(F.desc("chi"), F.desc(F.length("term")), "term").collect()  # stems of SAMPLE_ROWS documents at most
    chosen, prefixes = {}, set()
    for r in found:
        term = r["term"]
        if term not in prefixes and not any(term[:k] in chosen for k in range(1, len(term))):
            chosen[term] = int(r["df"])
            prefixes |= {term[:k] for k in range(1, len(term) + 1)}
    return list(chosen.items())


class Counts:
    """The vocabulary's terms in a text, with their numbers of occurrences."""

    def __init__(self, terms: list[str]):
        self.number, self.known = {t: k for k, t in enumerate(terms)}, Known(self.term, CACHE_WORDS)
        self.starts = {t[: STEM[0]] for t in terms}

    def term(self, word: bytes) -> int:
        bare = bare_of(word)
        if bare[: STEM[0]] not in self.starts:  # most words end here
            return -1
        return next((self.number[s] for s in (bare[:k] for k in STEM) if s in self.number), -1)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").encode().split()
        found = np.array(list(map(self.known.fresh().__getitem__, words)), np.int64)
        return np.unique(found[found >= 0], return_counts=True)


@sole
def worker_counts(terms: tuple[str, ...]) -> Counts:
    """One cache for all tasks of a Python worker."""
    return Counts(list(terms))


def example_terms(sample: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, y, terms and tf of the sample's documents that have a term of the vocabulary."""

    @tidied
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = worker_counts(tuple(terms))
        for batch in batches:
            rows = [(i, y, *(x.tolist() for x in counts(t.as_py()))) for i, y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)]
            rows = [r for r in rows if r[2]]
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "y", "terms", "tf"])

    return sample.select("doc_id", "y", "text").mapInArrow(read, "doc_id long, y int, terms array<long>, tf array<long>")


def weights_of(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(tf)) * idf
    return w / np.linalg.norm(w)


class Index:
    """Examples as unit vectors in blocks of BLOCK; for each term its postings, cut by block, and its largest weight in each block."""

    def __init__(self, terms: list[tuple[str, int]], n: int, examples: list[tuple[int, int, list[tuple[int, int]]]]):
        self.terms = [t for t, _ in terms]
        self.idf = np.log((n + 1) / (np.array([d for _, d in terms], float) + 1)) + 1
        vectors = []
        for doc_id, y, counts in examples:
            counts = sorted(counts)
            at = np.array([t for t, _ in counts])
            vectors.append((doc_id, y, at, weights_of(np.array([f for _, f in counts], float), self.idf[at])))
        vectors.sort(key=lambda v: (int(v[2][np.argmax(v[3])]), v[0]))  # alike examples share blocks, so bounds are tight
        self.ids = np.array([v[0] for v in vectors], np.int64)
        self.y = np.array([v[1] for v in vectors], float)
        self.blocks = -(-len(vectors) // BLOCK)
        term = np.concatenate([v[2] for v in vectors] or [np.array([], np.int64)]).astype(np.int64)
        row = np.repeat(np.arange(len(vectors)), [len(v[2]) for v in vectors])
        weight = np.concatenate([v[3] for v in vectors] or [np.array([])])
        order = np.lexsort((row, term))
        self.row, self.weight, term = row[order], weight[order], term[order]
        self.bounds = np.zeros((len(terms), max(self.blocks, 1)))
        np.maximum.at(self.bounds, (term, self.row // BLOCK), self.weight)
        cells = term * (self.blocks + 1) + self.row // BLOCK
        self.cuts = np.searchsorted(cells, np.arange(len(terms))[:, None] * (self.blocks + 1) + np.arange(self.blocks + 1)[None, :])
        self.values, self.levels = np.array([0.0]), np.array([0.0])
        self.empty = 0.0

    def scores(self, terms: np.ndarray, q: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the blocks with a common term, and their cosines; the postings of all blocks are added in one step."""
        a = self.cuts[terms][:, blocks]
        length = (self.cuts[terms][:, blocks + 1] - a).ravel()
        ends = np.cumsum(length)
        postings = np.repeat(a.ravel() - ends + length, length) + np.arange(ends[-1])
        w = np.repeat(np.repeat(q, len(blocks)), length) * self.weight[postings]
        place = np.repeat(np.tile(np.arange(len(blocks)) * BLOCK, len(terms)), length) + self.row[postings] % BLOCK
        score = np.bincount(place, w, len(blocks) * BLOCK)
        found = np.flatnonzero(score)
        return blocks[found // BLOCK] * BLOCK + found % BLOCK, score[found]

    def nearest(self, terms: np.ndarray, q: np.ndarray, k: int = NEAREST, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest examples with a common term, nearest first, ties to the smaller id; without: a row left out."""
        upper = q @ self.bounds[terms] + 1e-12
        order = np.argsort(-upper, kind="stable")
        order = order[upper[order] > 1e-12]
        rows, cosines, worst, at, step = np.array([], np.int64), np.array([]), 0.0, 0, VISITED
        while at < len(order) and upper[order[at]] >= worst:
            blocks, at, step = np.sort(order[at : at + step]), at + step, 2 * step
            near, score = self.scores(terms, q, blocks)
            rows, cosines = np.concatenate([rows, near[near != without]]), np.concatenate([cosines, score[near != without]])
            level = np.round(cosines, 12)
            if len(rows) > k:
                kept = np.flatnonzero(level >= np.partition(level, -k)[-k])
                rows, cosines, level = rows[kept], cosines[kept], level[kept]
            best = np.lexsort((self.ids[rows], -level))[:k]
            rows, cosines = rows[best], cosines[best]
            worst = cosines[-1] - 1e-9 if len(rows) == k else 0.0
        return rows, cosines

    def vote(self, rows: np.ndarray, cosines: np.ndarray) -> float:
        return float((self.y[rows] * cosines).sum() / cosines.sum()) if len(rows) else 0.0

    def calibrated(self, vote: float) -> float:
        return float(self.levels[max(np.searchsorted(self.values, vote + 1e-12) - 1, 0)])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps: from each value on, its level (pooled adjacent violators, equal values pooled first)."""
    pools: list[list[float]] = []
    for v in np.unique(x):
        own = y[x == v]
        pools.append([v, own.sum(), len(own)])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, s, n = pools.pop()
            pools[-1][1] += s
            pools[-1][2] += n
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


def train(docs: DataFrame, labels: DataFrame, label: str, trained_on, rows: int = SAMPLE_ROWS) -> Index:
    sample = labelled_sample(docs, labels, label, trained_on, rows)
    n, positive = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < positive < n:
        index = Index([], max(n, 1), [])
        index.empty = positive / n if n else 0.0
        return index
    chosen = telling_terms(stem_counts(sample), n, positive)
    found = example_terms(sample, [t for t, _ in chosen]).orderBy("doc_id").collect()  # SAMPLE_ROWS documents at most
    index = Index(chosen, n, [(r["doc_id"], r["y"], list(zip(r["terms"], r["tf"], strict=True))) for r in found])
    index.empty = float((positive - index.y.sum() + 0.0) / max(n - len(index.y), 1))
    if len(index.y):
        votes = []
        for row in range(len(index.y)):
            at = np.flatnonzero(index.row == row)
            terms_of = np.searchsorted(index.cuts[:, 0], at, side="right") - 1
            votes.append(index.vote(*index.nearest(terms_of, index.weight[at], without=row)))
        index.values, index.levels = isotonic(np.round(np.array(votes), 6), index.y)
    return index


class Judge:
    """score, nearest examples' ids and vocabulary terms of a text."""

    def __init__(self, index: Index):
        self.index, self.counts = index, worker_counts(tuple(index.terms))
        self.known = Known(self.judged, CACHE_TEXTS)

    def judged(self, found: tuple[bytes, bytes]) -> tuple[float, list[int], list[str]]:
        index, (at, tf) = self.index, (np.frombuffer(x, np.int64) for x in found)
        rows, cosines = index.nearest(at, weights_of(tf.astype(float), index.idf[at]))
        score = index.calibrated(index.vote(rows, cosines)) if len(rows) else index.empty
        return score, index.ids[rows[:3]].tolist(), [index.terms[t] for t in at]

    def __call__(self, text: str | None) -> tuple[float, list[int], list[str]]:
        at, tf = self.counts(text)
        return self.known.fresh()[at.tobytes(), tf.tobytes()] if len(at) else (self.index.empty, [], [])


def score(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, score, neighbours (the nearest examples' ids), terms (the vocabulary's terms found)."""
    held = docs.sparkSession.sparkContext.broadcast(index)  # bounded by SAMPLE_ROWS

    @tidied
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(held.value)
        for batch in batches:
            found = [judge(t.as_py()) for t in batch.column(1)]
            columns = list(zip(*found, strict=True)) or [()] * 3
            kinds = (pa.float64(), pa.list_(pa.int64()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "score", "neighbours", "terms"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(read, "doc_id long, score double, neighbours array<long>, terms array<string>")


def scored(docs: DataFrame, index: Index, name: str = "score") -> DataFrame:
    """docs with its score in a last column called name; each row keeps its own, so repeated ids don't matter."""
    held = docs.sparkSession.sparkContext.broadcast(index)
    text = docs.columns.index("text")

    @tidied
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(held.value)
        for batch in batches:
            scores = pa.array([judge(t.as_py())[0] for t in batch.column(text)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, name])

    return docs.mapInArrow(read, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def digest(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, neighbours, terms; labels of the fold held_out are not looked at."""
    index = train(docs, labels, "toxic", fold_of(F.col("doc_id"), folds) != held_out)
    return score(docs, index).select(
        "doc_id", (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "neighbours", "terms"
    )
