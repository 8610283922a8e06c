"""Language-model scoring by masked pseudo-likelihood.

Words are hashed into TOKENS buckets. A window network sees the WINDOW words on either side of a masked one and
predicts its class and, by a softmax over the class's members, the word itself; within a class the network starts from
the members' counts over the whole corpus and learns what the context changes. Both factors are normalized, so a
document's score is a sum of proper conditional log-probabilities, one for each word.

The network is trained in numpy on windows of every document, for ROUNDS rounds: each shard of about SHARD words trains
a copy on one word in ROUNDS of its own texts, and copies are averaged in a tree; a word's own weights are averaged by how
often each copy met the word, so a rare word's aren't thinned out by copies without it. The rounds' words are different ones,
so every word of every text is a target once. Within a class a step sets each target against the step's other targets of the
class, each counted by one over its chance to be there, which estimates the softmax over all members; scores use the whole
softmax. Counts and windows grow with the documents; the model's size is fixed. Texts are cut into words once, and scored whole.

Defined results: null, empty and blank texts have no words, log_prob 0 and score 0; repeated rows count as often as
they occur and get equal scores; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasieve.llm.common import written

TOKENS = 1 << 15
INPUTS = TOKENS
CLASSES = 160
FREQUENT = 40
WINDOW = 2
WIDTH = 10
HIDDEN = 24
ROUNDS = 2
#: Words a step: BATCH at first, an eighth of the words seen later, MOST_BATCH at most.
BATCH = 512
MOST_BATCH = 1 << 14
#: Words scored at a time.
CHUNK = 1 << 15
#: Rows of the class layer at a time, so its scores stay in the processor's cache.
ROWS = 2048
#: Steps in 1 of embeddings and of other factors, all within LIMIT: float32 sums of their products are exact in any
#: order, so equal texts get equal scores wherever they stand.
COARSE, FINE, LIMIT = 64, 256, 3.99
#: Scores within it are raised to e without a shift.
REACH = 60.0
#: Words of texts laid out together.
SPAN = 1 << 20
TOKENIZED = ["doc_id", "_tokens"]
RATE = 0.1
#: Rates of a word's own weights, divided by the root of 1 plus the sum of their squared gradients.
RATE_INPUT = 0.1
RATE_MEMBER = 0.2
FAN = 8
#: A copy is averaged in so many slices, so tasks never hold whole copies together.
SLICES = 16
#: Words of a shard; it sets what copies weigh against the corpus: about 2 bytes a word and round.
SHARD = 3_000_000


class Tokens:
    """Bucket numbers of a text's words, lower case. A hash takes less time than a look at a large cache of them."""

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        return np.fromiter(map(zlib.crc32, words), np.uint32, len(words)).astype(np.int64) % TOKENS


def tokenized(docs: DataFrame) -> DataFrame:
    """doc_id and _tokens: the bucket numbers of all words of the text, two bytes each."""
    if docs.columns == TOKENIZED:
        return docs

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            cells = [tokens(t.as_py()).astype(np.uint16).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary())], names=TOKENIZED)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, _tokens binary")


def laid_out(cells: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts with about SPAN words: the texts' numbers in cells, their lengths, and their words one after another."""
    held: list[bytes] = []
    first = size = 0
    for k, cell in enumerate(cells.to_pylist()):
        held.append(cell)
        size += len(cell) // 2
        if size >= SPAN or k == len(cells) - 1:
            yield np.arange(first, k + 1), np.array([len(h) // 2 for h in held]), np.frombuffer(b"".join(held), np.uint16).astype(np.int64)
            held, first, size = [], k + 1, 0


def counted(docs: DataFrame) -> np.ndarray:
    """Occurrences of each bucket in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TOKENS, np.int64)
        for batch in batches:
            for _, _, t in laid_out(batch.column(0)):
                total += np.bincount(t, minlength=TOKENS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["token", "n"])

    sums = tokenized(docs).select("_tokens").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()  # TOKENS rows at most
    out = np.zeros(TOKENS, np.int64)
    for r in sums:
        out[r["token"]] = r["n"]
    return out


def classes_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket's class and its log-probability within the class by counts plus one.

    The FREQUENT most frequent stand alone; the others are cut by frequency into classes alike in the sum of their
    shares of words and of buckets, so none has more than about 2 / CLASSES of either, and none is empty.
    """
    order = np.lexsort((np.arange(TOKENS), -counts))
    classes = np.empty(TOKENS, np.int64)
    classes[order[:FREQUENT]] = np.arange(FREQUENT)
    rest, n = order[FREQUENT:], CLASSES - FREQUENT
    mass = np.cumsum((counts[rest] + 1) / (counts[rest] + 1).sum() + 1 / len(rest))
    cut = np.minimum((mass - mass[0]) / mass[-1] * n, n - 1).astype(np.int64)
    cut = np.concatenate([[0], np.cumsum(np.minimum(np.diff(cut), 1))])  # no class is skipped
    classes[rest] = FREQUENT + np.maximum(cut, np.arange(len(rest)) - len(rest) + n)
    total = np.bincount(classes, weights=counts + 1.0, minlength=CLASSES)
    return classes, np.log((counts + 1.0) / total[classes])


class Members:
    """The buckets in order of class: class c has places start[c]:start[c + 1]."""

    def __init__(self, classes: np.ndarray, within: np.ndarray):
        order = np.argsort(classes, kind="stable")
        self.classes, self.start = classes, np.searchsorted(classes[order], np.arange(CLASSES + 1)).tolist()
        self.prior = within[order].astype(np.float32)
        self.place = np.empty(TOKENS, np.int64)
        self.place[order] = np.arange(TOKENS)
        size = np.diff(self.start)
        self.several = np.repeat(size > 1, size)

    def groups(self, tokens: np.ndarray) -> Iterator[tuple[np.ndarray, int, int, np.ndarray]]:
        """For each class with several members: rows of tokens in it, its first and last place, and the rows' members."""
        c = self.classes[tokens]
        by = np.argsort(c.astype(np.uint16), kind="stable")
        cuts = np.searchsorted(c[by], np.arange(CLASSES + 1)).tolist()
        place = self.place[tokens]
        for k in range(CLASSES):
            a, b, first, last = cuts[k], cuts[k + 1], self.start[k], self.start[k + 1]
            if a < b and last - first > 1:
                rows = by[a:b]
                yield rows, first, last, place[rows] - first

    def placed(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the tokens whose class has several members, in order of their places; those places; where each class among them begins, and their number."""
        place = self.place[tokens]
        rows = np.flatnonzero(self.several[place])
        rows = rows[np.argsort(place[rows].astype(np.uint16), kind="stable")]
        place = place[rows]
        return rows, place, np.unique(np.searchsorted(place, self.start))


class Network:
    """Concatenated embeddings of the context, a tanh layer, a softmax over classes and one over each class's members."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        f = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.e = (r.standard_normal((INPUTS + 1, WIDTH)) * 0.3).astype(np.float32)  # the last is the place outside a text
        self.w1, self.b1 = f(2 * WINDOW * WIDTH, HIDDEN), np.zeros(HIDDEN, np.float32)
        self.w2, self.b2 = f(HIDDEN, CLASSES), np.zeros(CLASSES, np.float32)
        self.v = np.zeros((TOKENS, HIDDEN), np.float32)  # in Members' order
        self.e_sum, self.v_sum = np.ones((INPUTS + 1, 1), np.float32), np.ones((TOKENS, 1), np.float32)
        self.e_met, self.v_met = np.zeros(INPUTS + 1, np.int64), np.zeros(TOKENS, np.int64)

    def parts(self) -> list[np.ndarray]:
        return [self.e, self.w1, self.b1, self.w2, self.b2, self.v]

    def take(self, flat: np.ndarray) -> None:
        at = 0
        for p in self.parts():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def rounded(self) -> Network:
        """Factors on the grid of exact sums."""
        for p, steps in ((self.e, COARSE), (self.w1, FINE), (self.w2, FINE), (self.v, FINE)):
            p[...] = np.rint(p.clip(-LIMIT, LIMIT) * steps) / steps
        return self

    def hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.e.take(context.ravel(), axis=0).reshape(len(context), -1)
        h = x @ self.w1
        h += self.b1
        np.tanh(h, out=h)
        h *= FINE
        np.rint(h, out=h)
        h /= FINE
        return x, h

    def forward(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, h = self.hidden(context)
        z = h @ self.w2 + self.b2
        z -= z.max(axis=1, keepdims=True)
        return x, h, z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def classes_safe(self) -> bool:
        """Whether no class's score can leave float32's exponents; hidden values lie within 1."""
        return float((np.abs(self.w2).sum(axis=0) + np.abs(self.b2)).max()) < REACH

    def words(self, context: np.ndarray, tokens: np.ndarray, members: Members) -> np.ndarray:
        """Log-probability of each token given its context."""
        out, every = np.empty(len(tokens)), np.empty((len(tokens), HIDDEN), np.float32)
        safe = self.classes_safe()
        for a in range(0, len(tokens), ROWS):
            h = every[a : a + ROWS] = self.hidden(context[a : a + ROWS])[1]
            z = h @ self.w2
            z += self.b2
            if not safe:
                z -= z.max(axis=1, keepdims=True)
            own = z[np.arange(len(z)), members.classes[tokens[a : a + ROWS]]]
            out[a : a + ROWS] = own - np.log(np.exp(z, out=z).sum(axis=1))
        return out + self.chosen(every, tokens, members)

    def chosen(self, h: np.ndarray, tokens: np.ndarray, members: Members) -> np.ndarray:
        """Log-probability of each token given its class and context."""
        out = np.zeros(len(tokens), np.float32)
        safe = float(np.abs(self.v).sum(axis=1).max()) < REACH - 20
        for rows, first, last, own in members.groups(tokens):
            z = h[rows] @ self.v[first:last].T
            z += members.prior[first:last]
            if not safe:
                z -= z.max(axis=1, keepdims=True)
            mine = z[np.arange(len(rows)), own]
            out[rows] = mine - np.log(np.exp(z, out=z).sum(axis=1))
        return out

    def step(self, context: np.ndarray, tokens: np.ndarray, members: Members, rate: float) -> None:
        x, h = self.hidden(context)
        one = np.ones((len(h), 1), np.float32)
        h1, gh = np.concatenate([h, one], axis=1), np.empty_like(h)
        # a last row of biases, or a last column of ones, makes one product of two
        w = np.concatenate([self.w2, self.b2[None]])
        back, gw = np.concatenate([self.w2.T, np.ones((CLASSES, 1), np.float32)], axis=1), np.zeros_like(w)
        own = members.classes[tokens]
        safe = self.classes_safe()
        for a in range(0, len(h), ROWS):
            part = h1[a : a + ROWS]
            g = part @ w
            if not safe:
                g -= g.max(axis=1, keepdims=True)
            np.exp(g, out=g)
            r = g @ back
            total = r[:, HIDDEN:] + 1e-30
            g[np.arange(len(g)), own[a : a + ROWS]] -= total[:, 0]
            np.divide(r[:, :HIDDEN], total, out=gh[a : a + ROWS])
            gw += (part / total).T @ g
        gh -= self.w2.T[own]
        rows, place, cuts = members.placed(tokens)
        if len(rows):
            start = np.flatnonzero(np.diff(place, prepend=-1))  # rows of one member follow one another
            here, times = place[start], np.diff(start, append=len(place))
            ends = np.searchsorted(start, cuts)
            v, n = self.v[here], np.repeat(np.diff(cuts), np.diff(ends)).astype(np.float32)
            prior = members.prior[here]
            prior = prior - np.log(-np.expm1(-n * np.exp(prior)))
            wide = np.abs(v).sum(axis=1).max() > REACH - 20  # a prior over its chance to be there is at most e**20
            v1, back = np.concatenate([v, prior[:, None]], axis=1), np.concatenate([v, np.ones((len(v), 1), np.float32)], axis=1)
            hr, r, gv = h1[rows], np.empty((len(rows), HIDDEN + 1), np.float32), np.empty_like(v)
            for a, b, c, d in zip(cuts.tolist(), cuts[1:].tolist(), ends.tolist(), ends[1:].tolist(), strict=False):
                p = hr[a:b] @ v1[c:d].T
                if wide:
                    p -= p.max(axis=1, keepdims=True)
                np.exp(p, out=p)
                np.matmul(p, back[c:d], out=r[a:b])
                np.matmul(p.T, hr[a:b, :HIDDEN] / r[a:b, HIDDEN:], out=gv[c:d])
            gh[rows] += r[:, :HIDDEN] / r[:, HIDDEN:] - np.repeat(v, times, axis=0)
            gv -= np.add.reduceat(hr[:, :HIDDEN], start, axis=0)
            total = self.v_sum[here] + np.einsum("ij,ij->i", gv, gv)[:, None] / HIDDEN
            self.v_sum[here] = total
            self.v[here] = v - gv * (RATE_MEMBER / np.sqrt(total))
        gh *= 1 - h * h
        gx = (gh @ self.w1.T).reshape(-1, WIDTH)
        rate = rate / len(h) * 8
        self.w2 -= rate * gw[:HIDDEN]
        self.b2 -= rate * gw[HIDDEN]
        self.w1 -= rate * (x.T @ gh)
        self.b1 -= rate * gh.sum(axis=0)
        times = np.bincount(context.ravel(), minlength=INPUTS + 1)
        here = np.flatnonzero(times)  # the weights of other words stay
        number = np.zeros(INPUTS + 1, np.int64)
        number[here] = np.arange(len(here))
        flat = number[context.ravel()]
        ge = np.stack([np.bincount(flat, weights=w, minlength=len(here)) for w in np.ascontiguousarray(gx.T)], axis=1).astype(np.float32)
        total = self.e_sum[here] + np.einsum("ij,ij->i", ge, ge)[:, None] / WIDTH
        self.e_sum[here] = total
        self.e[here] -= ge * (RATE_INPUT / np.sqrt(total))
        self.e_met += times
        self.v_met += np.bincount(members.place[tokens], minlength=TOKENS)

    def met(self, seen: int) -> np.ndarray:
        """How often each row of e, the dense layers and each row of v were met."""
        return np.concatenate([self.e_met, [seen], self.v_met]).astype(np.float64)


def spread_out(met: np.ndarray) -> np.ndarray:
    """met() for each number of flat(): a word's own weights with the word, the others with every word."""
    dense = 2 * WINDOW * WIDTH * HIDDEN + HIDDEN + HIDDEN * CLASSES + CLASSES
    return np.repeat(met, np.concatenate([np.full(INPUTS + 1, WIDTH), [dense], np.full(TOKENS, HIDDEN)]))


def contexts(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Input numbers of the WINDOW words on either side of each place."""
    padded = np.concatenate([np.full(WINDOW, INPUTS), tokens % INPUTS, np.full(WINDOW, INPUTS)])
    return np.stack([padded[at + k] for k in range(2 * WINDOW + 1) if k != WINDOW], axis=1)


def windows(lengths: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid out one after another: inputs with WINDOW outside places around each text, and each word's place there and in its text."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(tokens)) + WINDOW * (text + 1)
    inputs = np.full(len(tokens) + WINDOW * (len(lengths) + 1), INPUTS)
    inputs[place] = tokens % INPUTS
    return inputs, place, np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def seen_from(inputs: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The context of each place: contexts() for texts laid out by windows()."""
    return inputs[place[:, None] + np.array([k for k in range(-WINDOW, WINDOW + 1) if k])]


def trained(docs: DataFrame, classes: np.ndarray, within: np.ndarray | None = None) -> np.ndarray:
    """The averaged network's weights after ROUNDS rounds; round r takes the words at places r, r + ROUNDS, ... of every text.

    within is that of classes_of(); it is counted where it isn't given.
    """
    spark, docs = docs.sparkSession, tokenized(docs)
    if within is None:
        within = classes_of(counted(docs))[1]
    words = docs.agg(F.coalesce(F.sum(F.length("_tokens")), F.lit(0))).first()[0] // 2
    shards = 1 + words // SHARD
    held = spark.sparkContext.broadcast((classes, within))  # TOKENS numbers each
    flat = Network().flat()
    for turn in range(ROUNDS):
        start = spark.sparkContext.broadcast(flat)

        def train(batches: Iterator[pa.RecordBatch], start=start, turn=turn) -> Iterator[pa.RecordBatch]:
            net, members = Network(), Members(*held.value)
            net.take(start.value)
            seen, c, y = 0, np.zeros((0, 2 * WINDOW), np.int64), np.zeros(0, np.int64)
            for batch in batches:
                for _, lengths, tokens in laid_out(batch.column(0)):
                    inputs, place, within_text = windows(lengths, tokens)
                    at = np.flatnonzero(within_text % ROUNDS == turn)
                    c, y, a = np.concatenate([c, seen_from(inputs, place[at])]), np.concatenate([y, tokens[at]]), 0
                    while len(y) - a >= (size := min(max(seen // 8, BATCH), MOST_BATCH)):
                        net.step(c[a : a + size], y[a : a + size], members, RATE)
                        seen, a = seen + size, a + size
                    c, y = c[a:], y[a:]
            if len(y):
                net.step(c, y, members, RATE * min(len(y) / BATCH, 1))
                seen += len(y)
            met = net.met(seen)
            parts = np.array_split(net.flat() * spread_out(met).astype(np.float32), SLICES)
            for k, part in enumerate([met, *parts] if seen else []):  # slice 0 holds the counts
                yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int64()), "seen": pa.array([0 if k else seen], pa.int64()), "part": pa.array([part.tobytes()], pa.binary())})

        def added(rows: pa.Table) -> pa.Table:
            kind = np.float32 if rows.column("slice")[0].as_py() else np.float64
            total = sum(np.frombuffer(x, kind).astype(np.float64) for x in rows.column("part").to_pylist()).astype(kind)
            return pa.table({"slice": rows.column("slice")[:1], "seen": pa.array([sum(rows.column("seen").to_pylist())], pa.int64()), "part": pa.array([total.tobytes()], pa.binary())})

        copy = "slice long, seen long, part binary"
        copies = written(docs.select("_tokens").coalesce(shards).mapInArrow(train, copy).withColumn("copy", F.spark_partition_id()), "copies")
        n = copies.where("slice = 0").count()
        while n > 1:  # about FAN copies of a slice meet in a task
            n = -(-n // FAN)
            groups = copies.select("slice", "seen", "part", F.pmod(F.xxhash64("copy"), F.lit(n)).alias("copy"))
            sums = groups.groupBy("copy", "slice").applyInArrow(lambda key, rows: added(rows).append_column("copy", pa.array([key[0].as_py()], pa.int64())), f"{copy}, copy long")
            copies = written(sums, "sums")
            n = copies.where("slice = 0").count()
        rows = copies.select("slice", "part").orderBy("slice").collect()  # SLICES + 1 rows at most
        if rows:
            met = spread_out(np.frombuffer(rows[0]["part"], np.float64)).astype(np.float32)
            weights = np.concatenate([np.frombuffer(r["part"], np.float32) for r in rows[1:]])
            flat = np.where(met > 0, weights / np.maximum(met, 1), flat).astype(np.float32)
    net = Network()
    net.take(flat)
    return net.rounded().flat()


def score(docs: DataFrame, flat: np.ndarray, classes: np.ndarray, within: np.ndarray) -> DataFrame:
    """doc_id, n_words, log_prob (summed), score (log_prob for each word)."""
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps((flat, classes, within)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, classes, within = pickle.loads(held.value)
        net, members = Network(), Members(classes, within)
        net.take(flat)
        for batch in batches:
            counts, sums = [], []
            for _, lengths, tokens in laid_out(batch.column(1)):
                inputs, place, _ = windows(lengths, tokens)
                words = np.zeros(len(tokens))
                for a in range(0, len(tokens), CHUNK):
                    t = tokens[a : a + CHUNK]
                    words[a : a + CHUNK] = net.words(seen_from(inputs, place[a : a + CHUNK]), t, members)
                counts += lengths.tolist()
                sums += np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights=words, minlength=len(lengths)).tolist()
            means = [s / max(n, 1) for s, n in zip(sums, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.float64()), pa.array(means, pa.float64())], names=["doc_id", "n_words", "log_prob", "score"])

    return tokenized(docs).mapInArrow(read, "doc_id long, n_words long, log_prob double, score double")


def digest(docs: DataFrame) -> DataFrame:
    docs = written(tokenized(docs), "tokens")
    counts = counted(docs)
    classes, within = classes_of(counts)
    return score(docs, trained(docs, classes, within), classes, within)
