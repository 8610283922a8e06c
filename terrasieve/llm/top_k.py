"""Exact top-k by inner product: dual-tree search with cover trees.

Components are scaled and floored to integers, so scores are exact. Rows are dealt to the nearest of some pivots (from
a bounded sample); cells of more than a block's rows are cut again and again, across the line between two of their members that
lie far apart, so blocks are compact however many rows there are. Each block of candidates and each block of queries gets
a cover tree, and the cells above the candidates' blocks make up the upper levels of one tree: a query block meets the pivots'
cells, then the cells below those that can still matter, down to blocks. A pair of nodes is pruned when the largest
inner product that their centers and covering radii allow is below the worst k-th score of the node's queries. A first
descent follows only the most promising cells and gives those scores a start; the second is complete. Ties are never pruned.

Defined results: vectors that are null or hold null or non-finite components, and rows without id, take no part; an
empty vector counts as zeros, a shorter one as if filled with zeros; equal vectors are all candidates (of a group of equal ones only the
k + 1 smallest ids can matter, and only those go on); rows that repeat a vec_id are candidates each, and as queries share one
list, from which their own id is left out; with fewer candidates than k all are returned; empty tables give an empty result; extra columns are not
read. Scores must fit 53 bits.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrasieve.llm.common import written

K = 20
EVERY = 20
SCALE = 64
BLOCK = 2048
QUERY_BLOCK = 512
MOST_PIVOTS = 256
LEAF = 256
#: Leaves of query trees; a query block holds few queries unless the table is very large.
QUERY_LEAF = 64
#: A node whose next covers would hold fewer points than this on average is a leaf.
FEW = 32
#: Parts that a cell is cut into at a time, and cuts after which a hash cuts it (nearly equal points).
PARTS, MOST_CUTS = 16, 10
#: A cover's radius shrinks by this factor from level to level.
SHRINK = 0.7
FIRST = 2


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of long) of the rows that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite)
    return vectors.where(good).select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(SCALE * x.cast("double")).cast("long")).alias("v"))


class CoverTree:
    """Points in tree order; node i covers points[start[i]:end[i]] within radius[i] of center[i]; its children are first[i]:last[i]."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order: list[np.ndarray] = []
        self.center, self.radius, self.start, self.end, self.first, self.last = [], [], [], [], [], []
        queue = [(np.arange(len(ids)), 0)]  # members and the place of the center among them
        at = 0
        nodes: list[np.ndarray] = []
        while at < len(queue):
            members, c = queue[at]
            at += 1
            own = points[members]
            distance = np.sqrt(((own - own[c]) ** 2).sum(axis=1))
            radius = float(distance.max())
            self.center.append(own[c])
            self.radius.append(radius)
            self.first.append(len(queue))
            if len(members) > leaf and radius > 0:
                left, covers = np.arange(len(members)), []
                near, pick = distance <= radius * SHRINK, c
                while True:
                    inside = left[near]
                    covers.append((members[inside], int(np.flatnonzero(inside == pick)[0])))
                    left = left[~near]
                    if not len(left):
                        queue += covers
                        break
                    if len(covers) * FEW > len(members):  # points with no near ones: smaller covers would hold one or two each
                        break
                    # the point farthest from the center is the next cover's
                    pick = int(left[np.argmax(distance[left])])
                    if len(left) <= leaf:
                        near = np.ones(len(left), bool)
                    else:
                        near = np.sqrt(((own[left] - own[pick]) ** 2).sum(axis=1)) <= radius * SHRINK
            self.last.append(len(queue))
            nodes.append(members)
        # lay leaves out depth first, so a node's points are one range
        self.start, self.end = [0] * len(nodes), [0] * len(nodes)
        stack, n = [(0, False)], 0
        while stack:
            i, done = stack.pop()
            if done:
                self.end[i] = n
                continue
            self.start[i] = n
            stack.append((i, True))
            if self.first[i] == self.last[i]:
                order.append(nodes[i])
                n += len(nodes[i])
            else:
                stack.extend((j, False) for j in range(self.last[i] - 1, self.first[i] - 1, -1))
        laid = np.concatenate(order)
        self.ids, self.points = ids[laid], points[laid]
        self.center = np.array(self.center)
        self.norm = np.sqrt((self.center**2).sum(axis=1))
        self.radius = np.array(self.radius) + 1e-6


def most(q: CoverTree, i: np.ndarray | int, c: CoverTree, j: np.ndarray | int) -> np.ndarray:
    """No inner product of points below nodes i and j is larger."""
    dots = (q.center[i] * c.center[j]).sum(axis=-1)
    return dots + q.norm[i] * c.radius[j] + c.norm[j] * q.radius[i] + q.radius[i] * c.radius[j] + 0.5


def search(q: CoverTree, c: CoverTree, worst: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of each query's k best in c (id -1 where there are fewer); only scores from worst on are sure to be found."""
    ids = np.full((len(q.ids), k), -1, np.int64)
    scores = np.full((len(q.ids), k), -np.inf)
    kth = worst.copy()
    heap = [(-float(most(q, 0, c, 0)), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        a, b = q.start[i], q.end[i]
        if -bound < kth[a:b].min():
            continue
        qleaf, cleaf = q.first[i] == q.last[i], c.first[j] == c.last[j]
        if qleaf and cleaf:
            y, z = c.start[j], c.end[j]
            new = q.points[a:b] @ c.points[y:z].T
            new[q.ids[a:b, None] == c.ids[None, y:z]] = -np.inf
            rows = np.flatnonzero(new.max(axis=1) >= kth[a:b])
            if len(rows):
                both = np.concatenate([scores[a + rows], new[rows]], axis=1)
                names = np.concatenate([ids[a + rows], np.broadcast_to(c.ids[y:z], (len(rows), z - y))], axis=1)
                # what can be among the k best, ties with the last one included
                last = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k]
                some = int((both >= last[:, None]).sum(axis=1).max())
                if some < both.shape[1]:
                    few = np.argpartition(-both, some - 1, axis=1)[:, :some]
                    both, names = np.take_along_axis(both, few, 1), np.take_along_axis(names, few, 1)
                best = np.lexsort((names, -both), axis=1)[:, :k]
                scores[a + rows], ids[a + rows] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
                kth[a + rows] = np.maximum(kth[a + rows], scores[a + rows, -1])
        elif cleaf or (not qleaf and q.radius[i] > c.radius[j]):
            below = np.arange(q.first[i], q.last[i])
            for x, u in zip(below.tolist(), most(q, below, c, j).tolist(), strict=True):
                heapq.heappush(heap, (-u, x, j))
        else:
            below = np.arange(c.first[j], c.last[j])
            low = kth[a:b].min()
            for x, u in zip(below.tolist(), most(q, i, c, below).tolist(), strict=True):
                if u >= low:
                    heapq.heappush(heap, (-u, i, x))
    return ids, scores


def number(v):
    return F.transform(v, lambda x: x.cast("double"))


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def minus(a, b):
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))


def dealt(rows: DataFrame, pivots: np.ndarray, size: int) -> DataFrame:
    """rows with block (size rows at most, or so) and cuts: block // PARTS**c is the cell above it by c of its cuts, the last one a pivot's number."""
    width = pivots.shape[1]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (pivots**2).sum(axis=1) / 2
        for batch in batches:
            found = [int(np.argmax(np.resize(np.r_[v[:width], np.zeros(max(width - len(v), 0))], width) @ pivots.T - half)) for v in map(np.array, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["vec_id", "v", "block"])

    left = written(rows.mapInArrow(nearest, "vec_id long, v array<long>, block long"), "cells").withColumn("cuts", F.lit(0))
    done = None
    for cut in range(1, MOST_CUTS + 3):
        large = written(left.groupBy("block").agg(F.count(F.lit(1)).alias("_n"), F.min_by(number(F.col("v")), F.xxhash64("vec_id")).alias("_p")).where(F.col("_n") > size), "large")
        small = left.join(large.select("block"), "block", "left_anti")
        done = small if done is None else done.unionByName(small)
        if large.isEmpty():
            break
        big = left.join(large.withColumn("_parts", F.least(F.lit(PARTS), F.ceil(F.col("_n") / size))).drop("_n"), "block").withColumn("_w", number(F.col("v")))
        apart = minus("_w", "_p")
        far = big.groupBy("block").agg(F.max_by(apart, dot(apart, apart)).alias("_d"))
        along = big.drop("_p").join(far, "block").withColumn("_t", dot("_w", "_d"))
        shares = [k / PARTS for k in range(1, PARTS)]
        bounds = along.groupBy("block").agg(F.percentile_approx("_t", shares, 1000).alias("_b"), (dot(F.first("_d"), F.first("_d")) == 0).alias("_same"))
        part = F.floor(F.size(F.filter("_b", lambda b: b < F.col("_t"))) * F.col("_parts") / PARTS)
        by_hash = F.pmod(F.xxhash64("vec_id"), F.col("_parts"))
        part = by_hash if cut > MOST_CUTS else F.when(F.col("_same"), by_hash).otherwise(part)
        left = along.join(bounds, "block").select("vec_id", "v", (F.col("block") * PARTS + part).alias("block"), F.lit(cut).alias("cuts"))
        left = written(left, "cells")
    else:
        done = done.unionByName(left)
    return done


def trees(blocks: DataFrame, leaf: int = LEAF) -> DataFrame:
    """block, cuts, tree (pickled) and its root's center, norm and radius; a block's rows are few, however many there are in all."""

    def grow(_key, table: pa.Table) -> pa.Table:
        lists = [np.array(v, float) for v in table.column("v").to_pylist()]
        points = np.zeros((len(lists), max(1, *map(len, lists))))
        for p, v in zip(points, lists, strict=True):
            p[: len(v)] = v
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        t = CoverTree(ids[order], points[order], leaf)
        root = pa.array([t.center[0].tolist()], pa.list_(pa.float64())), [float(t.norm[0])], [float(t.radius[0])]
        return pa.table({"block": table.column("block")[:1], "cuts": table.column("cuts")[:1], "tree": pa.array([pickle.dumps(t)], pa.binary()), "center": root[0], "norm": root[1], "radius": root[2]})

    # a block's number alone doesn't name it: cells of different cuts may share one
    return written(blocks.groupBy("block", "cuts").applyInArrow(lambda key, t: grow(key, t), "block long, cuts int, tree binary, center array<double>, norm double, radius double"), "trees")


def levels(leaves: DataFrame) -> list[DataFrame]:
    """By cuts from the pivots' cells on: node (number), up (the cell above), block (that of leaves, else null), center, norm and radius."""
    deepest = leaves.agg(F.max("cuts")).first()[0] or 0
    out = []
    for cut in range(deepest + 1):
        below = leaves.where(F.col("cuts") > cut)
        power = F.pow(F.lit(float(PARTS)), F.col("cuts") - cut).cast("long")
        below = below.withColumn("node", F.floor(F.col("block") / power).cast("long"))
        first = below.groupBy("node").agg(F.max_by("center", "radius").alias("_c"))
        gap = minus("center", "_c")
        cells = below.join(first, "node").groupBy("node").agg(F.first("_c").alias("center"), F.max(F.sqrt(dot(gap, gap)) + F.col("radius") + 1e-6).alias("radius"))
        cells = cells.select("node", F.lit(None).cast("long").alias("block"), "center", F.sqrt(dot("center", "center")).alias("norm"), "radius")
        own = leaves.where(F.col("cuts") == cut).select(F.col("block").alias("node"), "block", "center", "norm", "radius")
        both = cells.unionByName(own).withColumn("up", F.floor(F.col("node") / PARTS).cast("long"))
        out.append(written(both, "nodes"))
    return out


def descent(queries: DataFrame, nodes: list[DataFrame], least: DataFrame | None) -> DataFrame:
    """qb, cb, cuts, bound: blocks of candidates that each query block meets: those whose bound reaches least(qb, least), or, without it, the FIRST most promising ones.

    At each level only the cells that are left are opened, so the pairs don't grow with the blocks in all.
    """
    top = nodes[0].select("node", "block", "center", "norm", "radius").collect()  # MOST_PIVOTS cells at most
    width = max((len(r["center"]) for r in top), default=1)
    center = np.array([list(r["center"]) + [0.0] * (width - len(r["center"])) for r in top]).reshape(-1, width)
    norm, radius = (np.array([r[c] for r in top], float) for c in ("norm", "radius"))
    names, blocks = pa.array([r["node"] for r in top], pa.int64()), pa.array([r["block"] for r in top], pa.int64())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, qc in enumerate(batch.column(1).to_pylist()):
                c = np.zeros(width)
                c[: len(qc)] = qc[:width]
                qn, qr = batch.column(2)[k].as_py(), batch.column(3)[k].as_py()
                bound = center @ c + qn * radius + norm * qr + qr * radius + 1.0
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), batch.column(0)[k].as_py())), names, blocks, pa.array(bound)], names=["qb", "node", "cb", "bound"])

    side = queries.select(F.col("qb"), F.col("center").alias("qc"), F.col("norm").alias("qn"), F.col("radius").alias("qr"))
    pairs = side.mapInArrow(meet, "qb long, node long, cb long, bound double")
    found = None
    for cut in range(len(nodes)):
        if cut:
            below = nodes[cut].select(F.col("up").alias("node"), F.col("node").alias("_node"), F.col("block").alias("cb"), "center", "norm", "radius")
            opened = pairs.where("cb is null").select("qb", "node").join(below, "node").join(side, "qb")
            bound = dot("qc", "center") + F.col("qn") * F.col("radius") + F.col("norm") * F.col("qr") + F.col("qr") * F.col("radius") + 1.0
            pairs = opened.select("qb", F.col("_node").alias("node"), "cb", bound.alias("bound"))
        if least is not None:
            pairs = pairs.join(least, "qb").where("bound >= least").drop("least")
        else:
            turn = F.row_number().over(Window.partitionBy("qb").orderBy(F.desc("bound"), "node", F.col("cb").isNull()))
            pairs = pairs.withColumn("_turn", turn).where(F.col("_turn") <= FIRST).drop("_turn")
        pairs = written(pairs, "pairs")
        leaves = pairs.where("cb is not null").select("qb", "cb", F.lit(cut).alias("cuts"), "bound")
        found = leaves if found is None else found.unionByName(leaves)
    return found


def searched(pairs: DataFrame, queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best that each query block finds in its blocks of candidates.

    A query block's tree comes first and stays; trees of candidates follow by falling bound, and each raises the scores that
    the next must reach. queries has ids and kth, the scores known before, which may be null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, worst, kth = None, None, None
        for batch in batches:
            for row in range(batch.num_rows):
                tree = pickle.loads(batch.column(2)[row].as_py())
                if batch.column(1)[row].as_py() is None:
                    q, worst = tree, np.full(len(tree.ids), -np.inf)
                    if batch.column(3)[row].is_valid:
                        least = dict(zip(batch.column(3)[row].as_py(), batch.column(4)[row].as_py(), strict=True))
                        worst = np.array([least.get(i, -np.inf) for i in q.ids.tolist()])
                    best = np.full((len(q.ids), k), -np.inf)
                    continue
                if batch.column(1)[row].as_py() < worst.min():
                    continue
                width = max(q.points.shape[1], tree.points.shape[1])
                for t in (q, tree):
                    t.points, t.center = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (t.points, t.center))
                ids, scores = search(q, tree, worst, k)
                kth = scores >= worst[:, None]
                found = (ids >= 0) & np.isfinite(scores) & kth
                best = -np.sort(-np.concatenate([best, np.where(found, scores, -np.inf)], axis=1), axis=1)[:, :k]
                worst = np.maximum(worst, best[:, -1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(q.ids, found.sum(axis=1))), pa.array(ids[found]), pa.array(scores[found].astype(np.int64))], names=["query_id", "vec_id", "score"]
                )

    asked = queries.join(pairs.select("qb").distinct(), "qb", "left_semi").select("qb", F.lit(None).cast("double").alias("bound"), "tree", "ids", "kth")
    none = F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<double>").alias("kth")
    trees_of = candidates.select(F.col("block").alias("cb"), "cuts", "tree")
    sent = pairs.join(trees_of, ["cb", "cuts"]).select("qb", "bound", "tree", *none)
    dealt_out = asked.unionByName(sent).repartition("qb").sortWithinPartitions("qb", F.desc_nulls_first("bound"))
    return dealt_out.mapInArrow(run, "query_id long, vec_id long, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id every divides, its k best among all other rows."""
    rows = written(integers(vectors), "vectors")
    total = rows.count()
    n = min(MOST_PIVOTS, max(1, total // block))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).collect()  # MOST_PIVOTS rows at most
    width = max((len(r["v"]) for r in sample), default=1) or 1
    pivots = np.array([r["v"] + [0] * (width - len(r["v"])) for r in sample] or [[0]], float)
    alike = Window.partitionBy("v").orderBy("vec_id")
    candidates = rows.withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= k + 1).select("vec_id", "v")
    ctrees = trees(dealt(candidates, pivots, block))
    qtrees = trees(dealt(rows.where(F.col("vec_id") % every == 0), pivots, QUERY_BLOCK), QUERY_LEAF)
    qtrees = written(qtrees.withColumn("qb", F.monotonically_increasing_id()), "queries")
    nodes = levels(ctrees)
    unknown = qtrees.withColumns({"ids": F.lit(None).cast("array<long>"), "kth": F.lit(None).cast("array<double>")})
    first_pairs = descent(qtrees, nodes, None)
    first = written(best(searched(first_pairs, unknown, ctrees, k), k), "first")
    kth = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("kth"))
    members = queries_of(qtrees)
    known = members.join(kth, "vec_id", "left").groupBy("qb").agg(
        F.min(F.coalesce("kth", F.lit(float("-inf")))).alias("least"), F.collect_list("vec_id").alias("ids"), F.collect_list(F.coalesce("kth", F.lit(float("-inf")))).alias("kth")
    )
    known = written(known, "known")
    later = descent(qtrees, nodes, known.select("qb", "least")).join(first_pairs.select("qb", "cb", "cuts"), ["qb", "cb", "cuts"], "left_anti")
    second = searched(later, qtrees.join(known.select("qb", "ids", "kth"), "qb"), ctrees, k)
    return best(first.drop("rank").unionByName(second), k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def queries_of(qtrees: DataFrame) -> DataFrame:
    """qb and vec_id of the queries in each block (QUERY_BLOCK or so)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, tree in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.unique(pickle.loads(tree.as_py()).ids)
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(ids), pa.int64()), pa.array(ids)], names=["qb", "vec_id"])

    return qtrees.select("qb", "tree").mapInArrow(read, "qb long, vec_id long")
