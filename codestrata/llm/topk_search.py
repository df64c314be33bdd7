"""Exact top-k inner products by dual-tree search over cover trees.

1. Vectors become whole numbers. Those of all rows are dealt to blocks of bounded size, near ones together, by the nearest of a bounded number of
   pivots; every block is indexed by a cover tree. The queries are blocked and indexed in the same way.
2. Every pair of a query block and a data block is a pair of tree roots. A pair of nodes is pruned when no
   pair of their points can beat the query group's worst kth score: by Cauchy-Schwarz no product exceeds
   <q, p> + rq |p| + rp |q| + rq rp for centres q, p and covering radii rq, rp.
3. A query block first searches its own most promising data block. The kth scores found there prune, by the same bound, pairs of
   roots before any vector moves, and then pairs of nodes in the others.
4. Leaves are compared as matrix products; only k rows per query and block leave a task.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.common import batches_of, pieces, shuffle_partitions
from codestrata.session import cut

K = 5
SCALE = 256
DATA_BLOCK = 4096
QUERY_BLOCK = 256
PIVOTS = 256  # rows that the blocks are laid around, whatever the corpus
LEAF = 64  # rows compared as one matrix product
WORTH = 8  # points per child at least; a node that would fall into smaller ones stays whole and is compared as one product
QUERY_LEAF = 1  # queries are compared alone at the bottom of their tree, unless they are equal
EXACT = 1 << 52  # products of norms below it are exact in doubles
LONGEST = (1 << 63) - 1


class CoverTree:
    """Nodes in arrays: a centre (a point of the tree), a covering radius, and children that halve the radius level by level.

    Every point of a node lies within its radius of the centre. A node's points are those between ``start`` and ``stop``
    in ``order``; its children are the nodes between ``child`` and ``child_stop``, none for a leaf.
    """

    ARRAYS = ("order", "centre", "radius", "start", "stop", "child", "child_stop")

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        order = np.arange(len(points))
        nodes: list[list] = []  # centre, radius, start, stop, child, child_stop
        if len(points):
            middle = points.mean(axis=0)
            self._node(nodes, order, int(((points - middle) ** 2).sum(axis=1).argmin()), 0, len(points))
        at = 0
        while at < len(nodes):
            centre, radius, start, stop = nodes[at][:4]
            nodes[at][4] = nodes[at][5] = len(nodes)
            if stop - start > leaf and 0 < radius < np.inf:
                self._divide(nodes, order, start, stop, radius / 2, WORTH if leaf >= WORTH else 1)
                nodes[at][5] = len(nodes)
            at += 1
        table = np.array(nodes, np.float64).reshape(-1, 6)
        self.order = order
        self.centre, self.start, self.stop, self.child, self.child_stop = (table[:, c].astype(np.int64) for c in (0, 2, 3, 4, 5))
        self.radius = table[:, 1]

    def _node(self, nodes: list, order: np.ndarray, centre: int, start: int, stop: int) -> None:
        own = self.points[order[start:stop]]
        radius = float(np.sqrt(((own - self.points[centre]) ** 2).sum(axis=1).max()))
        nodes.append([centre, radius * (1 + 1e-12), start, stop, 0, 0])  # never below the true radius

    def _divide(self, nodes: list, order: np.ndarray, start: int, stop: int, reach: float, worth: int) -> None:
        """Children around points farther than ``reach`` from each other that cover all points within it; none if they had fewer than ``worth`` points on average."""
        own = order[start:stop]
        x = self.points[own]
        near = np.full(len(own), np.inf)
        label = np.zeros(len(own), np.int64)
        centres: list[int] = []
        while True:
            far = int(near.argmax()) if centres else 0
            if centres and near[far] <= reach * reach:
                break
            if (len(centres) + 1) * worth > len(own):
                return
            d = ((x - x[far]) ** 2).sum(axis=1)
            closer = d < near
            near[closer], label[closer] = d[closer], len(centres)
            centres.append(int(own[far]))
        by = np.argsort(label, kind="stable")
        order[start:stop] = own[by]
        ends = start + np.cumsum(np.bincount(label, minlength=len(centres)))
        at = start
        for c, e in zip(centres, ends.tolist()):
            self._node(nodes, order, c, at, e)
            at = e

    def dump(self, ids: np.ndarray) -> bytes:
        """The tree and the ids of its points; whole numbers in the smallest type that holds them."""
        top = np.abs(self.points).max(initial=0)
        kind = next((t for t, limit in ((np.int16, 1 << 15), (np.int32, 1 << 31)) if top < limit), np.float64)
        f = io.BytesIO()
        np.savez(f, points=self.points.astype(kind), ids=ids, **{n: getattr(self, n) for n in self.ARRAYS})
        return f.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> tuple[CoverTree, np.ndarray]:
        z = np.load(io.BytesIO(blob))
        self = cls.__new__(cls)
        self.points = z["points"].astype(np.float64)
        for n in cls.ARRAYS:
            setattr(self, n, z[n])
        return self, z["ids"]

    def children(self, node: int) -> range:
        return range(self.child[node], self.child_stop[node])


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; products beyond a long are cut off at its ends."""
    size = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if size < EXACT:
        return a @ b.T
    whole = np.array([[int(v) for v in r] for r in a], object) @ np.array([[int(v) for v in r] for r in b], object).T
    return np.clip(whole, -LONGEST - 1, LONGEST)


def dual_search(queries: CoverTree, query_ids: np.ndarray, data: CoverTree, data_ids: np.ndarray, worst: np.ndarray, k: int) -> list[tuple[list, list]]:
    """(scores, ids) of at most k best rows per query, best first, that may reach the query's ``worst`` allowed score."""
    if not len(query_ids) or not len(data_ids):
        return [([], []) for _ in query_ids]
    # the best so far, best first, and how many they are
    best_score, best_id = np.zeros((2, len(query_ids), k), np.int64)
    held = np.zeros(len(query_ids), np.int64)
    worst = worst.copy()
    limit = np.empty(len(queries.centre))  # per query node: its queries' smallest kth score

    def refresh(node: int) -> None:
        own = queries.order[queries.start[node] : queries.stop[node]]
        limit[node] = worst[own].min()

    for node in range(len(limit)):
        refresh(node)
    q_norm = np.sqrt((queries.points[queries.centre] ** 2).sum(axis=1))
    d_norm = np.sqrt((data.points[data.centre] ** 2).sum(axis=1))

    def bound(q: np.ndarray, d: np.ndarray) -> np.ndarray:
        inner = queries.points[queries.centre[q]] @ data.points[data.centre[d]].T
        top = inner + queries.radius[q][:, None] * d_norm[d][None, :] + q_norm[q][:, None] * data.radius[d][None, :] + queries.radius[q][:, None] * data.radius[d][None, :]
        return top + np.abs(top) * 1e-9 + 1e-6  # rounding must not prune

    def leaves(q: int, d: int) -> None:
        own_q = queries.order[queries.start[q] : queries.stop[q]]
        own_d = data.order[data.start[d] : data.stop[d]]
        scores, ids = _product(queries.points[own_q], data.points[own_d]), data_ids[own_d]
        may = (scores >= worst[own_q][:, None]) & (ids[None, :] != query_ids[own_q][:, None])
        some = np.flatnonzero(may.any(axis=1))
        if not len(some):
            return
        own_q, may, scores = own_q[some], may[some], scores[some].astype(np.int64)
        if len(own_d) > k:  # ties with the kth stay
            kth = np.partition(np.where(may, scores, -LONGEST - 1), len(own_d) - k, axis=1)[:, len(own_d) - k]
            may &= scores >= kth[:, None]
        row, col = np.nonzero(may)
        old_row, old = np.nonzero(np.arange(k) < held[own_q][:, None])
        row, score, names = np.concatenate((old_row, row)), np.concatenate((best_score[own_q[old_row], old], scores[row, col])), np.concatenate((best_id[own_q[old_row], old], ids[col]))
        order = np.lexsort((names, ~score, row))  # ~ turns the order round without an overflow
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, place, order = row[place < k], place[place < k], order[place < k]
        best_score[own_q[row], place], best_id[own_q[row], place] = score[order], names[order]
        held[own_q] = np.bincount(row, minlength=len(own_q))
        full = own_q[held[own_q] == k]
        worst[full] = np.maximum(worst[full], best_score[full, k - 1])
        refresh(q)

    def descend(q: int, d: int) -> None:
        todo = [(q, d)]
        while todo:
            q, d = todo.pop()
            if bound(np.array([q]), np.array([d]))[0, 0] < limit[q]:
                continue
            q_kids, d_kids = queries.children(q), data.children(d)
            if not q_kids and not d_kids:
                leaves(q, d)
                continue
            if d_kids and (not q_kids or data.radius[d] >= queries.radius[q]):
                kids = np.arange(d_kids.start, d_kids.stop)
                tops = bound(np.array([q]), kids)[0]
                todo += [(q, int(kids[p])) for p in np.argsort(tops) if tops[p] >= limit[q]]  # the most promising is popped first
            else:
                refresh(q)
                todo += [(kid, d) for kid in q_kids]

    descend(0, 0)
    return [(best_score[i, :n].tolist(), best_id[i, :n].tolist()) for i, n in enumerate(held.tolist())]


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component as a double; null for vectors that take no part."""
    odd = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(vector, lambda v: v.cast("double") * float(scale))
    # as doubles: large numbers would not fit a long; those that overflow to infinity take no part either
    floored = F.transform(whole, lambda v: F.when(F.abs(v) < 2.0**52, F.floor(v).cast("double")).otherwise(v))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~odd & ~F.exists(whole, lambda v: F.abs(v) == float("inf")), floored)


def _blocks(rows: DataFrame, size: int, leaf: int, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(dim, block, n, centre, radius, norm, body): rows dealt to the nearest pivot, large cells cut into blocks of about ``size``."""

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it, 2048):
            vectors = b.column(1).to_pylist()
            dims = np.array([len(v) for v in vectors], np.int32)
            cells = np.zeros(len(vectors), np.int32)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x, p = np.array([vectors[i] for i in at]).reshape(len(at), d), pivots[int(d)]
                cells[at] = ((p**2).sum(axis=1)[None, :] - 2 * x @ p.T).argmin(axis=1)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(dims), pa.array(cells)], names=["id", "x", "dim", "cell"])

    placed = cut(rows.select("id", "x").mapInArrow(place, "id long, x array<double>, dim int, cell int"))
    sizes = placed.groupBy("dim", "cell").agg(F.count("*").alias("size"))
    parts = placed.join(sizes, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id", "x"), F.ceil(F.col("size") / size)).cast("int"))

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        x = np.array(part["x"].tolist(), np.float64).reshape(len(part), key[0])
        ids = part["id"].to_numpy(np.int64)
        centre = x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max())) * (1 + 1e-9)
        return pd.DataFrame({"dim": [key[0]], "cell": [key[1]], "part": [key[2]], "n": [len(np.unique(ids))], "centre": [centre.tolist()], "radius": [radius], "body": [CoverTree(x, leaf).dump(ids)]})

    built = parts.select("dim", "cell", "part", "id", "x").groupBy("dim", "cell", "part").applyInPandas(build, "dim int, cell int, part int, n long, centre array<double>, radius double, body binary")
    return cut(built.withColumn("block", F.monotonically_increasing_id()))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of ``queries`` its k best rows of ``vectors`` with another id, ties to the smaller id.

    The score is the inner product of floor(scale * x), whole numbers, with doubles under each component; products beyond a long are cut off at its ends.
    Vectors that are null, empty or hold null or non-finite numbers (also once scaled) take no part, nor do rows with a null id. Only vectors of
    equal length are compared. Rows that repeat an id and vector count once; of several vectors under one id each counts, and queries under one id
    are one query. Empty tables give no rows.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        d = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), whole_numbers(F.col(f"`{vector_col}`"), scale).alias("x"))
        return d.where(F.col("id").isNotNull() & F.col("x").isNotNull()).distinct()

    data, asked = cut(clean(vectors)), cut(clean(queries))
    count = data.count()
    share = int(min(1.0, PIVOTS / max(count, 1)) * (1 << 32))
    pivots: dict[int, np.ndarray] = {}
    lengths = [r["dim"] for r in data.select(F.size("x").alias("dim")).distinct().collect()]
    sampled = data.where(F.pmod(F.xxhash64("id", "x"), F.lit(1 << 32)) < share).select("x").collect()
    for d in {*lengths, *[r["dim"] for r in asked.select(F.size("x").alias("dim")).distinct().collect()]}:
        own = [r["x"] for r in sampled if len(r["x"]) == d]
        pivots[d] = np.array(own or [[0.0] * d], np.float64).reshape(-1, d)
    n_pivots = max(1, pieces(count, DATA_BLOCK))  # no more cells than there would be full blocks
    pivots = {d: p[np.lexsort(p.T[::-1])][:: max(1, len(p) // n_pivots)] if d else p for d, p in pivots.items()}
    blocks, groups = _blocks(data, DATA_BLOCK, LEAF, pivots), _blocks(asked, QUERY_BLOCK, QUERY_LEAF, pivots)
    # one row per pair of roots: numbers of blocks, not of vectors; the query blocks are spread so that no task has all
    spread = shuffle_partitions(spark)
    left = groups.select("dim", F.pmod("block", F.lit(spread)).alias("salt"), F.col("block").alias("group"), F.col("centre").alias("q"), F.col("radius").alias("rq"))
    right = blocks.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))).alias("salt"), "block", F.col("centre").alias("p"), F.col("radius").alias("rp"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    inner, q_norm, p_norm = dot("q", "p"), F.sqrt(dot("q", "q")), F.sqrt(dot("p", "p"))
    top = inner + F.col("rq") * p_norm + F.col("rp") * q_norm + F.col("rq") * F.col("rp")
    roots = cut(left.join(right, ["dim", "salt"]).select("group", "block", (top + F.abs(top) * 1e-9 + 1e-6).alias("top")))

    def search(pairs: DataFrame, kth: DataFrame) -> DataFrame:
        """Best rows of the pairs of blocks; ``kth`` has the scores to reach, per query block."""
        bodies = pairs.join(groups.select(F.col("block").alias("group"), F.col("body").alias("asked")).join(kth, "group"), "group")
        bodies = bodies.join(blocks.select("block", "body"), "block")

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches_of(it, 1):
                row = batch.to_pylist()[0]
                (q, q_ids), (d, d_ids) = CoverTree.load(row["asked"]), CoverTree.load(row["body"])
                known = dict(zip(row["queries"], row["scores"]))
                worst = np.array([known.get(i, -np.inf) for i in q_ids.tolist()], np.float64)
                out = dual_search(q, q_ids, d, d_ids, worst, k)
                flat = [(row["group"], i, v, s) for i, (scores, ids) in zip(q_ids.tolist(), out) for s, v in zip(scores, ids)]
                columns = list(zip(*flat)) or [[]] * 4
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["group", "query_id", "vec_id", "score"])

        dealt = bodies.repartition(4 * spread, "group", "block")
        return dealt.mapInArrow(run, "group long, query_id long, vec_id long, score long")

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    none = F.array().cast("array<long>")
    start = groups.select(F.col("block").alias("group"), none.alias("queries"), none.alias("scores"))
    first = roots.groupBy("group").agg(F.max_by("block", "top").alias("block"))
    found = cut(search(first, start))
    # a query with fewer than k rows so far has no score to reach, and a block with such a query no least one
    reached = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
    reached = reached.groupBy("group").agg(F.collect_list("query_id").alias("queries"), F.collect_list("score").alias("scores"), F.min("score").alias("least"))
    kth = groups.select(F.col("block").alias("group"), "n").join(reached, "group", "left")
    kth = cut(kth.select("group", F.coalesce("queries", none).alias("queries"), F.coalesce("scores", none).alias("scores"), F.when(F.size("queries") == F.col("n"), F.col("least")).alias("least")))
    rest = roots.join(first, ["group", "block"], "left_anti").join(kth.select("group", "least"), "group")
    rest = rest.where(F.col("least").isNull() | ~(F.col("top") < F.col("least"))).select("group", "block")
    every = found.unionByName(search(rest, kth.drop("least"))).select("query_id", "vec_id", "score")
    ranked = every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
