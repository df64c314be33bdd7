"""Exact similarity search and ranking curves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.scale import salted_join

SCORE_DIGITS = 9  # scores are compared after rounding, so the order of summation cannot break ties
BLOCK = 4096  # rows of one side that meet in one block product
STRIPE = 32768  # rows of one side that meet in one task of the grid, at least a block
SIDES = 4  # stripes of a side that has so many blocks, however few rows
GROUP = 64  # scores whose highest one bounds the best k from below
BROADCAST_BYTES = 64 << 20  # queries above this size take the block grid

_TOP = "query_id long, cand_id long, score double"


def _matrix(col) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in col])


def _best(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int | None, least: np.ndarray | None = None):
    """Top-k of a block as three flat arrays, ties to the candidate that comes first; candidates come sorted by id. Without k all of it.

    ``least`` bounds the best k of every query from below; what does not reach it may be left out.
    """
    if least is not None and np.isfinite(least).all():
        row, col = _reaching(q, c, least - 2.0 * 10.0**-SCORE_DIGITS)
        return qid[row], cid[col], np.round(np.einsum("ij,ij->i", q[row], c[col]), SCORE_DIGITS)
    s = q @ c.T
    if k is None or k >= s.shape[1]:
        np.round(s, SCORE_DIGITS, out=s)
        if k is None:  # nothing to rank
            return np.repeat(qid, len(cid)), np.tile(cid, len(qid)), s.ravel()
        top = np.argsort(-s, axis=1, kind="stable")
        return np.repeat(qid, len(cid)), cid[top].ravel(), np.take_along_axis(s, top, axis=1).ravel()
    row, col = np.nonzero(s >= _floor(s, k)[:, None])
    score = np.round(s[row, col], SCORE_DIGITS)
    order = np.lexsort((col, -score, row))
    row, col, score = row[order], col[order], score[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return qid[row[kept]], cid[col[kept]], score[kept]


def _reaching(q: np.ndarray, c: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, col) of all dot products of at least ``least``, with some just below: products are of single precision, and the bound is lowered by their error."""
    lengths = [np.sqrt((x * x).sum(1)) for x in (q, c)]
    longest = [x.max(initial=0.0) for x in lengths]
    if max(longest) > 1e15 or not np.isfinite(longest).all():
        return np.divmod(np.flatnonzero(q @ c.T >= least[:, None]), len(c))
    error = (q.shape[1] + 8) * 2.0**-24 * lengths[0] * longest[1]
    low = np.nextafter((least - error).astype(np.float32), np.float32(-np.inf))
    return np.divmod(np.flatnonzero(q.astype(np.float32) @ c.astype(np.float32).T >= low[:, None]), len(c))


def _kth(best, qid: np.ndarray, k: int) -> np.ndarray:
    """Per query its kth best score in flat arrays as ``_merged`` gives them, minus infinity where there are fewer."""
    first = np.searchsorted(best[0], qid)
    last = np.minimum(first + k - 1, len(best[0]) - 1)
    return np.where((first + k <= len(best[0])) & (best[0][last] == qid), best[2][last], -np.inf)


def _floor(s: np.ndarray, k: int) -> np.ndarray:
    """Per row a bound that the k best scores reach, also after rounding: the kth of the highest scores of k groups or more."""
    groups = s.shape[1] // GROUP
    if groups >= k:
        tops = s[:, : groups * GROUP].reshape(len(s), groups, GROUP).max(axis=2)
    else:
        tops = s
    return np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k] - 2.0 * 10.0**-SCORE_DIGITS


def top_k(sim: DataFrame, k: int | None) -> DataFrame:
    """Rank candidates per query by score, ties by candidate id; the partial limit runs before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("cand_id"))
    ranked = sim.withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= k) if k else ranked


def similarity(queries: DataFrame, cands: DataFrame, max_bytes: int = BROADCAST_BYTES, block: int = BLOCK) -> DataFrame:
    """Dot product of every query with every candidate: a row for each, so meant for few queries; ``nearest`` keeps the best.

    Query sets of a checked size travel to the candidates, larger ones meet them in a grid of bounded blocks; the rows are the same.
    """
    small = _small_queries(queries, max_bytes)
    return _scan(small, cands, None) if small is not None else _grid(queries, cands, None, block)


def nearest(queries: DataFrame, cands: DataFrame, k: int, max_bytes: int = BROADCAST_BYTES, block: int = BLOCK) -> DataFrame:
    """Exact top-k candidates per query: ``query_id, cand_id, score, rank``.

    Query sets of a checked size travel to the candidates, which are never shuffled;
    larger sets meet them in a grid of blocks of queries and ``BLOCK`` candidates, or ``block`` if that is more, each bounded on both sides. Only the
    best k per query and stripe leave a task.
    """
    small = _small_queries(queries, max_bytes)
    return top_k(_scan(small, cands, k) if small is not None else _grid(queries, cands, k, block), k)


def _small_queries(queries: DataFrame, max_bytes: int):
    """Ids and matrix of the query set, or None when it exceeds the bound; at most bound+1 rows are fetched."""
    head = queries.select(F.size("x").alias("d")).head(1)
    if not head:
        return np.empty(0, dtype=np.int64), np.empty((0, 0))
    limit = max(1, max_bytes // (8 * max(1, head[0]["d"])))
    if queries.select("id").limit(limit + 1).count() > limit:
        return None
    rows = queries.select(F.col("id").cast("long").alias("id"), F.transform("x", lambda v: v.cast("double")).alias("x")).toArrow()
    return np.asarray(rows["id"].to_pylist(), dtype=np.int64), _matrix(rows["x"].to_pylist())


def _scan(small, cands: DataFrame, k: int | None) -> DataFrame:
    sent = cands.sparkSession.sparkContext.broadcast(small)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qid, q = sent.value
        kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # per query chunk: the best k so far
        for pdf in batches:
            if not len(pdf) or not len(qid):
                continue
            pdf = pdf.sort_values("id")
            c, cid = _matrix(pdf["x"]), pdf["id"].to_numpy()
            for at in range(0, len(qid), 1024):
                found = _best(qid[at : at + 1024], q[at : at + 1024], cid, c, k)
                if k is None:
                    yield _frame(found)
                else:
                    kept[at] = _merged([kept[at], found], k) if at in kept else found
        for found in kept.values():
            yield _frame(found)

    return cands.select(F.col("id").cast("long").alias("id"), "x").mapInPandas(run, _TOP)


def _frame(found) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("query_id", "cand_id", "score"), found)))


def _merged(results: list, k: int):
    """The best k per query of several results, as flat arrays."""
    qid, cid, score = (np.concatenate(part) for part in zip(*results))
    order = np.lexsort((cid, -score, qid))
    qid, cid, score = qid[order], cid[order], score[order]
    kept = np.arange(len(qid)) - np.searchsorted(qid, qid) < k
    return qid[kept], cid[kept], score[kept]


def _grid(queries: DataFrame, cands: DataFrame, k: int | None, block: int) -> DataFrame:
    """Every stripe of queries meets every stripe of candidates in one task, block by block; rows are copied once per stripe of the other side."""

    def stripes(n: int) -> int:
        # without k a task gives every score, so it gets one block of either side
        return max(1, -(-n // block) if k is None else max(min(-(-n // block), SIDES), -(-n // max(block, STRIPE))))

    n_q, n_c = stripes(queries.count()), stripes(cands.count())

    def side(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return df.select(
            F.col("id").cast("long").alias("id"),
            "x",
            F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other),
        )

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return _frame(([], [], []))
        right = right.sort_values("id")
        qid, q, cid, c = left["id"].to_numpy(), _matrix(left["x"]), right["id"].to_numpy(), _matrix(right["x"])
        made = []
        for i in range(0, len(qid), block):
            own, rows = qid[i : i + block], q[i : i + block]
            if k is None:
                made += [_best(own, rows, cid[j : j + block], c[j : j + block], None) for j in range(0, len(cid), block)]
                continue
            best, least, more = None, None, []
            for j in range(0, len(cid), max(block, BLOCK)):
                found = _best(own, rows, cid[j : j + max(block, BLOCK)], c[j : j + max(block, BLOCK)], k, least)
                more.append(found)
                if best is None or sum(len(f[0]) for f in more) >= len(best[0]) or j + max(block, BLOCK) >= len(cid):
                    best, more = _merged([*more, best] if best else more, k), []
                    least = _kth(best, own, k)
            made.append(best)
        return _frame([np.concatenate(part) for part in zip(*made)])

    q = side(queries, "qb", n_q, "cb", n_c).groupBy("qb", "cb")
    c = side(cands, "cb", n_c, "qb", n_q).groupBy("qb", "cb")
    return q.cogroup(c).applyInPandas(run, _TOP)


# ---- relevance and curves -----------------------------------------------------------------------


def ground_truth(top: DataFrame, labels: DataFrame) -> DataFrame:
    """Flag the results that carry the label of their query; ``labels(id, label)``."""
    q = labels.select(F.col("id").alias("query_id"), F.col("label").alias("q_label"))
    c = labels.select(F.col("id").alias("cand_id"), F.col("label").alias("c_label"))
    both = salted_join(top.join(q, "query_id"), c, ["cand_id"], spread=["query_id"], salts=8)  # a hub is a hit of many queries
    return both.withColumn("rel", (F.col("q_label") == F.col("c_label")).cast("int")).drop("q_label", "c_label")


def relevant_totals(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """Number of candidates that share the label of a query, counted once per label."""
    per = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n_relevant"))
    rows = queries.select(F.col("id").alias("query_id"), "label")
    return salted_join(rows, per, ["label"], spread=["query_id"]).select("query_id", "n_relevant")


def dcg(rels: DataFrame) -> DataFrame:
    """Discounted gain at every cut-off: sum of rel / ln(rank + 1). At most K rows per query."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rels.withColumn("dcg", F.sum(F.col("rel") / F.log(F.col("rank") + F.lit(1.0))).over(w))


def ir_curves(rels: DataFrame, totals: DataFrame, k: int = 199, exclude_self: bool = False) -> DataFrame:
    """nDCG, recall and precision at 1..k per query; cut-offs beyond the result list repeat its gain.

    A query without relevant functions gets null nDCG and recall, which means skip it.
    """
    if exclude_self:
        w = Window.partitionBy("query_id").orderBy("rank")
        rels = rels.filter(F.col("cand_id") != F.col("query_id")).withColumn("rank", F.row_number().over(w))
        totals = totals.withColumn("n_relevant", F.col("n_relevant") - 1)
    grid = totals.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(k))))
    full = grid.join(rels.select("query_id", "rank", "rel"), ["query_id", "rank"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    run = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gain = 1.0 / F.log(F.col("rank") + F.lit(1.0))
    out = (
        dcg(full)
        .withColumn("ideal", F.sum(F.when(F.col("rank") <= F.col("n_relevant"), gain).otherwise(0.0)).over(run))
        .withColumn("hits", F.sum("rel").over(run))
    )
    return out.select(
        "query_id",
        F.col("rank").alias("k"),
        F.try_divide("dcg", "ideal").alias("ndcg"),
        F.try_divide(F.col("hits").cast("double"), F.col("n_relevant").cast("double")).alias("recall"),
        (F.col("hits") / F.col("rank")).alias("precision"),
    )


def pp_search(queries: DataFrame, cands: DataFrame, labels: DataFrame, query_id: int | None = None, k: int = 50) -> DataFrame:
    """Result table (rank, id, name, score) of one query, the first by default; only that query is searched for."""
    first = queries.agg(F.min("id")).scalar() if query_id is None else F.lit(query_id)
    hits = nearest(queries.filter(F.col("id") == first), cands, k)
    return hits.join(labels.select(F.col("id").alias("cand_id"), F.col("label").alias("name")), "cand_id").select(
        "rank", F.col("cand_id").alias("id"), "name", "score"
    ).orderBy("rank")
