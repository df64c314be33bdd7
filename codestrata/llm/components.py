"""Connected components of an edge table, as rounds of joins over written tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import pieces
from codestrata.session import cut

EDGES = 1 << 20  # edges, of two longs each, that one task may hold: 16 MB whatever the corpus


def smallest_linked(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix: the smallest row number reachable from every row."""
    n = len(linked)
    label = np.arange(n)
    while True:
        near = np.where(linked, label[None, :], n).min(axis=1, initial=n)
        new = np.minimum(label, near)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) for the nodes that are not themselves smallest, from the edges a-b."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(u):
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        label = new
        open_ = label[u] != label[v]
        u, v = u[open_], v[open_]
    label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _thinned(edges: DataFrame) -> DataFrame:
    """Edges of every task replaced by stars around the smallest node reachable inside the task."""

    def stars(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = np.zeros(0, np.int64)
        for batch in it:
            a = np.concatenate((a, batch.column(0).to_numpy()))
            b = np.concatenate((b, batch.column(1).to_numpy()))
            a, b = forest(a, b)
        yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return edges.mapInArrow(stars, "a long, b long")


def components(edges: DataFrame, per_task: int = EDGES) -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node reachable. ``edges`` has longs a and b.

    Every task first replaces its edges by stars, and as long as fewer tasks can hold what is left, at ``per_task`` edges each, the
    stars are gathered in so many without a shuffle. If one holds them all nothing remains to be done; more go through rounds.

    Every round hangs the larger neighbours of a node under its smallest neighbour, then the smaller
    ones; the edges left when nothing changes are stars. Rounds grow with the logarithm of the
    number of nodes. Minima are combined before the shuffle and joined back, so the centre of a large
    star is an ordinary join key that adaptive execution can split.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:  # both directions: larger neighbours move to the smallest one
            both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("least"))
            met = both.where(F.col("v") > F.col("u")).join(least, "u")
            return met.select(F.col("v").alias("a"), F.least("u", "least").alias("b")).where("a <> b").distinct()
        # a > b in every row: a node and its smaller neighbours move to the smallest of them
        least = e.groupBy("a").agg(F.min("b").alias("least"))
        met = e.join(least, "a")
        moved = met.select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b")
        return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38)"))).first())

    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    now = cut(_thinned(ordered))
    seen, tasks = state(now), None
    while seen[0]:
        few = pieces(seen[0], per_task)
        if tasks is None or few < tasks:
            now, tasks = cut(_thinned(now.coalesce(few))), few
            if few == 1:
                break
            seen = state(now)
            continue
        now = cut(star(star(now, True), False))
        was, seen = seen, state(now)
        if was == seen:
            break
    found = now.groupBy("a").agg(F.min("b").alias("root"))
    return found.select(F.col("a").alias("node"), "root").unionByName(found.select(F.col("root").alias("node"), "root").distinct())
