"""SimHash near-duplicates with vantage-point trees over the fingerprints.

1. A fingerprint is the bitwise majority over the XXH64 values of a text's word shingles.
2. Equal fingerprints become one point. A vantage-point tree fitted on a bounded sample of the points
   deals all of them to shards: at every node a point goes to the side of its distance from the
   vantage point, and a point so close to the rim that a partner may lie beyond it is also sent there.
   By the triangle inequality every pair within the radius meets in some shard.
3. Inside a shard the same tree is grown down to small blocks, which are compared exactly.
4. Links are handed on as spanning stars, never as all pairs, and joined to components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import batches_of, shuffle_partitions, unpacked, utf8, whole_row
from codestrata.llm.components import components, forest, smallest_linked
from codestrata.session import cut

SHINGLE = 3
RADIUS = 2
SEED = 42
SAMPLE = 1 << 16  # fingerprints that the top of the tree is fitted on: half a megabyte, whatever the corpus
POINTS_PER_SHARD = 20_000
MAX_SHARDS = SAMPLE // 8
BLOCK = 256  # points compared exactly with each other
CHUNK = 1 << 15  # shingles of one text whose bits are counted at a time


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text; 0 without words."""
    words = text.lower().split()  # on bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    width = min(shingle, len(words))
    first, last = starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(first), CHUNK):
        hashes = [digest(joined[s:e], SEED) for s, e in zip(first[at : at + CHUNK], last[at : at + CHUNK])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str, out: str, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the fingerprint of every text as a long (its 64 bits)."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, shingle) for t in utf8(texts)], np.uint64).view(np.int64))

    return docs.withColumn(out, of(F.col(text_col)))


def _distance(points: np.ndarray, centre: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ centre)


def _split(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A vantage point and a rim that halve the points as well as a few tries can; None if none divides them."""
    best = None
    for _ in range(4):
        centre = points[rng.integers(len(points))]
        d = _distance(points, centre)
        middle = int(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2])
        for rim in (middle - 1, middle):
            crossing = int(((d > rim - RADIUS) & (d <= rim)).sum())
            inside = int((d <= rim).sum())
            larger = max(inside, len(d) - inside + crossing)
            if 0 < inside and larger < 0.95 * len(d) and (best is None or larger < best[0]):
                best = (larger, centre, rim)
    return best and best[1:]


def grow(sample: np.ndarray, leaves: int, rng: np.random.Generator) -> tuple:
    """Nested (centre, rim, inside, outside); a leaf is an empty tuple."""
    if leaves <= 1 or len(sample) < 8 or (cut_at := _split(sample, rng)) is None:
        return ()
    centre, rim = cut_at
    d = _distance(sample, centre)
    return (centre, rim, grow(sample[d <= rim], leaves // 2, rng), grow(sample[d > rim], leaves - leaves // 2, rng))


def _numbered(tree: tuple, at: int = 0) -> tuple[tuple | int, int]:
    """The tree with numbers as leaves, and the next free number."""
    if not tree:
        return at, at + 1
    inside, at = _numbered(tree[2], at)
    outside, at = _numbered(tree[3], at)
    return (tree[0], tree[1], inside, outside), at


def route(points: np.ndarray, tree: tuple | int, radius: int = RADIUS) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, positions of its points): each point's own leaf and those beyond a rim that it is close to.

    A pair within the radius on two sides of a rim has its inner point within ``radius`` below the rim,
    so it is enough that inner points visit the outer side.
    """
    todo = [(tree, np.arange(len(points)))]
    while todo:
        node, at = todo.pop()
        if isinstance(node, int):
            yield node, at
            continue
        centre, rim, inside, outside = node
        d = _distance(points[at], centre).astype(np.int64)
        for child, mine in ((inside, at[d <= rim]), (outside, at[d > rim - radius])):
            if len(mine):
                todo.append((child, mine))


def close_stars(points: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) that connect exactly the points linked by distances of at most ``radius`` within the shard."""
    rng = np.random.default_rng(len(points))
    todo = [np.unique(points)]
    a, b = [], []
    while todo:
        own = todo.pop()
        halves = _split(own, rng) if len(own) > BLOCK else None
        if halves:
            d = _distance(own, halves[0]).astype(np.int64)
            todo += [own[d <= halves[1]], own[d > halves[1] - radius]]
            continue
        for x, y in _compared(own, radius):
            a.append(x)
            b.append(y)
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return forest(np.concatenate(a), np.concatenate(b))


def _compared(own: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a block as stars; a block that no vantage point divides is compared part by part."""
    parts = [own[i : i + BLOCK] for i in range(0, len(own), BLOCK)]
    for i, x in enumerate(parts):
        linked = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
        label = smallest_linked(linked)
        moved = label != np.arange(len(x))
        if moved.any():
            yield x[moved], x[label[moved]]
        for y in parts[i + 1 :]:
            near = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
            if near.any():
                at = np.nonzero(near)
                yield forest(x[at[0]], y[at[1]])


def linked_fingerprints(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` (long) whose components are those of all links."""
    spark = points.sparkSession
    count = points.count()
    leaves = min(MAX_SHARDS, max(4 * shuffle_partitions(spark), count // POINTS_PER_SHARD))
    # chosen by hash: about SAMPLE points whatever their number, and the same ones on every run
    share = min(1.0, SAMPLE / max(count, 1))
    sample = np.sort(points.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 32)) < int(share * (1 << 32))).select("fp").toPandas()["fp"].to_numpy(np.int64))
    tree, shards = _numbered(grow(sample.view(np.uint64), leaves, np.random.default_rng(SEED)))

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            own = batch.column(0).to_numpy().view(np.uint64)
            for leaf, at in route(own, tree, radius):
                yield pa.record_batch([pa.array(np.full(len(at), leaf, np.int32)), pa.array(own[at].view(np.int64))], names=["shard", "fp"])

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        a, b = close_stars(part["fp"].to_numpy(np.int64).view(np.uint64), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return points.select("fp").mapInArrow(deal, "shard int, fp long").groupBy("shard").applyInPandas(compare, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``mark`` (a hash of the text), ``fp`` (fingerprint as a long), ``component_id``.

    Documents link when their fingerprints differ in at most ``radius`` bits; ``component_id`` is the
    smallest id reachable over links. Text is lower-cased (A-Z) and split at ASCII blanks; a text with fewer
    words than a shingle is one shingle. Null, empty and blank texts have fingerprint 0 and link like any
    other. Repeated rows share a component; null ids do not count as smallest unless a component has
    no other, and then its ``component_id`` is null. No rows give no rows.
    """
    return simhash_roots(docs, id_col, text_col, shingle, radius).select("id", "mark", "fp", "component_id")


def simhash_roots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``simhash_components`` with the ``root`` of every component: one of its fingerprints."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    ids = cut(fingerprints(texts, "text", "fp", shingle).select("id", F.xxhash64("text").alias("mark"), "fp"))
    points = cut(ids.groupBy("fp").agg(F.min("id").alias("least")))
    found = components(linked_fingerprints(points, radius)).withColumnRenamed("node", "fp")
    roots = points.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    by_point = roots.join(named, "root").select("fp", "root", "component_id")
    return ids.join(by_point, "fp").select("id", "mark", "fp", "root", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of every component: that of the smallest id (repeated rows count once)."""
    found = simhash_components(docs, id_col, text_col, shingle, radius)
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "mark")).alias("first")
    root = F.struct(F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fp")).alias("fp"))
    stay = found.groupBy(root.alias("root")).agg(first).select(F.col("first.id").alias("stay_id"), F.col("first.mark").alias("stay_mark")).distinct()
    keyed = docs.select(whole_row(docs), F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("mark"))
    met = keyed.join(stay, keyed["id"].eqNullSafe(stay["stay_id"]) & (keyed["mark"] == stay["stay_mark"]), "left_semi")
    once = met.groupBy("id", "mark").agg(F.first("row").alias("row"))  # same keys as the join: no further shuffle
    return unpacked(once, "row", docs.columns, {})
