"""Embedding near-duplicates by cross-polytope hashing.

1. Equal vectors become one class with its number of copies.
2. Every class is hashed by several tables. A hash is made of a few functions, each three rounds of random signs and a
   fast Hadamard transform, then the largest coordinate and its sign: the nearest corner of a cross-polytope.
3. A class stands in its own bucket of each table and visits the buckets where one function takes the
   runner-up corner (multiprobe). Buckets are compared in square cells of bounded size with exact cosines.
4. A pair that meets more than once counts where it meets first. Cells hand on sums of links and
   spanning stars, never their pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import batches_of, shuffle_partitions, unpacked, whole_row
from codestrata.llm.components import components, forest
from codestrata.session import cut

THRESHOLD = 0.9
BLOCK = 1024  # classes on a side of a cell
ROUNDS = 3
SEED = 42
CORNERS = 128


def hash_size(classes: int) -> tuple[int, int]:
    """(functions per hash, tables) for so many classes.

    Buckets of a table should outnumber the classes divided by 64. A pair at cosine 0.9 meets in a table with probability
    0.49 for two functions, 0.29 for three (64 dimensions, probes included); the tables double with every function, so that more than
    0.99 of such pairs meet somewhere.
    """
    functions = max(2, math.ceil(math.log(max(classes, 1) / 64) / math.log(CORNERS)) if classes > 64 else 2)
    return functions, 2 ** (functions + 1)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of every row; the width is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        pairs = x.reshape(-1, n // (2 * step), 2, step)
        x = np.concatenate((pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]), axis=2).reshape(-1, n)
        step *= 2
    return x


def corners(x: np.ndarray, number: int, seed: int = SEED) -> np.ndarray:
    """(n, 2): nearest and second nearest corner of every row after the rotation of that number."""
    width = max(2, 1 << (x.shape[1] - 1).bit_length())
    turned = np.zeros((len(x), width))
    turned[:, : x.shape[1]] = x
    rng = np.random.default_rng([seed, number, width])
    for _ in range(ROUNDS):
        turned = hadamard(turned * rng.choice([-1.0, 1.0], width))
    size = np.abs(turned)
    best = size.argmax(axis=1)
    rows = np.arange(len(x))
    size[rows, best] = -1
    both = np.stack((best, size.argmax(axis=1)), axis=1)
    return 2 * both + (np.take_along_axis(turned, both, axis=1) < 0)


def buckets(x: np.ndarray, functions: int, tables: int) -> np.ndarray:
    """(n, tables, 1 + functions) bucket numbers: the own one and those visited."""
    base = 2 * max(2, 1 << (x.shape[1] - 1).bit_length())
    out = np.empty((len(x), tables, 1 + functions), np.int64)
    for t in range(tables):
        found = [corners(x, t * functions + k) for k in range(functions)]
        for probe in range(1 + functions):
            code = np.zeros(len(x), np.int64)
            for k in range(functions):
                code = code * base + found[k][:, 1 if probe == k + 1 else 0]
            out[:, t, probe] = code
    return out


def _scaled(x: np.ndarray) -> np.ndarray:
    """Unit vectors, in doubles; scaled by the largest component first so that nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linked_pairs(x: np.ndarray, codes: np.ndarray, table: int, bucket: int, sides: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the linked pairs of a cell that meet here first.

    ``sides`` tells the two blocks of a cell off the diagonal apart; only pairs across them count there.
    """
    own = codes[:, table, 0] == bucket
    near = np.triu(x @ x.T >= threshold, 1) & (own[:, None] | own[None, :])
    if sides is not None:
        near &= sides[:, None] != sides[None, :]
    i, j = np.nonzero(near)
    a, b = codes[i], codes[j]
    visits = lambda p, q, t: (p[:, t, :1] == q[:, t]).any(axis=1)  # noqa: E731  whether q stands in or visits the own bucket of p
    for t in range(table):
        new = ~(visits(a, b, t) | visits(b, a, t))
        i, j, a, b = i[new], j[new], a[new], b[new]
    at_a, at_b = visits(a, b, table), visits(b, a, table)
    first = np.where(at_a & at_b, np.minimum(a[:, table, 0], b[:, table, 0]), np.where(at_a, a[:, table, 0], b[:, table, 0]))
    here = first == bucket
    return i[here], j[here]


def usable(vector: Column) -> Column:
    """Whether a vector has numbers only, finite ones, and not all zero."""
    odd = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(~odd & F.exists(vector, lambda v: v != 0), F.lit(False))


def _links(classes: DataFrame, functions: int, tables: int, threshold: float, block: int) -> DataFrame:
    """(a, b, links): sums of links for classes (b null) and edges (links null)."""
    spark = classes.sparkSession

    def hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it, 2048):
            vectors = b.column(2).to_pylist()
            size = np.array([len(v) for v in vectors])
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                x = np.array([vectors[i] for i in at], np.float64)
                codes = buckets(_scaled(x), functions, tables)
                pick = pa.array(at)
                yield pa.record_batch(
                    [
                        b.column(0).take(pick),
                        b.column(1).take(pick),
                        pa.array([d] * len(at), pa.int32()),
                        pa.array([r.tobytes() for r in x], pa.binary()),
                        pa.array([r.tobytes() for r in codes], pa.binary()),
                        pa.array(list(codes.reshape(len(at), -1)), pa.list_(pa.int64())),
                    ],
                    names=["cid", "copies", "dim", "x", "codes", "list"],
                )

    rows = classes.select("cid", "copies", F.col("x").cast("array<double>").alias("x")).mapInArrow(
        hashed, "cid long, copies long, dim int, x binary, codes binary, list array<long>"
    )
    rows = cut(rows)
    entries = rows.select("cid", "copies", "dim", "x", "codes", F.posexplode("list").alias("no", "bucket"))
    entries = entries.withColumn("table", F.floor(F.col("no") / (1 + functions)).cast("int")).drop("no")
    key = ["dim", "table", "bucket"]
    # buckets beyond one block are dealt to blocks, and every two blocks meet in a cell of their own
    narrow = rows.select("dim", F.posexplode("list").alias("no", "bucket")).withColumn("table", F.floor(F.col("no") / (1 + functions)).cast("int"))
    large = cut(narrow.groupBy(*key).agg(F.count("*").alias("size")).where(F.col("size") > block).withColumn("blocks", F.ceil(F.col("size") / block).cast("int")))
    placed = entries.join(large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("side", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("cid", "copies", "dim", "x", "codes", "table", "bucket", "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))
    cell = [*key, "low", "high"]
    dealt = placed.repartition(4 * shuffle_partitions(spark), *cell).sortWithinPartitions(*cell)

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(now: tuple, held: list[dict]) -> pa.RecordBatch | None:
            dim, table, bucket, low, high = now
            if len(held) < 2:
                return None
            x = _scaled(np.frombuffer(b"".join(r["x"] for r in held), np.float64).reshape(-1, dim))
            codes = np.frombuffer(b"".join(r["codes"] for r in held), np.int64).reshape(len(held), tables, 1 + functions)
            sides = None if low == high else np.array([r["side"] for r in held])
            i, j = linked_pairs(x, codes, table, bucket, sides, threshold)
            if not len(i):
                return None
            cid, copies = np.array([r["cid"] for r in held]), np.array([r["copies"] for r in held])
            sums = np.zeros(len(held), np.int64)
            np.add.at(sums, i, copies[j])
            np.add.at(sums, j, copies[i])
            told = np.flatnonzero(sums)
            a, b = forest(cid[i], cid[j])
            k = len(told)
            return pa.record_batch(
                [
                    pa.array(np.concatenate((cid[told], a))),
                    pa.array([None] * k + b.tolist(), pa.int64()),
                    pa.array(sums[told].tolist() + [None] * len(b), pa.int64()),
                ],
                names=["a", "b", "links"],
            )

        now, held = None, []
        for batch in it:
            for row in batch.to_pylist():
                at = (row["dim"], row["table"], row["bucket"], row["low"], row["high"])
                if at != now:
                    if held and (made := result(now, held)) is not None:
                        yield made
                    now, held = at, []
                held.append(row)
        if held and (made := result(now, held)) is not None:
            yield made

    return dealt.mapInArrow(compare, "a long, b long, links long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``vectors`` plus ``n_links``, ``component_id`` and ``kept``; input columns of those names are replaced.

    Vectors link when their cosine, in doubles, is at least ``threshold`` and hashing lets them meet (see ``hash_size``); ``n_links``
    counts the other rows linked directly, equal vectors included, ``component_id`` is the smallest id reachable, itself
    included, and ``kept`` tells whether that is the row's own. Vectors that are null, empty, all zero or hold null or
    non-finite numbers link with nothing and are their own component. Vectors of different lengths do not link.
    Repeated rows link as any equal vectors do. Null ids never name a component that has another id.
    """
    vector = F.col(f"`{vector_col}`")
    rows = vectors.select(whole_row(vectors), F.col(f"`{id_col}`").cast("long").alias("id"), F.when(usable(vector), vector).alias("x"))
    grouped = rows.where(F.col("x").isNotNull()).groupBy("x").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    classes = cut(grouped.withColumn("cid", F.monotonically_increasing_id()))  # written once, so the numbers stay
    functions, tables = hash_size(classes.count())
    found = cut(_links(classes, functions, tables, threshold, block))
    links = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    roots = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "cid")
    named = classes.join(links, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("x", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), "component_id")
    met = rows.join(named, "x", "left")
    component = F.when(F.col("x").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return unpacked(
        met,
        "row",
        vectors.columns,
        {"n_links": F.coalesce("n", F.lit(0)).cast("long"), "component_id": component, "kept": component.eqNullSafe(F.col("id"))},
    )
