"""Clustering of every problem at once: k-means, spectral (one or several views), agglomerative.

Large problems go through rounds of Spark jobs over all of them, which pass centres, vectors or cluster sums to the rows.
Blocks and stripes only place the rows; their size changes no result. A problem of up to ``WHOLE`` blocks is solved in one task
by the same rule, without a table of all its pairs. No task ever holds a whole large problem and no pair table is written.

All clusterings take ``points(problem, index, x)`` and ``ks(problem, k)`` and give
``(problem, index, cluster)`` with clusters numbered from 0 by their smallest index.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.arrays import as_double, dot
from codestrata.operators.search import _best
from codestrata.scale import salted_join
from codestrata.session import cut, dropped

BLOCK = 2048  # rows of one problem of which a task may hold a table of all pairs
WHOLE = 8  # blocks of one problem that a task may hold without such a table
VALUES = 1 << 22  # numbers of one problem that k-means, which needs no pairs, may hold in a task
DIGITS = 9  # distances are compared after rounding
TILE = 256  # rows of either side whose products are worked out at once, so that they fit a core's cache
STRIPES = 8  # stripes of a large problem on either side of a grid, as long as they hold at most so many blocks of rows


def known_k(labelled: DataFrame) -> DataFrame:
    """k per problem = number of distinct labels."""
    return labelled.select("problem", "label").distinct().groupBy("problem").agg(F.count(F.lit(1)).cast("int").alias("k"))


# ---- local numerics on one bounded block ---------------------------------------------------------


def _matrix(col) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in col])


def _sq_dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.round(np.maximum(d, 0), DIGITS)


LISTED = 16  # most similar clusters that are remembered of every cluster


def _mutual_merges(sums: np.ndarray, sizes: np.ndarray, ids: np.ndarray):
    """Average-linkage merges of unit-vector sums as (parent, child, height, round); ``ids`` rise.

    The mean cosine between two clusters is the dot product of their mean vectors, so
    sums and sizes are enough. All mutual nearest neighbours merge in one round.

    Every cluster remembers its most similar ones and a bound on all others. A merged cluster is no more similar to a third one than the
    more similar of its parts was, so the bound holds on: products are only worked out anew with what has merged, and a cluster is compared with all
    others only if it has merged or nothing on its list is above its bound.
    """
    m, merges, level = len(ids), [], 0
    mean = sums / sizes[:, None]
    near = np.zeros((m, LISTED + 1), np.int64)
    value = np.full((m, LISTED + 1), -np.inf)
    bound, best, top = np.full(m, -np.inf), np.zeros(m, np.int64), np.full(m, -np.inf)
    alive = np.arange(m)

    def compare(rows: np.ndarray) -> None:
        for at in range(0, len(rows), TILE):
            own = rows[at : at + TILE]
            _, other, sim = _best(own, mean[own], alive, mean[alive], LISTED + 1)
            other, sim = other.reshape(len(own), -1), sim.reshape(len(own), -1)
            listed = other.shape[1]
            bound[own] = sim[:, -1] if listed < len(alive) else -np.inf
            sim = np.where(other == own[:, None], -np.inf, sim)
            near[own], value[own] = own[:, None], -np.inf
            near[own, :listed], value[own, :listed] = other, sim
            first = (np.arange(len(own)), sim.argmax(1))  # of equal ones the smallest comes first
            best[own], top[own] = other[first], sim[first]

    compare(alive)
    while len(alive) > 1:
        level += 1
        a = alive[(best[best[alive]] == alive) & (alive < best[alive])]
        if not len(a):  # products that differ in the last digit by the order of their factors
            most = alive[top[alive].argmax()]
            a, b = np.array([min(most, best[most])]), np.array([max(most, best[most])])
            top[a] = top[most]
        else:
            b = best[a]
        merges += [(ids[i], ids[j], 1.0 - sim, level) for i, j, sim in zip(a, b, top[a])]
        sums[a] += sums[b]
        sizes[a] += sizes[b]
        mean[a] = sums[a] / sizes[a][:, None]
        into, merged = np.arange(m), np.zeros(m, dtype=bool)
        into[b], merged[a], merged[b] = a, True, True
        gone = np.zeros(m, dtype=bool)
        gone[b] = True
        alive = alive[~gone[alive]]
        others = alive[~merged[alive]]
        at, col = np.nonzero(merged[near[others]])
        rows = others[at]
        lost = merged[best[others]]
        near[rows, col] = into[near[rows, col]]
        for i in range(0, len(rows), BLOCK * WHOLE):
            r, c = rows[i : i + BLOCK * WHOLE], col[i : i + BLOCK * WHOLE]
            value[r, c] = np.round(np.einsum("ij,ij->i", mean[r], mean[near[r, c]]), DIGITS)
        changed = np.unique(at)
        rows, lost = others[changed], lost[changed]
        top[rows] = value[rows].max(1)
        best[rows] = np.where(value[rows] == top[rows][:, None], near[rows], m).min(1)
        compare(np.concatenate([a, rows[lost & (top[rows] <= bound[rows] + 2 * 10.0**-DIGITS)]]))
    return merges


# ---- blocks -------------------------------------------------------------------------------------


def _sized(points: DataFrame, ks: DataFrame) -> DataFrame:
    """Points with k and the number of rows of their problem."""
    sizes = points.groupBy("problem").agg(F.count(F.lit(1)).alias("__n")).join(ks, "problem")
    return salted_join(points, sizes, ["problem"], spread=["index"])


def _blocks(sized: DataFrame, block: int) -> DataFrame:
    """Problems cut into blocks, placed by block and kept; the rounds then move only the other side.

    Blocks lost with an executor come back from the written table below the cache.
    """
    n = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = sized.withColumn("__block", F.pmod(F.xxhash64("index"), F.ceil(F.col("__n") / block)).cast("int"))
    pts = cut(cells).repartition(n, "problem", "__block").persist()
    pts.count()  # the planner knows the placement of a cache only once it is filled
    return pts


def _meet(pts: DataFrame, other: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``fn(rows of a block, rows of ``other`` for its problem)`` for every block."""
    cells = pts.select(F.col("problem").alias("__p"), F.col("__block").alias("__b")).distinct()
    there = cells.join(other.withColumnRenamed("problem", "__p"), "__p")
    return pts.groupBy("problem", "__block").cogroup(there.groupBy("__p", "__b")).applyInPandas(fn, schema)


def _stripes(n: str, block: int) -> Column:
    """How many stripes a problem of ``n`` rows is cut into for a grid: its rows are copied so many times."""
    return F.least(F.ceil(F.col(n) / block), F.greatest(F.lit(STRIPES), F.ceil(F.col(n) / (STRIPES * block)))).cast("int")


def _grid(rows: DataFrame, *cols: str) -> DataFrame:
    """Rows with their stripe ``b`` of ``bs`` as cells ``(problem, r, c)`` with r <= c; ``side`` 1 holds the rows of stripe c, 0 those of r.

    A cell works for both sides, so a row goes to ``bs`` cells. The one cell of a stripe with itself has side 0 only.
    """
    other = rows.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("bs") - 1)))
    return other.select("problem", F.least("b", "__o").alias("r"), F.greatest("b", "__o").alias("c"), (F.col("__o") < F.col("b")).cast("int").alias("side"), *cols)


def _sides(own: pd.DataFrame, by: str) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    """Both sides of a cell in the order of ``by``, and whether they are one stripe."""
    a, b = (own[own["side"] == side].sort_values(by) for side in (0, 1))
    return a, b, len(own) > 0 and own["r"].iloc[0] == own["c"].iloc[0]


def _renumber(assign: DataFrame) -> DataFrame:
    """Clusters numbered by their smallest index; works on one row per cluster."""
    firsts = assign.groupBy("problem", "cluster").agg(F.min("index").alias("first"))
    w = Window.partitionBy("problem").orderBy("first")  # k rows per problem
    numbers = firsts.select("problem", "cluster", (F.row_number().over(w) - 1).cast("int").alias("number"))
    return salted_join(assign, numbers, ["problem", "cluster"], spread=["index"]).select("problem", "index", F.col("number").alias("cluster"))


def _vector_sum(col: str):
    return vector_to_array(Summarizer.sum(array_to_vector(F.col(col))))


# ---- k-means ------------------------------------------------------------------------------------


def seed_centers(points: DataFrame, ks: DataFrame) -> DataFrame:
    """Starting centres ``(problem, c, center)``, farthest first over all rows.

    The row with the smallest index, then k - 1 times the row farthest from all chosen ones, ties to the
    smaller index. Every round is one job for all problems that ask for so many groups.
    """
    rows = points.join(ks, "problem", "left_semi")
    first = rows.groupBy("problem").agg(F.min(F.struct("index", "x")).alias("f"))
    centers = cut(first.select("problem", F.lit(0).alias("c"), F.col("f.x").alias("center")))
    for c in range(1, ks.agg(F.max("k")).first()[0] or 0):
        wanted = rows.join(ks.filter(F.col("k") > c), "problem", "left_semi")
        far = F.min(F.struct((-F.col("distance")).alias("near"), "index", "x")).alias("f")
        chosen = assign_to_centers(wanted, centers).groupBy("problem").agg(far)
        centers = cut(centers.unionByName(chosen.select("problem", F.lit(c).alias("c"), F.col("f.x").alias("center"))))
    return centers


def lloyd_step(points: DataFrame, centers: DataFrame) -> DataFrame:
    """One assignment and update as joins and built-in aggregates: new ``(problem, c, center, n, cost)``."""
    assigned = assign_to_centers(points, centers)
    mean = vector_to_array(Summarizer.mean(array_to_vector(as_double(F.col("x")))))
    return assigned.groupBy("problem", F.col("cluster").alias("c")).agg(
        F.transform(mean, lambda v: F.round(v, 12)).alias("center"), F.count(F.lit(1)).alias("n"), F.sum("distance").alias("cost")
    )


def assign_to_centers(points: DataFrame, centers: DataFrame) -> DataFrame:
    """Nearest centre per point as ``cluster`` with its squared ``distance``, ties to the smaller number; centres travel packed."""
    packed = centers.groupBy("problem").agg(
        F.sort_array(F.collect_list(F.struct("c", "center", dot(F.col("center"), F.col("center")).alias("sq")))).alias("__cs")
    )
    near = F.array_min(
        F.transform("__cs", lambda s: F.struct(F.round(s["sq"] - 2.0 * dot(F.col("x"), s["center"]), DIGITS).alias("d"), s["c"].alias("c")))
    )
    met = salted_join(points, packed, ["problem"], spread=["index"]).withColumn("__near", near)
    distance = F.round(F.col("__near.d") + dot(F.col("x"), F.col("x")), DIGITS)
    return met.withColumn("cluster", F.col("__near.c")).withColumn("distance", F.greatest(distance, F.lit(0.0))).drop("__cs", "__near")


def _local_kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """The same starts, rounds and roundings for the rows of one problem, in the order of their indices."""
    square = (x * x).sum(1)

    def near(centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.round((centers * centers).sum(1)[None, :] - 2.0 * (x @ centers.T), DIGITS)
        at = d.argmin(1)
        return at, np.maximum(np.round(d[np.arange(len(x)), at] + square, DIGITS), 0.0)

    centers = x[:1]
    while len(centers) < k:
        centers = np.vstack([centers, x[near(centers)[1].argmax()]])
    last = None
    while True:
        at, distance = near(centers)
        new = np.vstack([np.round(x[at == c].mean(0), 12) if (at == c).any() else centers[c] for c in range(len(centers))])
        far, cost = np.abs(new - centers).max(), distance.sum()
        centers = new
        if far <= 1e-9 or (last is not None and cost >= last):
            return near(centers)[0]
        last = cost


def kmeans(points: DataFrame, ks: DataFrame, block: int | None = None) -> DataFrame:
    """Lloyd's k-means for every problem, until no centre moves or the summed squared distance falls no further.

    A problem of at most ``block`` rows, unless given as many as hold ``VALUES`` numbers, is solved in one task; larger ones go through the
    rounds of joins and aggregates. Both follow the same rule.
    """
    sized = cut(_sized(points.select("problem", "index", as_double(F.col("x")).alias("x")), ks))
    t = dict(sized.dtypes)
    if block is None:
        block = VALUES // (sized.agg(F.max(F.size("x"))).first()[0] or 1)

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("index")
        return pd.DataFrame({"problem": pdf["problem"], "index": pdf["index"], "cluster": _local_kmeans(_matrix(pdf["x"]), int(pdf["k"].iloc[0]))})

    small = sized.filter(F.col("__n") <= block).groupBy("problem").applyInPandas(local, f"problem {t['problem']}, index {t['index']}, cluster int")
    large = sized.filter(F.col("__n") > block).select("problem", "index", "x")
    if large.isEmpty():
        return _renumber(cut(small))
    return _renumber(cut(small.unionByName(_large_kmeans(large, ks))))


def _large_kmeans(pts: DataFrame, ks: DataFrame) -> DataFrame:
    centers = seed_centers(pts, ks.join(pts.select("problem").distinct(), "problem", "left_semi"))
    last = None
    while True:
        step = lloyd_step(pts, centers).select("problem", "c", F.col("center").alias("new"), "cost")
        moved = cut(centers.join(step, ["problem", "c"], "left").withColumn("new", F.coalesce("new", "center")))
        shift = F.array_max(F.zip_with("new", "center", lambda a, b: F.abs(a - b)))
        far, cost = moved.agg(F.max(shift), F.sum("cost")).first()
        centers = moved.select("problem", "c", F.col("new").alias("center"))
        if far is None or far <= 1e-9 or (last is not None and cost >= last):
            break
        last = cost
    return assign_to_centers(pts, centers).select("problem", "index", "cluster")


# ---- spectral -----------------------------------------------------------------------------------

EXTRA = 6  # vectors iterated beyond the k that are asked for
POWERS = 4  # products with the affinity between two projections
RESIDUAL = 1e-7  # of a wanted eigenvector, relative to its length; a product with the affinity no longer turns it
ROUGH = 1e-4  # residuals above it are brought down by products in single precision, as long as each projection halves them
MAX_PROJECTIONS = 60  # beyond it the space is as good as its eigenvalues can be told apart


def spectral(points: DataFrame, ks: DataFrame, gamma: float = 1.0, block: int = BLOCK, whole: int | None = None) -> DataFrame:
    """Spectral clustering with an RBF affinity."""
    return multiview_spectral(points.select("problem", "index", F.col("x").alias("x0")), ks, gamma, block, whole)


def _affinity(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * _sq_dist(a, b))


def _affinity_times(
    a: np.ndarray, b: np.ndarray, gamma: float, right: np.ndarray, left: np.ndarray | None = None, kind: type = np.float64
) -> tuple[np.ndarray, np.ndarray | None]:
    """The affinity of ``a`` and ``b`` times ``right``, and its transpose times ``left`` if given; only a tile of it is there at a time.

    Where ``a`` is ``b`` every pair of tiles is worked out once for both sides. Tiles are of the precision ``kind``, sums are double.
    """
    one = a is b
    out = np.zeros((len(a), right.shape[1]))
    back = out if one else None if left is None else np.zeros((len(b), left.shape[1]))
    right = right.astype(kind)
    left = right if one or left is None else left.astype(kind)
    ones = [np.ones((len(x), 1)) for x in (a, b)]
    square = [gamma * (x * x).sum(1)[:, None] for x in (a, b)]
    # one product gives minus gamma times the squared distance
    first = np.hstack([2 * gamma * a, -square[0], -ones[0]]).astype(kind)
    second = np.hstack([b, ones[1], square[1]]).astype(kind)
    for i in range(0, len(a), TILE):
        for j in range(i if one else 0, len(b), TILE):
            d = first[i : i + TILE] @ second[j : j + TILE].T
            np.minimum(d, 0, out=d)
            np.exp(d, out=d)
            out[i : i + TILE] += d @ right[j : j + TILE]
            if back is not None and not (one and i == j):
                back[j : j + TILE] += d.T @ left[i : i + TILE]
    return out, back


def _start(seeds: np.ndarray, width: int) -> np.ndarray:
    """Numbers in -1 to 1 that hang on the seed of a row only."""
    with np.errstate(over="ignore"):
        z = seeds.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z ^ (z >> np.uint64(31))) / 2.0**63 - 1.0


def _precision(off: float, before: float) -> type:
    """That of the next products, from the residuals of the last two projections (infinite at first); double does not go back to single."""
    return np.float32 if off > ROUGH and (off < before / 2 or off == np.inf) else np.float64


def _projection(ss: np.ndarray, sq: np.ndarray, qq: np.ndarray, k: int, kind: type = np.float64) -> tuple[np.ndarray, float]:
    """Coefficients of the best vectors in the space of the columns of s, and how far the k wanted ones are from standing; q is the affinity times s.

    Directions in which s hardly reaches beyond the error of products of the precision ``kind`` are left out.
    """
    scale = 1 / np.sqrt(np.maximum(np.diag(ss), 1e-300))
    ss, sq, qq = (a * scale[:, None] * scale[None, :] for a in (ss, sq, qq))
    val, vec = np.linalg.eigh((ss + ss.T) / 2)
    use = val > val[-1] * (1e-11 if kind is np.float64 else 1e-9)
    basis = vec[:, use] / np.sqrt(val[use])
    ritz, turn = np.linalg.eigh(basis.T @ ((sq + sq.T) / 2) @ basis)
    keep = min(k + EXTRA, len(ritz))
    ritz, coef = ritz[::-1][:keep], (basis @ turn)[:, ::-1][:, :keep]
    first = coef[:, :k]
    # |Av - lv|^2 of unit vectors v
    off = np.diag(first.T @ qq @ first) - 2 * ritz[:k] * np.diag(first.T @ sq @ first) + ritz[:k] ** 2
    return coef * scale[:, None], float(np.sqrt(max(off.max(), 0.0)))


def _iterated(xs: list[np.ndarray], seeds: np.ndarray, k: int, gamma: float) -> tuple[np.ndarray, np.ndarray]:
    """The k leading eigenvectors of the averaged normalised affinity of the rows, and the averaged roots of their degrees."""
    roots = [np.sqrt(_affinity_times(x, x, gamma, np.ones((len(x), 1)))[0]) for x in xs]
    v, off, kind = _start(seeds, k + EXTRA), np.inf, np.float32
    for _ in range(MAX_PROJECTIONS):
        steps = [v]
        for _ in range(POWERS):
            steps.append(sum(_affinity_times(x, x, gamma, steps[-1] / root, kind=kind)[0] / root for x, root in zip(xs, roots)) / len(xs))
        s, q = np.hstack(steps[:-1]), np.hstack(steps[1:])
        before = off
        coef, off = _projection(s.T @ s, s.T @ q, q.T @ q, k, kind)
        v = s @ coef
        if kind is np.float64 and off <= RESIDUAL:
            break
        kind = _precision(off, before) if kind is np.float32 else kind
    return v[:, :k], sum(roots)[:, 0] / len(roots)


def multiview_spectral(points: DataFrame, ks: DataFrame, gamma: float = 1.0, block: int = BLOCK, whole: int | None = None) -> DataFrame:
    """Spectral clustering of aligned views ``x0, x1, ...``: the normalised affinities are averaged.

    The affinity exp(-gamma d^2) of all rows of a problem counts, a row with itself included. Rows are embedded by the k leading eigenvectors of
    the averaged affinity, divided by the roots of their degrees (averaged over the views), and grouped by k-means. A problem of at most ``block``
    rows is embedded from its whole matrix; for larger ones block products of the affinity are summed until the eigenvectors stand, in one task up to
    ``whole`` rows (``WHOLE`` blocks) and over a grid of stripes beyond.
    """
    whole = whole or WHOLE * block
    cols = [c for c in points.columns if c.startswith("x") and c[1:].isdigit()]
    sized = cut(_sized(points.select("problem", "index", *cols), ks)).withColumn("__seed", F.xxhash64("index"))
    t = dict(sized.dtypes)

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("index")
        xs, k = [_matrix(pdf[c]) for c in cols], int(pdf["k"].iloc[0])
        if len(pdf) > block:
            vec, degree = _iterated(xs, pdf["__seed"].to_numpy(), k, gamma)
        else:
            total, roots = 0.0, []
            for x in xs:
                a = _affinity(x, x, gamma)
                root = np.sqrt(a.sum(1))
                total, roots = total + a / root[:, None] / root[None, :], [*roots, root]
            vec, degree = np.linalg.eigh(total / len(cols))[1][:, ::-1][:, :k], np.mean(roots, axis=0)
        out = vec / degree[:, None] * np.sqrt(len(pdf))
        return pd.DataFrame({"problem": pdf["problem"], "index": pdf["index"], "x": list(out)})

    schema = f"problem {t['problem']}, index {t['index']}, x array<double>"
    rows = sized.filter(F.col("__n") <= whole).groupBy("problem").applyInPandas(local, schema)
    large = sized.filter(F.col("__n") > whole)
    if not large.isEmpty():
        rows = rows.unionByName(_embedded(large, cols, gamma, block))
    return kmeans(cut(rows), ks)


def _numbers(packed: pa.Scalar, rows: int) -> np.ndarray:
    """A packed matrix of so many rows."""
    return np.frombuffer(packed.as_buffer(), np.float64).reshape(rows, -1)


def _embedded(sized: DataFrame, cols: list[str], gamma: float, block: int) -> DataFrame:
    """The embedding of problems of any size: block Krylov iteration over a grid of stripes.

    A stripe is one row with its matrices packed. A cell of the grid holds two stripes of one problem, so it is bounded, and every product with the
    affinity passes only vectors of a few numbers per row to the cells and sums what they give. After some products the rows are projected on the
    best vectors of the space that these span (a small eigenvalue problem per problem), until the wanted ones no longer turn.
    """
    n = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = dict(sized.dtypes)
    types = {"problem": t["problem"], "index": f"array<{t['index']}>", "b": "int", "bs": "int", "k": t["k"], "m": "long", "d": "binary", "v": "binary", "h": "binary"}
    typed = lambda *names: ", ".join(f"{c} {types.get(c, 'binary')}" for c in names)
    stripes, views = _stripes("__n", block), len(cols)

    def pack(own: pa.Table) -> pa.Table:
        own = own.sort_by("index")
        out = {c: own[c].slice(0, 1) for c in ("problem", "b", "bs", "k")}
        out["m"] = pa.array([own.num_rows], pa.int64())
        out["index"] = pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), own["index"].combine_chunks())
        out["v"] = [_start(own["__seed"].to_numpy(), own["k"][0].as_py() + EXTRA).tobytes()]
        return pa.table(out | {c: [own[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).tobytes()] for c in cols})

    placed = sized.withColumn("b", F.pmod("__seed", stripes).cast("int")).withColumn("bs", stripes)
    rows = cut(placed.groupBy("problem", "b").applyInArrow(pack, typed("problem", "b", "bs", "k", "m", "index", "v", *cols)))
    grid = _grid(rows, "m", *cols).repartition(n, "problem", "r", "c").persist()
    grid.count()

    def product(state: DataFrame, kind: type, first: bool) -> DataFrame:
        """The state after a product: its vectors come to those before them, and the products take their place. The first one finds the roots of the degrees."""
        there = _grid(state, "d", "v").withColumnRenamed("problem", "p")

        def cell(own: pa.Table, vectors: pa.Table) -> pa.Table:
            at, there = ({side: i for i, side in enumerate(x["side"].to_pylist())} for x in (own, vectors))
            one = own.num_rows > 0 and own["r"][0] == own["c"][0]
            if 0 not in at or not (one or 1 in at):
                return pa.table({"problem": own["problem"].slice(0, 0), "b": pa.array([], pa.int32()), "y": pa.array([], pa.binary())})
            m = {side: own["m"][i].as_py() for side, i in at.items()}
            xs = {side: [_numbers(own[c][i], m[side]) for c in cols] for side, i in at.items()}
            if first:
                v, d = ({side: np.ones((m[side], w)) for side in at} for w in (1, views))
            else:
                v, d = ({side: _numbers(vectors[c][i], m[side]) for side, i in there.items()} for c in ("v", "d"))
            made: dict[int, list] = {side: [] for side in at}
            for i in range(views):
                scaled = {side: v[side] / d[side][:, i : i + 1] for side in at}
                got = _affinity_times(xs[0][i], xs[0][i] if one else xs[1][i], gamma, scaled[0 if one else 1], None if one else scaled[0], kind)
                for side in at:
                    made[side].append(got[side] / d[side][:, i : i + 1])
            y = [(np.hstack(made[side]) if first else sum(made[side]) / views).tobytes() for side in at]
            return pa.table({"problem": own["problem"].take(pa.array([0] * len(y))), "b": pa.array([own["c" if side else "r"][0].as_py() for side in at], pa.int32()), "y": y})

        def step(own: pa.Table, parts: pa.Table) -> pa.Table:
            y = sum(_numbers(p, own["m"][0].as_py()) for p in parts["y"].combine_chunks())
            kept = own.select(["problem", "b", "bs", "k", "m"])
            if first:
                return kept.append_column("d", [[np.sqrt(y).tobytes()]]).append_column("v", own["v"]).append_column("h", [[b""]])
            before = own["h"][0].as_py() + own["v"][0].as_py()
            return kept.append_column("d", own["d"]).append_column("v", [[y.tobytes()]]).append_column("h", [[before]])

        made = grid.groupBy("problem", "r", "c").cogroup(there.groupBy("p", "r", "c")).applyInArrow(cell, typed("problem", "b", "y"))
        met = state.groupBy("problem", "b").cogroup(made.withColumnRenamed("problem", "p").groupBy("p", "b"))
        return cut(met.applyInArrow(step, typed("problem", "b", "bs", "k", "m", "d", "v", "h")))

    def space(row: dict) -> tuple[np.ndarray, np.ndarray]:
        """The vectors since the last projection, and the affinity times them."""
        m = row["m"].as_py()
        every = [x.reshape(m, -1) for x in np.split(np.frombuffer(row["h"].as_buffer(), np.float64), POWERS)] + [_numbers(row["v"], m)]
        return np.hstack(every[:-1]), np.hstack(every[1:])

    def grams(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                s, q = space({c: batch.column(c)[i] for c in ("m", "h", "v")})
                g = np.concatenate([(s.T @ s).ravel(), (s.T @ q).ravel(), (q.T @ q).ravel()])
                yield pa.record_batch({"problem": batch.column("problem").slice(i, 1), "k": batch.column("k").slice(i, 1), "g": pa.array([g], pa.list_(pa.float64()))})

    def projected(kind: type):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            flat = np.asarray(pdf["g"].iloc[0])
            m = int(np.sqrt(len(flat) // 3))
            coef, off = _projection(*flat.reshape(3, m, m), int(pdf["k"].iloc[0]), kind)
            return pd.DataFrame({"problem": [pdf["problem"].iloc[0]], "coef": [coef.tobytes()], "off": [off]})

        return run

    def turned(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.slice(i, 1)
                s, _ = space({c: own.column(c)[0] for c in ("m", "h", "v")})
                v = s @ _numbers(own.column("coef")[0], s.shape[1])
                yield pa.record_batch({c: own.column(c) for c in ("problem", "b", "bs", "k", "m", "d")} | {"v": pa.array([v.tobytes()], pa.binary()), "h": pa.array([b""], pa.binary())})

    empty = F.lit(b"").alias("d"), F.lit(b"").alias("h")
    now = product(rows.select("problem", "b", "bs", "k", "m", "v", *empty), np.float64, True)
    off, kind = np.inf, np.float32
    for _ in range(MAX_PROJECTIONS):
        for _ in range(POWERS):
            now, was = product(now, kind, False), now
            dropped(was)
        per_problem = now.mapInArrow(grams, f"problem {t['problem']}, k {t['k']}, g array<double>").groupBy("problem", "k").agg(_vector_sum("g").alias("g"))
        best = cut(per_problem.groupBy("problem").applyInPandas(projected(kind), f"problem {t['problem']}, coef binary, off double"))
        now, was = cut(now.join(best.select("problem", "coef"), "problem").mapInArrow(turned, typed("problem", "b", "bs", "k", "m", "d", "v", "h"))), now
        before, off = off, best.agg(F.max("off")).first()[0]
        dropped(was)
        if kind is np.float64 and off <= RESIDUAL:
            break
        kind = _precision(off, before) if kind is np.float32 else kind
    grid.unpersist()

    def unpack(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                m, k = batch.column("m")[i].as_py(), batch.column("k")[i].as_py()
                x = _numbers(batch.column("v")[i], m)[:, :k] / _numbers(batch.column("d")[i], m).mean(1)[:, None] * np.sqrt(batch.column("n")[i].as_py())
                x = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.record_batch({"problem": batch.column("problem").take(pa.array(np.full(m, i))), "index": batch.column("index")[i].values, "x": x})

    sizes = rows.groupBy("problem").agg(F.sum("m").alias("n"))
    met = now.select("problem", "b", "k", "m", "d", "v").join(rows.select("problem", "b", "index"), ["problem", "b"]).join(sizes, "problem")
    return met.mapInArrow(unpack, f"problem {t['problem']}, index {t['index']}, x array<double>")


# ---- agglomerative ------------------------------------------------------------------------------


def agglomerative(points: DataFrame, ks: DataFrame, block: int = BLOCK, whole: int | None = None) -> DataFrame:
    """Average linkage on cosine distance, cut at k clusters.

    The mean cosine between two clusters is the dot product of their mean unit vectors, so sums and sizes are enough. Rounds of
    mutual nearest-neighbour merges give exactly the average-linkage tree, whatever their order; then one cut over all merge
    heights. Nearest neighbours come from a grid of block products. A problem leaves the rounds as soon as it has at most ``whole``
    clusters (``WHOLE`` blocks), and the same merges go on in one task: that bounds the rounds, not the result.
    """
    whole = whole or WHOLE * block
    sized = cut(_sized(points.select("problem", "index", "x"), ks))
    t = dict(sized.dtypes)
    length = F.sqrt(dot(F.col("x"), F.col("x")))
    state = cut(
        sized.withColumn("__len", F.greatest(length, F.lit(1e-300))).select(
            "problem", F.col("index").alias("cid"), F.transform("x", lambda v: v.cast("double") / F.col("__len")).alias("s"), F.lit(1.0).alias("w")
        )
    )
    schema = f"problem {t['problem']}, parent {t['index']}, child {t['index']}, height double, level int"
    merges: DataFrame | None = None
    level = 0

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid")
        got = _mutual_merges(_matrix(pdf["s"]), pdf["w"].to_numpy().copy(), pdf["cid"].to_numpy())
        out = pd.DataFrame(got, columns=["parent", "child", "height", "level"])
        out.insert(0, "problem", pdf["problem"].iloc[0])
        out["level"] += 1_000_000
        return out

    while True:
        sizes = state.groupBy("problem").agg(F.count(F.lit(1)).alias("m"))
        state = cut(salted_join(state.drop("m"), sizes, ["problem"], spread=["cid"]))
        done = state.filter(F.col("m") <= whole).groupBy("problem").applyInPandas(finish, schema)
        merges = done if merges is None else merges.unionByName(done)
        state = state.filter(F.col("m") > whole)
        if state.isEmpty():
            break
        level += 1
        nn = cut(_nearest_clusters(state, block, t))
        back = nn.select("problem", F.col("other").alias("cid"), F.col("cid").alias("other"))
        mutual = cut(nn.join(back, ["problem", "cid", "other"], "left_semi").filter(F.col("cid") < F.col("other")))
        merges = merges.unionByName(
            mutual.select("problem", F.col("cid").alias("parent"), F.col("other").alias("child"), (1.0 - F.col("sim")).alias("height"), F.lit(level).alias("level"))
        )
        absorbed = mutual.select("problem", F.col("other").alias("cid"), F.col("cid").alias("into"))
        state = cut(
            state.join(absorbed, ["problem", "cid"], "left")
            .select("problem", F.coalesce("into", "cid").alias("cid"), "s", "w")
            .groupBy("problem", "cid")
            .agg(_vector_sum("s").alias("s"), F.sum("w").alias("w"))
        )
    merges = cut(merges)
    ks = sized.select("problem", "k").distinct()
    w = Window.partitionBy("problem").orderBy(F.col("height").desc(), F.col("level").desc(), F.col("child"))
    most = ks.agg(F.max("k")).first()[0]
    high = (
        merges.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).join(ks, "problem").filter(F.col("r") < F.col("k"))
    )
    edges = merges.join(high.select("problem", "child"), ["problem", "child"], "left_anti").select("problem", "child", "parent")
    links = cut(
        sized.select("problem", F.col("index").alias("child")).join(edges, ["problem", "child"], "left")
        .select("problem", "child", F.coalesce("parent", "child").alias("parent"))
    )
    while True:  # pointer jumping: depth halves every round
        up = links.select("problem", F.col("child").alias("parent"), F.col("parent").alias("up"))
        nxt = cut(salted_join(links, up, ["problem", "parent"], spread=["child"], salts=4).select("problem", "child", "parent", "up"))
        changed = nxt.filter(F.col("up") != F.col("parent")).isEmpty()
        links = nxt.select("problem", "child", F.col("up").alias("parent"))
        if changed:
            break
    return _renumber(links.select("problem", F.col("child").alias("index"), F.col("parent").alias("cluster")))


def _nearest_clusters(state: DataFrame, block: int, t: dict[str, str]) -> DataFrame:
    """(problem, cid, other, sim): most similar other cluster, ties to the smaller id."""
    stripes = _stripes("m", block)
    rows = state.withColumn("b", F.pmod(F.xxhash64("cid"), stripes).cast("int")).withColumn("bs", stripes)

    def run(own: pd.DataFrame) -> pd.DataFrame:
        cols = ["problem", "cid", "other", "sim"]
        a, b, one = _sides(own, "cid")
        if a.empty or (b.empty and not one):
            return pd.DataFrame(columns=cols)
        x = _matrix(a["s"]) / a["w"].to_numpy()[:, None]
        y = x if one else _matrix(b["s"]) / b["w"].to_numpy()[:, None]
        best = _most_similar(x, y, one)
        ids = [a["cid"].to_numpy(), (a if one else b)["cid"].to_numpy()]
        got = [pd.DataFrame({"problem": a["problem"].iloc[0], "cid": ids[side], "other": ids[1 - side][at], "sim": sim}, columns=cols) for side, (at, sim) in enumerate(best)]
        got = pd.concat(got)
        return got[np.isfinite(got["sim"])]

    pairs = _grid(rows, "cid", "s", "w").groupBy("problem", "r", "c").applyInPandas(run, f"problem {t['problem']}, cid {t['index']}, other {t['index']}, sim double")
    # smallest (-sim, other): highest similarity first, then the smaller id
    return pairs.groupBy("problem", "cid").agg(F.min(F.struct((-F.col("sim")).alias("neg"), "other")).alias("b")).select(
        "problem", "cid", F.col("b.other").alias("other"), (-F.col("b.neg")).alias("sim")
    )


def _most_similar(x: np.ndarray, y: np.ndarray, one: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per row of ``x`` the first row of ``y`` with the highest dot product and that product, then the same the other way round.

    ``one``: both are the same rows; no row meets itself, and the other way round is left out.
    """
    found = [(np.zeros(len(x), np.int64), np.full(len(x), -np.inf))] + ([] if one else [(np.zeros(len(y), np.int64), np.full(len(y), -np.inf))])
    for i in range(0, len(x), TILE):
        for j in range(0, len(y), TILE):
            sim = x[i : i + TILE] @ y[j : j + TILE].T
            np.round(sim, DIGITS, out=sim)
            if one and i == j:
                np.fill_diagonal(sim, -np.inf)
            for (at, top), start, first, s in zip(found, (i, j), (j, i), (sim, sim.T)):
                best = s.argmax(1)
                value = s[np.arange(len(s)), best]
                rows = np.arange(start, start + len(s))
                # tiles come in rising order, so an earlier one keeps a tie
                better = value > top[rows]
                at[rows[better]], top[rows[better]] = first + best[better], value[better]
    return found


CLUSTERERS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "kmeans": kmeans,
    "spectral": spectral,
    "agglomerative": agglomerative,
}


def register_clusterer(name: str, fn: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    CLUSTERERS[name] = fn
