"""Clusterings against plain definitions, and the same groups whatever the blocks and partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.operators import cluster as C


def blobs(spark, n=120, k=3, spread=0.25, seed=3, problems=2):
    rng = np.random.default_rng(seed)
    rows = []
    for p in range(problems):
        centers = np.eye(6)[:k] * 3 + rng.normal(0, 0.1, (k, 6))
        size = n if p else n // 3
        rows += [(f"p{p}", i, f"p{p}${i % k}", [float(v) for v in centers[i % k] + rng.normal(0, spread, 6)]) for i in range(size)]
    return spark.createDataFrame(rows, "problem string, index long, label string, x array<double>").cache()


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["problem"], r["cluster"]), set()).add(r["index"])
    return out


def same_as_labels(points, got):
    labels = {}
    for r in points.collect():
        labels.setdefault((r["problem"], r["label"]), set()).add(r["index"])
    return sorted(map(sorted, got.values())) == sorted(map(sorted, labels.values()))


@pytest.mark.parametrize("name", ["kmeans", "spectral", "agglomerative"])
def test_separable_groups(spark, name):
    pts = blobs(spark)
    ks = C.known_k(pts)
    assert same_as_labels(pts, groups(C.CLUSTERERS[name](pts, ks)))


@pytest.mark.parametrize("name", ["spectral", "agglomerative"])
def test_small_blocks_separable(spark, name):
    pts = blobs(spark)
    got = groups(C.CLUSTERERS[name](pts, C.known_k(pts), block=16))
    assert same_as_labels(pts, got)


def slow_kmeans(x, k):
    d = lambda c: np.round(((x[:, None] - np.array(c)[None]) ** 2).sum(2), 9)
    centers = [x[0]]
    while len(centers) < k:
        centers.append(x[d(centers).min(1).argmax()])
    while True:
        near = d(centers).argmin(1)
        new = [x[near == j].mean(0) if (near == j).any() else centers[j] for j in range(k)]
        if np.allclose(new, centers, atol=1e-9, rtol=0):
            return near
        centers = new


def test_large_problem_in_any_partitions(spark):
    """3,000 rows without clear groups: k-means by definition, and the clusterings do not depend on blocks or partitions."""
    pts = noise(spark, 3000, seed=9)
    ks = pts.select("problem").distinct().withColumn("k", F.lit(4))
    rows = lambda df: sorted((r["index"], r["cluster"]) for r in df.collect())
    got = rows(C.kmeans(pts, ks))
    x = np.array([r["x"] for r in sorted(pts.collect(), key=lambda r: r["index"])])
    near = slow_kmeans(x, 4)
    first = {}
    assert got == [(i, first.setdefault(int(c), len(first))) for i, c in enumerate(near)]
    assert rows(C.kmeans(pts.repartition(7, "index"), ks)) == got
    assert rows(C.agglomerative(pts, ks, block=1500)) == rows(C.agglomerative(pts, ks, block=4000))


def dense_embedding_groups(x, k, gamma=1.0):
    """The groups by definition: eigenvectors of the whole matrix, then k-means."""
    d = np.round(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T, 0), 9)
    a = np.exp(-gamma * d)
    root = np.sqrt(a.sum(1))
    vec = np.linalg.eigh(a / root[:, None] / root[None])[1][:, ::-1][:, :k]
    near = slow_kmeans(vec / root[:, None] * np.sqrt(len(x)), k)
    first = {}
    return [first.setdefault(int(c), len(first)) for c in near]


def test_spectral_sees_a_tiny_far_group(spark):
    """3,000 rows in two problems, each with 5 rows far from the others: no row may be left out of the affinity."""
    rng = np.random.default_rng(1)
    rows = []
    for p in range(2):
        x = np.vstack([rng.normal(0, 0.3, (1495, 3)), rng.normal(0, 0.1, (5, 3)) + [6.0, 0, 0]])
        rows += [(f"p{p}", i, [float(v) for v in r]) for i, r in enumerate(x[rng.permutation(1500)])]
    pts = spark.createDataFrame(rows, "problem string, index long, x array<double>")
    ks = pts.select("problem").distinct().withColumn("k", F.lit(2))
    want = {p: dense_embedding_groups(np.array([r[2] for r in rows if r[0] == p]), 2) for p in ("p0", "p1")}
    assert all(sorted((w.count(0), w.count(1))) == [5, 1495] for w in want.values())
    for block in (2048, 700):
        got = C.spectral(pts, ks, block=block).collect()
        assert {p: [r["cluster"] for r in sorted(got, key=lambda r: r["index"]) if r["problem"] == p] for p in want} == want, block


def test_kmeans_in_one_task_and_by_joins(spark):
    pts = noise(spark, 300, seed=11)
    ks = pts.select("problem").distinct().withColumn("k", F.lit(5))
    rows = lambda df: sorted((r["index"], r["cluster"]) for r in df.collect())
    assert rows(C.kmeans(pts, ks, block=100)) == rows(C.kmeans(pts, ks))


def noise(spark, n=70, seed=5):
    rng = np.random.default_rng(seed)
    rows = [("p", i, [float(v) for v in rng.normal(0, 1, 4)]) for i in range(n)]
    return spark.createDataFrame(rows, "problem string, index long, x array<double>")


def slow_average_linkage(x, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - unit @ unit.T
    clusters = [[i] for i in range(len(x))]
    while len(clusters) > k:
        best = min(
            ((np.mean([d[i, j] for i in a for j in b]), ai, bi) for ai, a in enumerate(clusters) for bi, b in enumerate(clusters) if ai < bi)
        )
        _, a, b = best
        clusters[a] += clusters.pop(b)
    return sorted(map(sorted, clusters))


@pytest.mark.parametrize("block", [2048, 12])
@pytest.mark.parametrize("k", [2, 5])
def test_agglomerative_is_average_linkage(spark, block, k):
    pts = noise(spark, 40)
    ks = pts.select("problem").distinct().withColumn("k", F.lit(k))
    got = groups(C.agglomerative(pts, ks, block=block))
    x = np.array([r["x"] for r in sorted(pts.collect(), key=lambda r: r["index"])])
    assert sorted(map(sorted, got.values())) == slow_average_linkage(x, k)


def test_multiview(spark):
    pts = blobs(spark)
    two = pts.select("problem", "index", "label", F.slice("x", 1, 3).alias("x0"), F.col("x").alias("x1"))
    assert same_as_labels(pts, groups(C.multiview_spectral(two.drop("label"), C.known_k(pts))))
    assert same_as_labels(pts, groups(C.multiview_spectral(two.drop("label"), C.known_k(pts), block=32)))


def test_every_row_once_and_k_groups(spark):
    pts = noise(spark)
    ks = pts.select("problem").distinct().withColumn("k", F.lit(6))
    for fn in C.CLUSTERERS.values():
        got = fn(pts, ks).collect()
        assert sorted(r["index"] for r in got) == list(range(70))
        assert {r["cluster"] for r in got} == set(range(6))


def test_grid_cells_work_for_both_sides(spark, monkeypatch):
    """Many stripes and tiles: rows go to as many cells as there are stripes, and every pair of rows meets once."""
    rng = np.random.default_rng(3)
    a, b, v, w = rng.normal(size=(70, 5)), rng.normal(size=(45, 5)), rng.normal(size=(45, 3)), rng.normal(size=(70, 3))
    monkeypatch.setattr(C, "TILE", 16)
    out, back = C._affinity_times(a, b, 0.5, v, w)
    full = C._affinity(a, b, 0.5)
    assert np.allclose(out, full @ v, atol=1e-8) and np.allclose(back, full.T @ w, atol=1e-8)
    a[50] = a[3]  # a tie goes to the first
    ids, top = C._most_similar(a, a, True)[0]
    dots = np.round(a @ a.T, C.DIGITS)
    np.fill_diagonal(dots, -np.inf)
    assert ids.tolist() == dots.argmax(1).tolist() and top.tolist() == dots.max(1).tolist()
    (ids, _), (back, _) = C._most_similar(a, b, False)
    assert ids.tolist() == np.round(a @ b.T, C.DIGITS).argmax(1).tolist() and back.tolist() == np.round(b @ a.T, C.DIGITS).argmax(1).tolist()
    rows = spark.range(60).selectExpr("'p' AS problem", "id AS index", "cast(id % 5 AS int) AS b", "5 AS bs")
    cells = C._grid(rows, "index").collect()
    assert len(cells) == 60 * 5 and len({(r["r"], r["c"]) for r in cells}) == 15
    assert all((r["c"] if r["side"] else r["r"]) == r["index"] % 5 for r in cells)


def merged_by_all_pairs(x):
    """Rounds of mutual nearest neighbours from the whole matrix of products."""
    sums, sizes, ids, level, out = x.copy(), np.ones(len(x)), np.arange(len(x)), 0, []
    while len(ids) > 1:
        level += 1
        mean = sums / sizes[:, None]
        sim = np.round(mean @ mean.T, C.DIGITS)
        np.fill_diagonal(sim, -np.inf)
        best = sim.argmax(1)
        a = np.flatnonzero((best[best] == np.arange(len(ids))) & (np.arange(len(ids)) < best))
        out += [(int(ids[i]), int(ids[best[i]]), round(1.0 - sim[i, best[i]], 7), level) for i in a]
        sums[a] += sums[best[a]]
        sizes[a] += sizes[best[a]]
        rest = np.delete(np.arange(len(ids)), best[a])
        sums, sizes, ids = sums[rest], sizes[rest], ids[rest]
    return out


@pytest.mark.parametrize("copies", [0, 150])
def test_merges_need_few_products(monkeypatch, copies):
    """The merges of all pairs, but a cluster is compared with all others only where its list no longer tells the nearest."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 12)) + 0.8
    x[:copies] = x[rng.integers(copies, len(x), copies)]
    x /= np.linalg.norm(x, axis=1)[:, None]
    compared = []
    monkeypatch.setattr(C, "_best", lambda qid, q, cid, c, k, real=C._best: compared.append(len(qid) * len(cid)) or real(qid, q, cid, c, k))
    got = C._mutual_merges(x.copy(), np.ones(len(x)), np.arange(len(x)))
    want = merged_by_all_pairs(x)
    assert [(int(a), int(b), round(h, 7), level) for a, b, h, level in got] == want
    left = len(x) - np.array([0, *np.cumsum(np.bincount([w[3] for w in want])[1:-1])])
    assert 0 < sum(compared) < 0.8 * (left.astype(float) ** 2).sum()


def test_spectral_in_one_task_and_over_a_grid(spark):
    """The same groups from the whole matrix, from products in one task and from products over stripes; few tables stay behind."""
    rng = np.random.default_rng(4)
    rows = [(p, i, [float(v) for v in rng.normal(0, 0.4, 3) + 3 * np.eye(3)[i % 3] * (i % 7 > 1)]) for p in ("p", "q") for i in range(400)]
    pts = spark.createDataFrame(rows, "problem string, index long, x0 array<double>").withColumn("x1", F.slice("x0", 1, 2))
    ks = pts.select("problem").distinct().withColumn("k", F.lit(4))
    rows = lambda df: sorted((r["problem"], r["index"], r["cluster"]) for r in df.collect())
    want = rows(C.multiview_spectral(pts, ks))
    assert rows(C.multiview_spectral(pts, ks, block=100)) == want
    assert rows(C.multiview_spectral(pts.repartition(5), ks, block=100, whole=150)) == want


def test_kmeans_of_a_large_problem_takes_few_jobs(spark, monkeypatch):
    """5,000 rows hold few numbers, so that their rounds need no jobs."""
    pts = noise(spark, 5000, seed=2)
    ks = pts.select("problem").distinct().withColumn("k", F.lit(3))
    monkeypatch.setattr(C, "_large_kmeans", lambda *a: pytest.fail("rounds of jobs"))
    assert C.kmeans(pts, ks).count() == 5000


def test_single_precision_gives_way_where_it_stalls(monkeypatch):
    """Clear groups, whose leading eigenvalues are alike: residuals that single precision cannot bring down end it, and the last products are double."""
    rng = np.random.default_rng(4)
    x = np.array([rng.normal(0, 0.4, 3) + 3 * np.eye(3)[i % 3] * (i % 7 > 1) for i in range(400)])
    kinds, offs = [], []
    monkeypatch.setattr(C, "_affinity_times", lambda *a, real=C._affinity_times, **b: kinds.append(b.get("kind")) or real(*a, **b))
    monkeypatch.setattr(C, "_projection", lambda *a, real=C._projection: (lambda found: offs.append(found[1]) or found)(real(*a)))
    vec, degree = C._iterated([x, x[:, :2]], rng.integers(-(2**62), 2**62, 400), 4, 1.0)
    assert len(offs) < 12 and offs[-1] <= C.RESIDUAL and kinds[2] is np.float32 and kinds[-1] is np.float64
    total, roots = 0.0, []
    for view in (x, x[:, :2]):
        a = C._affinity(view, view, 1.0)
        roots.append(np.sqrt(a.sum(1)))
        total = total + a / roots[-1][:, None] / roots[-1][None, :] / 2
    value, want = np.linalg.eigh(total)
    assert np.allclose(np.abs(vec.T @ total @ vec), np.diag(value[::-1][:4]), atol=1e-6) and np.allclose(degree, np.mean(roots, axis=0))
