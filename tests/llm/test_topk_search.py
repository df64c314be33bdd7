"""Exact top-k inner products against all pairs."""

import math

import numpy as np
import pytest

from codestrata.llm.topk_search import CoverTree, dual_search, top_k

INF, NAN = float("inf"), float("nan")


def plain(rows, asked, k, scale=256):
    """[(query, rank, row, score)] with whole numbers of any size."""
    ok = lambda r: r[0] is not None and r[1] and all(x is not None and math.isfinite(x * scale) for x in r[1])
    whole = lambda r: (r[0], tuple(math.floor(x * scale) for x in r[1]))
    data = {whole(r) for r in rows if ok(r)}
    cut = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = []
    by = {}
    for i, v in {whole(r) for r in asked if ok(r)}:
        by.setdefault(i, []).append(v)
    for i, vs in by.items():
        scores = [(-cut(sum(a * b for a, b in zip(v, w))), j) for v in vs for j, w in data if j != i and len(v) == len(w)]
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def vectors(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    x = centres[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, dim))
    return [(int(i), v.tolist()) for i, v in enumerate(x.astype(np.float32))]


ODD = [
    (0, [0.5, 0.25]),
    (1, None),
    (2, [None, 1.0]),
    (3, [NAN, 1.0]),
    (4, [INF, 1.0]),
    (5, []),
    (6, [1.0]),
    (7, [0.5, 0.25]),
    (8, [0.5, 0.25]),
    (8, [0.5, 0.25]),
    (None, [9.0, 9.0]),
    (9, [-0.1, 0.1]),
    (10, [0.0, 0.0]),
    (11, [1e300, 1.0]),
    (12, [-3e15, 2e15]),
    (13, [1e17, -1e17]),
]

CASES = {
    "empty": [],
    "one": [(0, [1.0, 2.0])],
    "odd": ODD,
    "ties": [(i, [float(i % 3), 1.0]) for i in range(60)],
    "clouds": vectors(1, 900, 16, 0.1),
    "loose": vectors(2, 300, 24, 2.0),
}


@pytest.mark.parametrize("case", CASES)
def test_by_all_pairs(spark, case):
    rows = CASES[case]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, score string, rank int").repartition(3)
    out = top_k(df, df.where("vec_id % 5 = 0 or vec_id > 8" if case == "odd" else "vec_id % 7 = 0"))
    asked = [r for r in rows if r[0] is not None and (r[0] % 5 == 0 or r[0] > 8 if case == "odd" else r[0] % 7 == 0)]
    assert sorted(map(tuple, out.collect())) == plain(rows, asked, 5)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr("codestrata.llm.topk_search.DATA_BLOCK", 100)
    monkeypatch.setattr("codestrata.llm.topk_search.QUERY_BLOCK", 20)
    rows = CASES["clouds"]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = top_k(df, df.where("vec_id % 3 = 0"), k=3)
    assert sorted(map(tuple, out.collect())) == plain(rows, [r for r in rows if r[0] % 3 == 0], 3)


def test_cover_tree_covers():
    x = np.random.default_rng(3).normal(size=(700, 5)).round(1)
    tree, ids = CoverTree.load(CoverTree(x).dump(np.arange(700)))
    tree = CoverTree(x)
    assert sorted(tree.order) == list(range(700)) and len(tree.radius) > 10 and (ids == np.arange(700)).all()
    for node in range(len(tree.radius)):
        own = x[tree.order[tree.start[node] : tree.stop[node]]]
        assert np.sqrt(((own - x[tree.centre[node]]) ** 2).sum(axis=1)).max() <= tree.radius[node] + 1e-9
        kids = tree.children(node)
        if kids:
            assert sum(tree.stop[c] - tree.start[c] for c in kids) == tree.stop[node] - tree.start[node]
            centres = x[tree.centre[kids.start : kids.stop]]
            apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))[~np.eye(len(centres), dtype=bool)]
            assert not len(apart) or apart.min() > tree.radius[node] / 2 - 1e-9


def test_tight_groups_are_pruned(monkeypatch):
    rng = np.random.default_rng(4)
    x = (np.repeat(rng.normal(size=(40, 8)), 100, axis=0) * 256 + rng.normal(size=(4000, 8))).round()
    seen = []
    import codestrata.llm.topk_search as T

    product = T._product
    monkeypatch.setattr(T, "_product", lambda a, b: seen.append(len(a) * len(b)) or product(a, b))
    q = x[::100]
    out = dual_search(CoverTree(q, T.QUERY_LEAF), np.arange(0, 4000, 100), CoverTree(x), np.arange(4000), np.full(40, -np.inf), 5)
    assert sum(seen) < 0.5 * len(q) * len(x)
    for row, (scores, ids) in enumerate(out):
        s = x @ q[row]
        want = sorted((-s[i], i) for i in range(4000) if i != row * 100)[:5]
        assert [(-a, b) for a, b in zip(scores, ids)] == want


def test_points_without_groups_stay_in_large_nodes():
    """Far from each other in many dimensions: a node per point would cost more than it can prune."""
    x = np.random.default_rng(5).normal(size=(1000, 64)) * 256
    tree = CoverTree(x)
    assert len(tree.radius) < 1000 / 8
    q = x[::50].round()
    found = dual_search(CoverTree(q, 1), np.arange(0, 1000, 50), CoverTree(x.round()), np.arange(1000), np.full(20, -np.inf), 5)
    for row, (scores, ids) in enumerate(found):
        s = x.round() @ q[row]
        assert list(zip([-v for v in scores], ids)) == sorted((-s[i], i) for i in range(1000) if i != row * 50)[:5]
