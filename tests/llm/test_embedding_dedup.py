"""Embedding near-duplicates against all pairs."""

import numpy as np
import pytest

from codestrata.llm.embedding_dedup import buckets, corners, hadamard, hash_size, near_duplicates


def plain(rows, threshold=0.9):
    """{row number: (id, n_links, component_id, kept)} from all cosines."""
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n = len(rows)
    links = [[] for _ in rows]
    unit = [np.array(v, np.float64) / np.abs(v).max() if ok(v) else None for _, v in rows]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    for i in range(n):
        for j in range(i):
            a, b = unit[i], unit[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b >= threshold:
                links[i].append(j)
                links[j].append(i)
    seen, out = {}, []
    for i in range(n):
        if i not in seen:
            todo, group = [i], {i}
            while todo:
                for j in links[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
            seen |= dict.fromkeys(group, least)
        out.append((rows[i][0], len(links[i]), seen[i], seen[i] == rows[i][0]))
    return sorted(out, key=repr)


def got(df):
    return sorted([(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect()], key=repr)


def clouds(seed, groups, each, noise, dim=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    x = (centres[:, None] + noise * rng.normal(size=(groups, each, dim))).reshape(-1, dim).astype(np.float32)
    return [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)), x)]


INF, NAN = float("inf"), float("nan")
ODD = [
    (1, None),
    (2, []),
    (3, [0.0, 0.0, 0.0]),
    (4, [1.0, None, 2.0]),
    (5, [1.0, NAN, 2.0]),
    (6, [1.0, INF, 2.0]),
    (7, [1.0, 2.0, 3.0]),
    (8, [2.0, 4.0, 6.0]),
    (9, [1.0, 2.0, 3.0]),
    (9, [1.0, 2.0, 3.0]),
    (None, [1.0, 2.0, 3.0]),
    (10, [-1.0, -2.0, -3.0]),
    (11, [1.0, 2.0]),
    (12, [1e30, 2e30, 3e30]),
    (13, [5.0]),
    (14, [2.0]),
    (15, [0.0, -0.0, 1.0]),
    (16, [-0.0, 0.0, 1.0]),
    (None, None),
]


@pytest.mark.parametrize("rows", [[], ODD, clouds(1, 30, 12, 0.03)], ids=["empty", "odd", "tight"])
@pytest.mark.parametrize("block", [8, 1024])
def test_by_all_pairs(spark, rows, block):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    assert got(near_duplicates(df, block=block)) == plain(rows)


def test_recall_close_to_the_threshold(spark):
    rows = clouds(2, 25, 20, 0.31)  # cosines around 0.9
    want = plain(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = got(near_duplicates(df))
    links = sum(w[1] for w in want)
    assert links > 1000
    assert 0.97 * links <= sum(f[1] for f in found) <= links
    assert all(f[1] <= w[1] for f, w in zip(found, want))  # none below the threshold


def test_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "a", "b"), (2, [1.0, 2.0], "c", "d")], "vec_id long, embedding array<double>, n_links string, x string")
    out = near_duplicates(df)
    assert out.columns == ["vec_id", "embedding", "n_links", "x", "component_id", "kept"]
    assert sorted((r["vec_id"], r["n_links"], r["x"], r["component_id"], r["kept"]) for r in out.collect()) == [(1, 1, "b", 1, True), (2, 1, "d", 1, False)]


def test_rotation_keeps_lengths_and_corners_are_nearest():
    x = np.random.default_rng(0).normal(size=(50, 16))
    assert np.allclose((hadamard(x) ** 2).sum(axis=1), 16 * (x**2).sum(axis=1))
    both = corners(x, 3)
    assert (both[:, 0] != both[:, 1]).all() and both.max() < 32
    assert (corners(-x, 3)[:, 0] == (both[:, 0] ^ 1)).all()  # the opposite corner


def test_number_of_tables_keeps_the_recall():
    for n in (10, 10**5, 10**8, 10**10):
        functions, tables = hash_size(n)
        rng = np.random.default_rng(functions)
        x = rng.normal(size=(400, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z = rng.normal(size=x.shape)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        y = 0.9 * x + np.sqrt(1 - 0.81) * z / np.linalg.norm(z, axis=1, keepdims=True)
        a, b = buckets(x, functions, tables), buckets(y, functions, tables)
        meet = ((a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)).any(axis=1)
        assert meet.mean() > 0.95
