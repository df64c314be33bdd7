"""The ranking of a block and the grid of stripes against a full sort."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from codestrata.operators import search as S


def plain(q, c, k):
    s = np.round(q @ c.T, S.SCORE_DIGITS)
    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return top.ravel().tolist(), np.take_along_axis(s, top, axis=1).ravel().tolist()


@pytest.mark.parametrize("rows, k, copies", [(700, 10, False), (700, 10, True), (9, 10, False), (64, 1, True), (641, 10, True)])
def test_best_of_a_block(rows, k, copies):
    rng = np.random.default_rng(rows)
    c = rng.normal(size=(rows, 6))
    c = c[rng.integers(0, 5, rows)] if copies else c  # ties all over, decided by the id
    q = c[rng.integers(0, rows, 30)]
    _, ids, scores = S._best(np.arange(30), q, np.arange(rows), c, k)
    assert (ids.tolist(), scores.tolist()) == plain(q, c, k)


def test_few_scores_are_ranked(monkeypatch):
    """A block ranks what can be among the best, not every score."""
    rng = np.random.default_rng(0)
    q, c = rng.normal(size=(50, 8)), rng.normal(size=(4096, 8))
    sizes = []
    sort = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys, *a, **b: sizes.append(len(keys[0])) or sort(keys, *a, **b))
    monkeypatch.setattr(np, "argsort", lambda *a, **b: pytest.fail("sorts every score"))
    S._best(np.arange(50), q, np.arange(4096), c, 10)
    assert sizes and sizes[0] < 50 * 40


def test_rows_of_the_grid_are_copied_by_stripes(spark, monkeypatch):
    """Blocks of 8 rows: 12 of them on a side, but rows meet in 4 stripes; results as by a full sort."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(96, 4)).round(1)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(3)
    grid = S._grid(rows, rows, 5, 8)
    assert grid._jdf.queryExecution().logical().toString().count("explode(sequence(0, 3") == 2
    got = S.nearest(rows, rows, 5, max_bytes=0, block=8).orderBy("query_id", "rank").select("cand_id", F.col("score")).collect()
    assert ([r[0] for r in got], [r[1] for r in got]) == plain(x, x, 5)


@pytest.mark.parametrize("scale", [1.0, 0.01, 100.0])
def test_later_blocks_rank_only_what_reaches_the_kth(spark, monkeypatch, scale):
    """Queries in blocks of 16 meet 600 candidates 100 at a time, with ties; later blocks rank few scores, and nothing is lost."""
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(600, 5)), 2) * scale
    x[300:350] = x[:50]
    monkeypatch.setattr(S, "BLOCK", 100)
    assert len(S._reaching(x * 1e30, x * 1e30, np.full(600, -1e70))[0]) == 600 * 600  # beyond single precision
    least = np.sort(np.round(x @ x[:100].T, S.SCORE_DIGITS), axis=1)[:, -4]
    row, col = S._reaching(x, x[100:], least - 2.0 * 10.0**-S.SCORE_DIGITS)
    assert set(zip(*np.nonzero(np.round(x @ x[100:].T, S.SCORE_DIGITS) >= least[:, None]))) <= set(zip(row, col))
    ranked = []
    monkeypatch.setattr(S, "_floor", lambda s, k, real=S._floor: ranked.append(len(s)) or real(s, k))

    class Rows:  # stands in for a table: the grid hands its two sides to one task
        def count(self):
            return 1

        def select(self, *columns):
            return self

        groupBy = cogroup = select

        def applyInPandas(self, run, schema):
            own = pd.DataFrame({"id": np.arange(600), "x": list(x)})
            return run(own, own)

    found = S._grid(Rows(), Rows(), 4, 16)
    found = found.sort_values(["query_id", "score", "cand_id"], ascending=[True, False, True])
    top, scores = plain(x, x, 4)
    assert found["cand_id"].tolist() == top and np.allclose(found["score"], scores, rtol=1e-12)
    assert sum(ranked) == 600  # the first block of candidates only
