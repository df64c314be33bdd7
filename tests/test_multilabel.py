"""Joint logistic models against their gradient, and the evaluation against plain counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.operators import learn as L
from codestrata.plans import report as P


@pytest.fixture(scope="module")
def overlapping():
    """Classes that overlap: a frequent, a rare and a label that never occurs."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (300, 3))
    noise = rng.logistic(0, 1, (300, 2))
    seen = x @ np.array([[1.0, -2.0], [0.5, 0.0], [0.0, 1.0]]) + np.array([1.0, -3.0]) + noise > 0
    return x, np.column_stack([seen, np.zeros(300, bool)]).astype(int)


def test_every_label_is_at_its_minimum(spark, overlapping):
    x, y = overlapping
    rows = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "x array<double>, Y array<int>")
    weights = L.joint_logistic(rows, 3, 3, reg=0.01)
    held = np.column_stack([x, np.ones(len(x))])
    penalty = 0.01 * weights / np.array([1.0, 1.0, 1.0, L.CONSTANT**2])
    gradient = (1 / (1 + np.exp(-held @ weights.T)) - y).T @ held / len(x) + penalty
    assert np.abs(gradient).max() < 1e-3
    assert weights[0, 0] > 0.5 and weights[1, 0] < -1 and weights[2, 3] < -4


def test_scores_of_odd_rows(spark, overlapping):
    x, y = overlapping
    train = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)] + [(None, [1, 1, 1]), ([0.0] * 3, None)], "x array<double>, Y array<int>")
    test = spark.createDataFrame([(1, [9.0, 0.0, 0.0]), (2, None), (3, []), (4, [-9.0, 0.0, 9.0, 5.0]), (4, [-9.0, 0.0, 9.0])], "id int, x array<double>")
    got = L.multilabel_fit_predict(train, test, ["x"], ["often", "rare", "never"]).collect()
    scores = {r["id"]: r["scores"] for r in got}
    assert len(got) == 5 and scores[2] is None and len(scores[3]) == 3
    assert {r["id"]: r["p"] for r in got if r["id"] in (1, 4)} == {1: [1, 0, 0], 4: [0, 1, 0]}
    two = [r["scores"] for r in got if r["id"] == 4]
    assert two[0] == two[1]
    assert L.multilabel_fit_predict(train, test.limit(0), ["x"], ["often", "rare", "never"]).collect() == []
    assert {tuple(r) for r in L.multilabel_fit_predict(train.limit(0), test, ["x"], ["a"]).select("scores", "p").collect()} == {(None, None)}


def test_one_label(spark):
    rows = spark.createDataFrame([([float(i)], [int(i > 5)]) for i in range(12)], "x array<double>, Y array<int>")
    got = L.multilabel_fit_predict(rows, rows, ["x"], ["big"], 0.5).collect()
    assert [r["p"] for r in got] == [r["Y"] for r in got]


def test_evaluation_by_hand(spark):
    rows = [([1, 0], [0.9, 0.4]), ([1, 0], [0.3, 0.1]), ([0, 0], [0.3, 0.0]), ([0, 0], [0.0, 0.7]), (None, [1.0, 1.0]), ([1, 1], None)]
    scored = spark.createDataFrame(rows, "Y array<int>, scores array<double>")
    got = {(r["label"], r["metric"]): r["value"] for r in P.multilabel_evaluation(scored, ["a", "b"]).collect()}
    assert got[("a", "precision")] == 1.0 and got[("a", "recall")] == 0.5 and got[("a", "support")] == 2.0
    assert got[("b", "precision")] == 0.0 and got[("b", "auc")] is None
    # of four pairs three are in order and one is a tie
    assert got[("a", "auc")] == got[("macro avg", "auc")] == 0.875
    assert got[("all", "hamming_loss")] == 3 / 8
    assert got[("micro avg", "precision")] == pytest.approx(1 / 3) and got[("micro avg", "recall")] == 0.5
    assert len(got) == 4 * 6 + 3 + 1


def test_evaluation_of_nothing(spark):
    empty = spark.createDataFrame([], "Y array<int>, scores array<double>")
    got = P.multilabel_evaluation(empty, ["a"]).where(F.col("label").isin("a")).collect()
    assert got == []
