from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.operators import learn as L
from codestrata.operators import vote as U
from codestrata.plans import report as P
from test_cluster import blobs


@pytest.mark.parametrize("seed", range(40))
def test_best_keys_against_all_combinations(seed):
    rng = np.random.default_rng(seed)
    k, views = int(rng.integers(2, 4)), int(rng.integers(2, 4))
    counts = {}
    for _ in range(60):
        key = tuple(str(c) for c in rng.integers(0, k, views))
        counts[key] = counts.get(key, 0) + 1
    keys = sorted(counts.items())
    best, want = -1, []
    for combo in combinations(range(len(keys)), k):
        if all(a != b for i, j in combinations(combo, 2) for a, b in zip(keys[i][0], keys[j][0])):
            score = sum(keys[i][1] for i in combo)
            if score > best:
                best, want = score, list(combo)
    got = U._best_keys(keys, k)
    assert sum(keys[i][1] for i in got) == max(best, 0) and sorted(got) == sorted(want)


@pytest.mark.parametrize("seed", range(40))
def test_assignment_against_all_permutations(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 6))
    gain = rng.integers(0, 5, (n, n)).astype(float)
    best = max(permutations(range(n)), key=lambda p: (sum(gain[i, j] for i, j in enumerate(p)), [-j for j in p]))
    assert U._first_best(gain) == list(best)


def test_first_best_of_many_labels():
    gain = np.zeros((60, 60))
    assert U._first_best(gain) == list(range(60))  # all equal: the first word
    gain[np.arange(60), np.arange(60)[::-1]] = 1
    assert U._first_best(gain) == list(range(60))[::-1]


def test_more_clusters_than_labels_lose_no_row(spark):
    rows = [("p", i, i % 3, f"l{i % 2}") for i in range(9)]
    got = U.named_clusters(spark.createDataFrame(rows, "problem string, index long, cluster int, label string")).collect()
    assert sorted(r["index"] for r in got) == list(range(9))
    assert len({r["cluster"] for r in got if r["y_pred"] is None}) == 1
    assert {r["y_pred"] for r in got} == {"l0", "l1", None}


def test_consensus_flags_impossible(spark):
    paths = spark.createDataFrame([("a", "0$0", 5), ("a", "1$0", 4), ("b", "0$1", 3), ("b", "1$0", 3)], "problem string, path string, n long")
    ks = spark.createDataFrame([("a", 2), ("b", 2)], "problem string, k int")
    got = {(r["problem"], r["path"]) for r in U.consensus(paths, ks).collect()}
    assert got == {("a", None), ("b", "0$1"), ("b", "1$0")}


def test_self_training_reaches_all_rows(spark):
    pts = blobs(spark, n=150, spread=0.4).withColumn("x0", F.slice("x", 1, 3)).withColumn("x1", F.col("x"))
    agreed = pts.filter((F.col("index") % 3 == 0) | (F.col("index") % 5 == 0) | (F.col("index") < 30))
    rest = pts.join(agreed.select("problem", "index"), ["problem", "index"], "left_anti")
    got = U.self_train(agreed, rest, [L.nearest_centroid] * 2, final=True).collect()
    assert len(got) == pts.count() == len({(r["problem"], r["index"]) for r in got})
    truth = {(r["problem"], r["index"]): r["label"] for r in pts.collect()}
    assert np.mean([truth[r["problem"], r["index"]] == r["label"] for r in got]) > 0.95


@pytest.mark.parametrize("name", list(L.CLASSIFIERS))
def test_classifiers(spark, name):
    pts = blobs(spark, n=90, spread=0.4)
    got = L.holdout_predictions(pts, L.CLASSIFIERS[name]).collect()
    assert len(got) == 18 + 6
    assert np.mean([r["y_true"] == r["y_pred"] for r in got]) > 0.85


def test_svm_of_a_problem_ignores_the_others(spark):
    pts = blobs(spark, n=90, spread=0.9)
    wide = pts.filter("problem = 'p1'").withColumn("problem", F.lit("other")).withColumn("x", F.transform("x", lambda v: v * 1000.0))
    train, test = pts.filter("index % 3 > 0"), pts.filter("index % 3 = 0")
    alone = L.rbf_svm(train, test).collect()
    both = L.rbf_svm(train.unionByName(wide.filter("index % 3 > 0")), test.unionByName(wide.filter("index % 3 = 0"))).collect()
    pred = {(r["problem"], r["index"]): r["pred"] for r in both}
    assert np.mean([pred[r["problem"], r["index"]] == r["pred"] for r in alone]) > 0.9  # the solver stops near the optimum
    assert np.mean([pred["other", r["index"]] == r["pred"] for r in alone if r["problem"] == "p1"]) > 0.9  # scale does not matter


def test_voting_and_prediction(spark):
    pts = blobs(spark, n=90)
    views = {"functions": pts.filter("index != 4"), "w2v": pts.withColumn("x", F.slice("x", 1, 3))}
    report = P.voting_report(views, ["kmeans", "agglomerative"], ["nearest_centroid"]).collect()
    assert len(report) == 2 * 4
    assert all(r["f1_micro_after"] == pytest.approx(1.0) and not r["error"] for r in report)
    assert {r["embeddings"] for r in report} == {"w2v/functions"}
    ks = pts.select("problem").distinct().withColumn("k", F.lit(3))
    got = P.predict({n: v.drop("label") for n, v in views.items()}, "unsupervised_voting", ks, classifiers=["nearest_centroid"] * 2).collect()
    assert len(got) == 119 - 1 and {r["group"] for r in got} == {0, 1, 2}
