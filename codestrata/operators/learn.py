"""Supervised learners behind one signature: ``learner(train, test) -> (problem, index, pred)``.

``train(problem, index, label, x)`` and ``test(problem, index, x)`` hold all problems.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import Interaction
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.arrays import as_double, dot
from codestrata.operators.split import holdout, k_folds
from codestrata.operators.vectorize import mean_vectors
from codestrata.scale import salted_join
from codestrata.session import cut

MAX_PROBLEMS = 1000  # library estimators are fitted one problem at a time
MAX_LABELS = 10000
MAX_WEIGHTS = 4_000_000  # weights of one linear model, held by the driver while it is fitted
PARALLEL_FITS = 8


def nearest_centroid(train: DataFrame, test: DataFrame) -> DataFrame:
    """The label whose mean vector is nearest; one job for all problems, ties to the smaller label."""
    centers = mean_vectors(train, ["problem", "label"], "x", "center")
    packed = centers.groupBy("problem").agg(
        F.collect_list(F.struct("label", "center", dot(F.col("center"), F.col("center")).alias("sq"))).alias("__cs")
    )
    best = F.array_min(
        F.transform("__cs", lambda s: F.struct(F.round(s["sq"] - 2.0 * dot(F.col("x"), s["center"]), 9).alias("d"), s["label"].alias("label")))
    )
    hit = salted_join(test, packed, ["problem"], spread=["index"])
    return hit.select("problem", "index", best["label"].alias("pred"))


def _label_lists(train: DataFrame) -> dict:
    """Sorted labels per problem. The list is fetched, so its size is checked first."""
    pairs = train.select("problem", "label").distinct().limit(MAX_LABELS + 1).collect()
    names: dict = {}
    for r in pairs:
        names.setdefault(r["problem"], []).append(r["label"])
    if len(pairs) > MAX_LABELS or len(names) > MAX_PROBLEMS:
        raise ValueError("too many problems for library estimators; use nearest_centroid")
    return {p: sorted(v) for p, v in sorted(names.items())}


def _per_problem(train: DataFrame, test: DataFrame, fit: Callable[[DataFrame, int], object]) -> DataFrame:
    """Fit one distributed model per problem; a few problems are fitted at the same time."""
    train = cut(train.select("problem", "label", array_to_vector(as_double(F.col("x"))).alias("features")))
    test = cut(test.select("problem", "index", array_to_vector(as_double(F.col("x"))).alias("features")))
    names = _label_lists(train)

    def one(problem) -> DataFrame:
        labels = names[problem]
        there = test.filter(F.col("problem") == problem)
        if len(labels) == 1:
            return there.select("problem", "index", F.lit(labels[0]).alias("pred"))
        array = F.array(*[F.lit(x) for x in labels])
        rows = train.filter(F.col("problem") == problem).withColumn("y", (F.array_position(array, F.col("label")) - 1).cast("double"))
        model = fit(rows.select("features", "y"), len(labels))
        return model.transform(there).select("problem", "index", F.get(array, F.col("prediction").cast("int")).alias("pred"))

    with ThreadPool(PARALLEL_FITS) as pool:
        parts = pool.map(one, names)
    if not parts:
        return test.select("problem", "index", F.lit(None).cast("string").alias("pred"))
    return reduce(DataFrame.unionByName, parts)


def random_forest(train: DataFrame, test: DataFrame, trees: int = 100, seed: int = 42) -> DataFrame:
    return _per_problem(train, test, lambda rows, _: RandomForestClassifier(numTrees=trees, seed=seed, labelCol="y").fit(rows))


def boosted_trees(train: DataFrame, test: DataFrame, rounds: int = 20, seed: int = 42) -> DataFrame:
    def fit(rows: DataFrame, n: int):
        one = GBTClassifier(maxIter=rounds, seed=seed, labelCol="y")
        return one.fit(rows) if n == 2 else OneVsRest(classifier=one, labelCol="y", parallelism=n).fit(rows)

    return _per_problem(train, test, fit)


def rbf_svm(train: DataFrame, test: DataFrame, features: int = 256, reg: float = 0.001, seed: int = 42) -> DataFrame:
    """Linear SVM, one against the rest, on random Fourier features of the RBF kernel.

    The kernel width is that of each problem alone (gamma = 1 / (d var) over its training vectors): rows are scaled by it
    before one projection that all problems share. Every problem owns one block of a sparse feature vector, so the weights of
    the problems do not interact and one fit per label position serves all problems. Rows
    weigh 1 / (rows of their problem), which gives every problem the same penalty.
    """
    names = _label_lists(train)
    widest = train.agg(F.max(F.size("x"))).first()[0]
    if widest is None:
        return test.select("problem", "index", F.lit(None).cast("string").alias("pred"))
    width = features + 1
    if len(names) * width > MAX_WEIGHTS:
        raise ValueError("too many problems for one linear model; use nearest_centroid")
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, np.sqrt(2.0), (widest, features))
    b = rng.uniform(0.0, 2 * np.pi, features)

    total = lambda f: F.sum(F.aggregate(as_double(F.col("x")), F.lit(0.0), lambda acc, v: acc + f(v)))
    stats = train.groupBy("problem").agg(total(lambda v: v).alias("s"), total(lambda v: v * v).alias("ss"), F.sum(F.size("x")).alias("n"), F.max(F.size("x")).alias("d"))
    var = F.col("ss") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)
    scales = cut(stats.select("problem", F.when(var > 1e-12, 1.0 / F.sqrt(F.col("d") * var)).otherwise(1.0 / F.sqrt("d")).alias("scale")))

    @F.pandas_udf("array<double>")
    def project(x: pd.Series, scale: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        rows = np.zeros((len(x), widest))
        for at, v in enumerate(x):
            rows[at, : len(v)] = v
        z = np.sqrt(2.0 / features) * np.cos((rows * scale.to_numpy()[:, None]) @ w + b)
        return pd.Series(list(np.hstack([z, np.ones((len(z), 1))])))

    slots = {p: i for i, p in enumerate(names)}
    where = F.create_map(*[F.lit(v) for kv in slots.items() for v in kv])
    lists = F.create_map(*[F.lit(v) if i % 2 == 0 else F.array(*[F.lit(n) for n in v]) for kv in names.items() for i, v in enumerate(kv)])

    numeric = [{"idx": i, "name": f"z{i}"} for i in range(width)]
    z_meta = {"ml_attr": {"attrs": {"numeric": numeric}, "num_attrs": width}}
    slot_meta = {"ml_attr": {"type": "nominal", "name": "slot", "num_vals": len(slots)}}
    blocks = Interaction(inputCols=["slot", "z"], outputCol="features")

    def prepared(df: DataFrame) -> DataFrame:
        known = salted_join(df, scales, ["problem"], spread=["index"]).withColumn("slot", F.try_element_at(where, "problem")).filter(F.col("slot").isNotNull())
        known = known.withColumn("names", F.element_at(lists, F.col("problem"))).withColumn("z", array_to_vector(project("x", "scale")))
        known = known.withMetadata("slot", slot_meta).withMetadata("z", z_meta)
        return blocks.transform(known).drop("slot", "z", "scale")

    sizes = train.groupBy("problem").agg((1.0 / F.count(F.lit(1))).alias("weight"))
    rows = cut(
        prepared(salted_join(train, sizes, ["problem"], spread=["index"]))
        .withColumn("y", F.array_position("names", F.col("label")) - 1)
        .select("features", "y", "weight")
    )
    out = prepared(test).select("problem", "index", "features", "names")
    for j in range(max(map(len, names.values()))):
        model = LinearSVC(
            labelCol="__y", weightCol="weight", rawPredictionCol=f"__r{j}", predictionCol="__p", maxIter=50, regParam=reg / len(slots),
            standardization=False, fitIntercept=False,
        ).fit(rows.withColumn("__y", (F.col("y") == j).cast("double")))
        out = model.transform(out).drop("__p")
    scores = F.array(*[F.get(vector_to_array(f"__r{j}"), F.lit(1)) for j in range(max(map(len, names.values())))])
    best = F.array_max(F.transform(F.arrays_zip(F.slice(scores, F.lit(1), F.size("names")).alias("s"), F.col("names").alias("n")), lambda s: F.struct(s["s"], s["n"])))
    return out.select("problem", "index", best["n"].alias("pred"))


CLASSIFIERS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "random_forest": random_forest,
    "rbf_svm": rbf_svm,
    "boosted_trees": boosted_trees,
    "nearest_centroid": nearest_centroid,
}


def register_classifier(name: str, learner: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    CLASSIFIERS[name] = learner


def holdout_predictions(view: DataFrame, learner: Callable, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Truth and prediction of the held-out rows: ``(problem, index, y_true, y_pred)``."""
    parts = holdout(view, share, seed=seed)
    train, test = parts.filter(~F.col("is_test")), parts.filter("is_test")
    got = learner(train.select("problem", "index", "label", "x"), test.select("problem", "index", "x"))
    return test.select("problem", "index", F.col("label").alias("y_true")).join(
        got.select("problem", "index", F.col("pred").alias("y_pred")), ["problem", "index"]
    )


def cross_validate(view: DataFrame, learner: Callable, k: int = 5, seed: int = 42) -> DataFrame:
    """Accuracy per problem and fold. Every fold becomes its own key, so all folds are one fit call."""
    folds = k_folds(view, k, seed=seed).select("problem", "index", "label", "x", "cv_fold")
    key = F.concat_ws("\u0001", "problem", F.col("of").cast("string")).alias("problem")
    spread = folds.withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    train = spread.filter(F.col("of") != F.col("cv_fold")).select(key, "index", "label", "x")
    test = folds.withColumn("of", F.col("cv_fold")).select(key, "index", "label", "x")
    got = learner(train, test.select("problem", "index", "x"))
    hit = test.select("problem", "index", "label").join(got, ["problem", "index"])
    return hit.groupBy(
        F.split_part("problem", F.lit("\u0001"), F.lit(1)).alias("problem"), F.split_part("problem", F.lit("\u0001"), F.lit(2)).cast("int").alias("fold")
    ).agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


CONSTANT = 30.0  # the constant feature; a large one leaves the intercept all but free of the penalty


def joint_logistic(rows: DataFrame, n_labels: int, width: int, reg: float = 0.01, max_iter: int = 100) -> np.ndarray:
    """Weights (labels x width + 1, the intercept last) of one logistic model per label, fitted together; ``rows(x, Y)``.

    Every label owns one block of a sparse feature vector, so the labels share the gradient aggregate of every iteration
    and a fit takes as many passes over the rows as one model does. Each label minimises its mean loss
    plus ``reg`` / 2 times its squared weights. The driver holds the weights, labels x (width + 1) numbers.
    """
    one = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get("x", i), F.lit(0.0)))
    z = array_to_vector(F.concat(one, F.array(F.lit(CONSTANT))))
    z_meta = {"ml_attr": {"attrs": {"numeric": [{"idx": i, "name": f"z{i}"} for i in range(width + 1)]}, "num_attrs": width + 1}}
    slot_meta = {"ml_attr": {"type": "nominal", "name": "slot", "num_vals": max(n_labels, 2)}}
    each = rows.select(z.alias("z"), F.posexplode(F.slice("Y", 1, n_labels)).alias("slot", "y"))
    each = each.select("z", F.col("slot").cast("double").alias("slot"), F.col("y").cast("double").alias("y")).where("y IS NOT NULL")
    blocks = Interaction(inputCols=["slot", "z"], outputCol="features").transform(each.withMetadata("slot", slot_meta).withMetadata("z", z_meta))
    # a column that never changes gets no weight, and with a single label the constant is one
    fit = LogisticRegression(labelCol="y", maxIter=max_iter, regParam=reg / n_labels, standardization=False, fitIntercept=n_labels == 1, tol=1e-9, family="binomial")
    model = fit.fit(blocks.select("features", "y"))
    weights = model.coefficients.toArray()[: n_labels * (width + 1)].reshape(n_labels, width + 1) * np.append(np.ones(width), CONSTANT)
    weights[:, -1] += model.intercept
    return weights


def multilabel_fit_predict(train: DataFrame, test: DataFrame, views: list[str], labels: list[str], threshold: float = 0.4) -> DataFrame:
    """Logistic models of all labels over the concatenated views: ``test`` with ``scores`` and ``p``.

    Training rows without a target or a view teach nothing, and test rows without a view have null scores. Missing components are
    zero. Nothing to learn from gives null scores.
    """
    x = F.concat(*[as_double(F.col(v)) for v in views])
    rows = cut(train.select(x.alias("x"), "Y").where("x IS NOT NULL AND Y IS NOT NULL"))
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return test.withColumns({"scores": F.lit(None).cast("array<double>"), "p": F.lit(None).cast("array<int>")})
    weights = joint_logistic(rows, len(labels), width)

    @F.pandas_udf("array<double>")
    def scored(x: pd.Series) -> pd.Series:
        held = np.zeros((len(x), width))
        for at, v in enumerate(x):
            if v is not None:
                held[at, : len(v)] = np.nan_to_num(np.asarray(v, dtype=np.float64)[:width])
        with np.errstate(over="ignore"):
            p = 1.0 / (1.0 + np.exp(-(held @ weights[:, :-1].T + weights[:, -1])))
        return pd.Series([None if v is None else row for v, row in zip(x, p)], dtype=object)

    out = test.withColumn("scores", scored(x))
    return out.withColumn("p", F.transform("scores", lambda v: (v >= threshold).cast("int")))
