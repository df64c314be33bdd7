"""Evaluation reports and the prediction call.

``views`` maps a view name to ``(problem, index, label, x)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import combinations, product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.arrays import binarize
from codestrata.operators.aggregate import classification_report, f1_report, hamming_loss, path_counts, roc_auc
from codestrata.operators.cluster import CLUSTERERS, known_k, multiview_spectral
from codestrata.operators.learn import CLASSIFIERS, holdout_predictions, multilabel_fit_predict
from codestrata.operators.reshape import align_views
from codestrata.operators.vote import consensus, named_clusters, seed_sets, self_train
from codestrata.session import cut

REPORTED_CLUSTERERS = ["kmeans", "spectral", "agglomerative"]
REPORTED_CLASSIFIERS = ["random_forest", "rbf_svm", "boosted_trees"]


AT_ONCE = 4  # independent cells of a report whose jobs Spark gets at the same time; each is a chain of small jobs


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _each(cell: Callable[..., DataFrame], over: Iterable) -> list[DataFrame]:
    """``cell`` of every element, in order; cells do not read each other, so that one's small jobs fill the gaps of another's."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(cell, over))


def estimator_report(views: dict[str, DataFrame], classifiers: list[str] = REPORTED_CLASSIFIERS, share: float = 0.2) -> DataFrame:
    """Hold-out F1 per problem, view and classifier, scored in one aggregation."""
    parts = [
        holdout_predictions(view, CLASSIFIERS[c], share).select(
            "problem", F.lit(name).alias("embedding"), F.lit(c).alias("estimator"), "y_true", "y_pred"
        )
        for name, view in views.items()
        for c in classifiers
    ]
    return f1_report(_union(parts), ["problem", "embedding", "estimator"])


def kcluster_report(views: dict[str, DataFrame], clusterers: list[str] = REPORTED_CLUSTERERS) -> DataFrame:
    """F1 of every clustering with known k after the best renaming of clusters to labels."""
    kept = {name: cut(view.select("problem", "index", "label", "x")) for name, view in views.items()}

    def clustered(cell: tuple[str, str]) -> DataFrame:
        name, c = cell
        got = CLUSTERERS[c](kept[name], known_k(kept[name]))
        return got.join(kept[name].select("problem", "index", "label"), ["problem", "index"]).select(
            "problem", F.lit(name).alias("embedding"), F.lit(c).alias("clustering"), "index", "cluster", "label"
        )

    keys = ["problem", "embedding", "clustering"]
    return f1_report(named_clusters(_union(_each(clustered, product(kept, clusterers))), keys), keys)


def multiview_report(views: dict[str, DataFrame]) -> DataFrame:
    """F1 of multi-view spectral clustering over every pair of views and over all of them."""
    names = list(views)
    sets = [list(c) for c in combinations(names, 2)] + ([names] if len(names) > 2 else [])

    def clustered(s: list[str]) -> DataFrame:
        rows = cut(align_views({n: views[n] for n in s}))
        got = multiview_spectral(rows.drop("label"), known_k(rows))
        return got.join(rows.select("problem", "index", "label"), ["problem", "index"]).select(
            "problem", F.lit("/".join(s)).alias("embeddings"), "index", "cluster", "label"
        )

    keys = ["problem", "embeddings"]
    return f1_report(named_clusters(_union(_each(clustered, sets)), keys), keys)


def _view_sets(names: list[str]) -> list[list[str]]:
    return ([names] if len(names) > 2 else []) + [list(c) for c in combinations(names, 2)]


def _clusterings(rows: DataFrame, size: int, clusterers: list[str], ks: DataFrame) -> DataFrame:
    """Every clusterer on every view of an aligned set, once: columns ``c_<view>_<clusterer>``."""

    def clustered(cell: tuple[int, str]) -> DataFrame:
        i, c = cell
        return CLUSTERERS[c](rows.select("problem", "index", F.col(f"x{i}").alias("x")), ks).withColumnRenamed("cluster", f"c_{i}_{c}")

    found = _each(clustered, product(range(size), clusterers))
    return cut(reduce(lambda out, got: out.join(got, ["problem", "index"]), found, rows.select("problem", "index", "label")))


def voting_report(
    views: dict[str, DataFrame],
    clusterers: list[str] = REPORTED_CLUSTERERS,
    classifiers: list[str] = REPORTED_CLASSIFIERS,
    legacy_swap: bool = False,
) -> DataFrame:
    """F1 before and after self-training for every view set, clusterer tuple and classifier tuple.

    Each view is clustered once per view set; the grid of clusterer tuples is an array of
    cluster columns exploded into one long table, so consensus, alignment and scoring of
    all cells are single jobs. Cells without k compatible paths give an ``error`` row.
    """

    def of_set(s: list[str]) -> DataFrame:
        rows = cut(align_views({n: views[n] for n in s}))
        anchored = sorted(s, key=lambda n: 0)
        for i, n in enumerate(anchored):
            if n in ("w2v", "tfidf"):
                anchored[0], anchored[i] = anchored[i], anchored[0]
                break
        ks = cut(known_k(rows))
        found = _clusterings(rows, len(s), clusterers, ks)
        cells = [
            F.struct(F.lit("/".join(t)).alias("clusterings"), *[F.col(f"c_{i}_{c}").alias(f"c{i}") for i, c in enumerate(t)])
            for t in product(clusterers, repeat=len(s))
        ]
        grid = cut(found.select("problem", "index", "label", F.inline(F.array(*cells))))
        keys, cols = ["problem", "clusterings"], [f"c{i}" for i in range(len(s))]
        counts = grid.groupBy(*keys, F.concat_ws("$", *[F.col(c).cast("string") for c in cols]).alias("path")).agg(F.count(F.lit(1)).alias("n"))
        chosen = cut(consensus(counts, ks, keys))
        seeds = cut(seed_sets(grid, cols, chosen, keys))
        named = cut(named_clusters(seeds.filter("agreed"), keys, labels=rows))
        before = f1_report(named, keys, legacy_swap)
        embeddings = F.lit("/".join(anchored)).alias("embeddings")
        failed = chosen.filter(F.col("path").isNull()).select("problem", "clusterings")
        xs = [f"x{i}" for i in range(len(s))]
        data = rows.select("problem", "index", *xs)
        # a grid cell is its own problem for the learners, so one call trains every cell
        cell = F.concat_ws("\u0001", "problem", "clusterings").alias("cell")
        agreed = named.filter(F.col("y_pred").isNotNull()).select(cell, "problem", "index", F.col("y_pred").alias("label")).join(data, ["problem", "index"]).drop("problem")
        ok = seeds.join(failed, keys, "left_anti")
        # agreed rows of a cluster without a label have to find one like the rest
        unnamed = named.filter(F.col("y_pred").isNull()).select(cell, "problem", "index")
        rest = ok.filter(~F.col("agreed")).select(cell, "problem", "index").unionByName(unnamed).join(data, ["problem", "index"]).drop("problem")

        def trained(t: tuple[str, ...]) -> DataFrame:
            grown = self_train(
                agreed.withColumnRenamed("cell", "problem"), rest.withColumnRenamed("cell", "problem"), [CLASSIFIERS[c] for c in t]
            )
            after = grown.select(
                F.split_part("problem", F.lit("\u0001"), F.lit(1)).alias("problem"),
                F.split_part("problem", F.lit("\u0001"), F.lit(2)).alias("clusterings"),
                "index",
                F.col("label").alias("y_pred"),
            ).join(rows.select("problem", "index", F.col("label").alias("y_true")), ["problem", "index"])
            scored = f1_report(after, keys, legacy_swap)
            names = ["f1_micro", "f1_macro", "f1_weighted", "samples"]
            both = before.select(*keys, *[F.col(c).alias(f"{c}_before") for c in names]).join(
                scored.select(*keys, *[F.col(c).alias(f"{c}_after") for c in names]), keys
            )
            error = failed.select(*keys, *[F.lit(None).cast("bigint" if c == "samples" else "double").alias(f"{c}_{w}") for w in ("before", "after") for c in names])
            every = both.withColumn("error", F.lit(False)).unionByName(error.withColumn("error", F.lit(True)))
            return every.select("problem", embeddings, "clusterings", F.lit("/".join(t)).alias("estimators"), *both.columns[2:], "error")

        return _union(_each(trained, product(classifiers, repeat=len(s))))

    return _union(_each(of_set, _view_sets(list(views))))


def predict(
    views: dict[str, DataFrame],
    method: str,
    k: DataFrame,
    clusterers: list[str] | None = None,
    classifiers: list[str] | None = None,
) -> DataFrame:
    """Groups without ground truth: ``(problem, index, group)``.

    ``method`` is kclustering (one view, one clusterer), mv_spectral_clustering (aligned
    views) or unsupervised_voting (one clusterer and one classifier per view). ``k(problem, k)``.
    Problems without k compatible voting paths come back with a null group.
    """
    names = list(views)
    if method == "kclustering":
        view = views[names[0]]
        return CLUSTERERS[(clusterers or ["kmeans"])[0]](view, k).withColumnRenamed("cluster", "group")
    rows = cut(align_views({n: v if "label" in v.columns else v.withColumn("label", F.lit("")) for n, v in views.items()}))
    if method == "mv_spectral_clustering":
        return multiview_spectral(rows.drop("label"), k).withColumnRenamed("cluster", "group")
    if method != "unsupervised_voting":
        raise ValueError(f"unknown method {method}")
    clusterers = clusterers or ["kmeans"] * len(names)
    learners: list[Callable] = [CLASSIFIERS[c] for c in classifiers or ["random_forest"] * len(names)]
    assign = rows.drop("label")
    for i, c in enumerate(clusterers):
        got = CLUSTERERS[c](rows.select("problem", "index", F.col(f"x{i}").alias("x")), k)
        assign = assign.join(got.withColumnRenamed("cluster", f"c{i}"), ["problem", "index"])
    assign = cut(assign)
    cols = [f"c{i}" for i in range(len(clusterers))]
    chosen = cut(consensus(path_counts(assign, cols), k))
    lost = chosen.filter(F.col("path").isNull()).select("problem")
    unresolved = assign.join(lost, "problem", "left_semi").select("problem", "index", F.lit(None).cast("int").alias("group"))
    assign = assign.join(lost, "problem", "left_anti")
    seeds = cut(seed_sets(assign, cols, chosen))
    agreed = seeds.filter("agreed").withColumn("label", F.col("cluster").cast("string"))
    grown = self_train(agreed, seeds.filter(~F.col("agreed")), learners, final=True)
    return grown.select("problem", "index", F.col("label").cast("int").alias("group")).unionByName(unresolved)


# ---- many labels --------------------------------------------------------------------------------


def multilabel_evaluation(scored: DataFrame, labels: list[str], threshold: float = 0.4, y: str = "Y", scores: str = "scores") -> DataFrame:
    """(label, metric, value): the whole evaluation of predicted scores in one table.

    ``precision``, ``recall``, ``f1`` and ``support`` per label and of the four averages, ``auc`` per label and as ``macro avg``, and ``hamming_loss``
    of ``all``. A score of ``threshold`` or more predicts its label. The AUC of a label with one class only is null and stays out of
    the mean; rows without target or scores are left out, and a table without rows has no labels.
    """
    rows = cut(scored.where(F.col(y).isNotNull() & F.col(scores).isNotNull()).select(F.col(y).alias("y"), F.col(scores).alias("s"), binarize(F.col(scores), threshold).alias("p")))
    report = classification_report(rows, labels).select("label", *[F.col(c).cast("double").alias(c) for c in ("precision", "recall", "f1", "support")])
    out = report.unpivot(["label"], ["precision", "recall", "f1", "support"], "metric", "value")
    names = F.array(*[F.lit(x) for x in labels])
    auc = cut(roc_auc(rows.select(F.inline(F.arrays_zip(names.alias("label"), F.col("y"), F.col("s").alias("score")))).where("label IS NOT NULL AND y IS NOT NULL")))
    mean = auc.agg(F.avg("auc").alias("value")).select(F.lit("macro avg").alias("label"), F.lit("auc").alias("metric"), "value")
    out = out.unionByName(auc.select("label", F.lit("auc").alias("metric"), F.col("auc").alias("value"))).unionByName(mean)
    return out.unionByName(hamming_loss(rows).select(F.lit("all").alias("label"), F.lit("hamming_loss").alias("metric"), F.col("hamming_loss").alias("value")))


def multilabel_report(train: DataFrame, test: DataFrame, views: list[str], labels: list[str], threshold: float = 0.4) -> DataFrame:
    """Fit on ``train``, score ``test``, and evaluate: see ``multilabel_fit_predict`` and ``multilabel_evaluation``."""
    return multilabel_evaluation(multilabel_fit_predict(train, test, views, labels, threshold), labels, threshold)
