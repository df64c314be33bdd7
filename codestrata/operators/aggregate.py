"""Corpus statistics and metrics. Every metric reduces to counts before anything is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.arrays import dot
from codestrata.scale import first_per_key, hash_rank, range_running, stable_hash


def corpus_stats(df: DataFrame, flag: str = "compiles") -> DataFrame:
    """Files and compilable files per problem and solution kind."""
    return df.groupBy("problem", "label").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col(flag)).alias("compilable"))


def tag_distribution(df: DataFrame, labels: list[str], n: int | None = None) -> DataFrame:
    out = (
        df.select(F.explode("tags").alias("tag"))
        .filter(F.col("tag").isin(labels))
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), F.col("tag").desc())
    )
    return out.limit(n) if n else out


def labels(df: DataFrame, col: str = "label") -> DataFrame:
    return df.select(col).distinct()


def path_counts(assign: DataFrame, clusters: list[str]) -> DataFrame:
    """Solutions per combination of cluster ids over all views."""
    path = F.concat_ws("$", *[F.col(c).cast("string") for c in clusters])
    return assign.groupBy("problem", path.alias("path")).agg(F.count(F.lit(1)).alias("n"))


def contingency(assign: DataFrame, keys: list[str] = ("problem",)) -> DataFrame:
    return assign.groupBy(*keys, "cluster", "label").agg(F.count(F.lit(1)).alias("n"))


def relevant_counts(functions: DataFrame) -> DataFrame:
    """How many functions share a name within the same file of the same project."""
    return functions.groupBy("project", "file_name", "function_name").agg(F.count(F.lit(1)).alias("n"))


def group_solutions(df: DataFrame, key: str, fields: list[str], order: str, chunk: int = 1000) -> DataFrame:
    """Solutions of a problem as lists of at most ``chunk``; ``part`` numbers the lists of one problem.

    A list without a bound would pull a popular problem into one row.
    """
    d = hash_rank(df.withColumn("__h", stable_hash("group", order)), [key], "__h", [order], out="__rn")
    return (
        d.withColumn("part", F.floor((F.col("__rn") - 1) / chunk))
        .groupBy(key, "part")
        .agg(F.sort_array(F.collect_list(F.struct("__rn", *fields))).alias("s"))
        .select(key, "part", F.transform("s", lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias("solutions"))
    )


def dedup_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First occurrence of every key."""
    return first_per_key(df, key, order)


def fold_sizes(df: DataFrame, by: list[str] = ()) -> DataFrame:
    return df.groupBy("fold", *by).agg(F.count(F.lit(1)).alias("n"))


# ---- classification -----------------------------------------------------------------------------


def f1_report(df: DataFrame, keys: list[str], swap: bool = False) -> DataFrame:
    """Micro, macro and weighted F1 and the sample size per group, for one label per row.

    A null prediction is a wrong one and no class of its own. ``swap`` exchanges truth and prediction, which changes only the weighted score.
    """
    t, p = ("y_pred", "y_true") if swap else ("y_true", "y_pred")
    cells = df.groupBy(*keys, F.col(t).alias("t"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    sides = cells.select(
        *keys,
        F.inline(
            F.array(
                F.struct(
                    F.col("t").alias("label"), F.col("n").alias("support"), zero.alias("predicted"),
                    F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(zero).alias("tp"),
                ),
                F.struct(F.col("p").alias("label"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp")),
            )
        ),
    )
    per = (
        sides.filter(F.col("label").isNotNull() | (F.col("support") > 0))
        .groupBy(*keys, "label")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
        .withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), (F.col("support") + F.col("predicted")).cast("double")), F.lit(0.0)))
    )
    return per.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("support")).alias("f1_micro"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
        F.sum("support").alias("samples"),
    )


def _prf(tp, predicted, support):
    zero = F.lit(0.0)
    return (
        F.coalesce(F.try_divide(tp.cast("double"), predicted.cast("double")), zero).alias("precision"),
        F.coalesce(F.try_divide(tp.cast("double"), support.cast("double")), zero).alias("recall"),
        F.coalesce(F.try_divide(2.0 * tp, (predicted + support).cast("double")), zero).alias("f1"),
    )


def classification_report(df: DataFrame, names: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Precision, recall, F1 and support per label, and the micro, macro, weighted and samples averages."""
    pairs = df.select(F.posexplode(F.arrays_zip(F.col(y).alias("y"), F.col(p).alias("p"))).alias("pos", "c"))
    per = pairs.groupBy("pos").agg(
        F.sum((F.col("c.y") * F.col("c.p")).cast("long")).alias("tp"),
        F.sum(F.col("c.p").cast("long")).alias("predicted"),
        F.sum(F.col("c.y").cast("long")).alias("support"),
    )
    label = F.get(F.array(*[F.lit(n) for n in names]), F.col("pos"))
    rows = per.select(label.alias("label"), *_prf(F.col("tp"), F.col("predicted"), F.col("support")), "tp", "predicted", "support")
    micro = rows.agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"), F.sum("support").alias("support")).select(
        F.lit("micro avg").alias("label"), *_prf(F.col("tp"), F.col("predicted"), F.col("support")), "support"
    )
    macro = rows.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support")).withColumn("label", F.lit("macro avg"))
    weighted = rows.agg(
        *[F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support").cast("double")), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")],
        F.sum("support").alias("support"),
    ).withColumn("label", F.lit("weighted avg"))
    add = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x.cast("int"))
    tp = add(F.zip_with(F.col(y), F.col(p), lambda a, b: a * b))
    samples = (
        df.select(*_prf(tp, add(F.col(p)), add(F.col(y))), add(F.col(y)).alias("support"))
        .agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
        .withColumn("label", F.lit("samples avg"))
    )
    out = rows.drop("tp", "predicted")
    for part in (micro, macro, weighted, samples):
        out = out.unionByName(part)
    return out


def hamming_loss(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    wrong = F.aggregate(F.zip_with(F.col(y), F.col(p), lambda a, b: (a != b).cast("int")), F.lit(0), lambda s, x: s + x)
    return df.agg((F.sum(wrong) / F.sum(F.size(y))).alias("hamming_loss"))


def roc_auc(df: DataFrame, key: str = "label", y: str = "y", score: str = "score") -> DataFrame:
    """Area under the ROC curve per label from rank sums; ties share their mean rank.

    Equal scores are counted first; the running count is range partitioned, so a
    label with all the rows is still ranked by many tasks.
    """
    cells = df.groupBy(key, score).agg(
        F.count(F.lit(1)).alias("c"), F.sum(F.col(y).cast("long")).alias("pos")
    )
    ranked = range_running(cells, [key], [F.col(score)], {"before": "c"})
    got = ranked.groupBy(key).agg(
        F.sum(F.col("pos") * (F.col("before") + (F.col("c") + 1) / 2.0)).alias("r"),
        F.sum("pos").cast("double").alias("np"),
        F.sum(F.col("c") - F.col("pos")).cast("double").alias("nn"),
    )
    return got.select(key, F.try_divide(F.col("r") - F.col("np") * (F.col("np") + 1) / 2, F.col("np") * F.col("nn")).alias("auc"))


def roc_curve(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """(threshold, tpr, fpr) at every distinct score, from high to low, and the start point at infinity."""
    clean = F.coalesce(F.when(~F.isnan(score), F.col(score)), F.lit(0.0))
    cells = df.groupBy(clean.alias("threshold")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg")
    )
    run = range_running(cells, [], [F.col("threshold").desc()], {"pos_before": "pos", "neg_before": "neg"})
    n_pos = run.agg(F.sum("pos")).scalar()
    n_neg = run.agg(F.sum("neg")).scalar()
    points = run.select(
        "threshold",
        F.try_divide((F.col("pos_before") + F.col("pos")).cast("double"), n_pos).alias("tpr"),
        F.try_divide((F.col("neg_before") + F.col("neg")).cast("double"), n_neg).alias("fpr"),
    )
    start = df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))
    return points.unionByName(start)


def pair_auc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Area under the pair ROC curve; missing similarities count as 0."""
    clean = F.coalesce(F.when(~F.isnan(score), F.col(score)), F.lit(0.0))
    return roc_auc(df.select(F.lit("all").alias("label"), (F.col(y) == 1).cast("int").alias("y"), clean.alias("score"))).select("auc")


def pair_loss(df: DataFrame, batch: str = "batch", a: str = "x_a", b: str = "x_b", y: str = "y") -> DataFrame:
    """Sum of squared errors between similarity and label per batch, then weighted by batch size."""
    per = df.groupBy(batch).agg(F.sum(F.pow(dot(F.col(a), F.col(b)) - F.col(y), F.lit(2.0))).alias("loss"), F.count(F.lit(1)).alias("n"))
    return per.agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"))


def mean_curves(df: DataFrame, config: list[str], values: list[str]) -> DataFrame:
    """Curves averaged over the queries of a configuration, then over configurations."""
    per = df.groupBy(*config, "k").agg(*[F.avg(v).alias(v) for v in values])
    return per.groupBy("k").agg(*[F.avg(v).alias(v) for v in values])
