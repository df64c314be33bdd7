"""Corpus statistics, classification metrics, curves of pair similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.catalog import fixtures as fx
from codestrata.catalog.registry import Tables, query
from codestrata.functions import arrays as A
from codestrata.operators import aggregate as G
from codestrata.operators.split import suffix_duplicates

NUM = 6


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(c, NUM))
    return df


@query(
    "corpus_stats",
    f"WITH {fx.CORPUS} SELECT problem, label, count(*) AS files, count(*) FILTER (n_chars % 3 <> 0) AS compilable FROM corpus GROUP BY ALL",
)
def _(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("source").alias("problem"), F.concat("source", F.lit("$"), "lang").alias("label"), (F.col("n_chars") % 3 != 0).alias("compiles"))
    return G.corpus_stats(rows)


@query(
    "tag_distribution",
    f"""WITH {fx.LABEL_ROWS}, long AS (SELECT unnest(tags) AS tag FROM label_rows) SELECT tag, count(*) AS n FROM long
    WHERE tag IN ('en', 'fr', 'de', 'quality', 'toxic') GROUP BY tag ORDER BY n DESC, tag DESC LIMIT 4""",
)
def _(t: Tables) -> DataFrame:
    return G.tag_distribution(fx.label_rows(t), fx.LABELS, 4)


@query(
    "path_counts",
    f"WITH {fx.GIVEN_CLUSTERS} SELECT problem, concat(c0, '$', c1, '$', c2) AS path, count(*) AS n FROM given GROUP BY ALL",
)
def _(t: Tables) -> DataFrame:
    return G.path_counts(fx.given_clusters(t), ["c0", "c1", "c2"])


@query("contingency", f"WITH {fx.GIVEN_CLUSTERS} SELECT problem, cast(c1 AS int) AS cluster, label, count(*) AS n FROM given GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return G.contingency(fx.given_clusters(t).withColumn("cluster", F.col("c1")))


@query("relevant_counts", f"WITH {fx.FUNCTIONS} SELECT project, file_name, function_name, count(*) AS n FROM functions GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return G.relevant_counts(fx.functions(t))


CHUNK = 50


@query(
    "group_solutions",
    f"""WITH r AS (SELECT o_custkey % 40 AS problem, o_orderkey AS solution, o_orderstatus AS owner,
       row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY md5(concat('group:', o_orderkey)), o_orderkey) AS rn FROM orders)
    SELECT problem, (rn - 1) // {CHUNK} AS part, string_agg(concat(solution, owner), ' ' ORDER BY rn) AS solutions FROM r GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    rows = t.orders.select((F.col("o_custkey") % 40).alias("problem"), F.col("o_orderkey").alias("solution"), F.col("o_orderstatus").alias("owner"))
    got = G.group_solutions(rows, "problem", ["solution", "owner"], "solution", CHUNK)
    return got.select("problem", "part", F.array_join(F.transform("solutions", lambda s: F.concat(s["solution"].cast("string"), s["owner"])), " ").alias("solutions"))


@query(
    "dedup_first",
    "SELECT text AS name, min(doc_id) AS pos, arg_min(source, doc_id) AS source FROM documents GROUP BY text",
)
def _(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("text").alias("name"), F.col("doc_id").alias("pos"), "source")
    return G.dedup_first(rows, ["name"], ["pos"])


@query(
    "suffix_duplicates",
    """WITH r AS (SELECT o_orderkey AS id, concat('dir', o_custkey % 10) AS dir, concat(o_custkey % 50 + 100, 'A.CPP') AS name FROM orders),
    n AS (SELECT *, row_number() OVER (PARTITION BY dir, name ORDER BY md5(concat('name:', id)), id) AS rn FROM r)
    SELECT id, dir, name, CASE WHEN rn > 1 THEN concat(split_part(name, '.CPP', 1), '_', rn, '.CPP') ELSE name END AS unique_name FROM n""",
)
def _(t: Tables) -> DataFrame:
    c = F.col("o_custkey")
    rows = t.orders.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("dir"), (c % 10).cast("string")).alias("dir"), F.concat((c % 50 + 100).cast("string"), F.lit("A.CPP")).alias("name")
    )
    return suffix_duplicates(rows, ["dir"], "name", "id")


@query(
    "fold_sizes",
    "SELECT CASE WHEN o_orderkey % 10 < 7 THEN 'train' ELSE 'test' END AS fold, o_orderstatus AS tag, count(*) AS n FROM orders GROUP BY ALL",
)
def _(t: Tables) -> DataFrame:
    rows = t.orders.select(F.when(F.col("o_orderkey") % 10 < 7, "train").otherwise("test").alias("fold"), F.col("o_orderstatus").alias("tag"))
    return G.fold_sizes(rows, ["tag"])


# ---- classification -----------------------------------------------------------------------------


def f1_sql(relation: str, keys: str) -> str:
    """F1 per group written from per-class counts over all classes of a group."""
    k = ", ".join(f"t.{c.strip()}" for c in keys.split(","))
    on = " AND ".join(f"t.{c.strip()} = p.{c.strip()}" for c in keys.split(","))
    return f"""truth AS (SELECT {keys}, y_true AS c, count(*) AS support, count(*) FILTER (y_true = y_pred) AS tp FROM {relation} GROUP BY ALL),
    guess AS (SELECT {keys}, y_pred AS c, count(*) AS predicted FROM {relation} GROUP BY ALL),
    per AS (SELECT {', '.join(f'coalesce(t.{c.strip()}, p.{c.strip()}) AS {c.strip()}' for c in keys.split(','))}, coalesce(t.tp, 0) AS tp, coalesce(t.support, 0) AS support,
      2.0 * coalesce(t.tp, 0) / (coalesce(t.support, 0) + coalesce(p.predicted, 0)) AS f1 FROM truth t FULL JOIN guess p ON {on} AND t.c = p.c)
    SELECT {keys}, round(sum(tp) / sum(support), 6) AS f1_micro, round(avg(f1), 6) AS f1_macro, round(sum(f1 * support) / sum(support), 6) AS f1_weighted,
      cast(sum(support) AS bigint) AS samples FROM per GROUP BY ALL"""


@query("f1_report", f"WITH {fx.PREDICTIONS}, {f1_sql('predictions', 'grp')}")
def _(t: Tables) -> DataFrame:
    return rounded(G.f1_report(fx.predictions(t), ["grp"]), "f1_micro", "f1_macro", "f1_weighted")


@query(
    "f1_report_swapped",
    f"WITH {fx.PREDICTIONS}, swapped AS (SELECT grp, y_pred AS y_true, y_true AS y_pred FROM predictions), {f1_sql('swapped', 'grp')}",
)
def _(t: Tables) -> DataFrame:
    return rounded(G.f1_report(fx.predictions(t), ["grp"], swap=True), "f1_micro", "f1_macro", "f1_weighted")


_PRF = "coalesce({tp} / nullif({p}, 0), 0) AS precision, coalesce({tp} / nullif({s}, 0), 0) AS recall, coalesce(2.0 * {tp} / nullif({p} + {s}, 0), 0) AS f1"


# from ``cells`` (index, label, y, p) to ``a``, the rows of the report
REPORT = f"""per AS (SELECT label, sum(y * p) AS tp, sum(p) AS pr, sum(y) AS su FROM cells GROUP BY label),
    rep AS (SELECT label, {_PRF.format(tp='tp', p='pr', s='su')}, su AS support FROM per),
    one AS (SELECT index, sum(y * p) AS tp, sum(p) AS pr, sum(y) AS su FROM cells GROUP BY index),
    ind AS (SELECT {_PRF.format(tp='tp', p='pr', s='su')}, su AS support FROM one),
    a AS (SELECT * FROM rep
      UNION ALL SELECT 'micro avg', {_PRF.format(tp='sum(tp)', p='sum(pr)', s='sum(su)')}, sum(su) FROM per
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM rep
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM rep
      UNION ALL SELECT 'samples avg', avg(precision), avg(recall), avg(f1), sum(support) FROM ind)"""


@query(
    "classification_report",
    f"""WITH {fx.SCORED_ROWS},
    {REPORT}
    SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, cast(support AS bigint) AS support FROM a""",
)
def _(t: Tables) -> DataFrame:
    rows = fx.scored_rows(t).select(F.col("Y").alias("y"), A.binarize(F.col("scores")).alias("p"))
    return rounded(G.classification_report(rows, fx.LABELS), "precision", "recall", "f1")


@query("hamming_loss", f"WITH {fx.SCORED_ROWS} SELECT round(avg(CASE WHEN y <> p THEN 1.0 ELSE 0.0 END), 6) AS hamming_loss FROM cells")
def _(t: Tables) -> DataFrame:
    rows = fx.scored_rows(t).select(F.col("Y").alias("y"), A.binarize(F.col("scores")).alias("p"))
    return rounded(G.hamming_loss(rows), "hamming_loss")


@query(
    "roc_auc",
    f"""WITH {fx.SCORED_ROWS}, r AS (SELECT label, y, rank() OVER (PARTITION BY label ORDER BY score) AS lo, count(*) OVER (PARTITION BY label, score) AS c FROM cells),
    s AS (SELECT label, sum(CASE WHEN y = 1 THEN lo + (c - 1) / 2.0 END) AS r, sum(y) AS np, sum(1 - y) AS nn FROM r GROUP BY label)
    SELECT label, round((r - np * (np + 1) / 2.0) / (np * nn), 6) AS auc FROM s""",
)
def _(t: Tables) -> DataFrame:
    rows = fx.scored_rows(t).select(
        F.inline(F.arrays_zip(F.array(*[F.lit(x) for x in fx.LABELS]).alias("label"), F.col("Y").alias("y"), F.col("scores").alias("score")))
    )
    return rounded(G.roc_auc(rows), "auc")


@query(
    "roc_curve",
    f"""WITH {fx.PREDICTIONS}, c AS (SELECT score AS threshold, sum(y_bin) AS p, sum(1 - y_bin) AS n FROM predictions GROUP BY score),
    w AS (SELECT threshold, sum(p) OVER o AS cp, sum(n) OVER o AS cn, sum(p) OVER () AS tp, sum(n) OVER () AS tn FROM c WINDOW o AS (ORDER BY threshold DESC))
    SELECT threshold, round(cp / tp, 6) AS tpr, round(cn / tn, 6) AS fpr FROM w UNION ALL SELECT 'infinity'::double, 0.0, 0.0""",
)
def _(t: Tables) -> DataFrame:
    return rounded(G.roc_curve(fx.predictions(t).withColumn("y", F.col("y_bin"))), "tpr", "fpr")


@query(
    "pair_auc",
    f"""WITH {fx.PREDICTIONS}, c AS (SELECT score, sum(y_bin) AS p, sum(1 - y_bin) AS n FROM predictions GROUP BY score),
    w AS (SELECT p, n, sum(p) OVER (ORDER BY score DESC) - p AS above, sum(p) OVER () AS tp, sum(n) OVER () AS tn FROM c)
    SELECT round(sum(n * (above + p / 2.0)) / (max(tp) * max(tn)), 6) AS auc FROM w""",
)
def _(t: Tables) -> DataFrame:
    return rounded(G.pair_auc(fx.predictions(t).withColumn("y", F.col("y_bin"))), "auc")


@query(
    "pair_loss",
    f"""WITH {fx.VECTORS}, n AS (SELECT count(*) AS n FROM vectors),
    p AS (SELECT a.index % 25 AS batch, list_inner_product(a.x, b.x) AS s, CASE WHEN a.label = b.label THEN 1 ELSE -1 END AS y FROM vectors a JOIN vectors b ON b.index = a.index + 1),
    per AS (SELECT batch, sum((s - y) * (s - y)) AS loss, count(*) AS n FROM p GROUP BY batch)
    SELECT round(sum(loss * n) / sum(n), 6) AS loss FROM per""",
)
def _(t: Tables) -> DataFrame:
    v = fx.vectors(t)
    a = v.select("index", F.col("x").alias("x_a"), F.col("label").alias("la"))
    b = v.select((F.col("index") - 1).alias("index"), F.col("x").alias("x_b"), F.col("label").alias("lb"))
    pairs = a.join(b, "index").withColumn("batch", F.col("index") % 25).withColumn("y", F.when(F.col("la") == F.col("lb"), 1).otherwise(-1))
    return rounded(G.pair_loss(pairs), "loss")
