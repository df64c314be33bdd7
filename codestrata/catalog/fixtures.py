"""Corpus relations derived from the given tables, once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.catalog.registry import Tables

LABELS = ["en", "fr", "de", "quality", "toxic"]

# ---- documents as solutions ---------------------------------------------------------------------


def corpus(t: Tables) -> DataFrame:
    return t.spread("documents", "doc_id").select(
        F.col("doc_id").alias("index"),
        F.col("source").alias("problem"),
        F.concat("source", F.lit("$"), "lang").alias("label"),
        "lang",
        "n_chars",
        F.col("text").alias("code"),
    )


CORPUS = """corpus AS (
  SELECT doc_id AS index, source AS problem, concat(source, '$', lang) AS label, lang, n_chars, text AS code FROM documents)"""

# a document as a problem whose solutions are its lines
PROBLEM_NAME = "CASE WHEN doc_id % 11 = 0 THEN 'April Fools Day Contest' WHEN doc_id % 7 = 0 THEN NULL ELSE 'Round' END"


def problems(t: Tables) -> DataFrame:
    lines = F.transform(
        F.filter(F.split("text", "\n"), lambda x: x != ""),
        lambda x, i: F.struct(F.concat(F.col("doc_id").cast("string"), F.lit("-"), i.cast("string")).alias("index"), x.alias("code")),
    )
    return label_rows(t).drop("n_chars").join(t.documents, F.col("index") == F.col("doc_id")).select(
        "index", "tags", "Y", F.expr(PROBLEM_NAME).alias("contest_name"), lines.alias("solutions"), F.col("n_chars").alias("difficulty")
    )


def label_rows(t: Tables) -> DataFrame:
    """Documents with tags (language, quality, toxic) and the multi-hot target."""
    d = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id", "left")
    tags = F.array_compact(
        F.array("lang", F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic"))
    )
    y = F.array(
        *[(F.col("lang") == x).cast("int") for x in ("en", "fr", "de")],
        F.coalesce("quality", F.lit(0)).cast("int"),
        F.coalesce("toxic", F.lit(0)).cast("int"),
    )
    return d.select(F.col("doc_id").alias("index"), tags.alias("tags"), y.alias("Y"), "n_chars")


LABEL_ROWS = """label_rows AS (
  SELECT d.doc_id AS index, d.n_chars, d.lang,
         list_filter([d.lang, CASE WHEN l.quality = 1 THEN 'quality' END, CASE WHEN l.toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS tags,
         [CASE WHEN lang = 'en' THEN 1 ELSE 0 END, CASE WHEN lang = 'fr' THEN 1 ELSE 0 END, CASE WHEN lang = 'de' THEN 1 ELSE 0 END,
          coalesce(l.quality, 0), coalesce(l.toxic, 0)] AS Y
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

# predicted label vectors: scores per label from a hash, so that ties and both classes occur
SCORE = "(('0x' || substr(md5(concat({i}, ':', index)), 1, 4))::bigint % 100) / 100.0"


def scored_rows(t: Tables) -> DataFrame:
    def score(i: int):
        return (F.conv(F.substring(F.md5(F.concat(F.lit(str(i)), F.lit(":"), F.col("index").cast("string"))), 1, 4), 16, 10).cast("long") % 100) / 100.0

    return label_rows(t).withColumn("scores", F.array(*[score(i) for i in range(len(LABELS))]))


SCORED_ROWS = LABEL_ROWS + """,
scored_rows AS (
  SELECT *, [""" + ", ".join(SCORE.format(i=i) for i in range(5)) + """] AS scores FROM label_rows),
cells AS (
  SELECT index, pos, ['en','fr','de','quality','toxic'][pos] AS label, Y[pos] AS y, scores[pos] AS score, CASE WHEN scores[pos] >= 0.4 THEN 1 ELSE 0 END AS p
  FROM scored_rows, (SELECT unnest([1,2,3,4,5]) AS pos))"""

# ---- truth and prediction -----------------------------------------------------------------------


def predictions(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "source", "lang", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return d.select(
        F.col("doc_id").alias("index"),
        F.col("source").alias("grp"),
        F.col("lang").alias("y_true"),
        F.when(F.col("doc_id") % 4 == 0, "en").otherwise(F.col("lang")).alias("y_pred"),
        F.coalesce("quality", F.lit(0)).alias("y_bin"),
        ((F.col("n_chars") % 100).cast("double") / 100.0).alias("score"),
    )


PREDICTIONS = """predictions AS (
  SELECT d.doc_id AS index, d.source AS grp, d.lang AS y_true, CASE WHEN d.doc_id % 4 = 0 THEN 'en' ELSE d.lang END AS y_pred,
         coalesce(l.quality, 0) AS y_bin, cast(d.n_chars % 100 AS double) / 100.0 AS score
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

# ---- vectors ------------------------------------------------------------------------------------


def vectors(t: Tables) -> DataFrame:
    """Labelled vectors: five problems with three solution kinds each."""
    problem = F.concat(F.lit("p"), (F.col("vec_id") % 5).cast("string"))
    return t.embeddings.select(
        F.col("vec_id").alias("index"),
        problem.alias("problem"),
        F.concat(problem, F.lit("$"), (F.col("label") % 3).cast("string")).alias("label"),
        F.transform("embedding", lambda v: v.cast("double")).alias("x"),
    )


VECTORS = """vectors AS (
  SELECT vec_id AS index, concat('p', vec_id % 5) AS problem, concat('p', vec_id % 5, '$', label % 3) AS label, embedding::double[] AS x FROM embeddings)"""


def half_views(t: Tables) -> dict[str, DataFrame]:
    """Three views: both halves of the vector and the whole one; one view lacks every seventh row."""
    v = vectors(t)
    return {
        "functions": v.withColumn("x", F.slice("x", 33, 32)).filter(F.col("index") % 7 != 0),
        "w2v": v.withColumn("x", F.slice("x", 1, 32)),
        "tfidf": v,
    }


HALF_VIEWS = VECTORS + """,
w2v AS (SELECT index, problem, label, x[1:32] AS x FROM vectors),
callees AS (SELECT index, problem, label, x[33:64] AS x FROM vectors WHERE index % 7 <> 0)"""


def separable(t: Tables) -> DataFrame:
    """The vectors with ten times a one-hot of the label behind them: any sound grouping is that by label."""
    kind = F.split_part("label", F.lit("$"), F.lit(2)).cast("int")
    return vectors(t).withColumn("x", F.concat("x", F.array(*[F.when(kind == i, 10.0).otherwise(0.0) for i in range(3)])))


def separable_views(t: Tables) -> dict[str, DataFrame]:
    """The views of ``half_views``, each with the one-hot."""
    v = separable(t)
    hot = F.slice("x", 65, 3)
    return {
        "functions": v.withColumn("x", F.concat(F.slice("x", 33, 32), hot)).filter(F.col("index") % 7 != 0),
        "w2v": v.withColumn("x", F.concat(F.slice("x", 1, 32), hot)),
        "tfidf": v,
    }


def label_groups(where: str = "true") -> str:
    """Relations ending in ``grouped``(problem, index, label, cluster): the rows by label, groups numbered by their smallest index."""
    return VECTORS + f""",
grouped AS (
  SELECT problem, index, label, cast(dense_rank() OVER (PARTITION BY problem ORDER BY first) - 1 AS int) AS cluster
  FROM (SELECT *, min(index) OVER (PARTITION BY problem, label) AS first FROM vectors WHERE {where}))"""


def given_clusters(t: Tables) -> DataFrame:
    """Cluster numbers of three views made from the label and the id; they mostly agree with the label."""
    kind = F.split_part("label", F.lit("$"), F.lit(2)).cast("int")
    i = F.col("index")
    return vectors(t).select(
        "problem",
        "index",
        "label",
        ((kind + 1) % 3).cast("int").alias("c0"),
        ((kind + F.when(i % 4 == 0, 1).otherwise(0)) % 3).cast("int").alias("c1"),
        ((kind + 2 + F.when(i % 6 == 0, 2).otherwise(0)) % 3).cast("int").alias("c2"),
        "x",
    )


GIVEN_CLUSTERS = VECTORS + """,
kinds AS (SELECT *, cast(split_part(label, '$', 2) AS int) AS kind FROM vectors),
given AS (
  SELECT problem, index, label, (kind + 1) % 3 AS c0, (kind + CASE WHEN index % 4 = 0 THEN 1 ELSE 0 END) % 3 AS c1,
         (kind + 2 + CASE WHEN index % 6 = 0 THEN 2 ELSE 0 END) % 3 AS c2, x FROM kinds)"""

# ---- functions and instructions -----------------------------------------------------------------


def functions(t: Tables) -> DataFrame:
    """A function table; several rows share project, file and function name."""
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.substring("o_orderpriority", 1, 1).alias("project"),
        F.col("o_orderstatus").alias("compiler"),
        F.concat(F.lit("O"), (F.col("o_custkey") % 4).cast("string")).alias("optimization"),
        F.concat(F.lit("f"), (F.col("o_custkey") % 20).cast("string")).alias("file_name"),
        F.concat(F.lit("fn"), (F.col("o_orderkey") % 10).cast("string")).alias("function_name"),
        (F.col("o_custkey") % 200).cast("int").alias("num_instructions"),
    )


FUNCTIONS = """functions AS (
  SELECT o_orderkey AS id, substr(o_orderpriority, 1, 1) AS project, o_orderstatus AS compiler, concat('O', o_custkey % 4) AS optimization,
         concat('f', o_custkey % 20) AS file_name, concat('fn', o_orderkey % 10) AS function_name, cast(o_custkey % 200 AS int) AS num_instructions
  FROM orders)"""


def instructions(t: Tables) -> DataFrame:
    """40 consecutive events are one function body; values in cents are immediates inside and outside +-5000."""
    return t.events.select(
        F.floor(F.col("event_id") / 40).alias("function_id"),
        (F.col("event_id") % 40).alias("pos"),
        F.col("event_type").alias("mnemonic"),
        F.round(F.col("value") * 100).cast("long").alias("imm"),
        (F.col("event_id") % 3).alias("kind"),
    )


INSTRUCTIONS = """instructions AS (
  SELECT event_id // 40 AS function_id, event_id % 40 AS pos, event_type AS mnemonic, cast(round(value * 100) AS bigint) AS imm, event_id % 3 AS kind FROM events)"""


def instruction_tokens(t: Tables) -> DataFrame:
    """(function_id, pos, token) with a small set of distinct tokens."""
    return instructions(t).select("function_id", "pos", F.concat(F.lit("X_"), "mnemonic", F.lit("_"), (F.col("imm") % 50).cast("string")).alias("token"))


INSTRUCTION_TOKENS = INSTRUCTIONS + """,
itokens AS (SELECT function_id, pos, concat('X_', mnemonic, '_', imm % 50) AS token FROM instructions)"""
