"""The language stage of the pipeline: junk with letters, documents without a label, tables without any."""

from pyspark.sql import functions as F

import corpus_pipeline
from codestrata.llm import language_id

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
JUNK = ["| --- | :: ; ; ;; <<>> a " * 10, "0x1f 0x2a 0x3b " * 30]


def by_language(spark, docs):
    return {r["doc_id"]: r["lang"] for r in dict(corpus_pipeline.STAGES)["language_id"](spark, docs, FOLDER).collect()}


def lettered(docs):
    return {r["doc_id"] for r in docs.collect() if language_id.LETTER.search(r["text"] or "")}


def test_low_scores_go_and_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    junk = spark.createDataFrame([(10**6 + i, t, None, "src0", len(t)) for i, t in enumerate(JUNK)], SCHEMA)
    assert set(by_language(spark, docs.unionByName(junk))) == lettered(docs)


def test_null_languages_take_the_prediction(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    long = {r["doc_id"]: r["lang"] for r in docs.where("n_chars > 500 and doc_id % 7 = 1").collect()}
    hidden = docs.withColumn("lang", F.when(F.col("doc_id").isin(list(long)), F.lit(None)).otherwise(F.col("lang")))
    got = by_language(spark, hidden)
    assert len(long) > 15 and sum(got[k] == lang for k, lang in long.items()) >= 0.95 * len(long)
    assert all(got[r["doc_id"]] == r["lang"] for r in hidden.where("lang is not null").collect() if r["doc_id"] in got)


def test_no_labels_at_all(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select(*corpus_pipeline.COLUMNS).withColumn("lang", F.lit(None).cast("string"))
    got = by_language(spark, docs)
    assert set(got) == lettered(docs) and set(got.values()) == {None}


def test_low_scores_come_from_all_held_out_texts(spark):
    """More held-out texts than any bounded sample had, with the low scores in few of them."""
    n, text = 60_000, "t" * 200
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"), F.lit("en").alias("lang"), F.lit("en").alias("lang_pred"), (F.col("id") / (10 * n)).alias("made"))
    rows = rows.withColumn("score", F.round("made", 6))
    held = sorted(r["score"] for r in rows.where(language_id.held_out()).select("score").collect())
    assert len(held) > 10_000
    at = 0.01 * (len(held) - 1)
    want = held[int(at)] + (held[int(at) + 1] - held[int(at)]) * (at % 1)
    got = language_id.low_scores(rows)
    assert set(got) == {2} and abs(got[2] - want / 2) < 1e-12
