"""From raw documents to a mixed training corpus: language, lines, near copies, mix, token pieces.

Every stage takes the documents that its predecessor kept and returns them in the same columns; the last one
returns the digest of what it encoded.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import language_id, line_dedup, mixing, near_copies, queries, sentence_pieces, simhash_dedup
from codestrata.session import cut, own_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BATCH_ROWS = 2000  # texts that go to a Python worker and back at a time: their buffers lie outside the heap, on both sides
MIX_SHARE = (9, 10)  # of the tokens that reach the mix


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents; the length is that of the text as it is now."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language can be told: those without a letter go, and those with a low score of the network.

    A document without ``lang`` takes the predicted one. If no document has a label, all with a letter stay as they are.
    """
    net = language_id.train(docs.where(~language_id.held_out()))
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    predicted = cut(language_id.predict(docs, net))  # every text runs through the network once
    low = F.lit(0.0)
    for length, score in language_id.low_scores(predicted).items():
        low = F.when(language_id.length_class(F.col("text")) == length, score).otherwise(low)
    found = predicted.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= low))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep every document with its own lines; lines shared by three or more stay with their last holder only."""
    return _documents(line_dedup.dedup_lines(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of every group of texts linked by close SimHash fingerprints, or by a Jaccard similarity of 0.8 over five-word shingles."""
    return near_copies.drop_similar(docs, groups=simhash_dedup.simhash_roots(docs)).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that fill the budget of the target weights."""
    found = mixing.mix(docs, queries.mix_levels(), queries.MIX_WEIGHTS, MIX_SHARE)
    return mixing.taken(docs, found).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: its pieces, their checksum and the text decoded from them."""
    model = queries.piece_model()
    ids = sentence_pieces.encode_pieces(docs, model)
    back = sentence_pieces.decode_pieces(ids, model, out="decoded")
    return back.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length("ids") / 4).cast("long").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The stage in a session that hands few texts at a time to Python; results do not depend on it."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("language_id", in_small_batches(by_language)),
    ("line_dedup", in_small_batches(without_shared_lines)),
    ("simhash_dedup", in_small_batches(without_near_copies)),
    ("mixing", in_small_batches(mixed)),
    ("sentence_pieces", in_small_batches(encoded)),
]

#: Neither a trained network nor XXH64 fingerprints can be written in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written to this application's part of the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        path = f"{own_folder(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
