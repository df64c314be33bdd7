"""The pipeline against the plain versions of its stages, and on odd tables."""

import zlib

import public_tokenizers
import pytest
import sentencepiece
from test_line_dedup import plain as plain_lines
from test_near_copies import plain_components

import corpus_pipeline
from codestrata.llm import language_id

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_by_definition(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "simhash_dedup", "mixing", "sentence_pieces"]
    told = spark.createDataFrame(stages["language_id"](spark, docs, FOLDER).collect(), SCHEMA)
    want = {r["doc_id"] for r in docs.collect() if language_id.LETTER.search(r["text"] or "")}
    assert {r["doc_id"] for r in told.collect()} == want

    lines = spark.createDataFrame(stages["line_dedup"](spark, told, FOLDER).collect(), SCHEMA)
    kept = {k: t for k, t, _, _ in plain_lines([(r["doc_id"], r["text"]) for r in told.collect()])}
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == kept
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    single = spark.createDataFrame(stages["simhash_dedup"](spark, lines, FOLDER).collect(), SCHEMA)
    assert {r["doc_id"] for r in single.collect()} == set(plain_components(list(kept.items())).values())

    chosen = spark.createDataFrame(stages["mixing"](spark, single, FOLDER).collect(), SCHEMA)
    words = lambda df: sum(len((r["text"] or "").split()) for r in df.collect())
    assert 0.8 * words(single) < words(chosen) <= 0.9 * words(single)
    assert {tuple(r) for r in chosen.collect()} <= {tuple(r) for r in single.collect()}

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = {r["doc_id"]: r for r in stages["sentence_pieces"](spark, chosen, FOLDER).collect()}
    for r in chosen.collect():
        ids = library.encode(r["text"])
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (out[r["doc_id"]]["n_pieces"], out[r["doc_id"]]["ids_crc32"]) == (len(ids), zlib.crc32(packed))
    assert len(out) == chosen.count()

    assert {r["doc_id"] for r in corpus_pipeline.run(spark, FOLDER).collect()} == set(out)


ODD = [
    (1, None, None, None, None),
    (2, "", "en", "src1", 0),
    (3, "12 34", "de", "src2", 5),
    (4, "a short text of words", None, None, 1),
    (4, "a short text of words", None, None, 1),
    (None, "a text without an id at all", "en", "other", 1),
    (5, "word " * 50_000, "en", "src0", 250_000),
]


@pytest.mark.parametrize("rows", [[], ODD], ids=["empty", "odd"])
def test_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "nowhere")
        if name != "sentence_pieces":
            assert out.columns == corpus_pipeline.COLUMNS
        got = out.collect()
        assert len(got) <= len(rows)
        if name in ("line_dedup", "sentence_pieces"):
            assert len(got) == len(rows)
        if rows and name == "simhash_dedup":
            assert len([r for r in got if r["doc_id"] == 4]) == 1


def test_stages_hand_few_texts_at_a_time_to_python(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "0")  # no limit
        seen = corpus_pipeline.in_small_batches(lambda s, docs, folder: int(s.conf.get(key)))(spark, None, "")
        assert 0 < seen <= corpus_pipeline.BATCH_ROWS
        spark.conf.set(key, "7")
        assert corpus_pipeline.in_small_batches(lambda s, docs, folder: int(s.conf.get(key)))(spark, None, "") == 7
    finally:
        spark.conf.set(key, before)
