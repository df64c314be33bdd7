"""Language identification: held-out accuracy, the compiled network against the plain one, odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.llm import language_id as L
from codestrata.llm.queries import op5_language_id

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def net(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return L.train(docs.where(~L.held_out()))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    found = op5_language_id(spark, FOLDER).join(docs, "doc_id").collect()
    assert len(found) == 1000
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    own = [r["lang"] == r["lang_pred"] for r in found if r["held_out"]]
    assert len(own) > 150 and np.mean(own) > 0.95


def test_labels_take_no_part_in_predictions(spark, net):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source").limit(50)
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None)).withColumn("doc_id", F.col("doc_id") * 10)
    get = lambda d, k: {r["doc_id"] * k: (r["lang_pred"], r["score"]) for r in L.predict(d, net).collect()}
    assert get(docs, 10) == get(other, 1)


def test_compiled_network_is_the_network(net):
    x = np.random.default_rng(0).integers(0, 256, (40, L.WINDOW)).astype(np.uint8)
    plain = L._softmax(np.maximum(net.pooled(x)[0], 0) @ net.out + net.bias)
    assert np.abs(plain - L.Compiled(net).probabilities(x)).max() < 1e-5


def test_whole_texts_count(net):
    model = L.Compiled(net)
    english, german = ("the and of that with " * 30).encode(), ("der und die nicht mit sich " * 120).encode()
    assert model.of_texts([english])[0] == ["en"] and model.of_texts([german])[0] == ["de"]
    assert model.of_texts([english + german])[0] == ["de"]  # the longer part decides, wherever it is
    assert model.of_texts([german + english])[0] == ["de"]


def test_odd_rows(spark, net):
    rows = [(1, None, "a"), (2, "", "b"), (3, "123 !? 😀 _ ²", "c"), (None, "the and of", "d"), (5, "und die der nicht " * 50_000, "e"), (7, "é", "f"), (7, "é", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    out = L.predict(df, net)
    assert out.columns == ["doc_id", "text", "score", "lang_pred"]
    got = sorted([(r["doc_id"], r["lang_pred"], r["score"]) for r in out.collect()], key=repr)
    named = {k: v for k, v, _ in got}
    assert named[1] == named[2] == named[3] == L.UNKNOWN and named[None] == "en" and named[5] == "de"
    assert [s for k, _, s in got if k in (1, 2, 3)] == [0.0] * 3
    assert len([g for g in got if g[0] == 7]) == 2 and len({g for g in got if g[0] == 7}) == 1
    assert L.predict(df.limit(0), net).count() == 0


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, "en"), (3, "12", "de")], "doc_id long, text string, lang string")
    assert L.train(df) is None
    assert {r["lang_pred"] for r in L.predict(df, None).collect()} == {L.UNKNOWN}
    one = spark.createDataFrame([(1, "some text", "en"), (2, "more", "en")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in L.predict(one, L.train(one)).collect()} == {"en"}
