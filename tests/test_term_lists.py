"""Term weights and token ids are found where the documents are; keys that repeat or are null, and large vocabularies, give the same rows."""

import math
from collections import Counter

import pytest

from codestrata.operators import reshape as R
from codestrata.operators import vectorize as V

TEXTS = [(1, "a b a c"), (2, "b d"), (None, "a e"), (2, "b b f"), (None, "e"), (3, ""), (4, None), (5, "a b c d e f g h"), (6, "?")]


def documents(spark, rows=TEXTS):
    return spark.createDataFrame([(k, None if t is None else t.split(" ")) for k, t in rows], "key long, tokens array<string>").repartition(3)


def plain_weights(rows):
    counts = {}
    for k, t in rows:
        own = Counter(x for x in (t or "").split() if x.isalpha())
        counts[k] = counts.get(k, Counter()) + own
    df = Counter(x for c in counts.values() for x in c)
    idf = {x: math.log((1 + len(rows)) / (1 + n)) + 1 for x, n in df.items()}
    out = {}
    for k, c in counts.items():
        length = math.sqrt(sum((n * idf[x]) ** 2 for x, n in c.items()))
        out |= {(k, x): round(n * idf[x] / length, 9) for x, n in c.items()}
    return out


@pytest.mark.parametrize("most", [500_000, 2])
@pytest.mark.parametrize("rows", [TEXTS, TEXTS[:2], []], ids=["repeated", "unique", "none"])
def test_tfidf(spark, monkeypatch, most, rows):
    monkeypatch.setattr(V, "SMALL_ROWS", most)
    monkeypatch.setattr(V, "DOCS", 2)
    got = V.tfidf(documents(spark, rows), "key").collect()
    assert {(r["key"], r["term"]): round(r["w"], 9) for r in got} == plain_weights(rows)
    assert len(got) == len(plain_weights(rows))


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_documents_stay_where_they_are(spark):
    rows = [(i, f"a b{i % 7} c") for i in range(40)]
    docs = spark.createDataFrame([(k, t.split(" ")) for k, t in rows], "key long, tokens array<string>")
    vocab = spark.createDataFrame([("a", 0), ("b1", 1)], "token string, id long")
    assert shuffles(V.tfidf(docs, "key")) == 0
    assert shuffles(R.encode_tokens(docs, vocab, "key")) == 0


@pytest.mark.parametrize("most", [500_000, 2])
@pytest.mark.parametrize("vocab", [[("a", 0), ("b", 1), ("e", 2), (None, 3), ("f", None)], [("a", 0), ("a", 1), ("b", 2)], []], ids=["single", "double", "none"])
def test_encode_tokens(spark, monkeypatch, most, vocab):
    monkeypatch.setattr(R, "SMALL_ROWS", most)
    monkeypatch.setattr(R, "DOCS", 2)
    rows = [*TEXTS, (7, "a  b")]
    docs = spark.createDataFrame([(k, None if t is None else [x or None for x in t.split(" ")] if t else []) for k, t in rows], "key long, tokens array<string>")
    got = {r["key"]: (r["ids"], r["shown"]) for r in R.encode_tokens(docs, spark.createDataFrame(vocab, "token string, id long"), "key").collect()}
    want = {}
    for k, t in rows:
        for pos, x in enumerate(t.split(" ") if t else []):
            ids = [i for v, i in vocab if v == x and x] or [None]
            want.setdefault(k, []).extend((pos, len(vocab) if i is None else i, None if not x else f"[{x}]" if i is None else x) for i in ids)
    order = lambda s: (s[0], s[1], s[2] or "")
    assert got == {k: ([s[1] for s in sorted(v, key=order)], [s[2] for s in sorted(v, key=order)]) for k, v in want.items()}
