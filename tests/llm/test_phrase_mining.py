"""Collocations against a plain count of all phrases; the passes against what they must not miss."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from codestrata.llm import phrase_mining
from codestrata.llm.phrase_mining import collocations, frequent_phrases

SCHEMA = "doc_id long, lang string, text string"


def plain_counts(rows, most=5):
    counts, total = Counter(), Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    return counts, total


def plain(rows, least, top, most=5):
    counts, total = plain_counts(rows, most)
    frequent = {p: f for p, f in counts.items() if f >= least}
    out = []
    for (lang, p), a in frequent.items():
        if len(p) == 1:
            continue
        if any(g == lang and len(q) > len(p) and f >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), f in frequent.items()):
            continue
        score, k = min((1000 * a * total[lang] // (frequent[lang, p[:k]] * frequent[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, frequent[lang, p[:k]], frequent[lang, p[k:]], total[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        ranked += [(o[0], i, *o[1:]) for i, o in enumerate(own[:top], 1)]
    return sorted(ranked)


def made(seed, n, words="a b c d e F g h i j Été ù".split()):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "; "]) for _ in range(rng.randrange(60)))
        rows.append((i, rng.choice(["en", "de", None, "und", ""]), text))
    return rows


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("least, most, sample_of", [(3, 5, 8), (8, 5, 3), (20, 3, 50)])
def test_against_plain_counts(spark, least, most, sample_of):
    rows = made(least, 300)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert got(collocations(docs, min_count=least, max_words=most, top=40, sample_of=sample_of)) == plain(rows, least, 40, most)


def test_a_sample_that_proposes_nothing_loses_nothing(spark, monkeypatch):
    """Every frequent phrase is then a border failure, level by level."""
    rows = [(i, "en", "one two three four five six") for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA)
    passes = []
    run = phrase_mining._pass
    monkeypatch.setattr(phrase_mining, "_pass", lambda d, filters, *more: passes.append(len(filters)) or run(d, filters, *more))
    found = frequent_phrases(docs, "doc_id", "lang", "text", 30, 5, 10**9)
    assert {(r["phrase"], r["n"]) for r in found.where("words > 0").collect()} == {(" ".join(p), f) for (_, p), f in plain_counts(rows)[0].items()}
    assert passes == [1, 1, 2, 3, 4, 5]  # the sample, then one pass per length


def test_a_filter_that_lets_everything_through_changes_nothing(spark, monkeypatch):
    rows = made(5, 200)
    docs = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(phrase_mining.Known, "has", lambda self, hashes: np.ones(len(hashes), bool))
    assert got(collocations(docs, min_count=5, top=50)) == plain(rows, 5, 50)


def test_neighbourhoods_of_failures():
    """Only places from which a phrase of four words reaches a failure stay, with gaps between the stretches."""
    names = [b"\xff", *(f"w{i}".encode() for i in range(1, 40))]
    words = np.concatenate((np.zeros(1, np.uint64), phrase_mining._word_hashes(b"en", names[1:])))
    ids = np.array([0, *range(1, 30), 0, 7, 8, 0])
    wanted = phrase_mining._longer(words[[7]], words[[8]])

    class Failed:
        def has(self, hashes):
            return np.isin(hashes, wanted)

    assert phrase_mining._near(ids, words, Failed(), 4).tolist() == [0, 5, 6, 7, 8, 9, 10, 0, 29, 0, 7, 8, 0]


def test_odd_rows(spark):
    rows = [(1, "en", None), (2, None, ""), (3, None, "..;"), (None, "en", "x y"), (4, "en", "x y"), (4, "en", "x y"), (5, "de", "z " * 30_000), (6, "en", "\x00 \x01 \x00 \x01")]
    docs = spark.createDataFrame([(*r, "p", 1) for r in rows], SCHEMA + ", phrase string, n int")
    want = plain(rows, 2, 10)
    assert got(collocations(docs, min_count=2, top=10)) == want and ("de" in {w[0] for w in want})
    assert collocations(docs.limit(0)).collect() == []


def test_scores_beyond_64_bits(spark):
    """The score expression on counts whose products need more than 64 bits."""
    a, n, l, r = 10**12 + 7, 10**13 + 9, 10**12 + 11, 10**12 + 13
    df = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long")
    assert df.selectExpr(f"{phrase_mining.SCORE} AS score").first()[0] == 1000 * a * n // (l * r)


def test_a_false_positive_of_an_early_filter_loses_nothing(spark):
    """A filter that holds a phrase by chance but not its first part: that pass never reaches what is longer, a later one must."""
    rows = [(i, "en", "a b c d") for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA).select("lang", "text")
    proposed = ["b", "c", "d", "b c", "c d", "b c d", "a b c"]
    start = phrase_mining.known_phrases(spark.createDataFrame([("en", p) for p in proposed], "lang string, phrase string"), len(proposed))
    found = phrase_mining._closed(docs, start, 30, 5).where("words > 0")
    assert got(found.select("phrase", "n")) == sorted((" ".join(p), f) for (_, p), f in plain_counts(rows)[0].items())


def test_few_failures_take_one_pass(spark, monkeypatch):
    """Phrases that the sample has not proposed, at few places: one further pass finds those of all lengths."""
    rng = random.Random(4)
    rows = [(i, "en", " ".join(rng.choices("abcdefghij", k=40))) for i in range(200)] + [(1000 + i, "en", "v w x y z") for i in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA).select("lang", "text")
    frequent = sorted((" ".join(p), f) for (_, p), f in plain_counts(rows)[0].items() if f >= 12)
    proposed = [p for p, _ in frequent if not set(p) & set("vwxyz")]
    start = phrase_mining.known_phrases(spark.createDataFrame([("en", p) for p in proposed], "lang string, phrase string"), len(proposed))
    passes = []
    run = phrase_mining._pass
    monkeypatch.setattr(phrase_mining, "_pass", lambda d, filters, *more: passes.append(len(filters)) or run(d, filters, *more))
    assert got(phrase_mining._closed(docs, start, 12, 5).where("words > 0").select("phrase", "n")) == frequent
    assert passes == [1, 2]


def test_a_border_counted_by_hash_gives_exact_texts(spark):
    """Failures of every length, the longest too, have their texts and counts from the pass after; the border itself has no texts."""
    rows = [(i, "en", "a b c d e f") for i in range(30)] + [(100 + i, "en", f"a b x{i}") for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA).select("lang", "text")
    frequent = sorted((" ".join(p), f) for (_, p), f in plain_counts(rows)[0].items() if f >= 30)
    proposed = [p for p, _ in frequent if len(p.split()) < 5 and p != "c d"]
    start = phrase_mining.known_phrases(spark.createDataFrame([("en", p) for p in proposed], "lang string, phrase string"), len(proposed))
    border = phrase_mining._pass(docs, [start], None, 5, False, True).where("words > 1 AND NOT proposed")
    assert border.count() and not border.where("phrase IS NOT NULL OR hash IS NULL").count()
    assert got(phrase_mining._closed(docs, start, 30, 5, True).where("words > 0").select("phrase", "n")) == frequent
