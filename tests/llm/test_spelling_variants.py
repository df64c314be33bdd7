"""Spelling variants against brute force over all edits."""

import random
import re
import zlib
from collections import Counter

import pytest

from codestrata.llm import queries
from codestrata.llm.spelling_variants import variant_groups, word_counts


def plain_words(rows, least=2, letters=7):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= letters and n >= least}


def plain_groups(words, ratio=10):
    letters = sorted({c for w in words for c in w})
    near, form = {}, {}
    for w in words:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        edits |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near[w] = [v for v in edits if v in words and v != w]
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


def variants(seed, bases, copies):
    rng = random.Random(seed)
    words = {}
    for base in bases:
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(3)):
                i, kind = rng.randrange(len(w)), rng.randrange(3)
                if kind == 0:
                    w[i] = rng.choice("abxé")
                elif kind == 1:
                    w.insert(i, rng.choice("abxyé"))
                elif len(w) > 7:
                    del w[i]
            words["".join(w)] = rng.choice([2, 3, 20, 30, 300, 4000, 50_000])
    return words


def test_against_all_edits(spark):
    words = variants(1, ["abababab", "aaaaaaa", "éàüñöôç", "commission", "communication", "xabxabxab"], 150)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = plain_groups(words)
    assert sum(w[1] is not None for w in want) > 50 and max(w[4] for w in want) > 10
    assert got(variant_groups(df)) == want


def test_words_as_long_as_the_trie_is_deep(spark):
    words = variants(2, ["ab" * 33, "x" * 64, "x" * 65, "x" * 66, "q" * 300], 25)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(variant_groups(df)) == plain_groups(words)


def test_many_words_below_one_node(spark):
    rng = random.Random(3)
    words = {"prefixes" + "".join(rng.choices("abc", k=4)): rng.choice([2, 50]) for _ in range(300)}
    words |= {w[::-1]: n for w, n in words.items()}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(variant_groups(df)) == plain_groups(words)


def test_words_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "1234567 ,;"), (None, "Somewhere ÀÉÎÕÜÿ÷ SOMEWHERE"), (None, "Somewhere"), (4, "z" * 50_000), (4, "z" * 50_000), (5, "short wordlets wordlets " * 5000)]
    rows += [(i, "repeated Repeated") for i in range(200)]
    docs = spark.createDataFrame([(*r, "w", 7) for r in rows], "doc_id long, text string, word string, n long")
    words = word_counts(docs)
    assert {r["word"]: r["n"] for r in words.collect()} == plain_words(rows)
    assert len(plain_words(rows)) > 5
    assert [w for w in got(variant_groups(words)) if len(w[0]) < 100] == [w for w in plain_groups({k: n for k, n in plain_words(rows).items() if len(k) < 100})]


def test_no_words(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert got(variant_groups(word_counts(docs))) == []


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert got(queries.op12_spelling(spark, folder)) == plain_groups(plain_words(rows))
