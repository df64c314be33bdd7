"""Prefix BPE against the tokenizers library, both ways."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from codestrata.llm import queries
from codestrata.llm.prefix_bpe import PrefixEncoder, decode_words, decoded, encode_words, token_names

SPEC = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
NAMES = token_names(SPEC)
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "ab", "aA b", "éèÉÇñß", "İΣσςΑ αβ", "日本語 中文", "😀👍 ‍", "́è à", "\x1c\x1d\x85\xa0  x", "0123456789 ²½٣", "'srevmlld ", ".,!?-_", "\t\n\r\x0b\x0c "]
ODD = [None, "", " ", "\n\t", "<|startoftext|>", "a<|endoftext|> b<|endoftext", "haha" * 5000, "a" * 3000, "x " * 20_000, "the The THE"]


def texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(rng.choice(ALPHABETS)) for _ in range(rng.choice([1, 3, 8, 20, 40]))) for _ in range(n)] + [
        "".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for letters in ("ab", "a", "aeinorst", "the", "lo", "xyz-") for _ in range(n // 10)
    ]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_str(SPEC)


def packed(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


def test_against_the_library(library):
    own = PrefixEncoder(SPEC)
    many = texts(1, 5000) + [t or "" for t in ODD]
    for text, got in zip(many, own.encode_all(many)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert got == packed(ids), ascii(text)
        assert decoded(packed(ids), NAMES) == library.decode(ids, skip_special_tokens=False)


def test_every_prefix_goes_on_from_the_prefix_before_its_last_token():
    own = PrefixEncoder(SPEC)
    for word in ("thethethe", "internationalisation", "aaaaaaaaa", "lolololol"):
        ids = [np.frombuffer(i, "<u4").tolist() for i in own.paths([word[:j] for j in range(1, len(word) + 1)])]
        for j, path in enumerate(ids, 1):
            before = j - len(NAMES[path[-1]])
            assert path[:-1] == (ids[before - 1] if before else [])
    assert all(own.whole(i) for i in own.parts)


def test_two_tokens_stand_side_by_side_as_merging_says(library):
    own = PrefixEncoder(SPEC)
    rng = random.Random(2)
    tokens = [i for i in NAMES if i < 49_406]
    plain = [i for i in tokens if not NAMES[i].endswith("</w>")]
    ends = [i for i in tokens if NAMES[i].endswith("</w>")]
    for _ in range(3000):
        p, t = rng.choice(plain), rng.choice(ends)
        merged = [m.id for m in library.model.tokenize(NAMES[p] + NAMES[t][: -len("</w>")])]
        assert (own.weight(p, t) == 0) == (merged == [p, t])


def test_columns(spark, library):
    rows = [(i, t, "x", "y") for i, t in enumerate(ODD)] + [(1, "twice", "x", "y"), (1, "twice", "x", "y"), (None, "no id", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, row string")
    made = encode_words(docs, SPEC)
    assert made.columns == docs.columns
    back = decode_words(made, SPEC, out="made")
    got = back.collect()
    assert len(got) == len(rows) and {r["row"] for r in got} == {"y"}
    for r in got:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert bytes(r["ids"]) == packed(ids) and r["made"] == library.decode(ids, skip_special_tokens=False)
    assert encode_words(docs.limit(0), SPEC).collect() == []


def test_ids_outside_the_vocabulary_are_passed_over(spark, library):
    rows = [(1, packed([320, 10**6, 321])), (2, None), (3, b"")]
    got = {r["k"]: r["text"] for r in decode_words(spark.createDataFrame(rows, "k long, ids binary"), SPEC).collect()}
    assert got == {1: library.decode([320, 10**6, 321], skip_special_tokens=False), 2: "", 3: ""}


def test_query(spark, library):
    import hashlib

    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.op13_word_bpe(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(packed(ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
