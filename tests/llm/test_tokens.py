"""Token counts and the token store against the tokenizers library on whole texts."""

import random
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from codestrata.llm.token_counts import Counter, count_tokens
from codestrata.llm.token_store import END, Encoder, WaveletMatrix, count_token, find_token, read_documents, write_tokens
from codestrata.session import shared_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")
with open(PATH, encoding="utf-8") as f:
    SPEC = f.read()
LIBRARY = Tokenizer.from_file(PATH)

TEXTS = [
    None,
    "",
    " ",
    "a  b",
    "  x\n\n y \n",
    "it's 's\n't  \t z\xa0q I'll they'RE",
    "héé\n\x1c a b <|endoftext|> x<|endoftext|><|endoftext|>\n",
    "<|endoftext|>",
    "漢字 かな 😀😀 ՘ Ꟁ 𞗓 5²½ Ⅷ٣",
    "trail ",
    "\na\nb\n",
    "a\r\nb\x85c d　e",
    "\x00\x01 \x7f",
    "antidisestablishmentarianism" * 3,
    "x." * 50 + " 12345678901234567890 !!!??? --- ***",
]


def noise(seed, n):
    rng = random.Random(seed)
    bits = ["the", "Ing", " ", " ", " ", "\n", "\t", "é", "ß", "1", "22", ".", ",", "'s", "'", "<|endoftext|>", "日", " ", "😀", "_", "zq"]
    return ["".join(rng.choices(bits, k=rng.randrange(1, 40))) for _ in range(n)]


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("texts", [TEXTS, noise(1, 3000)], ids=["chosen", "noise"])
def test_workers_by_library(texts):
    count, encode = Counter(SPEC), Encoder(SPEC)
    for _ in range(2):  # the second time from memory
        for t in texts:
            assert count(t or "") == len(ids_of(t)), repr(t)
            assert np.frombuffer(encode(t or ""), "<u4").tolist() == ids_of(t), repr(t)


def test_memory_stays_bounded():
    count = Counter(SPEC)
    count.spaced.size = 50
    for t in noise(2, 400):
        assert count(t) == len(ids_of(t))
        assert len(count.spaced) <= 50 and len(count.spaced.old) <= 50


def test_count_tokens(spark):
    long = "word " * 100_000 + "x" * 20_000
    rows = [(i, t, "old") for i, t in enumerate([*TEXTS, long])] + [(None, "again", "old"), (None, "again", "old")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(4)
    out = count_tokens(df, SPEC, limit=20)
    assert out.columns == ["doc_id", "text", "n_tokens", "n_bytes", "over_limit"]
    want = [(k, t, len(ids_of(t)), len((t or "").encode()), len(ids_of(t)) > 20) for k, t, _ in rows]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert count_tokens(df.limit(0), SPEC).count() == 0


@pytest.mark.parametrize(("n", "top"), [(0, 5), (1, 0), (7, 1), (1000, 50256), (3000, 70_000), (513, 2)])
def test_wavelet_matrix(n, top):
    ids = np.random.default_rng(n).integers(0, top + 1, n)
    m = WaveletMatrix.of(ids)
    assert (m.unpack() == ids).all()
    assert [m.access(i) for i in range(0, n, 17)] == ids[::17].tolist()
    for token in {*ids[:5].tolist(), top, top + 1, 1 << 20}:
        assert m.find(token) == np.flatnonzero(ids == token).tolist()
        assert m.count(token) == (ids == token).sum()


def stored(spark, rows, **kw):
    path = f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"
    df = spark.createDataFrame(rows, "doc_id long, text string, part int, n long").repartition(5)
    write_tokens(df, SPEC, path, **kw)
    return path


@pytest.mark.parametrize("shard", [1, 100, 1 << 18])
def test_store_round_trip(spark, shard):
    texts = [*TEXTS, *noise(3, 60), "word " * 30_000]
    rows = [(1000 - 7 * i, t, 1, 1) for i, t in enumerate(texts)] + [(None, "no id", 1, 1)]
    path = stored(spark, rows, shard=shard)
    whole, want = [], []
    for k, t, _, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        own = [*ids_of(t), END]
        want.append((k, len(whole), len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        whole += own
    got = [tuple(r)[:4] for r in read_documents(spark, path).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    token = ids_of("the")[0]
    places = [i for i, x in enumerate(whole) if x == token]
    assert sorted(r[0] for r in find_token(spark, path, token).collect()) == places
    assert count_token(spark, path, token).first()[0] == len(places) > 10
    assert count_token(spark, path, 50_255).first()[0] == whole.count(50_255)


def test_store_of_repeated_and_no_rows(spark):
    path = stored(spark, [(5, "b", 1, 1), (5, "a", 1, 1), (5, "b", 1, 1)])
    assert sorted((r["start"], r["n_marks"], r["first_mark"]) for r in read_documents(spark, path).collect()) == [(0, 1, 1), (2, 1, 3), (4, 1, 5)]
    path = stored(spark, [])
    assert read_documents(spark, path).count() == 0 and count_token(spark, path, 2).first()[0] == 0


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 4095, 4096, 4097, 30_000])
def test_rank_and_select_at_the_edges_of_the_directory(n):
    rng = np.random.default_rng(n)
    ids = rng.choice([0, 2, 7, 300, 50_000], n, p=[0.6, 0.1, 0.1, 0.1, 0.1])
    m = WaveletMatrix.of(ids.astype(np.uint32))
    low = rng.integers(0, n + 1, 50)
    high = rng.integers(0, n + 1, 50)
    low, high = np.minimum(low, high), np.maximum(low, high)
    for token in (0, 2, 300, 50_000, 8, 1 << 20):
        assert m.count_within(token, low, high).tolist() == [int((ids[a:b] == token).sum()) for a, b in zip(low, high)]
        firsts = [np.flatnonzero(ids[a:b] == token) for a, b in zip(low, high)]
        assert m.first_within(token, low, high).tolist() == [int(a + f[0]) if len(f) else -1 for a, f in zip(low, firsts)]
        assert m.find(token) == np.flatnonzero(ids == token).tolist() and m.count(token) == int((ids == token).sum())
    assert [m.access(i) for i in range(0, n, 97)] == ids[::97].tolist() and m.unpack().tolist() == ids.tolist()
