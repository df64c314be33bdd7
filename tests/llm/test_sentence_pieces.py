"""Encoding and decoding against the sentencepiece library, and shortest paths against all paths."""

import functools
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from test_tokens import TEXTS, noise

from codestrata.llm.sentence_pieces import Model, Transducer, Written, decode_pieces, encode_pieces, load_model

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = load_model(PATH)
WRITTEN = Written(MODEL)
MORE = ["a▁b ▁", "▁", "\n\n x", "<0x41><s></s><unk>", "a" * 500, "ababab " * 30, "1234567", "   " * 20 + "x", "ÄÖ ǘ ﷽ 执梦ゼ", "퟿�"]


@functools.cache
def compiled():
    return Transducer(MODEL)


@pytest.mark.parametrize("texts", [TEXTS, MORE, noise(4, 2500)], ids=["chosen", "more", "noise"])
def test_by_library(texts):
    t = compiled()
    for _ in range(2):
        for text, got in zip(texts, t.encode_all([x or "" for x in texts])):
            ids = LIBRARY.encode(text or "")
            assert np.frombuffer(got, "<u4").tolist() == ids, repr(text)
            assert WRITTEN.decode(got) == LIBRARY.decode(ids)
            if "▁" not in (text or ""):
                assert WRITTEN.decode(got) == (text or "")


def test_pair_weights_are_what_merging_says():
    """The weight from the rims of two merge trees against merging the signs of both."""
    t = compiled()
    rng = random.Random(7)
    whole = sorted(t.ids.values())
    for _ in range(4000):
        left, right = rng.choice(whole), rng.choice(whole)
        piece = MODEL.pieces[rng.choice(whole)]
        k = rng.randrange(len(piece))
        left, right = t.ids.get(piece[:k], left), t.ids.get(piece[k:], right)
        text = MODEL.pieces[left] + MODEL.pieces[right]
        ends = set(range(1, len(text) + 1)) - {middle for _, _, middle, _ in t.merge_steps(text)}
        assert (t.weight(left, right) == 0) == (ends == {len(MODEL.pieces[left]), len(text)})


def test_unknown_signs_and_ids():
    t = compiled()
    assert WRITTEN.decode(t.encode("a\U000e0001b")) == "a\U000e0001b"
    assert WRITTEN.decode(np.array([300, 10**6], "<u4").tobytes()) == WRITTEN.decode(np.array([300], "<u4").tobytes())


def test_every_piece_alone():
    t = compiled()
    for i in range(300, 32_000, 37):
        text = MODEL.pieces[i].replace("▁", " ")
        assert np.frombuffer(t.encode(text), "<u4").tolist() == LIBRARY.encode(text)


def test_decoding_any_bytes():
    t = compiled()
    ids = [MODEL.pieces.index("<0xE6>"), MODEL.pieces.index("<0x97>"), 300]
    assert WRITTEN.decode(np.array(ids, "<u4").tobytes()).endswith(MODEL.pieces[300].replace("▁", " "))
    assert "�" in WRITTEN.decode(np.array(ids, "<u4").tobytes())


def test_unigram_path_is_the_best_of_all():
    pieces = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.0, "▁a": -2.2, "ba": -2.1, "aba": -6.0, "▁ab": -9.0}
    model = Model("unigram", ("<unk>", *pieces), (0.0, *pieces.values()), ("unknown", *["normal"] * len(pieces)), 0, True, False, False)
    t = Transducer(model)

    def best(text):
        paths = [(0.0, ())] if not text else []
        for i, p in enumerate(model.pieces):
            if i and text.startswith(p):
                score, rest = best(text[len(p) :])
                paths.append((score + model.scores[i], (i, *rest)))
        return max(paths, default=(float("-inf"), ()))

    for text in ["a", "ab", "abab", "ba ab", "aabba", " a", "b  b"]:
        own = "▁" + text.replace(" ", "▁")
        got = np.frombuffer(t.encode(text), "<u4").tolist()
        assert sum(model.scores[i] for i in got) == pytest.approx(best(own)[0]), text
    assert np.frombuffer(t.encode("axb"), "<u4").tolist().count(0) == 1


def test_tables(spark):
    long = "word " * 100_000 + "x" * 5_000
    rows = [(i, t, "old") for i, t in enumerate([*TEXTS, long])] + [(None, "again", "old"), (None, "again", "old")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(4)
    out = encode_pieces(df, MODEL)
    assert out.columns == ["doc_id", "text", "ids"]
    got = sorted([(r["doc_id"], r["text"], np.frombuffer(r["ids"], "<u4").tolist()) for r in out.collect()], key=repr)
    assert got == sorted([(k, t, LIBRARY.encode(t or "")) for k, t, _ in rows], key=repr)
    back = decode_pieces(out.drop("text"), MODEL)
    assert back.columns == ["doc_id", "ids", "text"]
    assert sorted([r["text"] for r in back.collect()]) == sorted(t or "" for _, t, _ in rows)
    assert encode_pieces(df.limit(0), MODEL).count() == 0
