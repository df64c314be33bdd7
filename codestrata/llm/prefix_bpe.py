"""BPE encoding by dynamic programming over prefixes, and decoding, for vocabularies whose words end in a marked sign.

A word is a row of symbols: the signs of its bytes, the last one marked as the word's end. An automaton over the
vocabulary reads the symbols once and names, for every prefix, the longest token that ends there; suffix links lead to the
shorter ones. Merging a prefix gives a unique last token, and a token t is that of a prefix exactly if it can stand
behind the last token p of what is left when t is cut off. Whether p and t can stand side by side is told by their
merge trees: only the pieces on the right rim of p and on the left rim of t ever touch, and a pair of them merges across the
border if its rank comes before both pieces become part of something larger. The table of last tokens is followed back from
the end of the word. The table is worked out for many words at once (``lattice.py``): a pair that can stand weighs 0, another
one is infinitely heavy, and of all ways to a prefix one is left.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codestrata.llm.byte_bpe import _SETTLED, Remembered, byte_signs, specials
from codestrata.llm.common import slices_of, unpacked, utf8, whole_row
from codestrata.llm.lattice import NEVER, Lattice, as_bytes

WORDS = 100_000  # words remembered per worker in each of two generations
ROWS = 256  # texts whose new words are read together

#: The pattern by which this kind of tokenizer cuts normalised texts.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""

_ASCII_WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^ \t\n\x0b\x0c\ra-z0-9]+")
_WORDS = regex.compile(WORD_PATTERN.replace(r"\s", r"\p{White_Space}"))


class PrefixEncoder:
    """Token ids of texts by one tokenizer file (``tokenizers`` JSON of this kind); the library only prepares texts with rare signs."""

    def __init__(self, spec: str):
        read = json.loads(spec)
        model = read["model"]
        end = model["end_of_word_suffix"]
        vocab = model["vocab"]
        #: a marked sign as one character of its own
        self.final = {s: chr(0xF0000 + ord(s)) for s in byte_signs()}
        self.plain = {s: vocab[s] for s in byte_signs()}
        symbols = lambda t: t[: -len(end) - 1] + self.final[t[-len(end) - 1]] if t.endswith(end) and t != end else t
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        tokens = {symbols(s + tail): vocab[s + tail] for s in byte_signs() for tail in ("", end)}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair, made = (vocab[a], vocab[b]), vocab[a + b]
            self.rank.setdefault(pair, rank)
            self.parts.setdefault(made, pair)
            tokens[symbols(a + b)] = made
        self.table = Lattice(tokens, self.weight)
        self.is_whole: dict[int, bool] = {}
        self.of_word = Remembered(lambda word: self.paths([self._symbols(word)])[0], WORDS)
        self.tokenizer = Tokenizer.from_str(spec)
        self.marks = specials(spec)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.marks, key=len, reverse=True))) + ")") if self.marks else None

    # which tokens can stand side by side

    def _rim(self, token: int, right: bool) -> list[tuple[int, float]]:
        """The pieces at one rim of a token's merge tree with the rank at which each becomes part of the next larger one."""
        rim, until = [(token, NEVER)], NEVER
        while token in self.parts:
            pair = self.parts[token]
            until = self.rank[pair]
            token = pair[1] if right else pair[0]
            rim.append((token, until))
        return rim

    def _crossed(self, p: int, t: int) -> bool:
        """Whether a merge across the border of p and t comes before the pieces that it takes are gone, the pair p, t itself aside.

        Among merges of equal rank the leftmost is first: the border's comes after one inside p and before one inside t.
        """
        for x, gone_x in self._rim(p, True):
            for y, gone_y in self._rim(t, False):
                rank = self.rank.get((x, y))
                if rank is not None and rank < gone_x and rank <= gone_y and (x, y) != (p, t):
                    return True
        return False

    def whole(self, token: int) -> bool:
        """Whether the token's own symbols merge to it."""
        known = self.is_whole.get(token)
        if known is None:
            if token in self.parts:
                a, b = self.parts[token]
                known = self.whole(a) and self.whole(b) and not self._crossed(a, b)
            else:
                known = True
            self.is_whole[token] = known
        return known

    def weight(self, p: int, t: int) -> float:
        """0 if merging the symbols of p and t gives exactly these two, else infinite; -1 for p is the start of a word."""
        if not self.whole(t):
            return NEVER
        return 0.0 if p < 0 or (p, t) not in self.rank and not self._crossed(p, t) else NEVER

    # encoding

    def _symbols(self, word: str) -> str:
        """The signs of a word's bytes, the last one marked."""
        signs = word if word.isascii() and word.isprintable() else "".join([byte_signs()[b] for b in word.encode()])
        return signs[:-1] + self.final[signs[-1]]

    def paths(self, symbols: list[str]) -> list[bytes]:
        """Ids of words given by their symbols; a word of unmarked signs is a prefix."""
        return as_bytes(*self.table.paths(symbols))

    def _words(self, text: str) -> list[str] | None:
        """The words of a text, None if the library has to prepare it."""
        if text.isascii():
            return _ASCII_WORDS.findall(text.lower())
        if _SETTLED.search(text) or "Σ" in text:  # signs on which Unicode versions differ, or whose small form hangs on their place
            return None
        return _WORDS.findall(unicodedata.normalize("NFC", text).lower())

    def _part(self, text: str, words: list[str] | None) -> bytes:
        if words is None:
            tidy = self.tokenizer.normalizer.normalize_str(text)
            return b"".join(self.paths([signs[:-1] + self.final[signs[-1]] for signs, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(tidy)]))
        self._remember(words)
        return b"".join(map(self.of_word.__getitem__, words))

    def _remember(self, words) -> None:
        new = [w for w in set(words).difference(self.of_word) if not self.of_word.known(w)]
        self.of_word.put(new, self.paths(list(map(self._symbols, new))))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """``encode`` of every text; words not met before go through the table together."""
        cut = [self._words(t) if self._plain(t) else None for t in texts]
        self._remember(set().union(*[w for w in cut if w is not None]))
        return [b"".join(map(self.of_word.__getitem__, w)) if w is not None else self.encode(t) for t, w in zip(texts, cut)]

    def _plain(self, text: str) -> bool:
        return self.special is None or not any(m in text for m in self.marks)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        if not text:
            return b""
        if self._plain(text):
            return self._part(text, self._words(text))
        mark = lambda p: np.array([self.tokenizer.token_to_id(p)], "<u4").tobytes()
        return b"".join(mark(p) if i % 2 else self._part(p, self._words(p)) for i, p in enumerate(self.special.split(text)) if p)


@functools.lru_cache(1)
def prefix_encoder(spec: str) -> PrefixEncoder:
    """One per worker, so that the automaton is built once."""
    return PrefixEncoder(spec)


@functools.lru_cache(1)
def token_names(spec: str) -> dict[int, str]:
    return {i: t for t, i in Tokenizer.from_str(spec).get_vocab(with_added_tokens=True).items()}


def decoded(ids: bytes, names: dict[int, str]) -> str:
    """The tokens' strings with one space between them; ids outside the vocabulary are passed over, as the library does."""
    numbers = np.frombuffer(ids, "<u4").tolist()
    try:
        return " ".join([names[i] for i in numbers])
    except KeyError:
        return " ".join([names[i] for i in numbers if i in names])


def encode_words(docs: DataFrame, spec: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` plus ``out``: the ids of every whole text as binary, four bytes each, lowest first.

    ``spec`` is the text of the tokenizer's file. No tokens are added around a text; strings of special tokens inside
    it are one token each, as in the library's default. Null, empty and blank texts have no ids. Row by row, so
    repeated rows, null ids and an empty table make no difference; an input column named ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # one vocabulary file, of fixed size

    def encode(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = prefix_encoder(shared.value)
        for texts in slices_of(it, ROWS):
            yield pa.array(of.encode_all([t or "" for t in texts.to_pylist()]), pa.binary())

    # kept apart from what reads the ids, which would else work them out again
    made = F.arrow_udf(encode, "binary").asNondeterministic()
    d = docs.select(whole_row(docs), made(F.col(f"`{text_col}`")).alias("made"))
    return unpacked(d, "row", docs.columns, {out: F.col("made")})


def decode_words(docs: DataFrame, spec: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``docs`` plus ``out``: the tokens of the ids as the library writes them without a decoder, one space between them.

    Special tokens are kept, ids outside the vocabulary passed over; null and empty ids have the empty text. An input column
    named ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    @F.arrow_udf("string")
    def decode(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = token_names(shared.value)
        for ids in slices_of(it, ROWS):
            yield pa.array([decoded(i, names) for i in utf8(ids)], pa.string())

    d = docs.select(whole_row(docs), decode(F.col(f"`{ids_col}`")).alias("made"))
    return unpacked(d, "row", docs.columns, {out: F.col("made")})
