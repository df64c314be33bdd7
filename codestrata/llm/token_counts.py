"""Token counts by byte-pair merging on a heap and a linked list.

The symbols of a word are the nodes of a doubly linked list. A heap holds the adjacent pairs that the vocabulary
merges, by rank and then position; the lowest is popped again and again, its two nodes become
one, and the two new pairs beside it are pushed. Pairs whose nodes have changed meanwhile are skipped when
popped. The count is the number of symbols less the number of merges: no identifier is looked up.
"""

from __future__ import annotations

import functools
import heapq
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.byte_bpe import Remembered, exact_words, in_signs, lines_of_words, spaced_words, specials
from codestrata.llm.common import unpacked, whole_row

LIMIT = 512


def merge_count(symbols: list, ranks: dict) -> int:
    """Merges that the symbols allow; ``ranks`` maps a pair of symbols to (rank, merged symbol)."""
    n = len(symbols)
    find = ranks.get
    heap = []
    for i in range(n - 1):
        pair = find((symbols[i], symbols[i + 1]))
        if pair is not None:
            heap.append((pair[0], i, pair[1]))
    if not heap:
        return 0
    heapq.heapify(heap)
    symbols = symbols[:]
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    merges = 0
    while heap:
        rank, i, merged = heapq.heappop(heap)
        j = after[i]
        if symbols[i] is None or j >= n:
            continue
        pair = find((symbols[i], symbols[j]))
        if pair is None or pair[0] != rank:
            continue  # one of the two has become part of something else
        symbols[i], symbols[j] = merged, None
        merges += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            pair = find((merged, symbols[k]))
            if pair is not None:
                heapq.heappush(heap, (pair[0], i, pair[1]))
        h = before[i]
        if h >= 0:
            pair = find((symbols[h], merged))
            if pair is not None:
                heapq.heappush(heap, (pair[0], h, pair[1]))
    return merges


class Counter:
    """Token counts of texts by one tokenizer file (``tokenizers`` JSON, byte-level)."""

    def __init__(self, spec: str):
        merges = json.loads(spec)["model"]["merges"]
        self.ranks = {}
        for rank, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.ranks.setdefault((a, b), (rank, a + b))
        own = specials(spec)
        self.special = re.compile("(?:" + "|".join(map(re.escape, sorted(own, key=len, reverse=True))) + ")") if own else None
        self.marks = own
        self.bare = Remembered(self._word)
        self.spaced = Remembered(lambda w: sum(map(self._word, spaced_words(w))))
        self.first = Remembered(lambda w: sum(map(self._word, exact_words(w))))

    def _word(self, word: str) -> int:
        symbols = list(in_signs(word))
        return len(symbols) - merge_count(symbols, self.ranks)

    def _plain(self, text: str) -> int:
        lines = lines_of_words(text)
        if lines is None:
            return sum(map(self.bare.__getitem__, exact_words(text)))
        spaced = self.spaced.__getitem__
        total = (len(lines) - 1) * self.bare["\n"]
        for words in lines:
            total += self.first[words[0]] + sum(map(spaced, words[1:]))
        return total

    def __call__(self, text: str) -> int:
        if self.special is None or not any(m in text for m in self.marks):
            return self._plain(text) if text else 0
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self._plain(p) for p in parts if p)


@functools.lru_cache(2)
def counter(spec: str) -> Counter:
    """One per worker, so that words stay remembered from task to task."""
    return Counter(spec)


def count_tokens(docs: DataFrame, spec: str, text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` plus ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``spec`` is the text of a byte-level tokenizer file. Strings of special tokens inside a text are one token
    each, as in the tokenizer's default; no tokens are added around a text. Null and empty texts have no bytes and
    no tokens. Texts are counted whole and row by row, so repeated rows and ids of any kind make no
    difference; input columns of the three names are replaced. Words that have been counted are remembered, boundedly, per worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # one vocabulary file, of fixed size

    @F.arrow_udf("long")
    def tokens(texts: pa.Array) -> pa.Array:
        count = counter(shared.value)
        return pa.array([count(t or "") for t in texts.to_pylist()], pa.int64())

    d = docs.select(whole_row(docs), tokens(F.col(f"`{text_col}`")).alias("n"))
    text = F.col(f"row.`{text_col}`")
    return unpacked(d, "row", docs.columns, {"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "n_tokens": F.col("n"), "over_limit": F.col("n") > limit})
