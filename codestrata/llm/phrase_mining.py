"""Phrase collocations by Toivonen's method: a sample proposes phrases, full passes count them and their negative border.

1. A sample of documents, chosen by hash, is mined level by level with a lowered support. What it finds is a proposal only.
2. A full pass counts every phrase whose two parts (without its last and without its first word) are both proposed: the
   proposed phrases and their negative border, and all single words. All counts are exact.
3. A border phrase that turns out frequent is a failure: longer phrases around it were not counted. A further pass
   takes all phrases known to be frequent for proposed and counts what no pass has counted yet, until no
   failure is left. Any frequent phrase has frequent parts, so then none is missing. What is still to be counted has a
   failure of the pass before in it, so a further pass looks at the neighbourhood of these only.
4. Failures with few occurrences need one further pass instead of one per length: it takes all that no pass has counted
   for proposed too, so it counts every phrase around them that is not known to hold an infrequent one.

Passes know the proposed phrases by a Bloom filter of bounded size. Its false positives make a pass count more
phrases than it must, and change no result: nothing is taken for frequent before it has been counted, and a phrase
counts as proposed only if its parts do, so one that a pass could not reach is not taken for counted later.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.common import batches_of, utf8
from codestrata.session import cut

UNKNOWN = "und"  # stands for a null language
MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
SAMPLE_OF = 16  # one in so many documents proposes phrases
CHUNK = 1 << 19  # words counted at once in a task
FILTER_BITS = 1 << 27  # 16 MB, the bound of a filter
BITS_PER_PHRASE = 12
SEGMENT = 1 << 20  # bits of a filter that one task sets
FEW = 8  # failures at no more than one in so many words are settled by one last pass
BUCKETS = 64  # parts of a language that rank on their own first

#: floor(1000 a n / (l r)): products of 38 digits at most; the score is at most 1000 n
SCORE = """cast(1000 * cast(a as decimal(17,0)) * cast(n as decimal(17,0)) as decimal(38,0))
  div cast(cast(l as decimal(17,0)) * cast(r as decimal(17,0)) as decimal(38,0))"""

#: A-Z lowered, the signs between pieces turned into line feeds
_TIDY = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n")
_GAP = b"\xff"  # no UTF-8 text holds this byte: it stands between pieces
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.arange(1, 5, dtype=np.uint64) * _FACTOR


def words_of(text: bytes) -> list[bytes]:
    """The words of a text with a gap before and behind each of its pieces."""
    return (b" " + text.translate(_TIDY) + b" ").replace(b"\n", b" \xff ").split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(4096)
def _seed(lang: bytes) -> int:
    return xxhash.xxh64_intdigest(lang)


def _word_hashes(lang: bytes, words: list[bytes]) -> np.ndarray:
    seed = _seed(lang)
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)


def _longer(hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word."""
    return _mixed(hashes * _FACTOR + word)


def _bits(hashes: np.ndarray, size: int) -> np.ndarray:
    """Four places of a filter per phrase."""
    out = np.empty((4, len(hashes)), np.int64)
    for i in range(4):
        out[i] = (_mixed(hashes + _STEPS[i]) & np.uint64(size - 1)).astype(np.int64)
    return out


class Known:
    """Phrases that a pass takes for proposed; may hold others by chance, but misses none."""

    def __init__(self, size: int, bits: np.ndarray):
        self.size, self.bits = size, bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.full(len(hashes), self.size > 0)
        if self.size:
            for at in _bits(hashes, self.size):
                found &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1) == 1
        return found


NOTHING = Known(0, np.zeros(0, np.uint8))


def _phrase_hashes(langs: list[bytes], phrases: list[bytes]) -> np.ndarray:
    split = [p.split(b" ") for p in phrases]
    out = np.array([xxhash.xxh64_intdigest(w[0], _seed(lang)) for lang, w in zip(langs, split)], np.uint64)
    rest = [i for i, w in enumerate(split) if len(w) > 1]
    k = 1
    while rest:
        words = np.array([xxhash.xxh64_intdigest(split[i][k], _seed(langs[i])) for i in rest], np.uint64)
        out[rest] = _longer(out[rest], words)
        k += 1
        rest = [i for i in rest if len(split[i]) > k]
    return out


def known_phrases(frequent: DataFrame, count: int) -> Known:
    """The filter over (lang, phrase, hash), the hash of rows without a phrase; tasks set the bits of a segment each, and only the segments travel."""
    if not count:
        return NOTHING
    size = min(FILTER_BITS, max(SEGMENT, 1 << math.ceil(math.log2(count * BITS_PER_PHRASE))))

    def places(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it, 8192):
            hashes = b.column(2).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            named = b.filter(b.column(1).is_valid())
            own = _phrase_hashes(utf8(named.column(0)), utf8(named.column(1)))
            at = np.unique(_bits(np.concatenate((own, hashes[b.column(1).is_null().to_numpy(zero_copy_only=False)])), size))
            yield pa.record_batch([pa.array((at // SEGMENT).astype(np.int32)), pa.array((at % SEGMENT).astype(np.int32))], names=["segment", "place"])

    def fill(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments: dict[int, np.ndarray] = {}
        for b in it:
            segment, place = b.column(0).to_numpy(), b.column(1).to_numpy()
            for s in np.unique(segment).tolist():
                segments.setdefault(s, np.zeros(SEGMENT, bool))[place[segment == s]] = True
        packed = [np.packbits(bits, bitorder="little").tobytes() for bits in segments.values()]
        yield pa.record_batch([pa.array(list(segments), pa.int32()), pa.array(packed, pa.binary())], names=["segment", "bits"])

    hashes = F.col("hash") if "hash" in frequent.columns else F.lit(None).cast("long").alias("hash")
    set_bits = frequent.select("lang", "phrase", hashes).mapInArrow(places, "segment int, place int")
    filled = set_bits.repartitionById(size // SEGMENT, "segment").mapInArrow(fill, "segment int, bits binary")
    bits = np.zeros(size // 8, np.uint8)
    for row in filled.collect():  # at most the bound of a filter in all
        start = row["segment"] * (SEGMENT // 8)
        bits[start : start + SEGMENT // 8] |= np.frombuffer(row["bits"], np.uint8)
    return Known(size, bits)


def _counted(lang: bytes, names: list[bytes], ids: np.ndarray, passes: list[Known], max_words: int, last: bool = False, by_hash: bool = False, told: Known | None = None) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, int]]:
    """(phrases, hashes, counts, proposed, words) of what this pass counts in a run of word numbers; number 0 is the gap.

    ``passes`` are the filters so far, the last one that of this pass. A phrase that an earlier pass has counted is left out.
    In a ``last`` pass what no pass has counted is proposed too. ``by_hash`` leaves out the texts of the border, and ``told`` has the border phrases
    of the first pass that are counted again, with their texts.
    """
    words = np.concatenate((np.zeros(1, np.uint64), _word_hashes(lang, names[1:])))
    within = [k.has(words) for k in passes]  # which phrases of the present length each filter holds, their parts with them
    for w in within:
        w[0] = False
    if len(passes) == 1:  # later passes have all words behind them
        yield names[1:], words[1:], np.bincount(ids, minlength=len(names))[1:], within[0][1:], 1
    texts, hashes, phrase = names, words, ids  # of the present length; ``phrase`` numbers the one that starts at each place
    here = np.flatnonzero(ids)
    for k in range(2, max_words + 1):
        proposed = np.zeros(len(ids) + 1, bool)
        proposed[here] = within[-1][phrase[here]]
        here = here[proposed[here] & proposed[here + 1]]
        if not len(here):
            return
        behind = ids[here + k - 1]
        code, first, back, counts = np.unique(phrase[here] * np.int64(len(names)) + behind, return_index=True, return_inverse=True, return_counts=True)
        starts, ends, final = phrase[here[first]], phrase[here[first] + 1], behind[first]
        reached = [w[starts] & w[ends] for w in within]  # by each pass: these it has counted
        new = ~np.any(reached[:-1], axis=0) if len(passes) > 1 else np.ones(len(code), bool)
        hashes = _longer(hashes[starts], words[final])
        within = [f.has(hashes) & r for f, r in zip(passes, reached)]
        if last:
            within[-1] |= new
        if by_hash:
            texts = [texts[a] + b" " + names[b] if p else b"" for a, b, p in zip(starts.tolist(), final.tolist(), within[-1].tolist())]
        else:
            texts = [texts[a] + b" " + names[b] for a, b in zip(starts.tolist(), final.tolist())]
        proposes = within[-1]
        if told is not None:
            again = told.has(hashes) & reached[0] & ~within[0]
            new, proposes = new | again, proposes | again
        yield list(compress(texts, new.tolist())), hashes[new], counts[new], proposes[new], k
        phrase = np.zeros(len(ids) + 1, np.int64)
        phrase[here] = back


def _near(ids: np.ndarray, words: np.ndarray, failed: Known, max_words: int) -> np.ndarray:
    """The run cut down to where failures and phrases of at most ``max_words`` words around them can lie, with gaps between."""
    near = np.zeros(len(ids) + 1, np.int32)
    here, hashes = np.flatnonzero(ids), words[ids[ids > 0]]
    for k in range(1, max_words + 1):
        hit = here[failed.has(hashes)]
        np.add.at(near, np.maximum(hit - (max_words - k), 0), 1)
        np.add.at(near, np.minimum(hit + max_words, len(ids)), -1)
        inside = here + k < len(ids)
        here, hashes = here[inside], hashes[inside]
        behind = ids[here + k]
        here, hashes = here[behind > 0], _longer(hashes[behind > 0], words[behind[behind > 0]])
    kept = np.cumsum(near[:-1]) > 0
    first = kept & np.concatenate(([True], ~kept[:-1]))
    # a gap before every stretch
    return np.insert(ids[kept], np.flatnonzero(first[kept]), 0)


class _Numbers(dict):
    """Numbers of words in the order in which they come; 0 is the gap."""

    def __init__(self) -> None:
        super().__init__({_GAP: 0})
        self.names = [_GAP]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.names)
        self.names.append(word)
        return n


COUNTS = "lang string, phrase string, hash long, words int, proposed boolean, n long"


def _pass(docs: DataFrame, passes: list[Known], failed: Known | None, max_words: int, last: bool = False, by_hash: bool = False, told: bool = False) -> DataFrame:
    """(lang, phrase, hash, words, proposed, n): exact counts of what this pass counts; ``words`` 0 is the number of all words of a language.

    ``failed`` are the failures of the pass before, None in the first pass, which counts all words. A ``last`` pass leaves no failures.
    A pass ``by_hash`` counts border phrases of two words and more by their hashes only, so they have no text; the next one has the failures
    ``told``: it counts those whose hash is in ``failed`` again, with their texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast((passes, failed))  # filters of bounded size, one per pass and one more

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[_Numbers, list[np.ndarray]]] = {}
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, (numbers, runs) in held.items():
                ids = np.concatenate(runs)
                shown = lang.decode()
                passes, failed = shared.value
                if failed is not None:
                    ids = _near(ids, np.concatenate((np.zeros(1, np.uint64), _word_hashes(lang, numbers.names[1:]))), failed, max_words)
                found = _counted(lang, numbers.names, ids, passes, max_words, last, by_hash, failed if told else None)
                if failed is None:
                    yield _rows(shown, [None], None, np.array([np.count_nonzero(ids)]), np.array([True]), 0)
                for phrases, hashes, n, proposed, k in found:
                    if by_hash and k > 1:
                        border = ~proposed
                        yield _rows(shown, None, hashes[border], n[border], proposed[border], k)
                        phrases, n, proposed = list(compress(phrases, proposed.tolist())), n[proposed], proposed[proposed]
                    yield _rows(shown, phrases, None, n, proposed, k)
            held.clear()

        for b in batches_of(it, 256):
            for lang, text in zip(utf8(b.column(0)), utf8(b.column(1))):
                words = words_of(text)
                numbers, runs = held.setdefault(lang, (_Numbers(), []))
                runs.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                runs.append(np.zeros(1, np.int64))
                size += len(words) + 1
                if size >= CHUNK:
                    yield from flushed()
                    size = 0
        yield from flushed()

    counted = docs.mapInArrow(count, COUNTS)
    return counted.groupBy("lang", "phrase", "hash", "words", "proposed").agg(F.sum("n").alias("n"))


def _rows(lang: str, phrases: list | None, hashes: np.ndarray | None, n: np.ndarray, proposed: np.ndarray, k: int) -> pa.RecordBatch:
    size = len(n)
    texts = pa.nulls(size, pa.string()) if phrases is None else pa.array(phrases, pa.binary()).cast(pa.string())
    numbers = pa.nulls(size, pa.int64()) if hashes is None else pa.array(hashes.view(np.int64))
    columns = [pa.array([lang], pa.string()).take(pa.array(np.zeros(size, np.int32))), texts, numbers, pa.array(np.full(size, k, np.int32)), pa.array(proposed), pa.array(n, pa.int64())]
    return pa.record_batch(columns, names=["lang", "phrase", "hash", "words", "proposed", "n"])


def _closed(docs: DataFrame, start: Known, min_count: int, max_words: int, by_hash: bool = False) -> DataFrame:
    """Frequent phrases and the word numbers (``words`` 0), by passes until no border phrase fails.

    After pass i no phrase of i words is missing, so there are at most ``max_words`` passes. Failures at few places have one pass
    more: a place lies in 14 phrases of 2 to 5 words, so this pass counts less than the first one.
    ``by_hash``: the first pass, whose border is by far the largest table, shuffles it as hashes. A hash that reaches the support is only a
    hint (texts may share one): the second pass counts these phrases as texts, so all counts are exact.
    """
    counted = cut(_pass(docs, [start], None, max_words, *([False, True] if by_hash else [])).where((F.col("n") >= min_count) | (F.col("words") == 0)))
    passes, found, last, untold = [start], counted.where("words = 0 OR phrase IS NOT NULL"), False, by_hash
    total = counted.where("words = 0").agg(F.sum("n")).first()[0] or 0
    while True:
        failed = counted.where(~F.col("proposed") & (F.col("words").between(1, max_words - 1) | F.col("hash").isNotNull()))
        missed, places = failed.agg(F.count("*"), F.sum("n")).first()
        if last or not missed:
            return found
        last = places * FEW <= total
        frequent = found.where("words > 0")
        if untold:
            frequent = frequent.unionByName(failed.where("phrase IS NULL"))
        passes.append(known_phrases(frequent, frequent.count()))
        failures = known_phrases(failed, missed)
        counted = cut(_pass(docs, passes, failures, max_words, last, False, untold).where(F.col("n") >= min_count))
        untold = False
        found = found.unionByName(counted)


def frequent_phrases(docs: DataFrame, id_col: str, lang_col: str, text_col: str, min_count: int, max_words: int, sample_of: int) -> DataFrame:
    """(lang, phrase, words, n): all phrases with at least ``min_count`` occurrences, and per lang one row of 0 words with the number of words."""
    rows = docs.select(
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.col(f"`{text_col}`").alias("text"),
        (F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(sample_of)) == 0).alias("sampled"),
    )
    lowered = max(2, min_count // (2 * sample_of))  # half of what is expected at the support itself
    proposed = _closed(rows.where("sampled").select("lang", "text"), NOTHING, lowered, max_words).where("words > 0")
    start = known_phrases(proposed, proposed.count())
    return _closed(rows.select("lang", "text"), start, min_count, max_words, True).select("lang", "phrase", "words", "n")


def collocations(
    docs: DataFrame,
    id_col: str = "doc_id",
    lang_col: str = "lang",
    text_col: str = "text",
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    top: int = TOP,
    sample_of: int = SAMPLE_OF,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of every language by score, count and text.

    A-Z are lowered, texts are split at ``.,;:!?`` and line ends into pieces, these at blanks and tabs into words. ``a`` counts a
    phrase's occurrences in pieces, overlaps included, ``l`` and ``r`` those of its two parts at the cut of lowest score (ties:
    the first), ``n`` all words of the language; score is floor(1000 a n / (l r)), worked out exactly. Phrases of 2 to ``max_words``
    words with ``a >= min_count`` count, but for those that never occur outside one longer such phrase.

    A null language is ``und``; null and empty texts have no words; every row counts, repeated rows and ids too (ids only
    choose the sample, which changes no result). An empty table gives no rows. Input columns of other names are not looked at.
    """
    found = cut(frequent_phrases(docs, id_col, lang_col, text_col, min_count, max_words, sample_of))
    counts = found.where("words > 0").select("lang", "phrase", F.col("n").alias("f"))
    totals = found.where("words = 0").select("lang", "n")
    long = found.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))

    # a phrase inside a longer one of equal count is inside one with just one word more, at its front or its end
    words = F.split("phrase", " ", -1)
    inside = (
        long.where("words > 2")
        .select("lang", "a", F.explode(F.array(F.array_join(F.slice(words, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("words") - 1), " "))).alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )
    kept = long.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer")

    part = lambda start, size: F.array_join(F.slice(words, start, size), " ")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right")
    )
    lefts = counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    rights = counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    scored = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"]).join(totals, "lang")
    lowest = scored.withColumn("score", F.expr(SCORE)).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("best"))
    ready = lowest.select("lang", "phrase", "best.a", "best.l", "best.r", "best.n", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parted = ready.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS)))
    first = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
