"""Language identification with a byte convolutional network in numpy.

A text is cut into windows of a fixed number of bytes. Every byte has an embedding; filters of several widths run
over a window, the maximum of each filter passes a rectifier to a softmax layer. The network is
trained on the driver on windows of a bounded sample of labelled documents. For prediction the linear part (embedding
and filters) is compiled into tables over pairs of bytes, so that a filter of width 2k is a sum of k
look-ups; the windows of whole texts run through it in small batches, and a text's probabilities are the
mean over its windows, by their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import batches_of, unpacked, utf8, whole_row

WINDOW = 128  # bytes
WIDTHS = (2, 4, 6)
FILTERS = 16  # per width
DEPTH = 8  # of the byte embedding
DOCS_PER_LANGUAGE = 600  # labelled documents sampled per language, whatever the corpus
WINDOWS_PER_DOC = 6
EPOCHS = 5
BATCH = 64
SEED = 42
UNKNOWN = "und"
LEAST_JUDGED = 20  # a length with fewer of them has no low score
CHUNK = 96  # windows that run through the network together: what they need fits a core's cache

LETTER = regex.compile(r"\p{L}")


def windows(text: bytes) -> np.ndarray:
    """(n, WINDOW) bytes of a whole text, the last window filled with zeros; none for an empty text."""
    n = -(-len(text) // WINDOW)
    return np.frombuffer(text.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Network:
    """``embedding`` (256, DEPTH), ``filters`` {width: (width * DEPTH, FILTERS)}, ``out`` (filters, languages) and ``bias``."""

    languages: list[str]
    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """Maxima of all filters over windows of bytes, and what a training step needs again."""
        seen = self.embedding[x]
        n = len(x)
        tops, kept = [], []
        for width, f in self.filters.items():
            spans = np.lib.stride_tricks.sliding_window_view(seen, width, axis=1)  # (n, positions, DEPTH, width)
            flat = np.ascontiguousarray(spans.transpose(0, 1, 3, 2)).reshape(n, -1, width * DEPTH)
            y = flat @ f
            at = y.argmax(axis=1)
            tops.append(np.take_along_axis(y, at[:, None, :], axis=1)[:, 0])
            kept.append((flat, at))
        return np.concatenate(tops, axis=1), kept


def fit(samples: list[bytes], labels: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Train on windows (WINDOW bytes each) with their languages, by Adam on the cross-entropy."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    small = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
    net = Network(
        languages,
        small(256, DEPTH) * 0.5,
        {w: small(w * DEPTH, FILTERS) / np.sqrt(w * DEPTH).astype(np.float32) for w in WIDTHS},
        small(FILTERS * len(WIDTHS), len(languages)) * 0.1,
        np.zeros(len(languages), np.float32),
    )
    if len(languages) < 2:
        return net
    x = np.frombuffer(b"".join(samples), np.uint8).reshape(-1, WINDOW)
    y = np.searchsorted(languages, labels)
    weight = (len(y) / (len(languages) * np.bincount(y, minlength=len(languages)))).astype(np.float32)  # rare languages count as much
    params = [net.embedding, *net.filters.values(), net.out, net.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            part = order[at : at + BATCH]
            bx, by = x[part], y[part]
            # a third of the windows is shortened, as the last one of a text is
            length = rng.integers(WINDOW // 6, 3 * WINDOW, len(bx))
            bx = np.where(np.arange(WINDOW) < length[:, None], bx, np.uint8(0))
            top, kept = net.pooled(bx)
            hidden = np.maximum(top, 0)
            p = _softmax(hidden @ net.out + net.bias)
            p[np.arange(len(by)), by] -= 1
            p *= (weight[by] / len(by))[:, None]
            back = (p @ net.out.T) * (top > 0)
            grads_f, grad_e = [], np.zeros_like(net.embedding)
            for i, (w, f) in enumerate(net.filters.items()):
                flat, where = kept[i]
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                chosen = flat[np.arange(len(bx))[:, None], where]  # (n, FILTERS, width * DEPTH)
                grads_f.append(np.einsum("nfd,nf->df", chosen, g))
                spread = (g[:, :, None] * f.T[None]).reshape(len(bx), FILTERS, w, DEPTH)
                signs = bx[np.arange(len(bx))[:, None, None], where[:, :, None] + np.arange(w)]
                np.add.at(grad_e, signs.reshape(-1), spread.reshape(-1, DEPTH))
            grads = [grad_e, *grads_f, hidden.T @ p, p.sum(axis=0)]
            step += 1
            rate = 0.01 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for q, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return net


class Compiled:
    """A network with its linear part as tables over pairs of bytes."""

    def __init__(self, net: Network):
        self.net = net
        n = len(net.filters)
        # tables[k]: what the k-th pair of a filter adds, for all filters that have so many pairs, side by side
        self.tables = []
        for k in range(max(net.filters) // 2):
            side = []
            for w, f in net.filters.items():
                if w // 2 > k:
                    a, b = (net.embedding @ f[(2 * k + i) * DEPTH : (2 * k + i + 1) * DEPTH] for i in (0, 1))
                    side.append((a[:, None] + b[None]).reshape(65536, -1))
            self.tables.append(np.ascontiguousarray(np.concatenate(side, axis=1)))
        self.first = [n - t.shape[1] // FILTERS for t in self.tables]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(n, languages) for windows of bytes."""
        pairs = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        widths = list(self.net.filters)
        total = self.tables[0].take(pairs, axis=0)
        for k in range(1, len(self.tables)):
            more = self.tables[k].take(pairs[:, 2 * k :], axis=0)
            total[:, : more.shape[1], self.first[k] * FILTERS :] += more
        # a filter ends where its last pair does
        tops = [total[:, : WINDOW - w + 1, i * FILTERS : (i + 1) * FILTERS].max(axis=1) for i, w in enumerate(widths)]
        return _softmax(np.maximum(np.concatenate(tops, axis=1), 0) @ self.net.out + self.net.bias)

    def of_texts(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        """Language and score of each whole text."""
        cut = [-(-len(t) // WINDOW) for t in texts]
        x = np.frombuffer(b"".join(t.ljust(n * WINDOW, b"\0") for t, n in zip(texts, cut)), np.uint8).reshape(-1, WINDOW)
        weight = np.full(len(x), WINDOW, np.float64)
        ends = np.cumsum(cut)
        for t, n, e in zip(texts, cut, ends):
            if n:
                weight[e - 1] = len(t) - (n - 1) * WINDOW
        p = np.zeros((len(x), len(self.net.languages)))
        for at in range(0, len(x), CHUNK):
            p[at : at + CHUNK] = self.probabilities(x[at : at + CHUNK])
        sums = np.concatenate((np.zeros((1, p.shape[1])), np.cumsum(p * weight[:, None], axis=0)))
        names, scores = [], []
        for t, n, e in zip(texts, cut, ends):
            if not n or not LETTER.search(t.decode()):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            own = (sums[e] - sums[e - n]) / len(t)
            best = int(own.argmax())
            names.append(self.net.languages[best])
            scores.append(round(float(min(max(own[best], 0.0), 1.0)), 6))  # sums differ in the last digits with the batch
        return names, scores


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that training never sees: a quarter, by crc32 of the id. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", per_language: int = DOCS_PER_LANGUAGE, per_doc: int = WINDOWS_PER_DOC) -> Network | None:
    """A network for the languages of ``docs``; None if no document has a label and a letter.

    About ``per_language`` documents of each language are chosen by a hash of id and text (a language with fewer gives all),
    and of each at most ``per_doc`` windows, spread over the whole text. Only those windows come to the driver.
    """
    text, label = F.col(f"`{text_col}`"), F.col(f"`{label_col}`").cast("string")
    known = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), text.alias("text"), label.alias("lang")).where(F.col("lang").isNotNull() & text.isNotNull())
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    chosen = known.join(F.broadcast(counts) if counts.count() < 1000 else counts, "lang")
    chosen = chosen.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 32)) * F.col("n") < F.lit(per_language * (1 << 32)))

    def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it, 512):
            langs, rows = [], []
            for t, lang in zip(utf8(b.column(0)), b.column(1).to_pylist()):
                if not LETTER.search(t.decode()):
                    continue
                own = windows(t)
                for i in np.unique(np.linspace(0, len(own) - 1, min(per_doc, len(own))).round().astype(int)):
                    langs.append(lang)
                    rows.append(own[i].tobytes())
            yield pa.record_batch([pa.array(langs, pa.string()), pa.array(rows, pa.binary())], names=["lang", "window"])

    found = sorted((r["lang"], bytes(r["window"])) for r in chosen.select("text", "lang").mapInArrow(spread, "lang string, window binary").collect())
    return fit([w for _, w in found], [lang for lang, _ in found]) if found else None


def predict(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``score`` (0 to 1), from whole texts and nothing else; input columns of those names are replaced.

    A null text and a text without a letter have language ``und`` and score 0, and so has every text if there is no network. Repeated rows have equal results.
    """
    if net is None:
        return unpacked(docs.select(whole_row(docs)), "row", docs.columns, {"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few hundred kilobytes

    @F.arrow_udf("struct<lang:string,score:double>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Compiled(shared.value)  # 25 MB, which go with the task: workers live on, idle or in other stages
        for texts in columns:
            names, scores = [], []
            for at in range(0, len(texts), 256):
                n, s = model.of_texts(utf8(texts.slice(at, 256)))
                names += n
                scores += s
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    d = docs.select(whole_row(docs), run(F.col(f"`{text_col}`")).alias("made"))
    return unpacked(d, "row", docs.columns, {"lang_pred": F.col("made.lang"), "score": F.col("made.score")})


def length_class(text: Column) -> Column:
    """0 below a quarter of a window, 1 below a window, 2 for longer texts: shorter ones have lower scores."""
    n = F.octet_length(text)
    return F.when(n < WINDOW // 4, 0).when(n < WINDOW, 1).otherwise(2)


def low_scores(predicted: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id") -> dict[int, float]:
    """Per length class the score below which a text is taken for no language that the network knows; ``predicted`` is a result of ``predict``.

    It is half of the score that 99 of 100 held-out labelled texts reach, so that clean texts stay. All of them count, but for
    those without a letter. Scores have six digits, so there are few different ones to rank, however many texts.
    """
    text = F.col(f"`{text_col}`")
    known = predicted.where(held_out(id_col) & F.col(f"`{label_col}`").isNotNull() & text.isNotNull() & (F.col("lang_pred") != UNKNOWN))
    seen = known.select(length_class(text).alias("length"), "score").groupBy("length", "score").agg(F.count("*").alias("n"))
    found = seen.groupBy("length").agg(F.percentile("score", F.lit(0.01), F.col("n")).alias("low"), F.sum("n").alias("n")).collect()
    return {r["length"]: r["low"] / 2 for r in found if r["n"] >= LEAST_JUDGED}
