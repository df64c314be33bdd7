"""Token ids in compressed files: one wavelet matrix per shard.

Documents are dealt to range partitions by id, encoded with the ``tokenizers`` library and written in ascending order.
A shard is a run of whole documents, and a row of a Parquet file: the ids of its documents, their
lengths and one bit-plane per bit of a token id, highest first. In every plane the ids are in the order in
which the planes above have stably put zeros before ones, so rank on the planes leads from a position to its id
(access), from an id to its number of occurrences (count), and select leads back to the positions
(find). A plane comes with a rank directory of two levels, one bits before every 4096 bits and, within these, before every 512,
which makes it a sixteenth longer. Nothing but the files is needed for all that.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codestrata.llm.byte_bpe import Remembered, exact_words, in_signs, specials
from codestrata.llm.common import batches_of

END = 2  # the id put after every document
BARE = 100_000  # words without a blank before them that a worker remembers in each of two generations
SHARD = 1 << 18  # tokens after which a shard is closed; a longer document is a shard of its own
SHARD_SCHEMA = "part int, shard int, n long, docs array<long>, lengths array<long>, planes array<binary>, tops array<binary>, blocks array<binary>"


class Encoder:
    """Token ids of texts, as little-endian 32-bit bytes, from the library's model for every distinct word.

    A text is cut at its blanks and before its line feeds. What lies between is remembered with its ids: a word that stands behind
    a blank, or a line feed and the word behind it. A part that is neither has None, and then the text takes the tokenizer's own cut.
    """

    def __init__(self, spec: str):
        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        self.marks = specials(spec)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.marks, key=len, reverse=True))) + ")") if self.marks else None
        self.bare = Remembered(self._word, BARE)
        self.part = Remembered(self._part)

    def _word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(in_signs(word))]).tobytes()

    def _part(self, part: str) -> bytes | None:
        if part[:1] == "\n":
            word = part[1:]
            return self.bare["\n"] + b"".join(map(self._word, exact_words(word))) if word.split() == [word] else None
        if part.isalpha():
            return self._word(" " + part)
        if part.split() != [part]:
            return None
        if part[-1] in ".,;:!?)" and part[:-1].isalpha():  # a mark behind letters is a word of its own
            return self.part[part[:-1]] + self.bare[part[-1]]
        return b"".join(map(self._word, exact_words(" " + part)))

    def _plain(self, text: str) -> bytes:
        parts = text.replace("\n", " \n").split(" ")
        first = parts[0]
        if first.split() == [first]:
            try:
                return b"".join(map(self._word, exact_words(first))) + b"".join(map(self.part.__getitem__, parts[1:]))
            except TypeError:  # a part without ids
                pass
        return b"".join(map(self.bare.__getitem__, exact_words(text)))

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self.special is None or not any(m in text for m in self.marks):
            return self._plain(text)
        mark = lambda p: np.array([self.tokenizer.token_to_id(p)], "<u4").tobytes()
        return b"".join(mark(p) if i % 2 else self._plain(p) for i, p in enumerate(self.special.split(text)) if p)


@functools.lru_cache(2)
def encoder(spec: str) -> Encoder:
    """One per worker, so that words stay remembered from task to task."""
    return Encoder(spec)


class WaveletMatrix:
    """Bit-planes of a sequence of ids with rank and select on every plane, for many places at once."""

    BLOCK = 512  # bits per entry of the lower level of the rank directory
    BLOCKS = 8  # entries of the lower level per entry of the upper one

    def __init__(self, planes: list[bytes], n: int, tops: list[bytes], blocks: list[bytes]):
        self.n = n
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.tops = [np.frombuffer(t, "<u4") for t in tops]
        self.blocks = [np.frombuffer(b, "<u2") for b in blocks]

    @staticmethod
    def pack(ids: np.ndarray) -> list[bytes]:
        """The planes of a sequence of non-negative ids."""
        top = int(ids.max()) if len(ids) else 0
        now = ids.astype(np.uint16 if top < 1 << 16 else np.uint32)
        kind, planes = now.dtype.type, []
        spare = np.empty_like(now)
        for bit in range(max(1, top.bit_length()) - 1, -1, -1):
            ones = (now >> kind(bit)).astype(np.uint8) & np.uint8(1)
            planes.append(np.packbits(ones, bitorder="little").tobytes())
            if not bit:
                break
            mask = ones.view(bool)
            zeros = len(now) - int(np.count_nonzero(mask))
            np.compress(~mask, now, out=spare[:zeros])
            np.compress(mask, now, out=spare[zeros:])
            now, spare = spare, now
        return planes

    @classmethod
    def directory(cls, plane: bytes) -> tuple[bytes, bytes]:
        """The two levels of a plane's rank directory, with an entry for its end."""
        words = cls._words(np.frombuffer(plane, np.uint8))
        per = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        before = np.concatenate(([0], np.cumsum(per)))
        tops = before[:: cls.BLOCKS]
        return tops.astype("<u4").tobytes(), (before - np.repeat(tops, cls.BLOCKS)[: len(before)]).astype("<u2").tobytes()

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        planes = cls.pack(ids)
        levels = [cls.directory(p) for p in planes]
        return cls(planes, len(ids), [t for t, _ in levels], [b for _, b in levels])

    @classmethod
    def _words(cls, plane: np.ndarray) -> np.ndarray:
        """A plane as rows of eight 64-bit words per block, and an empty block behind its end."""
        padded = np.zeros((len(plane) // (cls.BLOCK // 8) + 1) * (cls.BLOCK // 8), np.uint8)
        padded[: len(plane)] = plane
        return padded.view("<u8").reshape(-1, cls.BLOCK // 64)

    @functools.cached_property
    def words(self) -> list[np.ndarray]:
        return [self._words(p) for p in self.planes]

    def unpack(self) -> np.ndarray:
        """All ids in their order: the planes undone from the lowest up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        place = np.arange(self.n, dtype=np.int32)
        for bit, plane in enumerate(reversed(self.planes)):
            ones = np.unpackbits(plane, count=self.n, bitorder="little")
            before = np.cumsum(ones, dtype=np.int32)
            zeros = self.n - (int(before[-1]) if self.n else 0)
            now = now.take(np.where(ones.view(bool), before + np.int32(zeros - 1), place - before)) if bit else now
            now |= ones.astype(kind) << kind(bit)
        return now

    def _before(self, plane: int, block: np.ndarray) -> np.ndarray:
        return self.tops[plane][block // self.BLOCKS].astype(np.int64) + self.blocks[plane][block]

    def rank(self, plane: int, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits of a plane, for every place asked for."""
        block = at // self.BLOCK
        bits = np.clip((at - block * self.BLOCK)[:, None] - np.arange(0, self.BLOCK, 64), 0, 64).astype(np.uint64)
        mask = np.where(bits < 64, (np.uint64(1) << (bits & np.uint64(63))) - np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF))
        return self._before(plane, block) + np.bitwise_count(self.words[plane][block] & mask).sum(axis=1, dtype=np.int64)

    def ones(self, plane: int) -> int:
        return int(self._before(plane, np.array([len(self.blocks[plane]) - 1]))[0])

    def select(self, plane: int, one: bool, k: np.ndarray) -> np.ndarray:
        """Positions of the k-th (from 0) ones or zeros of a plane."""
        block = np.arange(len(self.blocks[plane]))
        starts = self._before(plane, block)
        if not one:
            starts = np.minimum(block * self.BLOCK, self.n) - starts
        block = np.searchsorted(starts, k, side="right") - 1
        bits = np.unpackbits(self.words[plane][block].view(np.uint8).reshape(len(k), -1), axis=1, bitorder="little")
        if not one:
            bits ^= 1
        found = np.cumsum(bits, axis=1, dtype=np.int64) == (k - starts[block] + 1)[:, None]
        return block * self.BLOCK + np.argmax(found, axis=1)

    def access(self, at: int) -> int:
        value, place = 0, np.array([at])
        for plane in range(len(self.planes)):
            ones = self.rank(plane, place)
            if int(self.rank(plane, place + 1)[0]) > int(ones[0]):
                value, place = value * 2 + 1, self.n - self.ones(plane) + ones
            else:
                value, place = value * 2, place - ones
        return value

    def _ranges(self, token: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the occurrences of an id within each stretch lie below the last plane."""
        if token >> len(self.planes):
            return np.zeros_like(low), np.zeros_like(low)
        for plane in range(len(self.planes)):
            a, b = self.rank(plane, low), self.rank(plane, high)
            if token >> (len(self.planes) - 1 - plane) & 1:
                zeros = self.n - self.ones(plane)
                low, high = zeros + a, zeros + b
            else:
                low, high = low - a, high - b
        return low, high

    def count_within(self, token: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How often an id occurs in each stretch, by rank."""
        a, b = self._ranges(token, low, high)
        return b - a

    def first_within(self, token: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first place of an id in each stretch, by rank and select; -1 if there is none."""
        a, b = self._ranges(token, low, high)
        out = np.full(len(low), -1, np.int64)
        some = np.flatnonzero(b > a)
        if len(some):
            out[some] = self._places(a[some])
        return out

    def _places(self, at: np.ndarray) -> np.ndarray:
        """Positions in the sequence of places below the last plane."""
        for plane in range(len(self.planes) - 1, -1, -1):
            zeros = self.n - self.ones(plane)
            one = at >= zeros
            up = np.empty_like(at)
            if one.any():
                up[one] = self.select(plane, True, at[one] - zeros)
            if not one.all():
                up[~one] = self.select(plane, False, at[~one])
            at = up
        return at

    def count(self, token: int) -> int:
        return int(self.count_within(token, np.array([0]), np.array([self.n]))[0])

    def find(self, token: int) -> list[int]:
        """Positions of an id, ascending."""
        low, high = self._ranges(token, np.array([0]), np.array([self.n]))
        return self._places(np.arange(int(low[0]), int(high[0]))).tolist() if high[0] > low[0] else []


def write_tokens(docs: DataFrame, spec: str, path: str, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD, end: int = END) -> None:
    """Encode whole texts and write them to ``path`` in ascending order of their ids, null first.

    ``spec`` is the text of the tokenizer's file. No special tokens are added but ``end`` after every document; special strings inside a text are handled as
    the library does by default. Null and empty texts have the end id only. Rows with equal ids are
    documents of their own, in the order of their texts. A table without rows writes an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # one vocabulary file, of fixed size
    last = np.array([end], "<u4").tobytes()

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(shared.value)
        part, number = TaskContext.get().partitionId(), 0
        docs, lengths, held, size = [], [], [], 0

        def closed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            planes = WaveletMatrix.pack(ids)
            levels = [WaveletMatrix.directory(p) for p in planes]
            row = {"part": part, "shard": number, "n": len(ids), "docs": docs, "lengths": lengths, "planes": planes, "tops": [t for t, _ in levels], "blocks": [b for _, b in levels]}
            longs, blobs = pa.list_(pa.int64()), pa.list_(pa.binary())
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n", pa.int64()), ("docs", longs), ("lengths", longs), ("planes", blobs), ("tops", blobs), ("blocks", blobs)]))

        for batch in batches_of(it, 512):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = ids_of(text or "") + last
                docs.append(doc)
                lengths.append(len(ids) // 4)
                held.append(ids)
                size += len(ids) // 4
                if size >= shard:
                    yield closed()
                    docs, lengths, held, size, number = [], [], [], 0, number + 1
        if docs:
            yield closed()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # the partitions go by id alone, so that the sample taken for their bounds holds no texts
    rows.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(encode, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)


def _shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def _starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, shard, before): tokens before each shard. Windows hold the shards of one part, and one row per part."""
    shards = _shards(spark, path).select("part", "shard", "n")
    parts = shards.groupBy("part").agg(F.sum("n").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("above"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    own = shards.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return own.join(parts, "part").select("part", "shard", (F.col("before") + F.col("above")).alias("before"))


def _matrix(row: dict) -> WaveletMatrix:
    return WaveletMatrix(row["planes"], row["n"], row["tops"], row["blocks"])


def read_documents(spark: SparkSession, path: str, mark: int = END) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, n_marks, first_mark) of every document in the files: the ids before it, its ids, their checksum, and how
    often and where first (in the whole sequence) the id ``mark`` is in it, by rank and select; null where it is not."""

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(it, 1):
            row = batch.to_pylist()[0]
            matrix = _matrix(row)
            ids = matrix.unpack().astype("<u4").tobytes()
            ends = np.cumsum(row["lengths"])
            starts = ends - row["lengths"]
            sums = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            marks, first = matrix.count_within(mark, starts, ends), matrix.first_within(mark, starts, ends)
            k = len(sums)
            yield pa.record_batch(
                [
                    pa.array([row["part"]] * k, pa.int32()),
                    pa.array([row["shard"]] * k, pa.int32()),
                    pa.array(row["docs"], pa.int64()),
                    pa.array(starts, pa.int64()),
                    pa.array(row["lengths"], pa.int64()),
                    pa.array(sums, pa.int64()),
                    pa.array(marks, pa.int64()),
                    pa.array(first, pa.int64(), mask=first < 0),
                ],
                names=["part", "shard", "id", "at", "n_tokens", "ids_crc32", "n_marks", "first"],
            )

    rows = _shards(spark, path).mapInArrow(read, "part int, shard int, id long, at long, n_tokens long, ids_crc32 long, n_marks long, first long")
    placed = rows.join(_starts(spark, path), ["part", "shard"])
    return placed.select("id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "n_marks", (F.col("before") + F.col("first")).alias("first_mark"))


def _looked_up(spark: SparkSession, path: str, token: int, found) -> DataFrame:
    """Per shard what ``found`` makes of its matrix, from rank and select alone."""

    def look(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(it, 1):
            row = batch.to_pylist()[0]
            values = found(_matrix(row), token)
            k = len(values)
            yield pa.record_batch([pa.array([row["part"]] * k, pa.int32()), pa.array([row["shard"]] * k, pa.int32()), pa.array(values, pa.int64())], names=["part", "shard", "value"])

    return _shards(spark, path).select("part", "shard", "n", "planes", "tops", "blocks").mapInArrow(look, "part int, shard int, value long")


def count_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(n): how often an id occurs in the files; 0 in files without rows."""
    return _looked_up(spark, path, token, lambda m, t: [m.count(t)]).agg(F.coalesce(F.sum("value"), F.lit(0)).alias("n"))


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(position): every place of an id in the whole sequence; no rows if it is nowhere, as in files without rows."""
    found = _looked_up(spark, path, token, lambda m, t: m.find(t))
    return found.join(_starts(spark, path), ["part", "shard"]).select((F.col("before") + F.col("value")).alias("position"))
