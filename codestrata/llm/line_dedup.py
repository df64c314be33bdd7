"""Line deduplication with a sharded minimal perfect hash over the repeated lines.

1. Every document lists the 128-bit hashes of its distinct line keys; counting them (with map-side
   combine, so a line of a third of all documents costs one row per task) gives the repeated keys.
2. The repeated keys are dealt to shards by hash. A shard is a minimal perfect hash (bit levels with a
   rank directory) that indexes three arrays: 64-bit fingerprints, document counts and last holders.
3. Documents do not join lines. They send one packed row of hashes per shard to a cell holding the
   shard's arrays and probe those; hot shards are copied to several cells and the documents spread
   over them, so no cell gets all holders of a hot line.
4. What a document loses returns to it as one packed value.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import batches_of, pieces, shuffle_partitions, unpacked, utf8, whole_row
from codestrata.session import cut

MIN_CHARS = 20
MIN_DOCS = 3
KEYS_PER_SHARD = 1 << 18
COPIES = 16  # cells per shard at least; the documents of one hot line spread over them
NO_ID = -(1 << 63)  # stands for a null id, below all others
WIDTH = 16  # bytes of a line hash


def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of the line's key, None for a key that is too short to count."""
    key = line.strip().lower()  # on bytes: only the six ASCII blanks, only A-Z
    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def _distinct(text: bytes, min_chars: int) -> list[bytes]:
    return [h for h in dict.fromkeys(line_hash(x, min_chars) for x in text.split(b"\n")) if h is not None]


def _mix(hi: np.ndarray, lo: np.ndarray, level: int) -> np.ndarray:
    x = hi ^ (lo + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1)))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class LineIndex:
    """Minimal perfect hash over distinct 128-bit keys with the arrays that it indexes.

    Each level is a bit table; a key that is alone in its slot sets the bit, the others go on to the
    next level. The index of a key is the number of bits set before its own.
    """

    SLACK = 1.6  # slots per key of a level

    def __init__(self, hi: np.ndarray, lo: np.ndarray, count: np.ndarray, last: np.ndarray):
        h, l = hi.view(np.uint64), lo.view(np.uint64)
        self.sizes: list[int] = []
        tables = []
        rest = np.arange(len(h))
        while len(rest):
            size = max(8, int(len(rest) * self.SLACK)) | 1
            slot = (_mix(h[rest], l[rest], len(self.sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(slot, minlength=size) == 1
            self.sizes.append(size)
            tables.append(alone)
            rest = rest[~alone[slot]]
        self._set_bits(np.concatenate(tables) if tables else np.zeros(0, bool))
        at = self._position(h, l)
        self.fingerprint = np.empty(len(h), np.uint64)
        self.count = np.empty(len(h), np.int64)
        self.last = np.empty(len(h), np.int64)
        self.fingerprint[at], self.count[at], self.last[at] = l, count, last

    def _set_bits(self, bits: np.ndarray) -> None:
        self.words = np.packbits(bits, bitorder="little")
        per = np.bitwise_count(self.words).astype(np.int64)
        self.rank = np.concatenate(([0], np.cumsum(per)))  # bits set before each byte

    def _position(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where no level has its bit."""
        out = np.full(len(hi), -1, np.int64)
        rest = np.arange(len(hi))
        base = 0
        for level, size in enumerate(self.sizes):
            slot = base + (_mix(hi[rest], lo[rest], level) % np.uint64(size)).astype(np.int64)
            byte, bit = slot >> 3, (slot & 7).astype(np.uint8)
            word = self.words[byte]
            found = (word >> bit) & 1 == 1
            before = np.bitwise_count(word & ((np.uint8(1) << bit) - np.uint8(1))).astype(np.int64)
            out[rest[found]] = (self.rank[byte] + before)[found]
            rest = rest[~found]
            base += size
            if not len(rest):
                break
        return out

    def look_up(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Array position of each key, -1 for keys that are not in the index."""
        at = self._position(hi, lo)
        return np.where((at >= 0) & (self.fingerprint[at] == lo) if len(self.fingerprint) else False, at, -1)

    def dump(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, sizes=np.array(self.sizes, np.int64), words=self.words, fingerprint=self.fingerprint, count=self.count, last=self.last)
        return f.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> LineIndex:
        z = np.load(io.BytesIO(blob))
        self = cls.__new__(cls)
        self.sizes, self.words = z["sizes"].tolist(), z["words"]
        self.rank = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))))
        self.fingerprint, self.count, self.last = z["fingerprint"], z["count"], z["last"]
        return self


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(hi, lo, n_docs, last): hashes of the line keys held by at least ``min_docs`` documents."""

    def hashes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it, 512):
            found = [_distinct(t, min_chars) for t in utf8(b.column(1))]
            n = np.array([len(x) for x in found], np.int64)
            halves = np.frombuffer(b"".join(x for f in found for x in f), "<i8").reshape(-1, 2)
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(found)), n)))
            yield pa.record_batch([pa.array(halves[:, 0]), pa.array(halves[:, 1]), ids], names=["hi", "lo", "id"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    listed = rows.mapInArrow(hashes, "hi long, lo long, id long")
    return listed.groupBy("hi", "lo").agg(F.count("*").alias("n_docs"), F.max("id").alias("last")).where(F.col("n_docs") >= min_docs)


def index_shards(lines: DataFrame, shards: int) -> DataFrame:
    """(shard, arrays): one perfect hash per shard of the repeated lines; the hash keeps the shards even."""

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        index = LineIndex(*(part[c].to_numpy(np.int64) for c in ("hi", "lo", "n_docs", "last")))
        return pd.DataFrame({"shard": [key[0]], "arrays": [index.dump()]})

    dealt = lines.withColumn("last", F.coalesce("last", F.lit(NO_ID))).withColumn("shard", F.pmod("hi", F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(build, "shard int, arrays binary")


def _lost(keyed: DataFrame, shards: DataFrame, n_shards: int, copies: int, min_chars: int) -> DataFrame:
    """(id, mark, lost): hashes each document loses, from its probes of the shards' arrays."""

    def probes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it, 512):
            at, cell, packed = [], [], []
            copy = b.column(3).to_numpy(zero_copy_only=False)
            for i, text in enumerate(utf8(b.column(2))):
                if not (found := _distinct(text, min_chars)):
                    continue
                own = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
                shard = own[:, 0] % n_shards
                for s in np.unique(shard):
                    at.append(i)
                    cell.append(int(s) * copies + int(copy[i]))
                    packed.append(own[shard == s].tobytes())
            ids = b.column(0).take(pa.array(at, pa.int64()))
            yield pa.record_batch(
                [pa.array(cell, pa.int32()), pa.array([1] * len(at), pa.int32()), ids, b.column(1).take(pa.array(at, pa.int64())), pa.array(packed, pa.binary())],
                names=["cell", "kind", "id", "mark", "data"],
            )

    def probe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, index = None, None
        for b in it:
            ids, marks, lost = [], [], []
            for row in b.to_pylist():
                if row["kind"] == 0:
                    cell, index = row["cell"], LineIndex.load(row["data"])
                    continue
                if row["cell"] != cell:  # no repeated line in that shard
                    continue
                hashes = np.frombuffer(row["data"], "<i8").reshape(-1, 2)
                found = index.look_up(hashes[:, 0].copy().view(np.uint64), hashes[:, 1].copy().view(np.uint64))
                own = NO_ID if row["id"] is None else row["id"]
                gone = hashes[(found >= 0) & (index.last[found] != own)]
                if len(gone):
                    ids.append(row["id"])
                    marks.append(row["mark"])
                    lost.append(gone.tobytes())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(lost, pa.binary())], names=["id", "mark", "lost"])

    schema = "cell int, kind int, id long, mark long, data binary"
    held = shards.select(
        F.explode(F.sequence(F.col("shard") * copies, F.col("shard") * copies + copies - 1)).alias("cell"),
        F.lit(0).alias("kind"),
        F.lit(None).cast("long").alias("id"),
        F.lit(None).cast("long").alias("mark"),
        F.col("arrays").alias("data"),
    )
    # copies of one text go to different cells too
    copy = F.pmod(F.xxhash64("id", "text"), F.lit(copies)).alias("copy")
    cells = held.unionByName(keyed.select("id", "mark", "text", copy).mapInArrow(probes, schema))
    met = cells.repartitionById(n_shards * copies, "cell").sortWithinPartitions("cell", "kind")
    found = met.mapInArrow(probe, "id long, mark long, lost binary")
    return found.groupBy("id", "mark").agg(F.collect_list("lost").alias("lost"))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    keys_per_shard: int = KEYS_PER_SHARD,
) -> DataFrame:
    """``docs`` without the lines that at least ``min_docs`` documents share, but for the last holder of each.

    A line's key is the line without ASCII blanks at both ends and with A-Z lower-cased; keys under
    ``min_chars`` code points never count. A key's lines all stay in the document with the largest id.
    Returns the columns of ``docs`` with the kept text, plus ``n_lines`` (before) and ``n_dropped``; input
    columns of those two names are replaced.

    Null or empty text is one empty line and comes back empty. Every row counts as a document, also
    repeated rows; rows that share the largest id all keep the line. A null id is below every other id.
    """
    spark = docs.sparkSession
    lines = cut(repeated_lines(docs, id_col, text_col, min_chars, min_docs))
    n_shards = pieces(lines.count(), keys_per_shard)
    copies = max(COPIES, pieces(shuffle_partitions(spark), n_shards))
    shards = index_shards(lines, n_shards)
    own = F.col(f"`{id_col}`").cast("long")
    keyed = docs.select(whole_row(docs), own.alias("id"), F.col(f"`{text_col}`").alias("text"))
    # equal ids with different texts are told apart by a hash of the text
    keyed = keyed.withColumn("mark", F.shiftrightunsigned(F.xxhash64("text"), 1))
    # the same row twice asks the same and gets one answer, so the join below repeats no row
    lost = _lost(keyed, shards, n_shards, copies, min_chars).select(
        F.col("id").alias("lost_id"), F.col("mark").alias("lost_mark"), "lost"
    )

    @F.arrow_udf("struct<kept:string,n_dropped:long>")
    def keep(texts: pa.Array, lost: pa.Array) -> pa.Array:
        made = []
        for at in range(0, len(texts), 256):  # few texts are Python objects at a time
            out, dropped = [], []
            for text, packed in zip(utf8(texts.slice(at, 256)), lost.slice(at, 256).to_pylist()):
                if not packed:
                    out.append(None)
                    dropped.append(0)
                    continue
                rows = text.split(b"\n")
                gone = {p[i : i + WIDTH] for p in packed for i in range(0, len(p), WIDTH)}
                stay = [r for r in rows if line_hash(r, min_chars) not in gone]
                out.append(b"\n".join(stay))
                dropped.append(len(rows) - len(stay))
            made.append((pa.array(out, pa.binary()).cast(pa.string()), pa.array(dropped, pa.int64())))
        columns = [pa.concat_arrays(list(c)) for c in zip(*made)] if made else [pa.array([], t) for t in (pa.string(), pa.int64())]
        return pa.StructArray.from_arrays(columns, names=["kept", "n_dropped"])

    met = keyed.join(lost, keyed["id"].eqNullSafe(lost["lost_id"]) & (keyed["mark"] == lost["lost_mark"]), "left")
    # a text that loses nothing stays where it is: only the others are handed to Python and back
    done = met.withColumn("done", keep(F.when(F.col("lost").isNotNull(), F.col("text")), "lost"))
    whole = F.coalesce("text", F.lit(""))
    n_lines = F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    replaced = {text_col: F.coalesce("done.kept", whole), "n_lines": n_lines.cast("long"), "n_dropped": F.col("done.n_dropped")}
    return unpacked(done, "row", docs.columns, replaced)
