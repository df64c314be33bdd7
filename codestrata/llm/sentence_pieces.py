"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The transducer is compiled from the model file into tables of arcs. Its normaliser is composed into it:
a blank and the sign that stands for it read the same arcs, and the dummy prefix is an arc before the first sign that reads nothing.
The paths of the pieces leave the start and end in states that write their ids; failure arcs lead from a state to the longest other one that
the signs read last can also be in, so that one pass over an input finds all pieces that end at each position; a sign without a
piece has an arc that writes the ids of its bytes. Composing the transducer with an input gives a lattice over the positions of the
input, and the ids are those on the lattice's shortest path in the tropical semiring (weights are added along a path, the least path counts).

In unigram models an arc weighs its negated score. In merge models the states after a piece also know it, and the arc from piece a
to piece b weighs 0 if merging the signs of both gives exactly these two, else infinity: a merge across the border would
happen for the pair just as in the whole text, so the one path of finite weight is what the merges yield. The weight of
a pair comes from the merge trees of the two pieces: only the pieces at the rims that touch can merge across the border.

Signs that no piece holds, and blanks if no piece has one behind another sign, part the lattice; few of the parts are remembered.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.byte_bpe import Remembered
from codestrata.llm.common import slices_of, unpacked, utf8, whole_row
from codestrata.llm.lattice import NEVER, UNKNOWN, Lattice, as_bytes

BLANK = "▁"  # stands for a space in pieces
PARTS = 100_000  # parts remembered per worker in each of two generations
ROWS = 256  # texts whose new words go through their lattices together
MERGES, NORMAL, UNUSED = "merges", "normal", "unused"


@dataclass(frozen=True)
class Model:
    """What is compiled from a model file; a few megabytes, sent to the executors."""

    kind: str
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    types: tuple[str, ...]
    unknown: int
    dummy_prefix: bool
    one_blank: bool
    byte_fallback: bool


def load_model(path: str) -> Model:
    """Read a ``.model`` file. Only the normaliser's own rules are compiled; a model with a character map is refused."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    if proto.normalizer_spec.precompiled_charsmap or not proto.normalizer_spec.escape_whitespaces:
        raise ValueError("models with a character map are not supported")
    if proto.trainer_spec.model_type not in (1, 2):
        raise ValueError("only unigram and merge models are supported")
    names = {1: NORMAL, 2: "unknown", 3: "control", 4: "user", 5: UNUSED, 6: "byte"}
    if any(p.type == 4 for p in proto.pieces):
        raise ValueError("models with user-defined symbols are not supported")
    return Model(
        MERGES if proto.trainer_spec.model_type == 2 else "unigram",
        tuple(p.piece for p in proto.pieces),
        tuple(p.score for p in proto.pieces),
        tuple(names[p.type] for p in proto.pieces),
        next(i for i, p in enumerate(proto.pieces) if p.type == 2),
        proto.normalizer_spec.add_dummy_prefix,
        proto.normalizer_spec.remove_extra_whitespaces,
        proto.trainer_spec.byte_fallback,
    )


class Transducer:
    """A model as arcs; composes them with texts."""

    def __init__(self, model: Model):
        self.model = model
        self.merges = model.kind == MERGES
        usable = (NORMAL, UNUSED) if self.merges else (NORMAL,)
        pieces = {p: i for i, p in enumerate(model.pieces) if model.types[i] in usable}
        # merges start from signs that are pieces; others never merge
        self.ids = {p: i for p, i in pieces.items() if not self.merges or all(s in pieces for s in p)}
        self.bytes = {p: i for i, p in enumerate(model.pieces) if model.types[i] == "byte"}
        self.byte_id = [self.bytes.get(f"<0x{b:02X}>", model.unknown) for b in range(256)]
        signs = {s for p in self.ids for s in p}
        blanks_lead = not any(BLANK in p.lstrip(BLANK) for p in self.ids)
        self.by_word = blanks_lead and "\n" not in signs and model.dummy_prefix and not model.one_blank
        blanks = f"[{BLANK} ]"
        self.parts = re.compile(f"{blanks}*[^{BLANK} ]+|{blanks}+") if blanks_lead else re.compile("(?s).+")
        lowest = min((s for s, t in zip(model.scores, model.types) if t == NORMAL), default=0.0)
        self.rims: dict[int, tuple | None] = {}
        self.lattice = Lattice(
            self.ids,
            self.weight if self.merges else None,
            alone=np.array([-score for score in model.scores]),
            unknown=0.0 if self.merges else 10 - lowest,
            least=0.0 if self.merges else -NEVER,
            alike={BLANK: " "},
        )
        self.packed = [i.to_bytes(4, "little") for i in range(len(model.pieces))]
        self.of_part = Remembered(lambda part: self.paths([part])[0], PARTS // 4)
        self.of_word = Remembered(lambda word: self.paths([" " + word])[0], PARTS)

    # weights

    def merge_steps(self, text: str) -> list[tuple[float, int, int, int]]:
        """(rank, left, middle, right) of the merges of a text in their order, as positions of signs: best score first, leftmost among equals."""
        n = len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ends = list(range(1, n + 1))  # 0 where a sign has become part of the piece before it
        heap: list[tuple[float, int, int]] = []

        def offer(i: int, j: int) -> None:
            whole = self.ids.get(text[i : ends[j]])
            if whole is not None:
                heapq.heappush(heap, (-self.model.scores[whole], i, ends[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        steps = []
        while heap:
            rank, i, end = heapq.heappop(heap)
            j = after[i]
            if not ends[i] or j >= n or ends[j] != end:
                continue
            steps.append((rank, i, j, end))
            ends[i], ends[j] = end, 0
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return steps

    def _rims(self, piece: int) -> tuple[list, list] | None:
        """Pieces at the right and the left rim of a piece's merge tree as (text, made, gone); None if its signs do not merge to it.

        Times are ranks, a merge that waited for a later one taking that one's. What is made last is never gone.
        """
        if piece not in self.rims:
            text = self.model.pieces[piece]
            n = len(text)
            right, left = [[text[-1:], -NEVER, NEVER]], [[text[:1], -NEVER, NEVER]]
            now, made = -NEVER, n == 1
            for rank, i, _, end in self.merge_steps(text):
                now = max(now, rank)
                made = i == 0 and end == n
                if end == n:
                    right[-1][2] = now
                    right.append([text[i:], now, NEVER])
                if i == 0:
                    left[-1][2] = now
                    left.append([text[:end], now, NEVER])
            self.rims[piece] = (right, left) if made else None
        return self.rims[piece]

    def weight(self, left: int, right: int) -> float:
        """The weight of the arc to piece ``right`` after piece ``left`` in a merge model; -1 is the start of a part."""
        own = self._rims(right)
        if own is None:
            return NEVER
        if left < 0:
            return 0.0
        find, scores = self.ids.get, self.model.scores
        for x, made_x, gone_x in self._rims(left)[0]:
            for y, made_y, gone_y in own[1]:
                whole = find(x + y)
                if whole is not None:
                    at = max(-scores[whole], made_x, made_y)
                    # at equal times the leftmost is first: a merge inside ``left``, then the border's, then one inside ``right``
                    if at < gone_x and at <= gone_y:
                        return NEVER
        return 0.0

    # encoding

    def paths(self, parts: list[str]) -> list[bytes]:
        """Ids on the shortest path of every part's lattice, as little-endian 32-bit numbers."""
        ids, ends = self.lattice.paths(parts)
        out = as_bytes(ids, ends)
        if (ids == UNKNOWN).any():
            at = 0
            for i, end in enumerate(ends.tolist()):
                if (ids[at:end] == UNKNOWN).any():
                    out[i] = self._with_unknown(parts[i], ids[at:end].tolist())
                at = end
        return out

    def _with_unknown(self, part: str, ids: list[int]) -> bytes:
        """A path with signs that have no piece, by their bytes."""
        out, at = [], 0
        for i in ids:
            out.append(self.packed[i] if i >= 0 else self._unknown(part[at]))
            at += len(self.model.pieces[i]) if i >= 0 else 1
        return b"".join(out)

    def _unknown(self, sign: str) -> bytes:
        return b"".join([self.packed[self.byte_id[b]] for b in sign.encode()]) if self.model.byte_fallback else self.packed[self.model.unknown]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as little-endian 32-bit numbers; parts not met before go through their lattices together."""
        cut = [self._cut(t) for t in texts]
        for memory in (self.of_word, self.of_part):
            parts = set().union(*[keys for runs in cut for m, keys in runs if m is memory])
            new = [p for p in parts.difference(memory) if not memory.known(p)]
            memory.put(new, self.paths([" " + w for w in new] if memory is self.of_word else new))
        return [b"".join([ids for memory, keys in runs for ids in map(memory.__getitem__, keys)]) for runs in cut]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def _cut(self, text: str) -> list[tuple[Remembered, list[str]]]:
        """A text as runs of parts; ``of_word`` has parts that start with one blank, without it."""
        if self.model.one_blank:  # arcs of the normaliser that read a blank and write nothing
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return []
        if not self.by_word or BLANK in text:
            return [(self.of_part, self.parts.findall((" " if self.model.dummy_prefix else "") + text))]
        runs: list[tuple[Remembered, list[str]]] = []
        for line in text.split("\n"):
            words = line.split(" ")
            if "" in words:
                runs.append((self.of_part, self.parts.findall(line if runs else " " + line)))
            elif runs:
                runs += [(self.of_part, words[:1]), (self.of_word, words[1:])]
            else:
                runs.append((self.of_word, words))
            runs.append((self.of_part, ["\n"]))
        return runs[:-1]


class Written:
    """The arcs read backwards: from ids to signs."""

    def __init__(self, model: Model):
        self.model = model
        self.written = [self._written(i) for i in range(len(model.pieces))]

    def _written(self, i: int) -> bytes:
        kind, piece = self.model.types[i], self.model.pieces[i]
        if kind == "byte":
            return bytes([int(piece[1:-1], 16)])
        if kind == "control":
            return b""
        return " ⁇ ".encode() if kind == "unknown" else piece.replace(BLANK, " ").encode()

    def decode(self, ids: bytes) -> str:
        """The text that ids stand for: the arcs read backwards. Bytes that are no UTF-8 become U+FFFD."""
        numbers = np.frombuffer(ids, "<u4")
        numbers = numbers[numbers < len(self.written)].tolist()
        text = b"".join(map(self.written.__getitem__, numbers)).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


@functools.lru_cache(1)
def transducer(model: Model) -> Transducer:
    """One per worker, so that the arcs are compiled once. What it remembers is bounded: some 60 MB in all."""
    return Transducer(model)


def encode_pieces(docs: DataFrame, model: Model, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` plus ``out``: the ids of every whole text as binary, four bytes each, lowest first.

    No begin or end ids. Null and empty texts have no ids. Row by row, so repeated rows and null ids make
    no difference; an input column named ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one vocabulary, of fixed size

    def encode(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = transducer(shared.value)
        for texts in slices_of(it, ROWS):
            yield pa.array(of.encode_all([t or "" for t in texts.to_pylist()]), pa.binary())

    # kept apart from what reads the ids, which would else work them out again
    made = F.arrow_udf(encode, "binary").asNondeterministic()
    d = docs.select(whole_row(docs), made(F.col(f"`{text_col}`")).alias("made"))
    return unpacked(d, "row", docs.columns, {out: F.col("made")})


def decode_pieces(docs: DataFrame, model: Model, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``docs`` plus ``out``: the text that the ids stand for; null has the empty text, ids outside the model stand for nothing.

    Row by row, so repeated rows and an empty table make no difference; an input column named ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def decode(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = Written(shared.value)
        for ids in slices_of(it, ROWS):
            yield pa.array([of.decode(i) for i in utf8(ids)], pa.string())

    d = docs.select(whole_row(docs), decode(F.col(f"`{ids_col}`")).alias("made"))
    return unpacked(d, "row", docs.columns, {out: F.col("made")})
