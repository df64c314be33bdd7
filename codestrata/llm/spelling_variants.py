"""Spelling variants: words one edit apart by a frontier that descends a relational trie, and the groups that they form.

The trie is a table: a node is the prefix that leads to it, and holds for every next letter how many words lie below,
how many letters they still have and with which they go on (as bits), and a hash of what is left if it is just one word. A state (word, position, node, edits) says
that the word's first letters lead to the node with none or one edit. Level by level the states of one depth are
joined with the nodes of that depth; an edge that reads the word's next letter keeps the edits, other edges and left-out letters
use the one edit. A state ends when one word is left below its edge, or none of a fitting length and letters.

An edit falls into the first half of a word or into the rest. So the trie is kept twice, for the words and for the words
read backwards, and a word starts in each at the node of the half that is then taken to be free of edits: near the root,
where edges fan out, there are no states.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import batches_of, utf8
from codestrata.session import cut, own_folder

MIN_LETTERS = 7
MIN_COUNT = 2
RATIO = 10  # a form is so many times as frequent
DROP = 31  # one in so many (document, run) loses a letter
HELD = 200_000  # words counted at once in a task
DEEPEST = 65  # letters of the longest words in the trie; see _long_neighbours

_RUNS = re.compile("[A-Za-zÀ-ÿ]{%d,}" % MIN_LETTERS)


def _lowered(run: str) -> str:
    """A-Z as small letters, other letters as they are."""
    return run.lower() if run.isascii() else run.encode().lower().decode()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of at least ``min_letters`` (7 or more) letters that occur ``min_count`` times in all texts.

    A word is a maximal run of letters ``[A-Za-zÀ-ÿ]`` with A-Z lowered. With h the CRC-32 of ``<id>:<run>``, the run loses the
    letter at h modulo its length if 31 divides h, and counts as what is left. Null and empty texts have no words; a null id
    is written as the empty string; every row counts, repeated ones too. A task counts before anything is shuffled, so that a
    frequent word costs a row per task.
    """

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches_of(it, 512):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text:
                    continue
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in Counter(map(_lowered, _RUNS.findall(text))).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % DROP == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                    if len(run) >= min_letters:
                        held[run] += n
            if len(held) >= HELD:
                yield counted(held)
                held = Counter()
        if held:
            yield counted(held)

    def counted(held: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# the trie

#: One of 64 bits for the (at most) three letters from a place of s on, and one for these, the last three letters and the number of letters left.
_BIT = "cast(xxhash64(substring(s, {}, 3)) & 63 AS int)"
_BOTH_BIT = "cast(xxhash64(substring(s, {}, 3), substring(s, -3, 3), {}) & 63 AS int)"


def _both_ways(words: DataFrame) -> DataFrame:
    """(s, m): words behind ``>`` and words read backwards behind ``<``, so that both tries fit one table."""
    ways = F.array(F.concat(F.lit(">"), F.col("word")), F.concat(F.lit("<"), F.reverse("word")))
    return words.select(F.explode(ways).alias("s"), F.char_length("word").alias("m"))


def _nodes(ways: DataFrame) -> DataFrame:
    """(node, depth, kids) of the nodes with at least two words below; the leaving edges are ``kids``, at most one per letter and the end.

    A node at depth d holds words that can be near one that starts no deeper than d.
    """
    backwards = F.col("s").startswith("<")
    least = F.floor((F.col("m") - F.when(backwards, 0).otherwise(1)) / 2)
    steps = ways.select("s", "m", F.explode(F.sequence(least.cast("int"), F.col("m"))).alias("d"))
    edges = (
        steps.select(
            F.expr("substring(s, 1, d + 1)").alias("node"),
            F.col("d").alias("depth"),
            F.expr("substring(s, d + 2, 1)").alias("c"),
            F.expr("shiftleft(1L, greatest(m - d - 1, 0))").alias("left"),
            F.expr(f"shiftleft(1L, {_BIT.format('d + 3')})").alias("next"),
            # with fewer than three letters left the last three are not all ahead, and this bit says nothing
            F.expr(f"CASE WHEN m - d - 1 < 3 THEN -1L ELSE shiftleft(1L, {_BOTH_BIT.format('d + 3', 'm - d - 1')}) END").alias("both"),
            F.expr("xxhash64(substring(s, d + 3, m))").alias("rest"),
        )
        .groupBy("node", "depth", "c")
        .agg(F.count("*").alias("below"), F.bit_or("left").alias("lengths"), F.bit_or("next").alias("nexts"), F.bit_or("both").alias("boths"), F.max("rest").alias("rest"))
    )
    nodes = edges.groupBy("node", "depth").agg(F.collect_list(F.struct("c", "below", "lengths", "nexts", "boths", "rest")).alias("kids"), F.sum("below").alias("words"))
    return nodes.where("words > 1").drop("words")


def _ahead(skip: int) -> str:
    """Whether words below the edge have as many letters left as the state ``skip`` letters on, and any goes on with its next three."""
    return f"shiftright(lengths, m - i - {skip}) & shiftright(nexts, bit{skip}) & shiftright(boths, both{skip}) & 1 = 1"


#: What an edge to the letter c makes of a state: the new position and edits, and null where there is none. Position -1 is a near word that ends here.
_MOVES = f"""array_compact(array(
  CASE WHEN c <> '' AND c = at AND edits = 0 AND below > 1 THEN struct(i + 1 AS i, 0 AS edits) END,
  CASE WHEN c <> '' AND c = at AND edits = 1 AND {_ahead(1)} THEN struct(i + 1 AS i, 1 AS edits) END,
  CASE WHEN c <> '' AND c <> at AND edits = 0 AND i < m AND {_ahead(1)} THEN struct(i + 1 AS i, 1 AS edits) END,
  CASE WHEN c <> '' AND edits = 0 AND {_ahead(0)} THEN struct(i AS i, 1 AS edits) END,
  CASE WHEN c <> '' AND c = after AND edits = 0 AND {_ahead(2)} THEN struct(i + 2 AS i, 1 AS edits) END,
  CASE WHEN c = '' AND i + 1 - edits = m THEN struct(-1 AS i, 1 AS edits) END
))"""


def _descended(states: DataFrame, nodes: DataFrame) -> DataFrame:
    """(s, i, edits, node, near) one level down; ``near`` is the near word where the search has ended, else null."""
    m = F.char_length("s") - 1
    met = states.join(nodes.drop("depth"), "node").withColumn("m", m)
    # what hangs on the state alone is worked out before the edges fan out
    met = met.withColumns({"at": F.expr("substring(s, i + 2, 1)"), "after": F.expr("substring(s, i + 3, 1)")} | {f"bit{k}": F.expr(_BIT.format(f"i + {k} + 2")) for k in range(3)})
    met = met.withColumns({f"both{k}": F.expr(_BOTH_BIT.format(f"i + {k} + 2", f"m - i - {k}")) for k in range(3)})
    edges = met.select("s", "i", "edits", "node", "m", "at", "after", *[f"{b}{k}" for b in ("bit", "both") for k in range(3)], F.inline("kids"))
    # a state without edits goes everywhere, one with its edit only along the letter that it reads
    edges = edges.where(f"c = at OR c = '' OR edits = 0 AND (c = after AND {_ahead(2)} OR {_ahead(1)} OR {_ahead(0)})")
    moved = edges.select("s", "node", "c", "below", "rest", F.explode(F.expr(_MOVES)).alias("to"))
    left = F.expr("substring(s, to.i + 2)")
    ended = (F.col("to.i") >= 0) & (F.col("below") == 1)
    fits = ~ended | (F.xxhash64(left) == F.col("rest"))
    near = F.when(F.col("to.i") < 0, F.col("node")).when(F.col("below") == 1, F.concat("node", "c", left))
    return moved.where(fits).select("s", "to.i", "to.edits", F.concat("node", "c").alias("node"), near.alias("near"))


def _trie_neighbours(words: DataFrame) -> DataFrame:
    """(word, near) for words of at most ``DEEPEST`` letters, some pairs twice."""
    spark = words.sparkSession
    ways = _both_ways(words.where(F.char_length("word") <= DEEPEST))
    path = f"{own_folder(spark)}/trie-{uuid.uuid4().hex}"
    _nodes(ways).write.partitionBy("depth").parquet(path)
    nodes = spark.read.schema("node string, kids array<struct<c string, below long, lengths long, nexts long, boths long, rest long>>, depth int").parquet(path)
    half = F.when(F.col("s").startswith("<"), F.ceil(F.col("m") / 2)).otherwise(F.floor(F.col("m") / 2)).cast("int")
    starts = cut(ways.select("s", half.alias("i")))
    deepest = nodes.agg(F.max("depth")).first()[0]
    found, states = None, None
    for depth in range(MIN_LETTERS // 2, (deepest or 0) + 1):
        new = starts.where(F.col("i") == depth).select("s", "i", F.lit(0).alias("edits"), F.expr("substring(s, 1, i + 1)").alias("node"))
        states = new if states is None else states.unionByName(new)
        moved = cut(_descended(states, nodes.where(F.col("depth") == depth)))
        near = moved.where("near IS NOT NULL").select("s", "near")
        found = near if found is None else found.unionByName(near)
        states = moved.where("near IS NULL").drop("near")
    if found is None:
        found = starts.select("s", F.col("s").alias("near")).limit(0)
    shown = lambda c: F.when(F.col(c).startswith("<"), F.reverse(F.expr(f"substring({c}, 2)"))).otherwise(F.expr(f"substring({c}, 2)"))
    return found.select(shown("s").alias("word"), shown("near").alias("near"))


# longer words


def _left_out(word: str) -> tuple[int, np.ndarray]:
    """A hash of a word, and the hashes of the word without its letter at each place; 64-bit, linear in the word's length."""
    letters = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64)
    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    factors = np.full(len(letters), base, np.uint64)
    factors[0] = 1
    powers = np.cumprod(factors)
    terms = letters * powers
    before = np.cumsum(terms) - terms
    whole = terms.sum(dtype=np.uint64)
    return int(whole.view(np.int64)), (before + (whole - before - terms) * np.uint64(inverse)).view(np.int64)


def _long_neighbours(words: DataFrame) -> DataFrame:
    """(word, near) for words of at least ``DEEPEST`` letters, some pairs twice.

    A trie as deep as the longest run of letters of a corpus would take a job per letter. Long words are rare; they meet by the
    hashes of what is left without one letter, and every pair is verified. Any number of letters costs one row per letter.
    """
    long = words.where(F.char_length("word") >= DEEPEST).select("word", F.xxhash64("word").alias("id"))

    def keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it, 16):
            for word, own in zip(utf8(b.column(0)), b.column(1).to_pylist()):
                whole, less = _left_out(word.decode())
                places = np.concatenate(([-1], np.arange(len(less)))).astype(np.int32)
                hashes = np.concatenate((np.array([whole], np.int64), less))
                yield pa.record_batch([pa.array(hashes), pa.array(places), pa.array(np.full(len(places), own, np.int64))], names=["h", "place", "id"])

    key = long.mapInArrow(keys, "h long, place int, id long")
    whole, less = key.where("place < 0"), key.where("place >= 0")
    other = less.select("h", "place", F.col("id").alias("other"))
    swapped = less.join(other, ["h", "place"]).where("id <> other").select("id", "other")
    shorter = whole.select("h", "id").join(other.select("h", "other"), "h").select("id", "other")
    pairs = swapped.unionByName(shorter).unionByName(shorter.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct()
    met = pairs.join(long, "id").join(long.select(F.col("id").alias("other"), F.col("word").alias("near")), "other")
    return met.where(F.levenshtein("word", "near", 1) == 1).select("word", "near")


# groups


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the chain of forms ends. Forms are ever more frequent, so chains are short, and every round halves them."""
    roots = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return roots


def variant_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n), one per word.

    Two words are near if one inserted, deleted or replaced code point turns one into the other. ``form`` is the near word of largest n
    (ties: first in code-point order) if that is at least ``ratio`` times the word's own, else null; ``root`` follows forms to the last one, and is the word
    itself without a form; ``n_near`` counts near words and ``form_n`` is the form's n. Words must be distinct, not null and
    of at least 7 letters, as ``word_counts`` gives them; other columns are not looked at. An empty table gives no rows.
    States of a node that very many words share are split by adaptive execution; a node has few edges, so no task collects words.
    """
    words = cut(words.select("word", "n"))
    found = _trie_neighbours(words).unionByName(_long_neighbours(words)).distinct()
    other = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    beside = cut(found.join(other, "near").groupBy("word").agg(F.count("*").alias("n_near"), best))
    told = words.join(beside, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    near_enough = F.col("near_n") >= F.col("n") * ratio
    told = cut(told.withColumns({"form": F.when(near_enough, F.col("near")), "form_n": F.when(near_enough, F.col("near_n"))}))
    roots = _roots(told.where("form IS NOT NULL"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
