"""Near copies by the exact Jaccard similarity of word shingles.

1. A text is the set of the XXH64 values of its word shingles; equal sets become one point.
2. Candidates are points that agree in all ROWS minima of one of BANDS bands of a MinHash signature. At the
   threshold a pair meets with a probability of 1 - (1 - 0.8 ** ROWS) ** BANDS, which is 1 - 5e-8, and above it sooner.
   (A radius of 64-bit fingerprints cannot do this: at similarity 0.8 they differ in 9.7 +- 2.9 bits, so a radius that
   misses few pairs is about 18, and around points 32 +- 4 bits apart no vantage point then divides anything.)
3. A candidate pair is linked only if the similarity of the whole sets reaches the threshold.
4. A key with few pairs has all of them compared. Of a crowded key all points are compared with one leader, and what is
   not connected by then is taken up again with others, so close groups cost no pairs of all with all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.llm.common import unpacked, utf8, whole_row
from codestrata.llm.components import components
from codestrata.session import cut

SHINGLE = 5
SIMILARITY = (4, 5)  # a Jaccard similarity of 0.8 links
ROWS = 4
BANDS = 32
SEED = 42
CHUNK = 256  # shingles that go through all hash functions together
FEW = 8  # pairs of a key per point of it, up to which all are compared
LEADERS = (1, 1, 6)  # leaders of a crowded key by turn, as a turn has its price however few pairs it meets; the pairs not connected after them are all compared

_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a text with fewer words is one shingle, one without words has none."""
    words = text.lower().split()  # on bytes: A-Z and the six ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    width = min(shingle, len(words))
    first, last = starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(first, last)], np.uint64))


def band_keys(own: np.ndarray) -> list[int]:
    """One signed 64-bit key per band; none for an empty set."""
    if not len(own):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), CHUNK):
        np.minimum(least, (own[None, at : at + CHUNK] * _FACTORS).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(part.tobytes(), band) for band, part in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def similar(a: bytes, b: bytes) -> bool:
    """Whether two sets, as bytes of sorted hashes, reach the threshold."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return SIMILARITY[1] * shared >= SIMILARITY[0] * (len(both) - shared)


def _slices(column: pa.Array) -> Iterator[pa.Array]:
    """A column in short parts, so that few texts are Python objects at a time."""
    for at in range(0, len(column), 256):
        yield column.slice(at, 256)


@F.arrow_udf(T.StructType().add("point", T.LongType()).add("n", T.LongType()).add("bands", T.ArrayType(T.LongType())))
def _signature(texts: pa.Array) -> pa.Array:
    points, sizes, bands = [], [], []
    for part in _slices(texts):
        for t in utf8(part):
            own = shingles(t)
            points.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
            sizes.append(len(own))
            bands.append(np.array(band_keys(own), np.int64))
    columns = [pa.array(np.array(points, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
    return pa.StructArray.from_arrays(columns, names=["point", "n", "bands"])


@F.arrow_udf(T.BinaryType())
def _set(texts: pa.Array) -> pa.Array:
    return pa.array([shingles(t).tobytes() for part in _slices(texts) for t in utf8(part)], pa.binary())


@F.arrow_udf(T.BooleanType())
def _similar(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([similar(x, y) for p, q in zip(_slices(a), _slices(b)) for x, y in zip(p.to_pylist(), q.to_pylist())], pa.bool_())


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that reach the threshold."""
    met = pairs.join(sets.select(F.col("point").alias("a"), F.col("hashes").alias("of_a")), "a")
    met = met.join(sets.select(F.col("point").alias("b"), F.col("hashes").alias("of_b")), "b")
    return met.where(_similar("of_a", "of_b")).select("a", "b")


def _links(crowded: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Verified edges (a, b) whose components are those of all similar pairs that share a key of ``crowded`` (key, point, n)."""
    edges = tested = None
    for turn in range(len(LEADERS) + 1):
        now = crowded.withColumn("part", F.col("point"))
        if edges is not None:
            found = components(edges).withColumnRenamed("node", "point")
            now = crowded.join(found, "point", "left").select("key", "point", "n", F.coalesce("root", "point").alias("part"))
        parts = now.groupBy("key", "part").agg(F.count("*").cast("double").alias("m"))
        keys = parts.groupBy("key").agg(F.sum("m").alias("rows"), F.sum(F.col("m") * F.col("m")).alias("squares"), F.count("*").alias("parts"))
        few = (F.col("rows") * F.col("rows") - F.col("squares") <= 2 * FEW * F.col("rows")) | F.lit(turn == len(LEADERS))
        now = cut(now.join(keys.where("parts > 1").select("key", few.alias("few")), "key"))
        if now.isEmpty():
            break
        side = lambda d, as_: d.select("key", *[F.col(c).alias(f"{c}_{as_}") for c in ("point", "n", "part")])
        small = now.where("few")
        met = side(small, "a").join(side(small, "b"), "key").where("point_a < point_b")
        if turn < len(LEADERS):
            large = now.where("not few")
            seeds = range(sum(LEADERS[:turn]), sum(LEADERS[: turn + 1]))
            first = [F.min(F.struct(F.xxhash64(F.lit(seed), "point").alias("h"), F.struct("point", "n", "part").alias("l")))["l"] for seed in seeds]
            leader = large.groupBy("key").agg(F.array_distinct(F.array(*first)).alias("ls")).select("key", F.explode("ls").alias("l"))
            leader = leader.select("key", *[F.col(f"l.{c}").alias(f"{c}_b") for c in ("point", "n", "part")])
            met = met.unionByName(side(large, "a").join(leader, "key"))
        met = met.where("part_a <> part_b")
        up, down = SIMILARITY
        met = met.where((F.col("n_a") * down >= F.col("n_b") * up) & (F.col("n_b") * down >= F.col("n_a") * up))
        pairs = met.select(F.col("point_a").alias("a"), F.col("point_b").alias("b")).distinct()
        pairs = cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        tested = pairs if tested is None else tested.unionByName(pairs)
        more = cut(_verified(pairs, sets))
        edges = more if edges is None else edges.unionByName(more)
        if turn == len(LEADERS):
            break
        crowded = cut(large.select("key", "point", "n"))
        if crowded.isEmpty():
            break
    return edges


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id``, ``mark`` (a hash of the text), ``point`` (a hash of its shingles), ``root`` (one point of the component), ``component_id``.

    Documents link when their sets of five-word shingles have a Jaccard similarity of at least 0.8. Text is lower-cased
    (A-Z) and split at ASCII blanks; null, empty and blank texts have the empty set and link with each other.
    Null ids do not count as smallest unless a component has no other, and then its ``component_id`` is null.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = cut(texts.select("id", F.xxhash64("text").alias("mark"), _signature("text").alias("s")).select("id", "mark", "s.*"))
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "mark")).alias("first")
    points = cut(rows.groupBy("point").agg(first, F.any_value("n").alias("n"), F.any_value("bands").alias("bands")))
    keyed = points.select(F.explode("bands").alias("key"), "point", "n")
    shared = keyed.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key")
    crowded = cut(keyed.join(shared, "key"))
    wanted = points.join(crowded.select("point").distinct(), "point").select("point", F.col("first.id").alias("of_id"), F.col("first.mark").alias("of_mark"))
    whole = texts.withColumn("mark", F.xxhash64("text"))
    met = whole.join(wanted, whole["id"].eqNullSafe(wanted["of_id"]) & (whole["mark"] == wanted["of_mark"]))
    sets = cut(met.groupBy("point").agg(F.any_value("text").alias("text")).select("point", _set("text").alias("hashes")))
    edges = _links(crowded, sets)
    roots = points.select("point", F.col("first.id").alias("least"))
    if edges is None:
        roots = roots.withColumn("root", F.col("point"))
    else:
        found = components(edges).withColumnRenamed("node", "point")
        roots = roots.join(found, "point", "left").select("point", "least", F.coalesce("root", "point").alias("root"))
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("id", "mark", "point").join(roots.join(named, "root").select("point", "root", "component_id"), "point")


def joined(found: DataFrame, groups: DataFrame) -> DataFrame:
    """``found`` of ``similar_components`` with components that share a group of ``groups(mark, root)`` made one under a common ``root``."""
    of_group = F.xxhash64(F.lit("group"), "root")
    pairs = cut(found.select("mark", "root").distinct().join(groups.select("mark", of_group.alias("b")).distinct(), "mark").select(F.col("root").alias("a"), "b").distinct())
    wide = pairs.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").select("b")
    edges = cut(pairs.join(wide, "b").select("a", "b"))
    if edges.isEmpty():
        return found
    common = components(edges).select(F.col("node").alias("root"), F.col("root").alias("common"))
    return found.join(common, "root", "left").withColumn("root", F.coalesce("common", "root")).drop("common")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: DataFrame | None = None) -> DataFrame:
    """``docs`` with one row of every component: that of the smallest id (repeated rows count once).

    ``groups(mark, root)`` are further links: texts (by their hash) with one root are one component.
    """
    found = similar_components(docs, id_col, text_col)
    if groups is not None:
        found = joined(cut(found), groups)
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "mark")).alias("first")
    stay = found.groupBy("root").agg(first).select(F.col("first.id").alias("stay_id"), F.col("first.mark").alias("stay_mark")).distinct()
    keyed = docs.select(whole_row(docs), F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("mark"))
    met = keyed.join(stay, keyed["id"].eqNullSafe(stay["stay_id"]) & (keyed["mark"] == stay["stay_mark"]), "left_semi")
    once = met.groupBy("id", "mark").agg(F.first("row").alias("row"))  # same keys as the join: no further shuffle
    return unpacked(once, "row", docs.columns, {})
