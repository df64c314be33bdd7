"""Array expressions: vectors, padding, label vectors, text codecs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def mean_vector(vectors: Column) -> Column:
    """Mean of a list of equally long vectors; null for an empty list."""
    n = F.size(vectors)
    zeros = F.transform(F.get(vectors, F.lit(0)), lambda x: F.lit(0.0))
    summed = F.aggregate(vectors, zeros, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y.cast("double")))
    return F.when(n > 0, F.transform(summed, lambda x: x / n))


def pad_post(a: Column, n: int) -> tuple[Column, Column]:
    """First ``n`` values, zeros on the right, and the clipped length."""
    zero = F.array_repeat(F.lit(0).cast("long"), n)
    return F.slice(F.concat(F.slice(a, 1, n).cast("array<bigint>"), zero), 1, n), F.least(F.size(a), F.lit(n))


def pad_pre(a: Column, n: int, pad: int | Column) -> Column:
    """Last ``n`` values, ``pad`` on the left."""
    pad = pad if isinstance(pad, Column) else F.lit(pad)
    size = F.size(a)
    kept = F.when(size > n, F.slice(a, F.greatest(size - n + 1, F.lit(1)), F.lit(n))).otherwise(a)
    return F.concat(F.array_repeat(pad.cast("long"), F.greatest(F.lit(n) - size, F.lit(0))), kept.cast("array<bigint>"))


def binarize(scores: Column, threshold: float = 0.4) -> Column:
    return F.transform(scores, lambda v: (v >= threshold).cast("int"))


def multi_hot(tags: Column, labels: list[str]) -> Column:
    """0/1 per label in the given order."""
    return F.transform(F.array(*[F.lit(x) for x in labels]), lambda x: F.array_contains(tags, x).cast("int"))


def is_labelled(tags: Column, labels: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(tags, F.array(*[F.lit(x) for x in labels])), F.lit(False))


def difficulty_class(c: Column) -> Column:
    return F.when(c.isNull(), "Various").when(c <= 1500, "Easy").when(c < 2500, "Medium").otherwise("Hard")


def vector_from_text(c: Column) -> Column:
    """``[0.1 0.2\\n 0.3]`` -> array of doubles."""
    bare = F.regexp_replace(c, r"[\n\[\]]", "")
    return F.transform(F.filter(F.split(bare, " "), lambda x: x != ""), lambda x: x.cast("double"))


def vector_to_text(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), " "), F.lit("]"))
