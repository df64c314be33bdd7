"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_row(df: DataFrame, name: str = "row") -> Column:
    """All columns as one struct, so that no name of the input can clash with a working column."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def unpacked(df: DataFrame, row: str, columns: Iterable[str], replaced: dict[str, Column]) -> DataFrame:
    """The columns packed by ``whole_row``; ``replaced`` takes the place of a column of that name or is added at the end."""
    known = list(columns)
    kept = [replaced[c].alias(c) if c in replaced else F.col(f"{row}.`{c}`").alias(c) for c in known]
    return df.select(*kept, *[v.alias(c) for c, v in replaced.items() if c not in known])


def pieces(count: int, size: int) -> int:
    """How many parts of at most about ``size`` rows ``count`` rows make."""
    return max(1, math.ceil(count / size))


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if t is None else t for t in column.cast(kind).to_pylist()]


def batches_of(it: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``rows``, so that what is derived from one slice stays small."""
    for batch in it:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def slices_of(it: Iterator[pa.Array], rows: int) -> Iterator[pa.Array]:
    """The same values in slices of at most ``rows``, so that few of them are Python objects at a time."""
    for column in it:
        for at in range(0, len(column), rows):
            yield column.slice(at, rows)
