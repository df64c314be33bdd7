"""Building blocks that keep hot keys out of a single task.

A window over ``partitionBy(key)`` sorts a whole key in one task. The numbering
helpers below cut every key into buckets first, number the rows inside a bucket
and add the number of rows in the buckets before it, so a key that holds a third
of the data still spreads over the cluster and the result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.session import cut

HASH_DIGITS = 3  # hex digits of an md5 used as a bucket: 4096 buckets per key
SALTS = 32
SMALL_ROWS = 500_000  # short rows that every task may hold


def stable_hash(seed: object, *cols: str | Column) -> Column:
    """md5 text of ``seed:col:col``; the source of every reproducible shuffle and draw."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]))


def hash_int(h: Column) -> Column:
    """First 32 bits of an md5 text as a non-negative long."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


def _with_offsets(
    d: DataFrame, keys: list[str], bucket: str, measure: Column, out: str, order: list, total: str | None, per_key: DataFrame | None = None
) -> DataFrame:
    """``out`` = measure summed over the rows before this one in its key, ``total`` = over the whole key.

    Columns of ``per_key`` ride along on the bucket table, so a hot key never meets them row by row.
    """
    per_bucket = d.groupBy(*keys, bucket).agg(F.sum(measure).alias("__size"))
    # one row per non-empty bucket: the window below never sees more than the bucket count per key
    w = Window.partitionBy(*keys, F.lit(0)).orderBy(bucket)
    offsets = per_bucket.select(
        *keys,
        _cell(keys, bucket),
        (F.sum("__size").over(w) - F.col("__size")).alias("__before"),
        *([F.sum("__size").over(Window.partitionBy(*keys, F.lit(0))).alias(total)] if total else []),
    )
    if per_key is not None:
        extra = per_key.select(_cell(keys, None, "__key"), *[c for c in per_key.columns if c not in keys])
        offsets = offsets.withColumn("__key", _cell(keys, None, "__key")).join(extra, "__key").drop("__key")
    # join and window share the one partitioning by cell
    inside = Window.partitionBy("__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        d.withColumn("__cell", _cell(keys, bucket))
        .join(offsets.drop(*keys), "__cell")
        .withColumn(out, F.col("__before") + F.coalesce(F.sum(measure).over(inside), F.lit(0)))
        .drop("__before", "__cell", bucket)
    )


def _cell(keys: list[str], bucket: str | None, name: str = "__cell") -> Column:
    """Key and bucket as one value that is never null itself, so null keys join like any other."""
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *([F.col(bucket).alias("b")] if bucket else [])).alias(name)


def hash_running_sum(
    df: DataFrame, keys: Sequence[str], hash_col: str, tie: Sequence[str], value: str, out: str, total: str | None = None
) -> DataFrame:
    """Exclusive running sum of ``value`` per key in md5 order."""
    d = df.withColumn("__bucket", F.substring(F.col(hash_col), 1, HASH_DIGITS))
    return _with_offsets(d, list(keys), "__bucket", F.col(value), out, [hash_col, *tie], total)


def hash_rank(
    df: DataFrame, keys: Sequence[str], hash_col: str, tie: Sequence[str], out: str = "rn", total: str | None = None, per_key: DataFrame | None = None
) -> DataFrame:
    """1-based position of every row inside its key, in md5 order; ``total`` = rows of the key, ``per_key`` = columns to add per key."""
    d = df.withColumn("__bucket", F.substring(F.col(hash_col), 1, HASH_DIGITS))
    return _with_offsets(d, list(keys), "__bucket", F.lit(1).cast("long"), out, [hash_col, *tie], total, per_key).withColumn(out, F.col(out) + 1)


def range_running(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: dict[str, str], partitions: int | None = None
) -> DataFrame:
    """Exclusive running sums (``{out: value column}``) per key in value order.

    The rows are range partitioned by (key, order) and written once to the shared
    folder, which freezes the partition boundaries; the partition number is the
    bucket. ``order`` must be total within a key.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn("__bucket", F.spark_partition_id()))
    keys = list(keys)
    per = placed.groupBy(*keys, "__bucket").agg(*[F.sum(v).alias(f"__s_{o}") for o, v in sums.items()])
    w = Window.partitionBy(*keys, F.lit(0)).orderBy("__bucket")
    offsets = per.select(_cell(keys, "__bucket"), *[(F.sum(f"__s_{o}").over(w) - F.col(f"__s_{o}")).alias(f"__b_{o}") for o in sums])
    inside = Window.partitionBy("__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("__cell", _cell(keys, "__bucket")).join(offsets, "__cell")
    for o, v in sums.items():
        out = out.withColumn(o, F.col(f"__b_{o}") + F.coalesce(F.sum(v).over(inside), F.lit(0)))
    return out.drop("__bucket", "__cell", *[f"__b_{o}" for o in sums])


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", spread: Sequence[str] = (), salts: int = SALTS) -> DataFrame:
    """Equi-join of a skewed side with a small-per-key side.

    The skewed side is spread over ``salts`` sub-keys by a hash of ``spread``, the
    other side is repeated once per sub-key. Adaptive execution still turns this
    into a broadcast when the measured size of ``small`` allows it.
    """
    left = big.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in (spread or big.columns[:1])]), F.lit(salts)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def look_up(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", spread: Sequence[str] = ()) -> DataFrame:
    """Equi-join with a table of short rows: one of at most SMALL_ROWS (counted) goes to every task and ``big`` stays where it is, a larger one is met by ``salted_join``."""
    if small.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return big.join(F.broadcast(small), list(on), how)
    return salted_join(big, small, on, how, spread)


def spread_heavy(big: DataFrame, on: Sequence[str], spread: Sequence[str], per_task: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """``big`` with a sub-key ``__salt``, and (on, __copies) of the keys that hold more than ``per_task`` of its rows.

    Sub-keys come from counted rows, so a key has as many as it needs and most have one. There are at most
    rows / ``per_task`` keys in the second table. Rows with a null in ``on`` are left out; they join with nothing.
    """
    there = big.where(" AND ".join(f"`{c}` IS NOT NULL" for c in on))
    heavy = cut(there.groupBy(*on).agg(F.ceil(F.count("*") / per_task).cast("int").alias("__copies")).where("__copies > 1"))
    copies = F.coalesce("__copies", F.lit(1))
    salted = there.join(heavy, list(on), "left").withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in spread]), copies).cast("int"))
    return salted.drop("__copies"), heavy


def meet_spread(salted: DataFrame, heavy: DataFrame, small: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner equi-join of both results of ``spread_heavy`` with ``small``, whose rows are repeated once per sub-key of their key."""
    copies = F.coalesce("__copies", F.lit(1))
    right = small.join(heavy, list(on), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("__copies")
    return salted.join(right, [*on, "__salt"]).drop("__salt")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every key; a map-side combined ``min``, so copies never meet in one task."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*order, *rest)
    if rest and any(t.startswith("map") for _, t in df.select(*rest).dtypes):
        packed_min = F.min_by(packed, F.struct(*order))
    else:
        packed_min = F.min(packed)
    return df.groupBy(*keys).agg(packed_min.alias("__first")).select(*keys, "__first.*").select(*df.columns)
