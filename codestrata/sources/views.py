"""Views: one relation ``(view, problem, index, label, x)`` for every kind of embedding."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.arrays import mean_vector

__all__ = ["register_view", "view_names", "views", "pooled"]

_LOADERS: dict[str, Callable[[SparkSession], DataFrame]] = {}


def register_view(name: str, loader: Callable[[SparkSession], DataFrame]) -> None:
    """``loader(spark)`` gives ``(index, label, embeddings array<array<double>>)``."""
    _LOADERS[name] = loader


def view_names() -> list[str]:
    return list(_LOADERS)


def views(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """All registered views as one relation."""
    parts = []
    for name in names or view_names():
        if name not in _LOADERS:
            raise KeyError(f"no view named {name}")
        parts.append(
            _LOADERS[name](spark).select(F.lit(name).alias("view"), "index", "label", "embeddings")
        )
    return reduce(DataFrame.unionByName, parts)


def pooled(df: DataFrame) -> DataFrame:
    """Mean-pool every solution to one vector; solutions without any vector leave the view."""
    keep = ["view"] if "view" in df.columns else []
    return (
        df.select(
            *keep,
            F.split_part("label", F.lit("$"), F.lit(1)).alias("problem"),
            "index",
            "label",
            mean_vector(F.col("embeddings")).alias("x"),
        )
        .filter(F.col("x").isNotNull())
    )
