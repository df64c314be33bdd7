"""Search evaluation as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.operators.aggregate import mean_curves
from codestrata.operators.search import ground_truth, ir_curves, nearest, relevant_totals
from codestrata.operators.split import sample_queries

CURVES = ["ndcg", "recall", "precision"]


def search_evaluation(functions: DataFrame, vectors: DataFrame, per_config: int = 10000, k: int = 199, seed: int = 12345) -> DataFrame:
    """Mean nDCG, recall and precision at 1..k over all configurations of compiler and optimisation level.

    ``functions(id, project, compiler, optimization, file_name, function_name)``, ``vectors(id, x)``. Up to ``per_config`` functions of
    every configuration are queries against all vectors; results of the same project, file and function are relevant. The
    curves are averaged within each configuration and then over them.
    """
    known = functions.join(vectors.select("id"), "id", "left_semi")
    labels = known.select("id", F.concat_ws("/", "project", "file_name", "function_name").alias("label"))
    asked = sample_queries(known, per_config, seed).select("id", "compiler", "optimization")
    top = nearest(vectors.join(asked.select("id"), "id", "left_semi"), vectors, k)
    curves = ir_curves(ground_truth(top, labels), relevant_totals(labels.join(asked, "id"), labels), k)
    rows = curves.join(asked.withColumnRenamed("id", "query_id"), "query_id")
    return mean_curves(rows, ["compiler", "optimization"], CURVES)
