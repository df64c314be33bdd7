"""Consensus of several clusterings, label alignment and self-training."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.scale import salted_join
from codestrata.session import cut

Learner = Callable[[DataFrame, DataFrame], DataFrame]
MIN_GROWTH = 20  # self-training goes on only while a round adds more rows than this


# ---- consensus ----------------------------------------------------------------------------------


def _best_keys(keys: list[tuple[tuple[str, ...], int]], k: int) -> list[int]:
    """Indices of k keys that differ pairwise in every component and cover most rows; empty if there are none.

    Every first component is used once, so the search goes from one to the next and
    stops where the largest remaining counts cannot beat the best found.
    """
    groups: dict[str, list[int]] = {}
    for i, (parts, _) in enumerate(keys):
        groups.setdefault(parts[0], []).append(i)
    best: list = [-1, []]

    def choose(names: tuple[str, ...]) -> None:
        tail = [0]
        for name in reversed(names):
            tail.append(tail[-1] + max(keys[i][1] for i in groups[name]))
        tail = tail[::-1]

        def go(level: int, used: list[set], score: int, picked: list[int]) -> None:
            if level == len(names):
                if score > best[0]:
                    best[:] = [score, list(picked)]
                return
            if score + tail[level] <= best[0]:
                return
            for i in groups[names[level]]:
                parts = keys[i][0]
                if any(p in u for p, u in zip(parts[1:], used)):
                    continue
                go(level + 1, [u | {p} for p, u in zip(parts[1:], used)], score + keys[i][1], [*picked, i])

        go(0, [set() for _ in keys[0][0][1:]], 0, [])

    if len(groups) == k:
        choose(tuple(sorted(groups)))
    return best[1]


def consensus(paths: DataFrame, ks: DataFrame, keys: list[str] = ("problem",)) -> DataFrame:
    """Chosen path keys per problem: ``(problem, path, n, score)``; path is null where no k keys are compatible.

    Works on the counted keys, of which there are at most k per view combination.
    """
    types = dict(paths.dtypes)
    keys = list(keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("path")
        found = _best_keys([(tuple(p.split("$")), int(n)) for p, n in zip(pdf["path"], pdf["n"])], int(pdf["k"].iloc[0]))
        head = {c: pdf[c].iloc[0] for c in keys}
        if not found:
            return pd.DataFrame([{**head, "path": None, "n": 0, "score": -1}])
        hit = pdf.iloc[found]
        return pd.DataFrame({**head, "path": hit["path"].to_numpy(), "n": hit["n"].to_numpy(), "score": int(hit["n"].sum())})

    schema = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", path string, n long, score long"
    return paths.join(ks, "problem").groupBy(*keys).applyInPandas(run, schema)


def seed_sets(assign: DataFrame, clusters: list[str], chosen: DataFrame, keys: list[str] = ("problem",)) -> DataFrame:
    """Every row flagged ``agreed`` when its path was chosen; agreed rows keep the cluster of the first view."""
    path = F.concat_ws("$", *[F.col(c).cast("string") for c in clusters])
    picked = chosen.filter(F.col("path").isNotNull()).select(*keys, "path", F.lit(True).alias("agreed"))
    hit = salted_join(assign.withColumn("path", path), picked, [*keys, "path"], "left", spread=["index"])
    return hit.withColumn("agreed", F.coalesce("agreed", F.lit(False))).withColumn(
        "cluster", F.when(F.col("agreed"), F.col(clusters[0]))
    )


# ---- alignment ----------------------------------------------------------------------------------


def _assign(gain: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Column per row with the largest total gain (shortest augmenting paths on -gain), and which cells some optimum may use."""
    n = len(gain)
    cost = -gain
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, came, seen = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int), np.zeros(n + 1, dtype=bool)
        while match[j0]:
            seen[j0] = True
            row = match[j0]
            free = np.flatnonzero(~seen[1:]) + 1
            reduced = cost[row - 1, free - 1] - u[row] - v[free]
            better = reduced < low[free]
            low[free[better]], came[free[better]] = reduced[better], j0
            j1 = free[low[free].argmin()]
            delta = low[j1]
            u[match[seen]] += delta
            v[seen] -= delta
            low[~seen] -= delta
            j0 = j1
        while j0:
            match[j0], j0 = match[came[j0]], came[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[match[j] - 1] = j - 1
    return out, cost - u[1:, None] - v[None, 1:] <= 1e-9


def _first_best(gain: np.ndarray) -> list[int]:
    """The optimal assignment that comes first when label positions are read as a word.

    All optimal assignments use cells without reduced cost only, so one solution is turned into the first one by
    exchanging along such cells, row by row.
    """
    column, tight = _assign(gain)
    n = len(gain)
    row_of = [0] * n
    for r, c in enumerate(column):
        row_of[c] = r

    def free(row: int, fixed: int, goal: int, seen: set[int]) -> bool:
        """Move ``row`` to another column, through rows after ``fixed``, so that ``goal`` is taken."""
        for c in np.flatnonzero(tight[row]).tolist():
            if c in seen or row_of[c] < fixed:
                continue
            seen.add(c)
            if c == goal or (row_of[c] > fixed and free(row_of[c], fixed, goal, seen)):
                row_of[c], column[row] = row, c
                return True
        return False

    for row in range(n):
        for c in np.flatnonzero(tight[row]).tolist():
            if c == column[row]:
                break
            if row_of[c] > row and free(row_of[c], row, column[row], {c}):
                row_of[c], column[row] = row, c
                break
    return column


def align_labels(cells: DataFrame, labels: DataFrame, keys: list[str] = ("problem",)) -> DataFrame:
    """One label per cluster such that the weighted F1 of the renamed clusters is largest.

    The score is a sum over (cluster, label) of ``2 n_a C_ab / (n_a + m_b)``, so the
    best permutation is an assignment on the k x k counts. Ties go to the permutation
    that is first in label order. Gives ``(keys, cluster, label)``; ``labels`` should hold all labels of
    the problem, and clusters beyond their number have a null label.
    """
    types = dict(cells.dtypes)
    keys = list(keys)
    names = labels.select("problem", "label").distinct().groupBy("problem").agg(F.sort_array(F.collect_set("label")).alias("__names"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = list(pdf["__names"].iloc[0])
        k = max(len(names), int(pdf["cluster"].max()) + 1)
        c = np.zeros((k, k))
        for a, b, n in zip(pdf["cluster"], pdf["label"], pdf["n"]):
            c[int(a), names.index(b)] += n
        row, col = c.sum(1)[:, None], c.sum(0)[None, :]
        gain = np.where(c > 0, 2 * row * c / np.maximum(row + col, 1), 0.0)
        got = [(a, names[b] if b < len(names) else None) for a, b in enumerate(_first_best(gain))]
        out = pd.DataFrame(got, columns=["cluster", "label"])
        for at, key in enumerate(keys):
            out.insert(at, key, pdf[key].iloc[0])
        return out

    schema = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", cluster int, label string"
    return cells.join(names, "problem").groupBy(*keys).applyInPandas(run, schema)


def named_clusters(assign: DataFrame, keys: list[str] = ("problem",), label: str = "label", labels: DataFrame | None = None) -> DataFrame:
    """``assign`` with truth and aligned prediction: ``(keys, index, y_true, y_pred)``.

    ``labels`` are all labels ``(problem, label)`` where ``assign`` may lack some. No row with a cluster is lost: those of a cluster that
    got no label have a null ``y_pred``.
    """
    keys = list(keys)
    known = assign.filter(F.col("cluster").isNotNull())
    cells = known.groupBy(*keys, "cluster", F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    every = assign.select("problem", F.col(label).alias("label")) if labels is None else labels.select("problem", "label")
    names = align_labels(cells, every, keys)
    return salted_join(known.withColumnRenamed(label, "y_true"), names.withColumnRenamed("label", "y_pred"), [*keys, "cluster"], "left", spread=["index"])


# ---- self-training ------------------------------------------------------------------------------


def self_train(
    agreed: DataFrame, rest: DataFrame, learners: list[Learner], final: bool = False, min_growth: int = MIN_GROWTH, max_rounds: int | None = None
) -> DataFrame:
    """Grow the agreed rows: ``(problem, index, label, round)`` for every row that found a label.

    ``agreed(problem, index, label, x0, x1, ...)``, ``rest`` the same without a label. Each
    round fits one learner per view on the agreed rows of all open problems and moves
    the rows on which all views agree. A problem closes when nothing is left or a
    round added at most ``min_growth`` rows, so rounds end without a limit; ``max_rounds`` stops
    earlier, for single steps. ``final`` gives the rows still open the label of the first view.

    Vectors are written once; a round writes only the keys and labels that it moves.
    """
    views = len(learners)
    xs = [f"x{i}" for i in range(views)]
    data = cut(agreed.select("problem", "index", *xs).unionByName(rest.select("problem", "index", *xs)))
    labels = cut(agreed.select("problem", "index", "label", F.lit(0).alias("round")))
    left = cut(rest.select("problem", "index"))
    added = labels.groupBy("problem").agg(F.count(F.lit(1)).alias("added"))

    def predictions(train: DataFrame, test: DataFrame, use: list[int]) -> DataFrame:
        train, test = train.join(data, ["problem", "index"]), test.join(data, ["problem", "index"])
        out = test.select("problem", "index")
        for i in use:
            one = learners[i](
                train.select("problem", "index", "label", F.col(xs[i]).alias("x")), test.select("problem", "index", F.col(xs[i]).alias("x"))
            )
            out = out.join(one.select("problem", "index", F.col("pred").alias(f"p{i}")), ["problem", "index"])
        return out

    number = 0
    while max_rounds is None or number < max_rounds:
        number += 1
        open_problems = added.filter(F.col("added") > min_growth).join(left.select("problem").distinct(), "problem", "left_semi")
        open_problems = cut(open_problems.select("problem"))
        if open_problems.isEmpty():
            break
        voted = predictions(labels.join(open_problems, "problem", "left_semi"), left.join(open_problems, "problem", "left_semi"), list(range(views)))
        same = reduce(lambda a, b: a & b, [F.col(f"p{i - 1}") == F.col(f"p{i}") for i in range(1, views)], F.lit(True))
        moved = cut(voted.filter(same).select("problem", "index", F.col("p0").alias("label"), F.lit(number).alias("round")))
        labels = labels.unionByName(moved)
        left = cut(left.join(moved.select("problem", "index"), ["problem", "index"], "left_anti"))
        added = moved.groupBy("problem").agg(F.count(F.lit(1)).alias("added"))
    if final and not left.isEmpty():
        last = predictions(labels, left, [0]).select("problem", "index", F.col("p0").alias("label"), F.lit(-1).alias("round"))
        labels = labels.unionByName(last)
    return labels
