"""Reproducible shuffles, splits, samples and pair tables. All randomness is an md5 of seed and id."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.arrays import difficulty_class, is_labelled, multi_hot
from codestrata.scale import HASH_DIGITS, _cell, hash_int, hash_rank, hash_running_sum, salted_join, stable_hash
from codestrata.session import cut

RARE = 7  # the fewest rows of which each of the default shares gets one


def shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in a random but repeatable order with their position."""
    d = hash_rank(df.withColumn("__h", stable_hash(seed, key)), [], "__h", [key], out="pos")
    return d.drop("__h")


def split_labelled(df: DataFrame, labels: list[str]) -> DataFrame:
    """Multi-hot target for rows with a known label; the others go to the ``unlabeled`` fold."""
    known = is_labelled(F.col("tags"), labels)
    return df.withColumn("Y", F.when(known, multi_hot(F.col("tags"), labels))).withColumn("fold", F.when(~known, "unlabeled"))


def stratified_split(df: DataFrame, key: str, p: float = 0.15, seed: int = 42, y: str = "Y", rare: int = RARE) -> DataFrame:
    """Folds train/dev/test with every label set split alike (shares 1-2p / p / p).

    Label sets of fewer than ``rare`` rows cannot be split by these shares and form one stratum per rarest label.
    """
    counts = (
        df.select(F.posexplode(y).alias("pos", "v"))
        .groupBy("pos")
        .agg(F.sum(F.col("v").cast("long")).alias("n"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "n"))).alias("c"))
        .select(F.transform("c", lambda s: s["n"]))
        .scalar()
    )
    d = df.withColumn("__set", F.array_join(F.transform(y, lambda v: v.cast("string")), ""))
    sizes = d.groupBy("__set").agg(F.count(F.lit(1)).alias("__n"))
    d = salted_join(d, sizes, ["__set"], spread=[key]).withColumn("__counts", counts)
    positives = F.filter(
        F.transform(F.col(y), lambda v, i: F.when(v == 1, F.struct(F.get(F.col("__counts"), i).alias("n"), i.alias("i")))),
        lambda s: s.isNotNull(),
    )
    rarest = F.array_min(positives)["i"].cast("string")
    d = d.withColumn(
        "__stratum", F.when(F.col("__n") < rare, F.concat(F.lit("rare:"), F.coalesce(rarest, F.lit("none")))).otherwise(F.col("__set"))
    ).drop("__counts", "__n", "__set")
    d = hash_rank(d.withColumn("__h", stable_hash(seed, key)), ["__stratum"], "__h", [key], out="__rn", total="__size")
    n_test = F.floor(F.col("__size") * p + 0.5)
    n_dev = F.floor((F.col("__size") - n_test) * (p / (1 - p)) + 0.5)
    fold = F.when(F.col("__rn") <= n_test, "test").when(F.col("__rn") <= n_test + n_dev, "dev").otherwise("train")
    return d.withColumn("fold", fold).drop("__h", "__rn", "__size", "__stratum")


def _label_pairs(labels: str) -> Column:
    """Every label (``1:1``) and every pair of labels (``1:3``) of a set written as ``1010``; ``none`` for a set without labels."""
    at = f"filter(sequence(1, greatest(length({labels}), 1)), i -> substring({labels}, i, 1) = '1')"
    pairs = F.expr(f"flatten(transform({at}, a -> transform(filter({at}, b -> b >= a), b -> concat(a, ':', b))))")
    return F.when(F.size(pairs) > 0, pairs).otherwise(F.array(F.lit("none")))


def _dealt(before: Column, n: Column, held_out: float, test_of_it: float) -> tuple[Column, Column]:
    """(test, dev) rows of a label set that follows ``before`` rows of its round: both shares are rounded along the round, never per set."""
    held = lambda c: F.floor(F.round(c * held_out, 9) + 0.5)
    test = lambda c: F.floor(F.round(held(c) * test_of_it, 9) + 0.5)
    in_test = test(before + n) - test(before)
    return in_test, held(before + n) - held(before) - in_test


def stratified_pairs_split(df: DataFrame, key: str, p: float = 0.15, seed: int = 42, y: str = "Y") -> DataFrame:
    """Folds train/dev/test (shares 1-2p / p / p) with every label and every pair of labels split alike.

    Rows of one label set can stand for each other, so the rounds work on the table of label sets and their counts. Label pairs (a label
    alone is a pair with itself) have a round each, the rarest first. A round deals the sets that hold its pair and no rarer one, by what the pair
    still wants in each fold. As a set is in one round only, all sets holding a pair are dealt when its round ends. At last
    single rows change folds as long as that lowers the squared distance of all pairs from their shares and one is off by more than a row.
    Rows then take their folds by md5 rank in their set, in one shuffle. Pairs off by more than a row may stay where no single change helps.

    The driver holds what each pair wants, labels x labels numbers; label sets and rows stay distributed. Null targets count as no label,
    repeated rows are rows of their own, and an empty table gives an empty one.
    """
    folds, share = ("test", "dev", "train"), (p, p, 1 - 2 * p)
    d = df.withColumn("__set", F.coalesce(F.array_join(F.transform(y, lambda v: F.when(v == 1, "1").otherwise("0")), ""), F.lit("")))
    sets = cut(d.groupBy("__set").agg(F.count(F.lit(1)).alias("n")).withColumn("pairs", _label_pairs("__set")))
    total = {r["pair"]: r["n"] for r in sets.select(F.explode("pairs").alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    rounds = sorted(total, key=lambda q: (total[q], q))
    if not rounds:
        return d.drop("__set").withColumn("fold", F.lit(None).cast("string"))
    number = F.create_map(*chain.from_iterable((F.lit(q), F.lit(i)) for i, q in enumerate(rounds)))
    w = Window.partitionBy("round").orderBy("__set").rowsBetween(Window.unboundedPreceding, -1)
    sets = sets.withColumn("round", F.array_min(F.transform("pairs", lambda q: number[q])))
    sets = cut(sets.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))))
    dealt_in = {r["round"] for r in sets.select("round").distinct().collect()}

    have = {q: [0, 0, 0] for q in rounds}
    shares = {}
    for i in sorted(dealt_in):
        want = [max(0.0, s * total[rounds[i]] - h) for s, h in zip(share, have[rounds[i]])]
        held = want[0] + want[1]
        shares[i] = (held / (sum(want) or 1.0), want[0] / (held or 1.0))
        test, dev = _dealt(F.col("before"), F.col("n"), *shares[i])
        given = sets.filter(F.col("round") == i).select(F.explode("pairs").alias("pair"), "n", test.alias("test"), dev.alias("dev"))
        for r in given.groupBy("pair").agg(F.sum("test").alias("test"), F.sum("dev").alias("dev"), F.sum("n").alias("n")).collect():
            have[r["pair"]] = [a + b for a, b in zip(have[r["pair"]], (r["test"], r["dev"], r["n"] - r["test"] - r["dev"]))]

    of_round = F.create_map(*chain.from_iterable((F.lit(i), F.array(*map(F.lit, s))) for i, s in shares.items()))
    sets = sets.withColumn("__shares", of_round[F.col("round")])
    test, dev = _dealt(F.col("before"), F.col("n"), F.col("__shares")[0], F.col("__shares")[1])
    sets = cut(sets.select("__set", "n", "pairs", test.alias("test"), dev.alias("dev")).withColumn("train", F.col("n") - F.col("test") - F.col("dev")))
    sets = _exchanged(sets, have, total, folds, share)
    d = hash_rank(d.withColumn("__h", stable_hash(seed, key)), ["__set"], "__h", [key], out="__rn", per_key=sets.select("__set", F.col("test").alias("__test"), F.col("dev").alias("__dev")))
    fold = F.when(F.col("__rn") <= F.col("__test"), "test").when(F.col("__rn") <= F.col("__test") + F.col("__dev"), "dev").otherwise("train")
    return d.select(*df.columns, fold.alias("fold"))


def _exchanged(sets: DataFrame, have: dict, total: dict, folds: tuple, share: tuple) -> DataFrame:
    """Label sets with their rows per fold after the exchanges; a change takes one row of a set from a fold to another."""
    moves: dict[str, list[int]] = {}
    now = sets
    off = lambda q: [h - s * total[q] for h, s in zip(have[q], share)]
    while any(abs(x) > 1 for q in have for x in off(q)):
        far = F.create_map(*chain.from_iterable((F.lit(q), F.array(*map(F.lit, off(q)))) for q in have))
        gain = lambda f, g: F.aggregate("pairs", F.lit(0.0), lambda a, q: a + far[q][f] - far[q][g] - 1)
        options = [
            F.struct(
                gain(f, g).alias("gain"),
                F.lit(f).alias("f"),
                F.lit(g).alias("g"),
                F.col(folds[f]).alias("rows"),
            )
            for f in range(3)
            for g in range(3)
            if f != g
        ]
        best = now.select("__set", "pairs", F.inline(F.array(*options))).filter((F.col("rows") > 0) & (F.col("gain") > 1e-6))
        found = best.agg(F.max(F.struct(F.round("gain", 6).alias("gain"), "__set", "f", "g", "pairs")).alias("b")).first()["b"]
        if found is None:
            break
        change = moves.setdefault(found["__set"], [0, 0, 0])
        for counts in (change, *(have[q] for q in found["pairs"])):
            counts[found["f"]] -= 1
            counts[found["g"]] += 1
        changes = sets.sparkSession.createDataFrame([(s, *c) for s, c in moves.items()], "__set string, c0 long, c1 long, c2 long")
        now = sets.join(changes, "__set", "left")
        now = now.select("__set", "n", "pairs", *[(F.col(f) + F.coalesce(f"c{i}", F.lit(0))).alias(f) for i, f in enumerate(folds)])
    return now


def stratified_by_difficulty(df: DataFrame, key: str, p: float = 0.15, seed: int = 42) -> DataFrame:
    """Only Easy, Medium and Hard rows are split; every ``Various`` row trains."""
    d = df.withColumn("difficulty_class", difficulty_class(F.col("difficulty")))
    rated = stratified_split(d.filter(F.col("difficulty_class") != "Various"), key, p, seed)
    return rated.unionByName(d.filter(F.col("difficulty_class") == "Various").withColumn("fold", F.lit("train")))


def make_folds(problems: DataFrame, labels: list[str], key: str = "index", p: float = 0.15, seed: int = 42) -> DataFrame:
    """train/dev/test/unlabeled per problem, then one row per solution; solutions follow their problem."""
    routed = split_labelled(problems, labels)
    known = stratified_split(routed.filter(F.col("fold").isNull()).drop("fold"), key, p, seed)
    every = known.unionByName(routed.filter(F.col("fold") == "unlabeled"))
    return every.select(F.col(key).alias("problem"), "fold", "tags", "Y", F.explode("solutions").alias("__s")).select(
        "problem", "fold", "tags", "Y", "__s.*"
    )


def grouped_split(df: DataFrame, validation: float, test: float, seed: int = 12345) -> DataFrame:
    """Whole files go to test until its quota is met, then to validation, then to train."""
    files = df.groupBy("project", "file_name").agg(F.count(F.lit(1)).alias("n"))
    files = files.withColumn("h", stable_hash(seed, "project", "file_name"))
    run = cut(hash_running_sum(files, [], "h", ["project", "file_name"], "n", "before", total="rows"))
    q_test, q_val = F.floor(F.col("rows") * test), F.floor(F.col("rows") * validation)
    in_test = run.filter(F.col("before") < q_test).agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    fold = (
        F.when(F.col("before") < q_test, "test").when(F.col("before") - in_test < q_val, "validation").otherwise("train")
    )
    return salted_join(df, run.select("project", "file_name", fold.alias("fold")), ["project", "file_name"], spread=["id"])


def holdout(df: DataFrame, share: float = 0.2, key: str = "index", seed: int = 42) -> DataFrame:
    """Flag a fixed share of every problem as test rows."""
    d = hash_rank(df.withColumn("__h", stable_hash(seed, "problem", key)), ["problem"], "__h", [key], out="__rn", total="__n")
    return d.withColumn("is_test", F.col("__rn") <= F.ceil(F.col("__n") * share)).drop("__h", "__rn", "__n")


def k_folds(df: DataFrame, k: int = 5, key: str = "index", seed: int = 42) -> DataFrame:
    """Fold number per row, balanced within every label of a problem."""
    d = hash_rank(df.withColumn("__h", stable_hash(seed, "problem", key)), ["problem", "label"], "__h", [key], out="__rn")
    return d.withColumn("cv_fold", ((F.col("__rn") - 1) % k).cast("int")).drop("__h", "__rn")


def sample_queries(functions: DataFrame, n: int = 10000, seed: int = 12345) -> DataFrame:
    """Up to ``n`` functions per compiler and optimisation level, without repetition."""
    d = functions.withColumn("__h", stable_hash(seed, "id"))
    d = hash_rank(d, ["compiler", "optimization"], "__h", ["id"], out="draw")
    return d.filter(F.col("draw") <= n).drop("__h")


def suffix_duplicates(df: DataFrame, keys: list[str], name: str, order: str, ext: str = ".CPP") -> DataFrame:
    """Second and later files of the same name get ``_2``, ``_3``, ..."""
    d = hash_rank(df.withColumn("__h", stable_hash("name", order)), [*keys, name], "__h", [order], out="__rn")
    stem = F.split_part(F.col(name), F.lit(ext), F.lit(1))
    renamed = F.when(F.col("__rn") > 1, F.concat(stem, F.lit("_"), F.col("__rn").cast("string"), F.lit(ext))).otherwise(F.col(name))
    return d.withColumn("unique_name", renamed).drop("__h", "__rn")


# ---- pairs --------------------------------------------------------------------------------------


GROUP_ROWS = 100_000  # rows of a provenance group that are numbered in one piece


def _positions(functions: DataFrame, fold: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Every function gets a position in its fold such that functions of one provenance are neighbours.

    ``start`` and ``g`` are the first position and the size of its provenance group, ``n`` the fold size. A group of more than ``group_rows``
    rows is numbered in pieces by the first digits of its md5, as many as its size asks for; small groups, which are most, are one piece each.
    """
    prov = ["project", "file_name", "function_name"]
    keys = [fold, *prov]
    rows = functions.select(*keys, "id")
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("g")).withColumn("__gh", stable_hash("group", *prov))
    groups = cut(hash_running_sum(groups, [fold], "__gh", prov, "g", "start", total="n").drop("__gh"))
    pieces = F.ceil(F.log(16.0, F.col("g") / group_rows) - 1e-9)
    groups = groups.select(_cell(keys, None), "start", "g", "n", F.when(F.col("g") > group_rows, F.greatest(pieces, F.lit(1))).otherwise(0).cast("int").alias("__digits"))
    d = rows.withColumn("__cell", _cell(keys, None)).join(groups, "__cell").drop("__cell").withColumn("__h", stable_hash("row", "id"))
    d = d.withColumn("__bucket", F.expr("substring(__h, 1, __digits)"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy("__h", "id")
    d = d.withColumn("r", F.row_number().over(inside))
    if not groups.filter("__digits > 0").isEmpty():
        sizes = d.filter("__digits > 0").groupBy(*keys, "__bucket").agg(F.max("r").alias("__n"))
        w = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select(_cell(keys, "__bucket"), F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
        d = d.withColumn("__cell", _cell(keys, "__bucket")).join(offsets, "__cell", "left")
        d = d.withColumn("r", F.col("r") + F.coalesce("__before", F.lit(0)))
    return d.select(fold, "id", F.col("r").cast("long").alias("r"), "start", "g", "n")


def epoch_pairs(functions: DataFrame, epochs: int = 25, fold: str = "fold", sides: str = "both") -> DataFrame:
    """``fold, epoch, id_a, id_b, y`` with one similar (+1) and one dissimilar (-1) partner per function and epoch.

    The partner is drawn by position: a similar one among the other rows of the own
    group, a dissimilar one among all rows outside of it, both uniform and in one
    draw. Each draw is one equi-join on a unique position; no pairs are listed first.
    Functions lacking either partner are left out of both sides, unless only one side is asked for.
    """
    pos = cut(_positions(functions, fold))
    at = pos.select(fold, (F.col("start") + F.col("r") - 1).alias("at"), F.col("id").alias("id_b"))
    draws = pos.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    h_pos = hash_int(F.md5(F.concat_ws(":", F.lit("+"), F.col("epoch").cast("string"), F.col("id").cast("string"))))
    h_neg = hash_int(F.md5(F.concat_ws(":", F.lit("-"), F.col("epoch").cast("string"), F.col("id").cast("string"))))
    similar = F.when(F.col("g") > 1, F.col("start") + F.pmod(F.col("r") + F.pmod(h_pos, F.greatest(F.col("g") - 1, F.lit(1))), F.col("g")))
    other = F.pmod(h_neg, F.greatest(F.col("n") - F.col("g"), F.lit(1)))
    dissimilar = F.when(F.col("n") > F.col("g"), F.when(other < F.col("start"), other).otherwise(other + F.col("g")))
    wanted = {"both": [(1, similar), (-1, dissimilar)], "positive": [(1, similar)], "negative": [(-1, dissimilar)]}[sides]
    d = draws.withColumn("__ok", F.lit(True))
    for _, place in wanted:
        d = d.withColumn("__ok", F.col("__ok") & place.isNotNull())
    long = d.filter("__ok").select(
        fold, "epoch", F.col("id").alias("id_a"),
        F.inline(F.array(*[F.struct(F.lit(y).alias("y"), place.alias("at")) for y, place in wanted])),
    )
    return long.join(at, [fold, "at"]).select(fold, "epoch", "id_a", "id_b", "y")


def positive_pairs(functions: DataFrame, epochs: int = 1, fold: str = "fold") -> DataFrame:
    return epoch_pairs(functions, epochs, fold, "positive")


def negative_pairs(functions: DataFrame, epochs: int = 1, fold: str = "fold") -> DataFrame:
    return epoch_pairs(functions, epochs, fold, "negative")


def batches(pairs: DataFrame, size: int, fold: str = "fold") -> DataFrame:
    """Batch numbers per fold and epoch; a batch takes ``size / 2`` functions with both of their pairs.

    All pairs of a function are in one md5 bucket, where a dense rank numbers the functions; the highest rank of a bucket is its number of
    functions, so the pairs are made and shuffled once.
    """
    keys = [fold, "epoch", "__bucket"]
    d = pairs.withColumn("__h", stable_hash("batch", "epoch", "id_a")).withColumn("__bucket", F.substring("__h", 1, HASH_DIGITS))
    inside = Window.partitionBy(*keys).orderBy("__h", "id_a")
    ranked = cut(d.withColumn("__rn", F.dense_rank().over(inside)).drop("__h"))
    sizes = ranked.groupBy(*keys).agg(F.max("__rn").alias("__n"))
    before = Window.partitionBy(fold, "epoch").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(_cell(keys, None), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    number = F.floor((F.col("__before") + F.col("__rn") - 1) / (size // 2))
    placed = ranked.withColumn("__cell", _cell(keys, None)).join(offsets, "__cell").withColumn("batch", number)
    return placed.select(fold, "epoch", "id_a", *[c for c in pairs.columns if c not in (fold, "epoch", "id_a")], "batch")
