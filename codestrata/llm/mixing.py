"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

The corpus is a tree: domain, language, source. A token budget flows from the root down. At every node it is
divided among the children by weight; a child that cannot use its share (all its tokens, for the
allowed number of epochs) keeps what it can, and the rest goes to its siblings by weight again. Only what all children of a
node together cannot use stays with the node's own siblings, since a node never receives more than its subtree
can use. Every leaf fills its quota with whole epochs and a prefix of one more, in a seeded order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.common import unpacked, whole_row
from codestrata.scale import hash_running_sum
from codestrata.session import cut

SEED = 42
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words between ASCII blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _weight(weights: Mapping[str, int], name: Column) -> Column:
    out = F.lit(1).cast("long")
    for key, w in sorted(weights.items()):
        out = F.when(name == key, F.lit(int(w)).cast("long")).otherwise(out)
    return out


def path_name(c: Column) -> Column:
    """A path part that is never null: null is a child of its own."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def divide(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """``nodes`` (parent..., name, cap, weight, budget) plus ``quota``: the parent's ``budget`` divided among its children.

    Children are filled in the order of cap per weight; one is full if its cap is at most its share of what is left. The
    others share the rest by weight, rounded down, and the tokens lost in rounding go one by one to the first of them. All
    in whole numbers. A window holds the children of one node, which are rows of the tree and not documents.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), name)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(*parent)
    big = lambda c: c.cast("decimal(38,0)")
    left = F.col("budget") - (F.sum("cap").over(upto) - F.col("cap"))
    d = nodes.withColumn("__over", (big(F.col("cap")) * big(F.sum("weight").over(rest)) > big(F.col("weight")) * big(left)).cast("int"))
    d = d.withColumn("__open", F.max("__over").over(upto))  # 1 from the first child that is not full
    d = d.withColumn("__left", F.col("budget") - F.sum(F.when(F.col("__open") == 0, F.col("cap")).otherwise(0)).over(every))
    d = d.withColumn("__weights", F.sum(F.when(F.col("__open") == 1, F.col("weight")).otherwise(0)).over(every))
    share = F.expr("cast((cast(weight as decimal(20,0)) * cast(__left as decimal(18,0))) div __weights as long)")
    d = d.withColumn("__share", F.when(F.col("__open") == 1, share).otherwise(F.col("cap")))
    d = d.withColumn("__lost", F.col("__left") - F.sum(F.when(F.col("__open") == 1, F.col("__share")).otherwise(0)).over(every))
    d = d.withColumn("__turn", F.sum("__open").over(upto))
    extra = F.when((F.col("__open") == 1) & (F.col("__turn") <= F.col("__lost")), 1).otherwise(0)
    return d.withColumn("quota", (F.col("__share") + extra).cast("long")).drop("__over", "__open", "__left", "__weights", "__share", "__lost", "__turn")


def leaf_quotas(leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], levels: Sequence[str], share: tuple[int, int], max_epochs: int) -> DataFrame:
    """``quota`` per leaf of ``leaves`` (root, levels..., available); the levels are names as ``path_name`` makes them."""
    leaves = leaves.withColumn("cap", F.col("available") * max_epochs)
    total = leaves.groupBy("root").agg(F.sum("available").alias("all"), F.sum("cap").alias("cap"))
    above = total.select("root", F.least(F.expr(f"all * {int(share[0])} div {int(share[1])}"), "cap").alias("budget"))
    parent = ["root"]
    for level in levels:
        path = [*parent, level]
        own = {f"={k}": v for k, v in weights.get(level, {}).items()}
        nodes = leaves.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(own, F.col(level)))
        above = divide(nodes.join(above, parent), parent, level).select(*path, F.col("quota").alias("budget"))
        parent = path
    return leaves.join(above.withColumnRenamed("budget", "quota"), parent).drop("cap")


def mix(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[str, Mapping[str, int]],
    share: tuple[int, int] = (1, 2),
    max_epochs: int = 1,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """What each document gives to the mix: ``id``, ``mark`` (a hash of the text), ``tokens``, ``epochs`` (how often
    it is taken whole) and ``prefix`` (tokens taken from its start in the last, partial epoch); ``leaf`` and ``turn`` name its leaf and place the
    document in the leaf's seeded order.

    ``levels`` names the levels of the tree from the top with their columns; ``weights`` has whole weights of nodes
    by level and name, 1 where not named; ``share`` is the budget as a fraction of all tokens. The sum of
    ``tokens * epochs + prefix`` over a leaf is its quota exactly. Documents come in the order of md5(seed, epoch,
    id), where epoch is the number of whole passes before. Null levels are nodes of their own; null and empty texts have
    no tokens and are never taken. Repeated rows are documents of their own, in any order among
    themselves. No rows give no rows.
    """
    names = list(levels)
    if {"root", "id", "mark", "tokens", "available", "quota", "turn"} & set(names):
        raise ValueError("a level needs another name")
    text = F.col(f"`{text_col}`")
    # the written table is narrow: no text takes part in what follows
    rows = cut(
        docs.select(
            F.lit(0).alias("root"),
            F.col(f"`{id_col}`").cast("long").alias("id"),
            F.xxhash64(text).alias("mark"),
            word_count(text).alias("tokens"),
            *[path_name(c).alias(n) for n, c in levels.items()],
        )
    )
    path = ["root", *names]
    leaves = rows.groupBy(*path).agg(F.sum("tokens").alias("available"))
    quotas = leaf_quotas(leaves, weights, names, share, max_epochs)
    quotas = quotas.withColumn("whole", F.when(F.col("available") > 0, F.expr("quota div available")).otherwise(F.lit(0)).cast("long"))
    quotas = cut(quotas.withColumn("rest", F.col("quota") - F.col("whole") * F.col("available")))
    turn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    d = hash_running_sum(rows.join(quotas, path).withColumn("turn", turn), path, "turn", ["id", "mark"], "tokens", "before")
    prefix = F.greatest(F.lit(0), F.least(F.col("tokens"), F.col("rest") - F.col("before"))).cast("long")
    epochs = F.when(F.col("tokens") > 0, F.col("whole")).otherwise(F.lit(0)).cast("long")
    leaf = F.to_json(F.struct(*path[1:])).alias("leaf")
    return d.select("id", "mark", "tokens", epochs.alias("epochs"), prefix.alias("prefix"), leaf, "turn")


def taken(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that fill what ``mix`` takes, whole texts only, each at most as often as it is in ``docs``.

    Documents that the mix takes whole at least once stay. Where a leaf's prefix ends inside a document, that document does not fit; what
    the leaf is then short of goes to its later documents in the seeded order, to each that fits into what is left. This repeats until no document
    of the leaf fits, so a very long text never uses up the quota of those behind it, and a leaf ends short by less than its
    shortest document that was left out. Nothing is taken beyond a quota. Ties of order go by id and hash of the text; repeated rows share a place
    in the order and are taken together or not; a null id is an id of its own; documents without tokens are never taken; no rows give no rows.
    ``mixed`` is what ``mix`` returns.
    """
    rows = mixed.select("leaf", "id", "mark", "turn", "tokens", "epochs", "prefix").where("tokens > 0")
    whole = (F.col("epochs") > 0) | (F.col("prefix") == F.col("tokens"))
    # repeated rows as one, with the tokens of all
    rows = rows.groupBy("leaf", "id", "mark", "turn").agg(F.sum("tokens").alias("tokens"), F.min(whole.cast("int")).alias("whole"), F.sum(F.when(F.col("epochs") > 0, 0).otherwise(F.col("prefix"))).alias("prefix"))
    rows = cut(rows)
    short = rows.groupBy("leaf").agg(F.sum(F.when(F.col("whole") == 0, F.col("prefix")).otherwise(0)).alias("short"))
    stay = rows.where("whole = 1").select("id", "mark")
    rest = rows.where("whole = 0").select("leaf", "id", "mark", "turn", "tokens")
    while True:
        # documents longer than what is left can never fit; of the others the run that fits from the first on is taken
        rest = rest.join(short.where("short > 0"), "leaf").where("tokens <= short")
        rest = hash_running_sum(rest, ["leaf"], "turn", ["id", "mark"], "tokens", "before")
        rest = cut(rest.withColumn("fits", F.col("before") + F.col("tokens") <= F.col("short")))
        if rest.isEmpty():
            break
        used = rest.where("fits").groupBy("leaf").agg(F.sum("tokens").alias("used"))
        short = cut(short.join(used, "leaf").select("leaf", (F.col("short") - F.col("used")).alias("short")))
        stay = stay.unionByName(rest.where("fits").select("id", "mark"))
        rest = rest.where("not fits").select("leaf", "id", "mark", "turn", "tokens")
    stay = stay.select(F.col("id").alias("stay_id"), F.col("mark").alias("stay_mark")).distinct()
    keyed = docs.select(whole_row(docs), F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("mark"))
    met = keyed.join(stay, keyed["id"].eqNullSafe(stay["stay_id"]) & (keyed["mark"] == stay["stay_mark"]), "left_semi")
    return unpacked(met, "row", docs.columns, {})
