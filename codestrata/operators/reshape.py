"""Flattening, look-ups, vocabularies, path contexts, call inlining."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions import text as X
from codestrata.functions.arrays import pad_post, pad_pre
from codestrata.scale import SMALL_ROWS, first_per_key, look_up, meet_spread, range_running, salted_join, spread_heavy
from codestrata.session import cut

DOCS = 2000  # whose tokens a task encodes at a time

# ---- predicates over rows -----------------------------------------------------------------------


def filter_relevant(df: DataFrame) -> DataFrame:
    """Problems with solutions that are not from an April Fools contest."""
    joke = F.coalesce(F.contains(F.col("contest_name"), F.lit("April Fools")), F.lit(False))
    return df.filter((F.size("solutions") > 0) & ~joke)


def filter_size(df: DataFrame, max_lines: int = 100000, col: str = "code") -> DataFrame:
    return df.filter(X.within_line_limit(F.col(col), max_lines))


def clean_code(df: DataFrame, col: str = "code", max_lines: int = 100000) -> DataFrame:
    """The whole cleaning chain as one projection; the original stays in ``raw``, rows left empty are dropped."""
    c = X.compact_lines(X.drop_includes(X.strip_digit_separators(X.ascii_only(F.col(col)))))
    return filter_size(df, max_lines, col).withColumn("raw", F.col(col)).withColumn(col, c).filter(F.col(col) != "")


def require(df: DataFrame, cols: list[str], strict: bool = False) -> DataFrame:
    """Rows that have every feature; with ``strict`` a missing feature fails the job instead."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"features not computed: {missing}")
    if strict:
        for c in cols:
            df = df.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} not computed"))).otherwise(F.col(c)))
        return df
    # made by a generator, so that features are not worked out twice, for the filter and for the result
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns])))).dropna(subset=cols)


def flatten(df: DataFrame, inherit: list[str] = ("tags",)) -> DataFrame:
    """One row per solution with the columns of its problem."""
    return df.select(F.explode("solutions").alias("__s"), *inherit).select("__s.*", *inherit)


def with_problem(df: DataFrame, label: str = "label") -> DataFrame:
    return df.withColumn("problem", F.split_part(label, F.lit("$"), F.lit(1)))


def remove_spans(files: DataFrame, findings: DataFrame, key: str = "file", col: str = "code") -> DataFrame:
    """Delete, per finding (file, 1-based line), the lines up to where the braces close again.

    The start lines of a file join its row once; the work stays inside the row, and
    files without findings pass through untouched.
    """
    starts = findings.groupBy(key).agg(F.collect_set(F.col("line").cast("int")).alias("__starts"))
    cut_out = F.when(F.col("__starts").isNull(), F.col(col)).otherwise(X.remove_spans(F.col(col), F.col("__starts")))
    return files.join(starts, key, "left").withColumn(col, cut_out).select(*files.columns)


# ---- views --------------------------------------------------------------------------------------


def align_views(views: dict[str, DataFrame]) -> DataFrame:
    """Solutions present in every view with one vector per view: ``x0, x1, ...``.

    The first ``w2v`` or ``tfidf`` view becomes the anchor that gives label and order.
    """
    names = list(views)
    for i, n in enumerate(names):
        if n in ("w2v", "tfidf"):
            names[0], names[i] = names[i], names[0]
            break
    out = None
    for i, n in enumerate(names):
        one = first_per_key(views[n].select("problem", "index", "label", "x"), ["problem", "index"], ["label"])
        if out is None:
            out = one.withColumnRenamed("x", "x0")
        else:
            out = out.join(one.select("problem", "index", F.col("x").alias(f"x{i}")), ["problem", "index"])
    return out


def lookup_vectors(tokens: DataFrame, vocab: DataFrame, key: str, col: str = "tokens") -> DataFrame:
    """(key, pos, vec) for known tokens; unknown tokens drop out. Hot tokens are salted by document."""
    long = tokens.select(key, F.posexplode(col).alias("pos", "token"))
    return look_up(long, vocab.select("token", "vec"), ["token"], spread=[key, "pos"]).select(key, "pos", "vec")


def encode_tokens(df: DataFrame, vocab: DataFrame, key: str, col: str = "tokens") -> DataFrame:
    """Token ids per document; unknown tokens get id V and are shown as ``[token]``.

    A vocabulary of at most SMALL_ROWS tokens, each with one id, goes to every task, and documents are encoded where they are. Only those whose key
    repeats are shuffled, as all are with another vocabulary.
    """
    known = cut(vocab.select("token", F.col("id").cast("long").alias("id")))
    size = known.count()
    rows = df.select(key, F.col(col).alias("tokens"))
    if size > SMALL_ROWS or known.select("token").distinct().count() < size:
        return _encoded_by_join(rows, known, key, size)
    held = known.where("token IS NOT NULL AND id IS NOT NULL").toArrow()
    sent = df.sparkSession.sparkContext.broadcast((held["token"].combine_chunks(), held["id"].combine_chunks()))

    def encode(batches):
        tokens, ids = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                lists = batch.column("tokens").slice(at, DOCS)
                flat = lists.flatten()
                found = pc.index_in(flat, value_set=tokens)
                unknown = pc.binary_join_element_wise(pa.scalar("["), flat, pa.scalar("]"), pa.scalar(""))
                ends = pa.array(np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))), pa.int32())
                made = pc.fill_null(ids.take(found), pa.scalar(size, ids.type)), pc.if_else(pc.is_valid(found), flat, unknown)
                yield pa.record_batch({key: batch.column(key).slice(at, DOCS)} | {c: pa.ListArray.from_arrays(ends, x) for c, x in zip(("ids", "shown"), made)})

    rows = rows.where(F.size("tokens") > 0)
    again = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col(key).alias("__again")))
    schema = f"`{key}` {dict(rows.dtypes)[key]}, ids array<long>, shown array<string>"
    if again.isEmpty():
        return rows.mapInArrow(encode, schema)
    same = rows[key].eqNullSafe(again["__again"])
    return rows.join(again, same, "left_anti").mapInArrow(encode, schema).unionByName(_encoded_by_join(rows.join(again, same, "left_semi"), known, key, size))


def _encoded_by_join(rows: DataFrame, vocab: DataFrame, key: str, size: int) -> DataFrame:
    """As ``encode_tokens`` from (key, tokens), token by token; the tokens of a repeated key go by their positions."""
    long = rows.select(key, F.posexplode("tokens").alias("pos", "token"))
    hit = look_up(long, vocab, ["token"], "left", spread=[key, "pos"])
    one = F.struct(
        "pos",
        F.coalesce("id", F.lit(size).cast("long")).alias("id"),
        F.when(F.col("id").isNull(), F.concat(F.lit("["), F.col("token"), F.lit("]"))).otherwise(F.col("token")).alias("shown"),
    )
    seq = hit.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("s"))
    return seq.select(key, F.transform("s", lambda s: s["id"]).alias("ids"), F.transform("s", lambda s: s["shown"]).alias("shown"))


def special_vectors(vocab: DataFrame) -> DataFrame:
    """The vocabulary matrix plus the unknown row (id V, mean of all) and the padding row (id V+1, zeros)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    stats = vocab.agg(
        F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.mean(array_to_vector(F.transform("vec", lambda x: x.cast("double"))))).alias("m")
    )
    extra = stats.select(
        F.inline(
            F.array(
                F.struct(F.lit("[UNK]").alias("token"), F.col("n").alias("id"), F.col("m").alias("vec")),
                F.struct(
                    F.lit("[PAD]").alias("token"), (F.col("n") + 1).alias("id"), F.transform("m", lambda x: F.lit(0.0)).alias("vec")
                ),
            )
        )
    )
    return vocab.select("token", "id", F.transform("vec", lambda x: x.cast("double")).alias("vec")).unionByName(extra)


def encode_instructions(df: DataFrame, vocab: DataFrame, key: str, col: str = "instr") -> DataFrame:
    """Instruction ids shifted by one; unknown instructions get the id of their architecture's unknown token."""
    long = df.select(key, F.posexplode(col).alias("pos", "token"))
    hit = salted_join(long, vocab.select("token", "id"), ["token"], "left", spread=[key, "pos"])
    x_unk = vocab.filter(F.col("token") == "X_UNK").select("id").scalar()
    a_unk = vocab.filter(F.col("token") == "A_UNK").select("id").scalar()
    unk = F.when(F.contains("token", F.lit("X_")), x_unk).when(F.contains("token", F.lit("A_")), a_unk).otherwise(x_unk)
    one = F.struct("pos", (F.coalesce("id", unk) + 1).alias("id"))
    seq = hit.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("s"))
    return seq.select(key, F.transform("s", lambda s: s["id"]).alias("ids"))


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been processed yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def labelled_embeddings(functions: DataFrame, emb: DataFrame) -> DataFrame:
    """Functions that have a vector, with their two label forms."""
    return functions.join(emb, "id").select(
        "id",
        F.concat_ws("/", "project", "file_name", "function_name").alias("label"),
        F.concat(
            F.col("function_name"), F.lit("@"), F.concat_ws("/", "project", "compiler", "optimization", "file_name")
        ).alias("full_label"),
        *[c for c in emb.columns if c != "id"],
    )


def query_vectors(ids: DataFrame, emb: DataFrame, mean: bool = False) -> DataFrame:
    """Vectors of the wanted ids, or their mean as a single query."""
    hit = emb.join(ids.select("id").distinct(), "id", "left_semi")
    if not mean:
        return hit
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return hit.agg(vector_to_array(Summarizer.mean(array_to_vector(F.transform("x", lambda v: v.cast("double"))))).alias("x"))


# ---- vocabularies and path contexts --------------------------------------------------------------


def build_vocab(tokens: DataFrame, min_count: int = 1, col: str = "token") -> DataFrame:
    """Distinct tokens with ids by falling count, ties by token."""
    counts = tokens.groupBy(F.col(col).alias("token")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)
    one = counts.withColumn("__one", F.lit(1).cast("long"))
    return range_running(one, [], [F.col("n").desc(), F.col("token")], {"id": "__one"}).select("token", "n", "id")


def match_vocab(fold_types: DataFrame, train_types: DataFrame, fold_paths: DataFrame, train_paths: DataFrame) -> DataFrame:
    """Fold path id -> train path id for paths whose node types all exist in train and whose translation does too."""
    t = match_by_text(fold_types, train_types, "node_type")
    long = fold_paths.select("id", F.posexplode(F.split(F.trim("path"), r"\s+")).alias("pos", "fold_id"))
    hit = salted_join(long, t.withColumn("fold_id", F.col("fold_id").cast("string")), ["fold_id"], "left", spread=["id", "pos"])
    translated = (
        hit.groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", F.col("train_id").cast("string").alias("v")))).alias("s"), F.count_if(F.col("train_id").isNull()).alias("missing"))
        .filter(F.col("missing") == 0)
        .select(F.col("id").alias("fold_id"), F.array_join(F.transform("s", lambda s: s["v"]), " ").alias("path"))
    )
    return translated.join(train_paths.select("path", F.col("id").alias("train_id")), "path").select("fold_id", "train_id")


def match_by_text(fold: DataFrame, train: DataFrame, field: str) -> DataFrame:
    """Ids of equal entries in two vocabularies."""
    return fold.select(field, F.col("id").alias("fold_id")).join(train.select(field, F.col("id").alias("train_id")), field).select("fold_id", "train_id")


def parse_contexts(df: DataFrame, key: str = "key", col: str = "values") -> DataFrame:
    """``"s,p,e"`` strings to structs, cut at the first malformed entry."""
    parts = F.transform(F.col(col), lambda v: F.split(v, ","))
    bad = F.array_position(F.transform(parts, lambda p: F.size(p) != 3), F.lit(True)).cast("int")
    good = F.when(bad > 0, F.slice(parts, F.lit(1), bad - 1)).otherwise(parts)
    return df.select(
        key,
        F.transform(
            good,
            lambda p: F.struct(
                F.get(p, F.lit(0)).alias("start"), F.get(p, F.lit(1)).alias("path_index"), F.get(p, F.lit(2)).alias("end")
            ),
        ).alias("contexts"),
    )


def translate_contexts(contexts: DataFrame, tokens: DataFrame, paths: DataFrame, key: str = "key") -> DataFrame:
    """Contexts in train ids, -1 where train knows nothing."""
    long = contexts.select(key, F.posexplode("contexts").alias("pos", "c")).select(key, "pos", "c.*")

    def mapped(df: DataFrame, table: DataFrame, col: str) -> DataFrame:
        t = table.select(F.col("fold_id").cast("string").alias(col), F.col("train_id").cast("long").alias(f"t_{col}"))
        return salted_join(df, t, [col], "left", spread=[key, "pos"])

    long = mapped(mapped(mapped(long, tokens, "start"), tokens, "end"), paths, "path_index")
    one = F.struct(
        "pos",
        F.coalesce("t_start", F.lit(-1)).alias("start"),
        F.coalesce("t_path_index", F.lit(-1)).alias("path_index"),
        F.coalesce("t_end", F.lit(-1)).alias("end"),
    )
    return long.groupBy(key).agg(
        F.transform(
            F.sort_array(F.collect_list(one)),
            lambda s: F.struct(s["start"].alias("start"), s["path_index"].alias("path_index"), s["end"].alias("end")),
        ).alias("contexts")
    )


def attach_contexts(samples: DataFrame, contexts: DataFrame, path_col: str = "path") -> DataFrame:
    """Samples joined with the contexts of the file that carries their index as base name; empty ones drop out."""
    stem = F.regexp_replace(F.element_at(F.split(F.col(path_col), r"[/\\]"), -1), r"\.[^.]*$", "")
    ctx = contexts.withColumn("index", stem).filter(F.size("contexts") > 0).drop(path_col)
    return samples.join(ctx, "index")


def context_failures(samples: DataFrame, attached: DataFrame) -> DataFrame:
    """Samples per fold that found no context."""
    return samples.join(attached.select("index"), "index", "left_anti").groupBy("fold").agg(F.count(F.lit(1)).alias("failures"))


def encode_contexts(df: DataFrame, token_size: int | Column, path_size: int | Column, n: int, keep: list[str]) -> DataFrame:
    """Three left-padded id arrays; -1 becomes the size of its vocabulary."""

    def ids(field: str, size) -> Column:
        size = size if isinstance(size, Column) else F.lit(size)
        raw = F.transform("contexts", lambda c: F.when(c[field] == -1, size.cast("long")).otherwise(c[field].cast("long")))
        return pad_pre(raw, n, 0)

    return df.select(*keep, ids("start", token_size).alias("start"), ids("path_index", path_size).alias("path"), ids("end", token_size).alias("end"))


# ---- instructions -------------------------------------------------------------------------------


def inline_calls(instr: DataFrame, calls: DataFrame, depth: int = 0) -> DataFrame:
    """Instruction lists with callees spliced in after their call sites, ``depth`` levels deep.

    ``instr(function_id, pos, token)``, ``calls(function_id, pos, callee)``. Every level is
    one equi-join; the splice position is carried as an array that sorts in reading order.
    """
    out = instr.select(F.col("function_id").alias("root"), "function_id", "pos", "token", F.array(F.col("pos").cast("long")).alias("path"))
    level = out
    for _ in range(depth):
        sites = level.join(calls, ["function_id", "pos"]).select("root", "path", F.col("callee").alias("function_id"))
        level = sites.join(instr, "function_id").select(
            "root", "function_id", "pos", "token", F.concat("path", F.array(F.col("pos").cast("long"))).alias("path")
        )
        out = out.unionByName(level)
    return out.select(F.col("root").alias("function_id"), "path", "token")


def inlined_bodies(instr: DataFrame, calls: DataFrame, depth: int = 1, max_length: int | None = None, per_task: int = 100_000) -> DataFrame:
    """(function_id, body): token lists of all functions with the bodies of callees spliced in, ``depth`` levels deep.

    ``instr(function_id, pos, token)``, ``calls(function_id, pos, callee)``. The body of depth d of a function is its tokens in
    order of ``pos``, each followed by the bodies of depth d - 1 of its callees; every body of a depth is built once, however
    many functions call it, and recursion ends with the depth. Bodies grow with what they call: ``max_length`` keeps the
    first tokens of every body, which are also the first of the whole one, so that no list of any level is longer.

    Null functions have no body; null tokens stay; a null position sorts first and calls nothing. Several callees of one
    position follow each other in order of their ids, a repeated call is spliced once more, and tokens of one position
    are sorted. Calls without an instruction at their position, and callees without a body, add nothing. A callee that
    more than ``per_task`` sites call is met in as many tasks as that takes.
    """
    at = F.col("pos").cast("long").alias("pos")
    rows = instr.where("function_id IS NOT NULL").select("function_id", at, F.lit(0).alias("kind"), F.array("token").alias("piece"))
    known = rows.select("function_id", "pos").distinct()
    sites = cut(calls.select("function_id", at, "callee").join(known, ["function_id", "pos"], "left_semi"))
    sites, heavy = spread_heavy(sites, ["callee"], ["function_id", "pos"], per_task)
    sites = cut(sites)

    def joined(pieces: DataFrame) -> DataFrame:
        parts = F.sort_array(F.collect_list(F.struct("pos", "kind", "callee", "piece")))
        body = F.flatten(F.transform(parts, lambda p: p["piece"]))
        return pieces.groupBy("function_id").agg((body if max_length is None else F.slice(body, 1, max_length)).alias("body"))

    rows = rows.withColumn("callee", F.lit(None).cast(sites.schema["callee"].dataType))
    bodies = plain = cut(joined(rows))
    callers = sites.select("function_id").distinct()
    unchanged = plain.join(callers, "function_id", "left_anti")
    open_rows = cut(rows.join(callers, "function_id", "left_semi"))
    for _ in range(depth):
        met = meet_spread(sites, heavy, bodies.select(F.col("function_id").alias("callee"), F.col("body").alias("piece")), ["callee"])
        pieces = open_rows.unionByName(met.select("function_id", "pos", F.lit(1).alias("kind"), "callee", "piece"))
        bodies = cut(joined(pieces).unionByName(unchanged))
    return bodies


def linearize(blocks: DataFrame, features: DataFrame) -> DataFrame:
    """Blocks ``(id, addr, asm)`` and features ``(id, addr, features)`` to one body per function in address order."""
    both = blocks.join(features, ["id", "addr"])
    s = F.sort_array(F.collect_list(F.struct("addr", "asm", "features")))
    return both.groupBy("id").agg(s.alias("s")).select(
        "id",
        F.array_join(F.transform("s", lambda b: F.coalesce(b["asm"], F.lit(""))), "").alias("asm"),
        F.flatten(F.transform("s", lambda b: b["features"])).alias("instr"),
    )


def materialize_pairs(pairs: DataFrame, instr: DataFrame, n: int = 150) -> DataFrame:
    """Padded instruction lists of both sides of a pair; padded before the join so every row has a fixed size.

    A function in very many pairs meets them in as many tasks as its counted pairs need. Pairs with a null or unknown id drop out.
    """
    ids, length = pad_post(F.col("instr"), n)
    padded = instr.select("id", ids.alias("f"), length.alias("len"))
    a = padded.select(F.col("id").alias("id_a"), F.col("f").alias("f_a"), F.col("len").alias("len_a"))
    b = padded.select(F.col("id").alias("id_b"), F.col("f").alias("f_b"), F.col("len").alias("len_b"))
    with_a = meet_spread(*spread_heavy(pairs, ["id_a"], ["id_b"]), a, ["id_a"])
    return meet_spread(*spread_heavy(with_a, ["id_b"], ["id_a"]), b, ["id_b"]).select("id_a", "id_b", *[c for c in pairs.columns if c not in ("id_a", "id_b")], "f_a", "len_a", "f_b", "len_b")
