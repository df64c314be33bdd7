"""Shuffles, splits, samples and pair tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.catalog import fixtures as fx
from codestrata.catalog.registry import Tables, query
from codestrata.catalog.texts import BODY, bodies
from codestrata.operators import reshape as R
from codestrata.operators import split as P


@query("shuffle", "SELECT o_orderkey AS id, row_number() OVER (ORDER BY md5(concat('42:', o_orderkey)), o_orderkey) AS pos FROM orders")
def _(t: Tables) -> DataFrame:
    return P.shuffle(t.orders.select(F.col("o_orderkey").alias("id")), "id")


def _stratified(relation: str, p: float = 0.15) -> str:
    return f"""counts AS (SELECT list(n ORDER BY pos) AS c FROM (SELECT pos, sum(Y[pos]) AS n FROM {relation}, (SELECT unnest([1,2,3,4,5]) AS pos) GROUP BY pos)),
    sets AS (SELECT *, array_to_string(Y, '') AS s, count(*) OVER (PARTITION BY array_to_string(Y, '')) AS n FROM {relation}),
    strata AS (
      SELECT *, CASE WHEN n >= 7 THEN s ELSE concat('rare:', (SELECT arg_min(pos, c[pos] * 10 + pos) - 1 FROM counts, (SELECT unnest([1,2,3,4,5]) AS pos) WHERE Y[pos] = 1)) END AS stratum FROM sets),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat('42:', index)), index) AS rn, count(*) OVER (PARTITION BY stratum) AS size FROM strata),
    quota AS (SELECT *, floor(size * {p} + 0.5) AS n_test FROM ranked),
    split AS (SELECT *, CASE WHEN rn <= n_test THEN 'test' WHEN rn <= n_test + floor((size - n_test) * ({p} / (1 - {p})) + 0.5) THEN 'dev' ELSE 'train' END AS fold FROM quota)"""


@query(
    "stratified_split",
    f"WITH {fx.LABEL_ROWS}, labelled AS (SELECT * FROM label_rows WHERE list_sum(Y) > 0), {_stratified('labelled')} SELECT index, fold FROM split",
)
def _(t: Tables) -> DataFrame:
    rows = P.split_labelled(fx.label_rows(t).drop("Y"), fx.LABELS).filter(F.col("fold").isNull())
    return P.stratified_split(rows, "index").select("index", "fold")


@query(
    "stratified_pairs_split",
    f"""WITH {fx.LABEL_ROWS}, spots AS (SELECT unnest([1,2,3,4,5]) AS i), shares AS (SELECT unnest(['test', 'dev', 'train']) AS fold, unnest([0.15::double, 0.15::double, 0.7::double]) AS share),
    pairs AS (SELECT concat(a.i, ':', b.i) AS pair, count(*) AS n FROM label_rows, spots a, spots b WHERE a.i <= b.i AND Y[a.i] = 1 AND Y[b.i] = 1 GROUP BY ALL
      UNION ALL SELECT 'none', count(*) FROM label_rows WHERE list_sum(Y) = 0 HAVING count(*) > 0)
    SELECT pair, fold, n, round(n * share, 2) AS wanted, true AS close FROM pairs, shares""",
)
def _(t: Tables) -> DataFrame:
    """How many rows of every label and label pair each fold should hold, and whether it does to within one row."""
    got = P.stratified_pairs_split(fx.label_rows(t), "index")
    at = lambda i: F.get("Y", F.lit(i - 1)) == 1
    held = [F.when(at(a) & at(b), f"{a}:{b}") for a in range(1, 6) for b in range(a, 6)]
    pairs = F.array_compact(F.array(*held, F.when(~F.array_contains("Y", 1), "none")))
    per = got.select(F.explode(pairs).alias("pair"), "fold").groupBy("pair").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("fold") == f).alias(f) for f in ("test", "dev", "train")]
    )
    rows = per.select("pair", "n", F.inline(F.array(*[F.struct(F.lit(f).alias("fold"), F.lit(s).alias("share"), F.col(f).alias("got")) for f, s in (("test", 0.15), ("dev", 0.15), ("train", 0.7))])))
    wanted = F.col("n") * F.col("share")
    return rows.select("pair", "fold", "n", F.round(wanted, 2).alias("wanted"), (F.abs(F.col("got") - wanted) <= 1).alias("close"))


@query(
    "stratified_by_difficulty",
    f"""WITH {fx.LABEL_ROWS}, d AS (SELECT *, CASE WHEN index % 10 = 0 THEN NULL ELSE n_chars END AS difficulty FROM label_rows WHERE list_sum(Y) > 0),
    rated AS (SELECT * FROM d WHERE difficulty IS NOT NULL), {_stratified('rated')}
    SELECT index, CASE WHEN difficulty <= 1500 THEN 'Easy' WHEN difficulty < 2500 THEN 'Medium' ELSE 'Hard' END AS difficulty_class, fold FROM split
    UNION ALL SELECT index, 'Various', 'train' FROM d WHERE difficulty IS NULL""",
)
def _(t: Tables) -> DataFrame:
    rows = P.split_labelled(fx.label_rows(t).drop("Y"), fx.LABELS).filter(F.col("fold").isNull()).drop("fold")
    rows = rows.withColumn("difficulty", F.when(F.col("index") % 10 != 0, F.col("n_chars")))
    return P.stratified_by_difficulty(rows, "index").select("index", "difficulty_class", "fold")


@query(
    "make_folds",
    f"""WITH {fx.LABEL_ROWS}, labelled AS (SELECT * FROM label_rows WHERE list_sum(Y) > 0), {_stratified('labelled')},
    folds AS (SELECT index, fold FROM split UNION ALL SELECT index, 'unlabeled' FROM label_rows WHERE list_sum(Y) = 0),
    lines AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS code, generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: x <> ''), 1) - 1 AS i FROM documents)
    SELECT doc_id AS problem, concat(doc_id, '-', i) AS index, fold, md5(code) AS digest FROM lines JOIN folds ON doc_id = index""",
)
def _(t: Tables) -> DataFrame:
    got = P.make_folds(fx.problems(t).drop("Y"), fx.LABELS)
    return got.select("problem", "index", "fold", F.md5("code").alias("digest"))


@query(
    "grouped_split",
    f"""WITH {fx.FUNCTIONS}, files AS (SELECT project, file_name, count(*) AS n FROM functions GROUP BY ALL),
    run AS (SELECT *, sum(n) OVER (ORDER BY md5(concat('12345:', project, ':', file_name)), project, file_name) - n AS before, sum(n) OVER () AS total FROM files),
    test AS (SELECT coalesce(sum(n), 0) AS n FROM run WHERE before < floor(total * 0.2)),
    fold AS (SELECT project, file_name, CASE WHEN before < floor(total * 0.2) THEN 'test' WHEN before - (SELECT n FROM test) < floor(total * 0.1) THEN 'validation' ELSE 'train' END AS fold FROM run)
    SELECT id, fold FROM functions JOIN fold USING (project, file_name)""",
)
def _(t: Tables) -> DataFrame:
    return P.grouped_split(fx.functions(t), 0.1, 0.2).select("id", "fold")


@query(
    "holdout",
    f"""WITH {fx.VECTORS}, r AS (SELECT index, problem, row_number() OVER (PARTITION BY problem ORDER BY md5(concat('42:', problem, ':', index)), index) AS rn, count(*) OVER (PARTITION BY problem) AS n FROM vectors)
    SELECT index, problem, rn <= ceil(n * 0.2) AS is_test FROM r""",
)
def _(t: Tables) -> DataFrame:
    return P.holdout(fx.vectors(t).select("index", "problem")).select("index", "problem", "is_test")


@query(
    "k_folds",
    f"""WITH {fx.VECTORS} SELECT index, cast((row_number() OVER (PARTITION BY problem, label ORDER BY md5(concat('42:', problem, ':', index)), index) - 1) % 5 AS int) AS cv_fold FROM vectors""",
)
def _(t: Tables) -> DataFrame:
    return P.k_folds(fx.vectors(t).select("index", "problem", "label")).select("index", "cv_fold")


@query(
    "sample_queries",
    f"""WITH {fx.FUNCTIONS} SELECT id, compiler, optimization, row_number() OVER (PARTITION BY compiler, optimization ORDER BY md5(concat('12345:', id)), id) AS draw FROM functions QUALIFY draw <= 100""",
)
def _(t: Tables) -> DataFrame:
    return P.sample_queries(fx.functions(t), 100).select("id", "compiler", "optimization", "draw")


# ---- pairs --------------------------------------------------------------------------------------


def folded(t: Tables) -> DataFrame:
    return fx.functions(t).withColumn("fold", F.when(F.col("id") % 10 < 7, "train").when(F.col("id") % 10 == 7, "validation").otherwise("test"))


EPOCHS = 2
PAIRS = fx.FUNCTIONS + f""",
folded AS (SELECT *, CASE WHEN id % 10 < 7 THEN 'train' WHEN id % 10 = 7 THEN 'validation' ELSE 'test' END AS fold FROM functions),
groups AS (SELECT fold, project, file_name, function_name, count(*) AS g FROM folded GROUP BY ALL),
starts AS (
  SELECT *, sum(g) OVER (PARTITION BY fold ORDER BY md5(concat('group:', project, ':', file_name, ':', function_name)), project, file_name, function_name) - g AS start, sum(g) OVER (PARTITION BY fold) AS n FROM groups),
pos AS (
  SELECT f.fold, f.id, s.start, s.g, s.n, row_number() OVER (PARTITION BY f.fold, f.project, f.file_name, f.function_name ORDER BY md5(concat('row:', id)), id) AS r
  FROM folded f JOIN starts s USING (fold, project, file_name, function_name)),
seats AS (SELECT fold, start + r - 1 AS seat, id AS id_b FROM pos),
draws AS (
  SELECT *, ('0x' || substr(md5(concat('+:', epoch, ':', id)), 1, 8))::bigint AS hp, ('0x' || substr(md5(concat('-:', epoch, ':', id)), 1, 8))::bigint AS hn FROM pos, (SELECT unnest(range(0, {EPOCHS})) AS epoch)),
places AS (
  SELECT fold, epoch, id, CASE WHEN g > 1 THEN start + (r + hp % greatest(g - 1, 1)) % g END AS p,
         CASE WHEN n > g THEN CASE WHEN hn % (n - g) < start THEN hn % (n - g) ELSE hn % (n - g) + g END END AS q FROM draws)"""


def _pairs_sql(side: str, need: str) -> str:
    col, y = {"p": ("p", 1), "q": ("q", -1)}[side]
    return f"SELECT l.fold, cast(epoch AS int) AS epoch, id AS id_a, id_b, {y} AS y FROM places l JOIN seats a ON l.fold = a.fold AND l.{col} = a.seat WHERE {need}"


BOTH = f"{_pairs_sql('p', 'p IS NOT NULL AND q IS NOT NULL')} UNION ALL {_pairs_sql('q', 'p IS NOT NULL AND q IS NOT NULL')}"


@query("positive_pairs", f"WITH {PAIRS} {_pairs_sql('p', 'true')}")
def _(t: Tables) -> DataFrame:
    return P.positive_pairs(folded(t), EPOCHS)


@query("negative_pairs", f"WITH {PAIRS} {_pairs_sql('q', 'true')}")
def _(t: Tables) -> DataFrame:
    return P.negative_pairs(folded(t), EPOCHS)


@query("epoch_pairs", f"WITH {PAIRS} {BOTH}")
def _(t: Tables) -> DataFrame:
    return P.epoch_pairs(folded(t), EPOCHS)


@query(
    "batches",
    f"""WITH {PAIRS}, pairs AS ({BOTH}), ids AS (SELECT DISTINCT fold, epoch, id_a FROM pairs),
    n AS (SELECT *, (row_number() OVER (PARTITION BY fold, epoch ORDER BY md5(concat('batch:', epoch, ':', id_a)), id_a) - 1) // 50 AS batch FROM ids)
    SELECT fold, epoch, batch, count(*) AS pairs, cast(sum(y) AS bigint) AS balance, cast(sum(id_a * 3 + id_b) AS bigint) AS checksum FROM pairs JOIN n USING (fold, epoch, id_a) GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    got = P.batches(P.epoch_pairs(folded(t), EPOCHS), 100)
    return got.groupBy("fold", "epoch", "batch").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum("y").alias("balance"), F.sum(F.col("id_a") * 3 + F.col("id_b")).alias("checksum")
    )


@query(
    "materialize_pairs",
    f"""WITH {fx.INSTRUCTIONS}, {BODY}, pad AS (SELECT id, array_to_string(list_resize(instr[1:30], 30, 0), ',') AS f, cast(least(len(instr), 30) AS int) AS len FROM body),
    pairs AS (SELECT l_orderkey AS id_a, l_suppkey AS id_b, l_linenumber AS epoch FROM lineitem)
    SELECT id_a, id_b, epoch, md5(a.f) AS f_a, md5(b.f) AS f_b, a.len AS len_a, b.len AS len_b FROM pairs JOIN pad a ON id_a = a.id JOIN pad b ON id_b = b.id""",
)
def _(t: Tables) -> DataFrame:
    pairs = t.lineitem.select(F.col("l_orderkey").alias("id_a"), F.col("l_suppkey").alias("id_b"), F.col("l_linenumber").alias("epoch"))
    got = R.materialize_pairs(pairs, bodies(t), 30)
    text = lambda c: F.md5(F.array_join(F.col(c).cast("array<string>"), ",")).alias(c)
    return got.select("id_a", "id_b", "epoch", text("f_a"), text("f_b"), "len_a", "len_b")
