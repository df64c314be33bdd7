"""Vector views, clustering, consensus, self-training and whole evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.catalog import fixtures as fx
from codestrata.catalog.metrics import REPORT, f1_sql, rounded
from codestrata.catalog.registry import Tables, query, quoted
from codestrata.catalog.texts import ASCII
from codestrata.functions import text as X
from codestrata.operators import cluster as C
from codestrata.operators import learn as L
from codestrata.operators import vectorize as V
from codestrata.operators import vote as U
from codestrata.operators.aggregate import contingency, path_counts
from codestrata.plans import report as P

# ---- vector views -------------------------------------------------------------------------------

TFIDF = f"""{fx.CORPUS},
terms AS (SELECT index, unnest(regexp_extract_all(lower({ASCII}), {quoted(X.TFIDF_PATTERN)})) AS term FROM corpus),
tf AS (SELECT index, term, count(*) AS tf FROM terms GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM corpus)) / (1 + count(*))) + 1 AS idf, row_number() OVER (ORDER BY term) - 1 AS id FROM tf GROUP BY term),
raw AS (SELECT index, term, id, tf * idf AS v FROM tf JOIN idf USING (term)),
weights AS (SELECT index, term, id, v / sqrt(sum(v * v) OVER (PARTITION BY index)) AS w FROM raw)"""


def code_tokens(t: Tables) -> DataFrame:
    return fx.corpus(t).select("index", F.split(X.ascii_only(F.col("code")), " ").alias("tokens"))


@query("tfidf", f"WITH {TFIDF} SELECT index, term, round(w, 6) AS w FROM weights")
def _(t: Tables) -> DataFrame:
    return rounded(V.tfidf(code_tokens(t), "index"), "w")


@query(
    "tfidf_vectors",
    f"""WITH {TFIDF} SELECT index, cast((SELECT count(*) FROM idf) AS int) AS size, string_agg(id, ',' ORDER BY id) AS indices, round(sum(w), 5) AS total FROM weights GROUP BY index""",
)
def _(t: Tables) -> DataFrame:
    rows = V.tfidf_vectors(V.tfidf(code_tokens(t), "index"), "index")
    return rows.select(
        "index", "size", F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices"), F.round(F.aggregate("values", F.lit(0.0), lambda a, b: a + b), 5).alias("total")
    )


@query("word2vec")
def _(t: Tables) -> DataFrame:
    return V.word2vec(code_tokens(t), size=16)


@query(
    "attention_pool",
    f"""WITH {fx.VECTORS}, e AS (SELECT label, x, CASE WHEN index % 5 = 0 THEN 0.0 ELSE exp(x[1] * 3) END AS e FROM vectors),
    long AS (SELECT label, e, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS dim FROM e)
    SELECT label, cast(dim AS int) AS dim, round(sum(e * v) / (sum(e) + 1e-7), 6) AS v FROM long GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    rows = fx.vectors(t).withColumn("weight", F.get("x", F.lit(0)) * 3).withColumn("seen", F.col("index") % 5 != 0)
    got = V.attention_pool(rows, ["label"], mask="seen")
    return got.select("label", F.posexplode("x").alias("dim", "v")).select("label", "dim", F.round("v", 6).alias("v"))


# ---- clustering ---------------------------------------------------------------------------------

STARTS = fx.VECTORS + """,
centers AS (SELECT problem, index // 5 AS c, x AS center FROM vectors WHERE index < 15),
assigned AS (
  SELECT v.problem, v.index, v.x, c.c, row_number() OVER (PARTITION BY v.index ORDER BY round(list_inner_product(center, center) - 2 * list_inner_product(v.x, center), 9), c.c) AS r
  FROM vectors v JOIN centers c USING (problem) QUALIFY r = 1)"""


def starts(t: Tables) -> DataFrame:
    """The first three vectors of every problem as starting centres."""
    return fx.vectors(t).filter(F.col("index") < 15).select("problem", F.floor(F.col("index") / 5).cast("int").alias("c"), F.col("x").alias("center"))


@query("assign_to_centers", f"WITH {STARTS} SELECT problem, index, cast(c AS int) AS cluster FROM assigned")
def _(t: Tables) -> DataFrame:
    return C.assign_to_centers(fx.vectors(t), starts(t)).select("problem", "index", "cluster")


@query(
    "lloyd_step",
    f"""WITH {STARTS}, long AS (SELECT problem, c, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS dim FROM assigned)
    SELECT problem, cast(c AS int) AS c, cast(dim AS int) AS dim, round(avg(v), 6) AS v, count(*) AS n FROM long GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    got = C.lloyd_step(fx.vectors(t), starts(t))
    return got.select("problem", "c", "n", F.posexplode("center").alias("dim", "v")).select("problem", "c", "dim", F.round("v", 6).alias("v"), "n")


@query("kmeans", f"WITH {fx.label_groups()} SELECT problem, index, cluster FROM grouped")
def _(t: Tables) -> DataFrame:
    v = fx.separable(t)
    return C.kmeans(v, C.known_k(v))


@query("spectral", f"WITH {fx.label_groups()} SELECT problem, index, cluster FROM grouped")
def _(t: Tables) -> DataFrame:
    v = fx.separable(t)
    return C.spectral(v, C.known_k(v))


@query("agglomerative", f"WITH {fx.label_groups()} SELECT problem, index, cluster FROM grouped")
def _(t: Tables) -> DataFrame:
    v = fx.separable(t)
    return C.agglomerative(v, C.known_k(v))


@query("multiview_spectral", f"WITH {fx.label_groups('index % 7 <> 0')} SELECT problem, index, cluster FROM grouped")
def _(t: Tables) -> DataFrame:
    from codestrata.operators.reshape import align_views

    rows = align_views(fx.separable_views(t))
    return C.multiview_spectral(rows.drop("label"), C.known_k(rows))


# ---- consensus ----------------------------------------------------------------------------------

CONSENSUS = fx.GIVEN_CLUSTERS + """,
paths AS (SELECT problem, c0, c1, c2, concat(c0, '$', c1, '$', c2) AS path, count(*) AS n FROM given GROUP BY ALL),
best AS (
  SELECT a.problem, [a.path, b.path, c.path] AS keys, a.n + b.n + c.n AS score, row_number() OVER (PARTITION BY a.problem ORDER BY a.n + b.n + c.n DESC, a.path, b.path, c.path) AS r
  FROM paths a JOIN paths b USING (problem) JOIN paths c USING (problem)
  WHERE a.c0 = 0 AND b.c0 = 1 AND c.c0 = 2 AND a.c1 <> b.c1 AND a.c1 <> c.c1 AND b.c1 <> c.c1 AND a.c2 <> b.c2 AND a.c2 <> c.c2 AND b.c2 <> c.c2 QUALIFY r = 1),
chosen AS (SELECT p.problem, p.path, p.n, b.score FROM best b JOIN paths p ON p.problem = b.problem AND list_contains(b.keys, p.path))"""


def chosen(t: Tables) -> DataFrame:
    g = fx.given_clusters(t)
    return U.consensus(path_counts(g, ["c0", "c1", "c2"]), C.known_k(g))


@query("consensus", f"WITH {CONSENSUS} SELECT problem, path, n, score FROM chosen")
def _(t: Tables) -> DataFrame:
    return chosen(t)


@query(
    "seed_sets",
    f"""WITH {CONSENSUS} SELECT g.problem, g.index, c.path IS NOT NULL AS agreed, cast(CASE WHEN c.path IS NOT NULL THEN c0 END AS int) AS cluster
    FROM given g LEFT JOIN chosen c ON g.problem = c.problem AND concat(c0, '$', c1, '$', c2) = c.path""",
)
def _(t: Tables) -> DataFrame:
    got = U.seed_sets(fx.given_clusters(t), ["c0", "c1", "c2"], chosen(t))
    return got.select("problem", "index", "agreed", "cluster")


def _aligned(relation: str) -> str:
    """Best of all six permutations of three labels, for a relation (problem, cluster, label)."""
    return f"""cell AS (SELECT problem, cluster, label, count(*) AS n FROM {relation} GROUP BY ALL),
    rowsum AS (SELECT problem, cluster, sum(n) AS n FROM cell GROUP BY ALL), colsum AS (SELECT problem, label, sum(n) AS n FROM cell GROUP BY ALL),
    gain AS (SELECT r.problem, r.cluster, c.label, coalesce(2.0 * r.n * cell.n / (r.n + c.n), 0) AS g FROM rowsum r JOIN colsum c USING (problem) LEFT JOIN cell ON cell.problem = r.problem AND cell.cluster = r.cluster AND cell.label = c.label),
    perm AS (SELECT a.problem, [a.label, b.label, c.label] AS names, row_number() OVER (PARTITION BY a.problem ORDER BY round(a.g + b.g + c.g, 9) DESC, a.label, b.label, c.label) AS r
      FROM gain a JOIN gain b USING (problem) JOIN gain c USING (problem) WHERE a.cluster = 0 AND b.cluster = 1 AND c.cluster = 2 AND a.label <> b.label AND a.label <> c.label AND b.label <> c.label QUALIFY r = 1),
    aligned AS (SELECT problem, cast(i AS int) AS cluster, names[i + 1] AS label FROM perm, (SELECT unnest([0, 1, 2]) AS i))"""


@query(
    "align_labels",
    f"WITH {fx.GIVEN_CLUSTERS}, one AS (SELECT problem, c1 AS cluster, label FROM given), {_aligned('one')} SELECT problem, cluster, label FROM aligned",
)
def _(t: Tables) -> DataFrame:
    g = fx.given_clusters(t).withColumn("cluster", F.col("c1"))
    return U.align_labels(contingency(g), g)


@query(
    "named_clusters_f1",
    f"""WITH {fx.GIVEN_CLUSTERS}, one AS (SELECT problem, c1 AS cluster, label FROM given), {_aligned('one')},
    scored AS (SELECT g.problem, g.label AS y_true, a.label AS y_pred FROM given g JOIN aligned a ON g.problem = a.problem AND g.c1 = a.cluster), {f1_sql('scored', 'problem')}""",
)
def _(t: Tables) -> DataFrame:
    from codestrata.operators.aggregate import f1_report

    named = U.named_clusters(fx.given_clusters(t).withColumn("cluster", F.col("c1")))
    return rounded(f1_report(named, ["problem"]), "f1_micro", "f1_macro", "f1_weighted")


def _centroid_sql(name: str, train: str, test: str, col: str) -> str:
    """Relation ``name``(problem, index, pred): nearest centroid of ``train`` for every row of ``test``."""
    return f"""{name}_long AS (SELECT problem, label, unnest({col}) AS v, generate_subscripts({col}, 1) AS d FROM {train}),
    {name}_mean AS (SELECT problem, label, d, avg(v) AS v FROM {name}_long GROUP BY ALL),
    {name}_center AS (SELECT problem, label, list(v ORDER BY d) AS c FROM {name}_mean GROUP BY ALL),
    {name} AS (
      SELECT t.problem, t.index, c.label AS pred, row_number() OVER (PARTITION BY t.problem, t.index ORDER BY round(list_inner_product(c, c) - 2 * list_inner_product(t.{col}, c), 9), c.label) AS r
      FROM {test} t JOIN {name}_center c USING (problem) QUALIFY r = 1)"""


def _seeds(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Agreed rows named after their first cluster, and the rest; two views of every row."""
    rows = U.seed_sets(fx.given_clusters(t), ["c0", "c1", "c2"], chosen(t)).withColumn("x0", F.slice("x", 1, 32)).withColumn("x1", F.slice("x", 33, 32))
    return rows.filter("agreed").withColumn("label", F.col("cluster").cast("string")), rows.filter(~F.col("agreed"))


SEEDS = CONSENSUS + """,
sides AS (SELECT g.problem, g.index, cast(CASE WHEN c.path IS NOT NULL THEN c0 END AS varchar) AS label, x[1:32] AS x0, x[33:64] AS x1
  FROM given g LEFT JOIN chosen c ON g.problem = c.problem AND concat(c0, '$', c1, '$', c2) = c.path),
agreed AS (SELECT * FROM sides WHERE label IS NOT NULL), rest AS (SELECT * FROM sides WHERE label IS NULL),
open AS (SELECT problem FROM agreed GROUP BY ALL HAVING count(*) > 20),"""


@query(
    "self_train_round",
    f"""WITH {SEEDS} {_centroid_sql('p0', 'agreed', 'rest', 'x0')}, {_centroid_sql('p1', 'agreed', 'rest', 'x1')}
    SELECT problem, index, label, 0 AS round FROM agreed UNION ALL
    SELECT a.problem, a.index, a.pred, 1 FROM p0 a JOIN p1 b USING (problem, index) WHERE a.pred = b.pred AND a.problem IN (SELECT problem FROM open)""",
)
def _(t: Tables) -> DataFrame:
    agreed, rest = _seeds(t)
    return U.self_train(agreed, rest, [L.nearest_centroid] * 2, max_rounds=1)


@query(
    "self_train",
    f"""WITH {CONSENSUS} SELECT g.problem, g.index, cast(c0 AS varchar) AS label,
      CASE WHEN c.path IS NOT NULL THEN 0 WHEN count(c.path) OVER (PARTITION BY g.problem) > 20 THEN 1 ELSE -1 END AS round
    FROM given g LEFT JOIN chosen c ON g.problem = c.problem AND concat(c0, '$', c1, '$', c2) = c.path""",
)
def _(t: Tables) -> DataFrame:
    hot = F.slice("x", 65, 3)
    agreed, rest = (
        d.drop("x").join(fx.separable(t).select("problem", "index", "x"), ["problem", "index"])
        .withColumn("x0", F.concat(F.slice("x", 1, 32), hot)).withColumn("x1", F.concat(F.slice("x", 33, 32), hot))
        for d in _seeds(t)
    )
    return U.self_train(agreed, rest, [L.nearest_centroid] * 2, final=True)


@query(
    "named_clusters_missing_label",
    f"""WITH {fx.GIVEN_CLUSTERS}, one AS (SELECT problem, index, c1 AS cluster, label FROM given WHERE NOT ends_with(label, '$2')), {_aligned('one').replace('c.label, coalesce', 'c.label AS label, coalesce').replace('JOIN colsum c USING (problem)', "JOIN (SELECT DISTINCT v.problem, v.label, coalesce(c.n, 0) AS n FROM vectors v LEFT JOIN colsum c ON v.problem = c.problem AND v.label = c.label) c USING (problem)")}
    SELECT o.problem, o.index, o.label AS y_true, a.label AS y_pred FROM one o LEFT JOIN aligned a USING (problem, cluster)""",
)
def _(t: Tables) -> DataFrame:
    """Rows of one label are missing, its name is not: names are still taken from all labels, and no row is lost."""
    g = fx.given_clusters(t)
    part = g.filter(~F.col("label").endswith("$2")).withColumn("cluster", F.col("c1"))
    return U.named_clusters(part, labels=g).select("problem", "index", "y_true", "y_pred")


# ---- supervised ---------------------------------------------------------------------------------

HOLDOUT = fx.VECTORS + """,
parts AS (SELECT *, row_number() OVER (PARTITION BY problem ORDER BY md5(concat('42:', problem, ':', index)), index) <= ceil(0.2 * count(*) OVER (PARTITION BY problem)) AS is_test FROM vectors),
train AS (SELECT * FROM parts WHERE NOT is_test), test AS (SELECT * FROM parts WHERE is_test)"""


@query(
    "holdout_predictions",
    f"WITH {HOLDOUT}, {_centroid_sql('p', 'train', 'test', 'x')} SELECT problem, index, label AS y_true, pred AS y_pred FROM p JOIN test USING (problem, index)",
)
def _(t: Tables) -> DataFrame:
    return L.holdout_predictions(fx.vectors(t), L.nearest_centroid)


@query(
    "cross_validate",
    f"""WITH {fx.VECTORS}, folds AS (SELECT *, (row_number() OVER (PARTITION BY problem, label ORDER BY md5(concat('42:', problem, ':', index)), index) - 1) % 5 AS fold FROM vectors),
    train AS (SELECT concat(problem, '/', f.of) AS problem, index, label, x FROM folds, (SELECT unnest([0,1,2,3,4]) AS of) f WHERE fold <> f.of),
    test AS (SELECT concat(problem, '/', fold) AS problem, index, label, x FROM folds), {_centroid_sql('p', 'train', 'test', 'x')}
    SELECT split_part(problem, '/', 1) AS problem, cast(split_part(problem, '/', 2) AS int) AS fold, round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0 END), 6) AS accuracy, count(*) AS n
    FROM p JOIN test USING (problem, index) GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    return rounded(L.cross_validate(fx.vectors(t), L.nearest_centroid), "accuracy")


@query(
    "estimator_report",
    f"""WITH {HOLDOUT}, {_centroid_sql('p', 'train', 'test', 'x')},
    scored AS (SELECT problem, 'whole' AS embedding, 'nearest_centroid' AS estimator, label AS y_true, pred AS y_pred FROM p JOIN test USING (problem, index)),
    {f1_sql('scored', 'problem, embedding, estimator')}""",
)
def _(t: Tables) -> DataFrame:
    return rounded(P.estimator_report({"whole": fx.vectors(t)}, ["nearest_centroid"]), "f1_micro", "f1_macro", "f1_weighted")


@query(
    "estimator_report_library",
    f"""WITH {HOLDOUT} SELECT problem, 'whole' AS embedding, estimator, 1.0::double AS f1_micro, 1.0::double AS f1_macro, 1.0::double AS f1_weighted, count(*) AS samples
    FROM test, (SELECT unnest({P.REPORTED_CLASSIFIERS}) AS estimator) GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    return rounded(P.estimator_report({"whole": fx.separable(t)}), "f1_micro", "f1_macro", "f1_weighted")


@query(
    "multilabel_fit_predict",
    f"""WITH {fx.LABEL_ROWS} SELECT index, array_to_string(Y, '') AS p FROM label_rows JOIN embeddings ON vec_id = index WHERE index % 5 = 0""",
)
def _(t: Tables) -> DataFrame:
    rows = fx.label_rows(t).join(t.embeddings.select(F.col("vec_id").alias("index"), F.col("embedding").alias("x")), "index")
    # ten times the target behind the vector: every label can be learnt
    rows = rows.withColumn("x", F.concat(F.col("x").cast("array<double>"), F.transform("Y", lambda y: y * 10.0)))
    train, test = rows.filter(F.col("index") % 5 != 0), rows.filter(F.col("index") % 5 == 0)
    got = L.multilabel_fit_predict(train, test, ["x"], fx.LABELS)
    return got.select("index", F.array_join(F.col("p").cast("array<string>"), "").alias("p"))


@query(
    "multilabel_evaluation",
    f"""WITH {fx.SCORED_ROWS},
    {REPORT},
    wide AS (SELECT label, precision::double AS precision, recall::double AS recall, f1::double AS f1, support::double AS support FROM a),
    ranks AS (SELECT label, y, rank() OVER (PARTITION BY label ORDER BY score) + (count(*) OVER (PARTITION BY label, score) - 1) / 2.0 AS r FROM cells),
    auc AS (SELECT label, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auc FROM ranks GROUP BY label),
    long AS (SELECT label, metric, value FROM (UNPIVOT wide ON precision, recall, f1, support INTO NAME metric VALUE value)
      UNION ALL SELECT label, 'auc', auc FROM auc
      UNION ALL SELECT 'macro avg', 'auc', avg(auc) FROM auc
      UNION ALL SELECT 'all', 'hamming_loss', avg(CASE WHEN y <> p THEN 1.0 ELSE 0.0 END) FROM cells)
    SELECT label, metric, round(value, 6) AS value FROM long""",
)
def _(t: Tables) -> DataFrame:
    return rounded(P.multilabel_evaluation(fx.scored_rows(t), fx.LABELS, 0.4), "value")


@query("multilabel_report")
def _(t: Tables) -> DataFrame:
    """Targets of the documents learnt from the vectors as they are, with every fifth document held out."""
    rows = fx.label_rows(t).join(t.embeddings.select(F.col("vec_id").alias("index"), F.col("embedding").alias("x")), "index")
    train, test = rows.filter(F.col("index") % 5 != 0), rows.filter(F.col("index") % 5 == 0)
    return rounded(P.multilabel_report(train, test, ["x"], fx.LABELS), "value")


# ---- reports ------------------------------------------------------------------------------------


def _perfect(cells: str, relation: str, keys: str) -> str:
    """F1 of one for every cell and problem, with the number of rows."""
    return f"SELECT {keys}, 1.0::double AS f1_micro, 1.0::double AS f1_macro, 1.0::double AS f1_weighted, count(*) AS samples FROM {relation}, {cells} GROUP BY ALL"


@query(
    "kcluster_report",
    f"""WITH {fx.VECTORS}, cells AS (SELECT * FROM (SELECT unnest(['functions', 'w2v', 'tfidf']) AS embedding), (SELECT unnest({P.REPORTED_CLUSTERERS}) AS clustering)),
    rows AS (SELECT * FROM vectors, cells WHERE embedding <> 'functions' OR index % 7 <> 0)
    SELECT problem, embedding, clustering, 1.0::double AS f1_micro, 1.0::double AS f1_macro, 1.0::double AS f1_weighted, count(*) AS samples FROM rows GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    return rounded(P.kcluster_report(fx.separable_views(t)), "f1_micro", "f1_macro", "f1_weighted")


@query(
    "multiview_report",
    f"""WITH {fx.VECTORS}, cells AS (SELECT unnest(['functions/w2v', 'functions/tfidf', 'w2v/tfidf', 'functions/w2v/tfidf']) AS embeddings),
    rows AS (SELECT * FROM vectors, cells WHERE embeddings = 'w2v/tfidf' OR index % 7 <> 0) {_perfect('(SELECT 1)', 'rows', 'problem, embeddings')}""",
)
def _(t: Tables) -> DataFrame:
    return rounded(P.multiview_report(fx.separable_views(t)), "f1_micro", "f1_macro", "f1_weighted")


# the same reports over the vectors as they are, in views that disagree: no SQL, held against brute force on small data in the tests
@query("kcluster_report_views")
def _(t: Tables) -> DataFrame:
    return rounded(P.kcluster_report(fx.half_views(t)), "f1_micro", "f1_macro", "f1_weighted")


@query("multiview_report_views")
def _(t: Tables) -> DataFrame:
    return rounded(P.multiview_report(fx.half_views(t)), "f1_micro", "f1_macro", "f1_weighted")


@query("estimator_report_views")
def _(t: Tables) -> DataFrame:
    """The library classifiers on views in which the classes overlap."""
    return rounded(P.estimator_report(fx.half_views(t)), "f1_micro", "f1_macro", "f1_weighted")


VOTING = ["functions", "w2v"]


@query(
    "voting_report",
    f"""WITH {fx.VECTORS}, c AS (SELECT unnest({P.REPORTED_CLUSTERERS}) AS c), e AS (SELECT unnest({P.REPORTED_CLASSIFIERS}) AS e),
    cells AS (SELECT concat(a.c, '/', b.c) AS clusterings, concat(x.e, '/', y.e) AS estimators FROM c a, c b, e x, e y)
    SELECT problem, 'w2v/functions' AS embeddings, clusterings, estimators,
      {', '.join(f"{'count(*)' if m == 'samples' else '1.0::double'} AS {m}_{w}" for w in ('before', 'after') for m in ('f1_micro', 'f1_macro', 'f1_weighted', 'samples'))}, false AS error
    FROM vectors, cells WHERE index % 7 <> 0 GROUP BY problem, clusterings, estimators""",
)
def _(t: Tables) -> DataFrame:
    """The whole grid of clusterings and of the three library classifiers over two views."""
    views = {n: v for n, v in fx.separable_views(t).items() if n in VOTING}
    names = [f"{m}_{w}" for w in ("before", "after") for m in ("f1_micro", "f1_macro", "f1_weighted")]
    return rounded(P.voting_report(views), *names)


@query("voting_report_mixed")
def _(t: Tables) -> DataFrame:
    """Views that disagree, so that self-training has work; all view sets, with the learner that fits all cells in one job."""
    return P.voting_report(fx.half_views(t), classifiers=["nearest_centroid"])


@query("predict_kclustering", f"WITH {fx.label_groups()} SELECT problem, index, cluster AS \"group\" FROM grouped")
def _(t: Tables) -> DataFrame:
    v = fx.separable(t)
    return P.predict({"w2v": v}, "kclustering", C.known_k(v), ["agglomerative"])


@query("predict_multiview", f"WITH {fx.label_groups('index % 7 <> 0')} SELECT problem, index, cluster AS \"group\" FROM grouped")
def _(t: Tables) -> DataFrame:
    return P.predict(fx.separable_views(t), "mv_spectral_clustering", C.known_k(fx.vectors(t)))


@query("predict_voting", f"WITH {fx.label_groups('index % 7 <> 0')} SELECT problem, index, cluster AS \"group\" FROM grouped")
def _(t: Tables) -> DataFrame:
    return P.predict(fx.separable_views(t), "unsupervised_voting", C.known_k(fx.vectors(t)), classifiers=["nearest_centroid"] * 3)
