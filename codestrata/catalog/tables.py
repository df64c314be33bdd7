"""Readers and writers. Inputs are written from the given tables to the shared folder, then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.catalog import fixtures as fx
from codestrata.catalog.registry import Tables, query
from codestrata.functions import arrays as A
from codestrata.operators import aggregate as G
from codestrata.sources import files as S
from codestrata.sources.views import pooled, register_view, views


@query(
    "read_corpus",
    "SELECT concat('problem=', source, '$kind=', lang) AS label, concat('problem=', source) AS problem, md5(concat(text, chr(10))) AS digest FROM documents",
)
def _(t: Tables) -> DataFrame:
    root = t.scratch("corpus")
    rows = t.spread("documents", "doc_id").select(F.col("source").alias("problem"), F.col("lang").alias("kind"), F.col("text").alias("value"))
    S.write_sources(rows, root, ["problem", "kind"])
    found = S.read_corpus(t.spark, root, "*.txt")
    return found.select("label", "problem", F.md5("code").alias("digest"))


@query(
    "load_formats",
    """SELECT f.format, doc_id, quality, toxic FROM labels, (SELECT unnest(['csv', 'tsv', 'json', 'jsonl', 'parquet']) AS format) f""",
)
def _(t: Tables) -> DataFrame:
    out = None
    base = t.scratch("labels")
    rows = t.labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), F.col("toxic").cast("int"))
    for kind in ("csv", "tsv", "json", "jsonl", "parquet"):
        path = f"{base}.{kind}"
        if kind in ("csv", "tsv"):
            rows.write.csv(path, header=True, sep="," if kind == "csv" else "\t")
        elif kind == "parquet":
            rows.write.parquet(path)
        else:
            rows.write.json(path)
        part = S.load(t.spark, path, "doc_id long, quality int, toxic int").select(F.lit(kind).alias("format"), "doc_id", "quality", "toxic")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "read_csv",
    "SELECT cast(event_id AS varchar) AS event_id, event_type, props FROM events",
)
def _(t: Tables) -> DataFrame:
    path = t.scratch("events.tsv")
    t.events.select("event_id", "event_type", "props").write.csv(path, header=True, sep="\t", escape='"')
    return S.read_csv(t.spark, path, ["event_id", "event_type", "props"])


@query(
    "read_keyed_lines",
    """SELECT concat('k', event_id) AS key, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN event_type ELSE concat(event_type, '|', user_id, ',7') END AS cells,
       cast(event_id % 3 AS int) AS n FROM events""",
)
def _(t: Tables) -> DataFrame:
    path = t.scratch("lines")
    i = F.col("event_id") % 3
    t.events.select(
        F.concat_ws(
            " ", F.concat(F.lit("k"), "event_id"), F.when(i >= 1, F.col("event_type")), F.when(i == 2, F.concat("user_id", F.lit(",7")))
        ).alias("value")
    ).write.text(path)
    rows = S.read_keyed_lines(t.spark, path)
    return rows.select("key", F.array_join("values", "|").alias("cells"), F.size("values").alias("n"))


@query(
    "write_folds",
    "SELECT CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'dev' ELSE 'test' END AS fold, doc_id AS index, md5(text) AS digest FROM documents",
)
def _(t: Tables) -> DataFrame:
    path = t.scratch("folds")
    r = F.col("doc_id") % 10
    rows = t.documents.select(
        F.col("doc_id").alias("index"), "text", F.when(r < 7, "train").when(r < 9, "dev").otherwise("test").alias("fold")
    )
    S.write_folds(rows, path)
    back = t.spark.read.schema("index long, text string, fold string").json(path)
    return back.select("fold", "index", F.md5("text").alias("digest"))


@query(
    "write_report",
    f"WITH {fx.CORPUS} SELECT problem, label, count(*) AS files, cast(count(*) FILTER (n_chars % 2 = 0) AS bigint) AS compilable FROM corpus GROUP BY ALL",
)
def _(t: Tables) -> DataFrame:
    path = t.scratch("report")
    rows = t.documents.select("source", "lang", "n_chars").select(
        F.col("source").alias("problem"), F.concat("source", F.lit("$"), "lang").alias("label"), (F.col("n_chars") % 2 == 0).alias("compiles")
    )
    S.write_report(G.corpus_stats(rows), path, ["problem", "label", "files", "compilable"])
    return t.spark.read.schema("problem string, label string, files long, compilable long").csv(path, header=True)


FUNCTION_ID = "('0x' || substr(md5(concat_ws(':', 'function', project, compiler, optimization, file_name, function_name)), 1, 15))::bigint"


@query(
    "write_functions",
    f"""WITH {fx.FUNCTIONS} SELECT DISTINCT {FUNCTION_ID} AS id, project, compiler, optimization, file_name, function_name FROM functions""",
)
def _(t: Tables) -> DataFrame:
    path = t.scratch("functions")
    rows = fx.functions(t).select("project", "compiler", "optimization", "file_name", "function_name").distinct()
    S.write_functions(rows.filter(F.col("compiler") != "P"), path)
    S.write_functions(rows, path)  # the second append stores only what is new
    cols = "id long, project string, compiler string, optimization string, file_name string, function_name string"
    return t.spark.read.schema(cols).parquet(path)


@query(
    "parse_provenance",
    """SELECT l_orderkey AS index, l_linenumber AS line, l_partkey AS part, concat('proj', l_suppkey) AS project, 'gcc-7' AS compiler, concat('O', l_linenumber % 4) AS optimization, concat(l_returnflag, '.o') AS file_name
    FROM lineitem WHERE l_partkey % 3 <> 0 AND l_linenumber <> 2""",
)
def _(t: Tables) -> DataFrame:
    path = F.expr(
        "concat(CASE WHEN l_partkey % 3 = 0 THEN '' ELSE concat('bin/proj', l_suppkey, '/gcc-7/') END, 'O', l_linenumber % 4, '/', l_returnflag, CASE WHEN l_linenumber = 2 THEN '.so' ELSE '.o' END)"
    )
    rows = t.lineitem.select(F.col("l_orderkey").alias("index"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), path.alias("path"))
    return S.parse_provenance(rows).drop("path")


@query(
    "export_corpus",
    f"""WITH {fx.INSTRUCTION_TOKENS}, body AS (SELECT function_id, string_agg(token, ' ' ORDER BY pos) AS b FROM itokens GROUP BY ALL),
    first AS (SELECT function_id % 17 AS hash, arg_min(b, function_id) AS b FROM body GROUP BY ALL)
    SELECT hash, concat(' ', b, ' endfun endfun endfun endfun endfun') AS line FROM first""",
)
def _(t: Tables) -> DataFrame:
    body = fx.instruction_tokens(t).groupBy("function_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]).alias("instr")
    )
    return S.export_corpus(body.withColumn("hash", F.col("function_id") % 17), "hash", "instr", ["function_id"])


@query(
    "views",
    """WITH e AS (SELECT vec_id AS index, concat('p', vec_id % 5, '$', label % 3) AS label, embedding::double[] AS x FROM embeddings),
    v AS (SELECT 'parts' AS view, index, label, list_transform(range(1, 33), lambda i: (x[i] + x[i + 32]) / 2) AS x FROM e
          UNION ALL SELECT 'whole', index, label, x FROM e WHERE index % 7 <> 0)
    SELECT view, split_part(label, '$', 1) AS problem, index, label, cast(len(x) AS int) AS dims, round(list_sum(x), 6) AS total, round(x[7], 6) AS x7 FROM v""",
)
def _(t: Tables) -> DataFrame:
    rows = fx.vectors(t)
    register_view("parts", lambda s: rows.select("index", "label", F.array(F.slice("x", 1, 32), F.slice("x", 33, 32)).alias("embeddings")))
    register_view("whole", lambda s: rows.filter(F.col("index") % 7 != 0).select("index", "label", F.array("x").alias("embeddings")))
    total = F.round(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 6)
    return pooled(views(t.spark, ["parts", "whole"])).select(
        "view", "problem", "index", "label", F.size("x").alias("dims"), total.alias("total"), F.round(F.get("x", F.lit(6)), 6).alias("x7")
    )


@query(
    "vector_text_codec",
    "SELECT vec_id AS index, cast(64 AS int) AS dims, round(list_sum(embedding::double[]), 6) AS total FROM embeddings",
)
def _(t: Tables) -> DataFrame:
    text = t.embeddings.select(
        F.col("vec_id").alias("index"), F.regexp_replace(A.vector_to_text(A.as_double(F.col("embedding"))), " ", " \n ").alias("text")
    )
    back = text.select("index", A.vector_from_text(F.col("text")).alias("x"))
    return back.select("index", F.size("x").alias("dims"), F.round(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 6).alias("total"))
