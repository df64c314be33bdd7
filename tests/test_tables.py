"""Files, path contexts, spans and calls on small literal inputs."""

import json

import pytest
from pyspark.sql import functions as F

from codestrata.operators import reshape as R
from codestrata.operators.vectorize import attention_pool
from codestrata.scale import meet_spread, spread_heavy
from codestrata.sources import files as S
from codestrata.sources import schemas
from codestrata.sources.views import pooled, register_view, views


def test_read_corpus(spark, tmp_path):
    for p in ("p1/s1/a.cpp", "p1/s2/b b.cpp", "p2/s1/c+d.cpp", "p2/s1/skip.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("int a;\nint b;")
    got = S.read_corpus(spark, str(tmp_path)).collect()
    assert {(r["index"], r["label"], r["problem"]) for r in got} == {("a", "p1$s1", "p1"), ("b b", "p1$s2", "p1"), ("c+d", "p2$s1", "p2")}
    assert {r["code"] for r in got} == {"int a;\nint b;"}


def test_write_sources(spark, tmp_path):
    """The same folders and texts as Spark's writer makes, without a checksum file for each, which costs a process."""
    rows = spark.createDataFrame([("a:b", "x y", "1\n2"), ("a:b", "x y", "1\n2"), ("c", None, "ü"), ("c", "", None), ("d%=[1]", "+", "")], "p string, q string, value string")
    S.write_sources(rows.repartition(3), str(tmp_path / "own"), ["p", "q"])
    rows.write.option("maxRecordsPerFile", 1).partitionBy("p", "q").text(str(tmp_path / "spark"))
    found = [sorted(map(tuple, S.read_corpus(spark, str(tmp_path / d), "*.txt").select("label", "problem", "code").collect())) for d in ("own", "spark")]
    assert found[0] == found[1] and len(found[0]) == 5
    assert not list((tmp_path / "own").rglob("*.crc"))


def test_load_nested_problems(spark, tmp_path):
    rows = [
        {"index": "1", "tags": ["dp"], "solutions": [{"index": "1a", "code": "x"}, {"index": "1b", "code": "y"}], "contest_name": "Round 1"},
        {"index": "2", "tags": ["dp"], "solutions": [], "contest_name": "Round 1"},
        {"index": "3", "tags": [], "solutions": [{"index": "3a", "code": "z"}], "contest_name": "April Fools 2020"},
        {"index": "4", "tags": ["math"], "solutions": [{"index": "4a", "code": "z"}]},
    ]
    path = tmp_path / "problems.json"
    path.write_text(json.dumps(rows))
    problems = R.filter_relevant(S.load(spark, str(path), schemas.PROBLEM, multiline=True))
    got = [(r["index"], r["tags"]) for r in R.flatten(problems).orderBy("index").collect()]
    assert got == [("1a", ["dp"]), ("1b", ["dp"]), ("4a", ["math"])]


def test_write_functions_appends_once(spark, tmp_path):
    cols = "project string, compiler string, optimization string, file_name string, function_name string"
    rows = spark.createDataFrame([("p", "gcc", "O1", "a.o", "f"), ("p", "gcc", "O2", "a.o", "f")], cols)
    path = str(tmp_path / "functions")
    S.write_functions(rows.limit(1), path)
    S.write_functions(rows, path)
    S.write_functions(rows, path)
    assert spark.read.parquet(path).count() == 2


def test_path_contexts(spark):
    def table(field, d):
        return spark.createDataFrame([(k, v) for k, v in d.items()], f"{field} string, id long")

    tokens = R.match_by_text(table("token", {"a": 0, "b": 1, "zz": 2}), table("token", {"a": 5, "b": 6}), "token")
    paths = R.match_vocab(
        table("node_type", {"N": 0, "M": 1, "Q": 2}), table("node_type", {"N": 3, "M": 4}), table("path", {"0 1": 0, "0 2": 1}), table("path", {"3 4": 9})
    )
    lines = spark.createDataFrame([("d/x.cpp", ["0,0,1", "2,1,0", "7", "0,0,0"])], "key string, values array<string>")
    got = R.translate_contexts(R.parse_contexts(lines), tokens, paths)
    assert [tuple(c) for c in got.first()["contexts"]] == [(5, 9, 6), (-1, -1, 5)]
    samples = spark.createDataFrame([("x", "train"), ("y", "train")], "index string, fold string")
    attached = R.attach_contexts(samples, got.withColumnRenamed("key", "path"))
    assert [r["index"] for r in attached.collect()] == ["x"]
    assert [tuple(r) for r in R.context_failures(samples, attached).collect()] == [("train", 1)]
    enc = R.encode_contexts(attached, 7, 10, 4, ["index"]).first()
    assert (enc["start"], enc["path"], enc["end"]) == ([0, 0, 5, 7], [0, 0, 9, 10], [0, 0, 6, 5])


def test_remove_spans(spark):
    code = "int f(){\nreturn 1;\n}\nint main(){\n}"
    files = spark.createDataFrame([("a", code), ("b", code), ("c", "x{\n\ny")], "file string, code string")
    findings = spark.createDataFrame([("a", 1), ("c", 1)], "file string, line int")
    got = {r["file"]: r["code"] for r in R.remove_spans(files, findings).collect()}
    assert got == {"a": "int main(){\n}", "b": code, "c": ""}


def test_inline_calls_reads_in_order(spark):
    instr = spark.createDataFrame([(f, p, f"{f}{p}") for f in "abc" for p in range(3)], "function_id string, pos long, token string")
    calls = spark.createDataFrame([("a", 1, "b"), ("b", 0, "c"), ("c", 2, "a")], "function_id string, pos long, callee string")

    def body(depth):
        rows = R.inline_calls(instr, calls, depth).filter("function_id = 'a'").orderBy("path").collect()
        return " ".join(r["token"] for r in rows)

    assert body(0) == "a0 a1 a2"
    assert body(1) == "a0 a1 b0 b1 b2 a2"
    assert body(2) == "a0 a1 b0 c0 c1 c2 b1 b2 a2"


def _spliced(instr, calls, f, depth):
    """The definition, as a recursion."""
    out = []
    for _, pos, token in sorted((r for r in instr if r[0] == f), key=lambda r: (r[1], r[2])):
        out.append(token)
        for callee in sorted(c for g, p, c in calls if (g, p) == (f, pos) and c is not None) if depth else ():
            out += _spliced(instr, calls, callee, depth - 1)
    return out


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_inlined_bodies_follow_the_recursion(spark, depth):
    """A callee that all call, a cycle, two callees at one position, a repeated call, a callee and a position that do not exist."""
    instr = [(f"f{f}", p, f"f{f}.{p}") for f in range(9) for p in range(4)]
    calls = [(f"f{f}", 1, "f0") for f in range(9)] + [("f1", 3, "f2"), ("f2", 0, "f1"), ("f3", 2, "f4"), ("f3", 2, "f1"), ("f4", 0, "f5"), ("f4", 0, "f5")]
    calls += [("f5", 2, "none"), ("f6", 99, "f1"), ("f7", 2, None), (None, 1, "f1"), ("f8", None, "f1")]
    body_of = {f"f{f}": _spliced(instr, calls, f"f{f}", depth) for f in range(9)}
    rows = spark.createDataFrame(instr + [(None, 0, "lost")], "function_id string, pos int, token string").withColumn("callee", F.lit("other"))
    sites = spark.createDataFrame(calls, "function_id string, pos int, callee string").withColumn("token", F.lit(0))
    for per_task in (100_000, 2):
        got = R.inlined_bodies(rows, sites, depth, per_task=per_task)
        assert {r["function_id"]: r["body"] for r in got.collect()} == body_of
    cut_off = R.inlined_bodies(rows, sites, depth, max_length=6)
    assert {r["function_id"]: r["body"] for r in cut_off.collect()} == {f: b[:6] for f, b in body_of.items()}
    assert R.inlined_bodies(rows.limit(0), sites, depth).collect() == []
    plain = {f: _spliced(instr, [], f, 0) for f in body_of}
    assert {r["function_id"]: r["body"] for r in R.inlined_bodies(rows, sites.limit(0), depth).collect()} == plain


def test_inlined_bodies_keep_null_tokens_and_positions(spark):
    rows = spark.createDataFrame([("a", None, "x"), ("a", 0, None), ("a", 1, "y"), ("b", 0, "z")], "function_id string, pos int, token string")
    sites = spark.createDataFrame([("a", 0, "b"), ("a", None, "b")], "function_id string, pos int, callee string")
    got = {r["function_id"]: r["body"] for r in R.inlined_bodies(rows, sites, 2).collect()}
    assert got == {"a": ["x", None, "z", "y"], "b": ["z"]}


def test_pairs_of_a_function_in_most_of_them(spark):
    instr = spark.createDataFrame([(i, list(range(1, i + 2))) for i in range(5)], "id int, instr array<int>")
    pairs = spark.createDataFrame([(i % 5, 0, i) for i in range(40)] + [(None, 1, 41), (2, 77, 42)], "id_a int, id_b int, pair int")
    got = R.materialize_pairs(pairs, instr, 4)
    assert got.columns == ["id_a", "id_b", "pair", "f_a", "len_a", "f_b", "len_b"]
    assert sorted((r["pair"], r["f_a"], r["f_b"]) for r in got.collect()) == [
        (i, ([*range(1, i % 5 + 2)] + [0] * 4)[:4], [1, 0, 0, 0]) for i in range(40)
    ]


def test_heavy_keys_meet_in_as_many_parts_as_they_need(spark):
    big = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 50), (None, 51), ("alone", 52)], "k string, v int")
    small = spark.createDataFrame([("hot", "h"), ("cold", "c"), (None, "n"), ("unused", "u")], "k string, w string")
    salted, heavy = spread_heavy(big, ["k"], ["v"], 10)
    assert [tuple(r) for r in heavy.collect()] == [("hot", 5)]
    assert salted.where("k = 'hot'").select("__salt").distinct().count() > 1
    assert sorted(map(tuple, meet_spread(salted, heavy, small, ["k"]).collect())) == [("cold", 50, "c")] + [("hot", i, "h") for i in range(50)]


def test_views_and_pooling(spark):
    rows = spark.createDataFrame([("1", "p$a", [[1.0, 2.0], [3.0, 4.0]]), ("2", "p$b", [])], schemas.EMBEDDING_ROW)
    register_view("v", lambda s: rows)
    got = pooled(views(spark, ["v"])).collect()
    assert [(r["view"], r["problem"], r["index"], r["x"]) for r in got] == [("v", "p", "1", [2.0, 3.0])]


def test_attention_pool(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 0.0, True), (1, [0.0, 1.0], 0.0, True), (1, [9.0, 9.0], 5.0, False), (2, [1.0, 1.0], 1.0, False)], "id int, x array<double>, weight double, seen boolean")
    got = {r["id"]: [round(v, 5) for v in r["x"]] for r in attention_pool(rows, ["id"], mask="seen").collect()}
    assert got == {1: [0.5, 0.5], 2: [0.0, 0.0]}


def test_clean_code_and_require(spark):
    rows = spark.createDataFrame([(1, "#include <a>\n\nint x = 1'000;  \n"), (2, "#include <a>"), (3, None), (4, "a\nb\nc\nd")], "index int, code string")
    got = {r["index"]: (r["code"], r["raw"]) for r in R.clean_code(rows, max_lines=3 + 1).collect()}
    assert got == {1: ("int x = 1000;", "#include <a>\n\nint x = 1'000;  \n"), 4: ("a\nb\nc\nd", "a\nb\nc\nd")}
    assert R.require(rows, ["code"]).count() == 3
    assert R.filter_size(rows, 1).select(F.count("*")).first()[0] == 1
