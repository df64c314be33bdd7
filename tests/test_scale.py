"""Numbering, joins and splits that must not depend on how large a key is."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from codestrata.operators import split as P
from codestrata.operators.aggregate import f1_report, group_solutions, roc_auc
from codestrata.operators.search import nearest, similarity
from codestrata.scale import first_per_key, hash_rank, hash_running_sum, range_running, salted_join, stable_hash


def skewed(spark, n=3000):
    """Every third row has the key hot, the others spread over 40 keys, some null."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 41 != 0, (F.col("id") % 40).cast("string"))
    return spark.range(n).select(F.col("id"), key.alias("key"), (F.col("id") * 7 % 13).alias("v"))


def test_hash_rank(spark):
    got = hash_rank(skewed(spark).withColumn("h", stable_hash(1, "id")), ["key"], "h", ["id"], total="n").collect()
    groups = {}
    for r in got:
        groups.setdefault(r["key"], []).append(r)
    assert len(got) == 3000 and None in groups
    for rows in groups.values():
        rows.sort(key=lambda r: r["rn"])
        assert [r["rn"] for r in rows] == list(range(1, len(rows) + 1))
        assert [r["h"] for r in rows] == sorted(r["h"] for r in rows)
        assert {r["n"] for r in rows} == {len(rows)}


def test_hash_running_sum(spark):
    rows = hash_running_sum(skewed(spark).withColumn("h", stable_hash(1, "id")), ["key"], "h", ["id"], "v", "before").collect()
    seen = {}
    for r in sorted(rows, key=lambda r: r["h"]):
        assert r["before"] == seen.get(r["key"], 0)
        seen[r["key"]] = seen.get(r["key"], 0) + r["v"]


def test_range_running(spark):
    rows = range_running(skewed(spark), ["key"], [F.col("v").desc(), F.col("id")], {"a": "v", "b": "id"}).collect()
    seen = {}
    for r in sorted(rows, key=lambda r: (-r["v"], r["id"])):
        a, b = seen.get(r["key"], (0, 0))
        assert (r["a"], r["b"]) == (a, b)
        seen[r["key"]] = (a + r["v"], b + r["id"])


def test_salted_join_equals_join(spark):
    big = skewed(spark)
    small = big.groupBy("key").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        got = sorted(map(tuple, salted_join(big, small, ["key"], how, spread=["id"]).select("id", "n").collect()), key=repr)
        assert got == sorted(map(tuple, big.join(small, "key", how).select("id", "n").collect()), key=repr)


def test_first_per_key(spark):
    got = {r["key"]: r["id"] for r in first_per_key(skewed(spark), ["key"], ["id"]).collect()}
    want = {}
    for r in skewed(spark).collect():
        want[r["key"]] = min(want.get(r["key"], r["id"]), r["id"])
    assert got == want


def test_group_solutions_keeps_everything_in_bounded_lists(spark):
    rows = group_solutions(skewed(spark), "key", ["id", "v"], "id", chunk=100).collect()
    assert max(len(r["solutions"]) for r in rows) == 100
    assert sorted(s["id"] for r in rows for s in r["solutions"]) == list(range(3000))


@pytest.mark.parametrize("seed", range(4))
def test_grouped_split_is_the_sequential_rule(spark, seed):
    rnd = random.Random(seed)
    files = [(f"p{rnd.randrange(4)}", f"f{i}", rnd.randrange(1, 30) * (20 if i == 5 else 1)) for i in range(30)]
    rows = [(i, p, f) for i, (p, f) in enumerate((p, f) for p, f, n in files for _ in range(n))]
    got = P.grouped_split(spark.createDataFrame(rows, "id long, project string, file_name string"), 0.15, 0.3).collect()
    total, fold = len(rows), {}
    order = sorted(files, key=lambda x: hashlib.md5(f"12345:{x[0]}:{x[1]}".encode()).hexdigest())
    quota, names, taken = [int(total * 0.3), int(total * 0.15), total], ["test", "validation", "train"], 0
    at = 0
    for p, f, n in order:
        while taken >= quota[at] and at < 2:
            at, taken = at + 1, 0
        fold[p, f] = names[at]
        taken += n
    assert len(got) == total
    assert all(r["fold"] == fold[r["project"], r["file_name"]] for r in got)


def functions(spark):
    return spark.range(600).select(
        "id",
        F.lit("p").alias("project"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("file_name"),
        F.lit("f").alias("function_name"),
        F.when(F.col("id") < 500, "train").otherwise("test").alias("fold"),
    )


def test_epoch_pairs(spark):
    rows = functions(spark)
    where = {r["id"]: (r["fold"], r["file_name"]) for r in rows.collect()}
    pairs = P.epoch_pairs(rows, 3).collect()
    per = {}
    for r in pairs:
        same = where[r["id_a"]][1] == where[r["id_b"]][1]
        assert where[r["id_a"]][0] == where[r["id_b"]][0] == r["fold"] and r["id_a"] != r["id_b"]
        assert same == (r["y"] == 1)
        per.setdefault((r["epoch"], r["id_a"]), []).append(r["y"])
    assert all(sorted(v) == [-1, 1] for v in per.values())
    sizes = {}
    for w in where.values():
        sizes[w] = sizes.get(w, 0) + 1
    assert len(per) == 3 * sum(1 for w in where.values() if sizes[w] > 1)


def test_stratified_split_shares(spark):
    rows = spark.range(1000).select(F.col("id").alias("index"), F.array((F.col("id") % 2).cast("int"), (F.col("id") % 3 == 0).cast("int")).alias("Y"))
    got = P.stratified_split(rows, "index").groupBy("Y", "fold").count().collect()
    sizes = {}
    for r in got:
        sizes[tuple(r["Y"])] = sizes.get(tuple(r["Y"]), 0) + r["count"]
    for r in got:
        share = {"test": 0.15, "dev": 0.15, "train": 0.7}[r["fold"]]
        assert abs(r["count"] - share * sizes[tuple(r["Y"])]) <= 1
    assert sum(sizes.values()) == 1000


def test_nearest_ways_agree(spark):
    pts = spark.range(300).select("id", F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.sin(F.col("id") * i % 50)).alias("x"))
    a = sorted(map(tuple, nearest(pts, pts, 5).collect()))
    b = sorted(map(tuple, nearest(pts, pts, 5, max_bytes=0, block=70).collect()))
    assert a == b and len(a) == 1500
    some = pts.where("id % 10 = 0")
    c = sorted(map(tuple, similarity(some, pts).collect()))
    d = sorted(map(tuple, similarity(some, pts, max_bytes=0, block=70).collect()))
    assert c == d and len(c) == 30 * 300


def test_f1_micro_is_accuracy(spark):
    df = spark.range(500).select(F.lit("g").alias("g"), (F.col("id") % 4).alias("y_true"), (F.col("id") % 7 % 5).alias("y_pred"))
    r = f1_report(df, ["g"]).first()
    assert r["f1_micro"] == pytest.approx(df.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("int"))).first()[0])
    s = f1_report(df, ["g"], swap=True).first()
    assert s["f1_macro"] == pytest.approx(r["f1_macro"]) and s["f1_weighted"] != pytest.approx(r["f1_weighted"])


def test_auc_ignores_monotone_maps(spark):
    df = spark.range(400).select(F.lit("l").alias("label"), (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") * 17 % 90 / 10.0).alias("score"))
    a = roc_auc(df).first()["auc"]
    b = roc_auc(df.withColumn("score", F.exp("score") * 3 - 1)).first()["auc"]
    rows = df.collect()
    pos, neg = [r["score"] for r in rows if r["y"]], [r["score"] for r in rows if not r["y"]]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert a == pytest.approx(want) and b == pytest.approx(want)


def test_intermediate_files_go_with_the_application(spark):
    import os

    from codestrata.session import cut, own_folder, release

    df = cut(spark.range(10))
    folder = own_folder(spark).removeprefix("file:")
    assert df.count() == 10 and any(n.startswith("cut-") for n in os.listdir(folder))
    release(spark)
    assert not os.path.exists(folder)


def test_separators_are_literal(spark):
    from codestrata.sources.files import keyed_lines

    for sep in (".", "|", "\\", "||", "*", " "):
        row = keyed_lines(spark.createDataFrame([(sep.join(["k", "1", "2"]),)], "value string"), "value", sep).first()
        assert tuple(row) == ("k", ["1", "2"]), sep


def test_export_counts_and_text(spark, tmp_path):
    from codestrata.sources.files import export_corpus, export_counts, write_corpus

    df = spark.createDataFrame([("h", 1, ["a"]), ("h", 2, ["b"]), ("g", 3, ["c"])], "h string, i int, ins array<string>")
    assert tuple(export_counts(df, "h").first()) == (3, 2)
    write_corpus(export_corpus(df, "h", "ins", ["i"]), str(tmp_path / "out"))
    assert sorted(r[0].split()[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["a", "c"]


def test_functions_are_stored_once(spark, tmp_path):
    from codestrata.sources.files import write_functions

    rows = [("p", "gcc", "O0", "f", "g"), ("p", "gcc", "O0", "f", "g"), ("p", "gcc", "O1", "f", "g")]
    df = spark.createDataFrame(rows, "project string, compiler string, optimization string, file_name string, function_name string")
    for _ in range(2):
        write_functions(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_look_up_moves_no_rows_for_a_small_table(spark, monkeypatch):
    from codestrata import scale

    big = spark.createDataFrame([(i, "a" if i % 3 else f"t{i}") for i in range(300)], "k long, t string")
    small = spark.createDataFrame([("a", 1), ("t3", 2), ("t9", 3)], "t string, v int")
    got = lambda how: sorted(map(str, scale.look_up(big, small, ["t"], how, ["k"]).select("k", "t", "v").collect()))
    joined = {how: got(how) for how in ("inner", "left")}
    assert "BroadcastHashJoin" in scale.look_up(big, small, ["t"])._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(scale, "SMALL_ROWS", 2)
    assert joined == {how: got(how) for how in joined}


def test_batches_make_their_pairs_once(spark):
    from codestrata.operators.split import batches

    made = spark.sparkContext.accumulator(0)

    def counted(it):
        for b in it:
            made.add(b.num_rows)
            yield b

    rows = [("t" if i % 3 else None, i % 2, i // 2, i, y) for i in range(400) for y in (1, -1)]
    pairs = spark.createDataFrame(rows, "fold string, epoch int, id_a long, id_b long, y int")
    got = batches(pairs.mapInArrow(counted, pairs.schema), 10).collect()
    assert made.value == len(rows) == len(got)
    ids = {}
    for f, e, a, _, _ in rows:
        ids.setdefault((f, e), set()).add((hashlib.md5(f"batch:{e}:{a}".encode()).hexdigest(), a))
    want = {(*k, a): i // 5 for k, v in ids.items() for i, (_, a) in enumerate(sorted(v))}
    assert all(r["batch"] == want[r["fold"], r["epoch"], r["id_a"]] for r in got)


def test_positions_of_groups_in_pieces(spark):
    from codestrata.operators.split import _positions

    rows = [(i, None if i % 5 == 0 else "p", "f", f"n{0 if i % 7 else 1}", "train" if i % 2 else "test") for i in range(600)]
    df = spark.createDataFrame(rows, "id long, project string, file_name string, function_name string, fold string")
    whole, pieces = (sorted(map(tuple, _positions(df, "fold", n).collect())) for n in (1000, 9))
    assert whole == pieces and len(whole) == 600
    at = {(r[0], r[3] + r[2] - 1) for r in whole}
    assert at == {(f, i) for f in ("train", "test") for i in range(300)}
