"""Mixing against the same rules in plain Python with fractions."""

import hashlib
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from codestrata.llm.mixing import mix, taken

LEVELS = ("domain", "lang", "source")
WEIGHTS = {"domain": {"a": 5, "b": 1}, "lang": {"en": 3}, "source": {"s0": 4, "s1": 2}}


def fill(children, budget):
    """{name: quota}: by repeated sharing; children are (name, cap, weight)."""
    todo, out, left = sorted(children), {}, budget
    while True:
        wide = sum(w for _, _, w in todo)
        full = [c for c in todo if Fraction(c[1]) <= Fraction(left * c[2], wide)] if todo else []
        if not full:
            break
        for c in full:
            out[c[0]] = c[1]
            left -= c[1]
            todo.remove(c)
    wide = sum(w for _, _, w in todo)
    order = sorted(todo, key=lambda c: (c[1] / c[2], c[0]))
    for n, c, w in order:
        out[n] = left * w // wide if wide else 0
    for n, _, _ in order[: left - sum(out[n] for n, _, _ in order)]:
        out[n] += 1
    return out


def plain(rows, share, epochs, seed=42):
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    path = [tuple("" if v is None else f"={v}" for v in r[2:5]) for r in rows]
    cap = lambda p: sum(w for w, q in zip(words, path) if q[: len(p)] == p) * epochs
    quota = {(): min(sum(words) * share[0] // share[1], cap(()))}
    for depth, level in enumerate(LEVELS):
        for parent in [p for p in quota if len(p) == depth]:
            names = sorted({q[depth] for q in path if q[:depth] == parent})
            own = [(n, cap((*parent, n)), WEIGHTS[level].get(n[1:] if n else None, 1)) for n in names]
            quota |= {(*parent, n): v for n, v in fill(own, quota[parent]).items()}
    out = []
    for leaf in set(path):
        own = [i for i, p in enumerate(path) if p == leaf]
        all_ = sum(words[i] for i in own)
        whole = quota[leaf] // all_ if all_ else 0
        rest = quota[leaf] - whole * all_
        turn = lambda i: hashlib.md5(f"{seed}:{whole}:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest()  # noqa: B023, E731
        for i in sorted(own, key=turn):
            part = min(words[i], rest)
            rest -= part
            out.append((rows[i][0], words[i], whole if words[i] else 0, part))
    return sorted(out, key=repr)


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.4
        path = ("a", "en", "s0") if hot else (rng.choice(["a", "b", "c", None]), rng.choice(["en", "de", None]), f"s{rng.randrange(6)}")
        rows.append((i, " ".join(["w"] * rng.randrange(60)), *path))
    return rows


CASES = {
    "empty": [],
    "nulls": [(1, None, None, None, None), (None, "a b", None, "en", None), (3, "", "a", "en", "s0"), (4, "x y z", "", "en", "")],
    "no tokens": [(1, " ", "a", "en", "s0"), (2, None, "b", "en", "s0")],
    "very long": [(1, "w " * 300_000, "a", "en", "s0"), (2, "w", "b", "de", "s1"), (3, "w w w", "b", "de", "s2")],
    "corpus": corpus(400, 1),
}


def mixed(spark, rows, share, epochs, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string, lang string, source string").repartition(5)
    return df, mix(df, {c: F.col(c) for c in LEVELS}, WEIGHTS, share, epochs, **kw)


@pytest.mark.parametrize(("share", "epochs"), [((1, 2), 1), ((3, 1), 4)])
@pytest.mark.parametrize("case", CASES)
def test_by_definition(spark, case, share, epochs):
    _, out = mixed(spark, CASES[case], share, epochs)
    assert sorted([(r["id"], r["tokens"], r["epochs"], r["prefix"]) for r in out.collect()], key=repr) == plain(CASES[case], share, epochs)


def test_repeated_rows_fill_the_quota(spark):
    rows = [(7, "a b c", "a", "en", "s0")] * 5
    _, out = mixed(spark, rows, (1, 2), 1)
    assert sum(r["prefix"] for r in out.collect()) == 15 // 2


def test_taken_keeps_columns_and_whole_documents(spark):
    rows = corpus(120, 2)
    df, out = mixed(spark, rows, (1, 2), 1)
    df = df.withColumn("tokens", F.lit("own")).withColumn("row", F.lit(1))
    got = taken(df, out)
    assert got.columns == df.columns
    want = {i for i, t, e, p in plain(rows, (1, 2), 1) if e or (t and p == t)}
    assert {r["doc_id"] for r in got.collect()} >= want and 0 < len(want) < 120


def test_no_python_in_the_plan(spark):
    _, out = mixed(spark, CASES["nulls"], (1, 2), 1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_whole_documents_fill_the_quota_beside_very_long_ones(spark):
    """A long document early in the order must not cost its leaf the rest of the quota."""
    rows = [(i, "w " * (1000 if i % 20 == 3 else 1 + i % 7), f"s{i % 2}") for i in range(80)] + [(None, "x y", "s0"), (5, None, "s1"), (6, "same", "s1"), (6, "same", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, leaf string")
    size = lambda t: len((t or "").split())
    for share in ((1, 20), (1, 2), (9, 10)):
        found = mix(docs, {"source": F.col("leaf")}, {}, share)
        kept = taken(docs, found)
        assert kept.columns == docs.columns
        got = kept.collect()
        quota = {r["leaf"]: r["q"] for r in found.groupBy("leaf").agg(F.sum(F.col("tokens") * F.col("epochs") + F.col("prefix")).alias("q")).collect()}
        for leaf in ("s0", "s1"):
            used = sum(size(r["text"]) for r in got if r["leaf"] == leaf)
            (want,) = (q for name, q in quota.items() if leaf in name)
            left = [t for k, t, s in rows if s == leaf and size(t) and (k, t) not in {(r["doc_id"], r["text"]) for r in got}]
            assert used <= want and all(size(t) * sum(x == t for x in left) > want - used or size(t) > want - used for t in left), (share, leaf, used, want)
    assert taken(docs.limit(0), mix(docs.limit(0), {"source": F.col("leaf")}, {})).collect() == []
