"""Line dedup against a plain definition, and the perfect hash on its own."""

import random

import numpy as np
import pytest

from codestrata.llm.line_dedup import LineIndex, dedup_lines

BLANKS = " \t\n\x0b\x0c\r"
LONG = "a line that is long enough"


def plain(rows):
    """{row number: (kept, n_lines, n_dropped)} by the definition; every row is a document."""
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    lines = [(t or "").split("\n") for _, t in rows]
    key = lambda x: low(x.strip(BLANKS))
    holders = {}
    for n, own in enumerate(lines):
        for k in {key(x) for x in own}:
            holders.setdefault(k, []).append(n)
    value = lambda n: float("-inf") if rows[n][0] is None else rows[n][0]
    out = []
    for n, own in enumerate(lines):
        stay = [
            x for x in own if len(key(x)) < 20 or len(holders[key(x)]) < 3 or value(n) == max(value(h) for h in holders[key(x)])
        ]
        out.append((rows[n][0], "\n".join(stay), len(own), len(own) - len(stay)))
    return sorted(out, key=repr)


def got(df):
    return sorted([(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in df.collect()], key=repr)


CASES = {
    "empty": [],
    "nulls": [(1, None), (2, ""), (None, LONG), (3, LONG), (None, LONG + "\nx")],
    "all ids null": [(None, LONG), (None, LONG), (None, LONG + "\n")],
    "repeated rows": [(5, LONG), (5, LONG), (5, LONG + "\nother"), (4, f"{LONG}\n{LONG}\n")],
    "case and blanks": [(1, LONG.upper() + "\t"), (2, f"\x0b {LONG}"), (3, f"{LONG}\r\nend\n"), (4, LONG.replace("a", "à"))],
    "code points": [(i, "é" * 19 + "\n" + "ü" * 20) for i in range(4)],
    "very long": [(i, "\n".join([LONG] * 20_000 + [f"own line of document {i} " * 2])) for i in range(3)],
}


@pytest.mark.parametrize("case", CASES)
def test_by_definition(spark, case):
    rows = CASES[case]
    assert got(dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_many_shards(spark):
    rng = random.Random(3)
    pool = [f"shared line number {i} of the pool" for i in range(400)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"a line of its own {i} {rng.random()}" for _ in range(9))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got(dedup_lines(df, keys_per_shard=50)) == plain(rows)


def test_other_columns_stay(spark):
    rows = [(i, LONG, i * 2, "z", "m") for i in range(3)]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_lines long, lost string, row string"))
    assert out.columns == ["doc_id", "text", "n_lines", "lost", "row", "n_dropped"]
    assert sorted(map(tuple, out.collect())) == [(0, "", 1, "z", "m", 1), (1, "", 1, "z", "m", 1), (2, LONG, 1, "z", "m", 0)]


def test_index_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, (5000, 2))
    index = LineIndex.load(LineIndex(keys[:, 0], keys[:, 1], np.arange(5000), np.arange(5000) * 7).dump())
    at = index.look_up(keys[:, 0].copy().view(np.uint64), keys[:, 1].copy().view(np.uint64))
    assert sorted(at) == list(range(5000))
    assert (index.count[at] == np.arange(5000)).all() and (index.last[at] == np.arange(5000) * 7).all()
    other = rng.integers(-(2**63), 2**63 - 1, (5000, 2)).view(np.uint64)
    assert (index.look_up(other[:, 0].copy(), other[:, 1].copy()) == -1).all()


def test_only_texts_that_lose_lines_reach_python(spark):
    """Texts that stay as they are take no memory of the Python workers; their lines are counted where they lie."""
    rows = [(i, LONG + "\nx") for i in range(3)] + [(9, "own\n\nlines\n"), (10, "\r\n\x0b é")]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "keep(CASE WHEN isnotnull(lost" in out._jdf.queryExecution().optimizedPlan().toString()
    assert got(out) == plain(rows)
