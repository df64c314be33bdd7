"""Personal data against the plain patterns, tried one match after the other in Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from codestrata.llm.pii import digest, find_personal_data, masked, prefix_sums

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    """[(start, kind number, end, kind)] of the base kinds."""
    out = []
    for no, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind != "ip" or all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), no, m.end(), kind))
    return sorted(out)


def noise(seed, n):
    rng = random.Random(seed)
    bits = ["a@b.c", "@", ".", "%", "_", "-", "+", " ", "1", "255", "0256", "7.7.7.7", "4111 1111 1111 1111", "4242-4242-4242-4242", "+1 (565) 555-5579", "é", "😀", "x", "12", "\n", "(", "Z"]
    return ["".join(rng.choices(bits, k=rng.randrange(1, 30))) for _ in range(n)]


TEXTS = [
    None,
    "",
    "a@b.c_d@e.f a@b.c%d@e.f. a@b@c.d @x.y x@y..z x@-.-",
    "1.2.3.4.5.6.7.8 256.1.1.1 000000255.0.0.00001 1.2.3 1..2.3.4.5",
    "4111111111111111 41111111111111110000 1 4111111111111111 1  4111-1111 1111-1111 x4111 1111 1111 1111 ",
    "+1 (565) 555-5579 +1+49 30 1234567 +123 ++44 20 7946 0958.",
    "ünïcode 😀 before x@y.zz",
]
SHAPES = [("a.", ""), ("a.b@c", ".d"), ("1 ", ""), ("9", ""), ("+1", " "), ("1.1.1.1 ", ""), ("0", ""), ("x@y.z ", "")]
LONG = [a + b * 1000 if b else a * 1000 for a, b in SHAPES]


def base_spans(row):
    return [(s["start"], s["kind_no"], s["end"], s["kind"]) for s in row["spans"] if s["kind_no"] < 4]


@pytest.mark.parametrize("texts", [TEXTS, noise(1, 1500), LONG, []], ids=["chosen", "noise", "long", "empty"])
def test_base_spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: base_spans(r) for r in find_personal_data(df).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_very_long_texts(spark):
    """Shapes on which the plain patterns take quadratic time."""
    rows = [(i, a + b * 100_000 if b else a * 20_000 if "@" in a or "." in a[1:2] and a != "a." else a * 100_000) for i, (a, b) in enumerate(SHAPES)]
    out = find_personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    got = {r["doc_id"]: base_spans(r) for r in out.collect()}
    assert {i: len(s) for i, s in got.items()} == {0: 0, 1: 1, 2: 0, 3: 0, 4: 0, 5: 20_000, 6: 0, 7: 20_000}
    assert got[1] == [(0, 0, 200_005, "email")] and got[5][-1] == (159_992, 1, 159_999, "ip")


def test_added_kinds_and_context(spark):
    rows = [
        (1, "iban GB82 WEST 1234 5698 7654 32 paid"),
        (2, "iban GB82 WEST 1234 5698 7654 33 paid"),
        (3, "DE89370400440532013000"),
        (4, "my SSN is 123-45-6789"),
        (5, "code 123-45-6789 of a part"),
        (6, "call +1 (565) 555-5579"),
    ]
    out = find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"], round(s["score"], 1)) for s in r["spans"]] for r in out.collect()}
    assert got == {1: [("iban", 5, 32, 1.0)], 2: [], 3: [("iban", 0, 22, 0.8)], 4: [("ssn", 10, 21, 0.5)], 5: [], 6: [("phone", 5, 22, 0.8)]}


def test_columns_digest_and_mask(spark):
    rows = [(1, "x@y.zz and 7.7.7.7", "old", "w"), (None, None, "old", "w"), (1, "x@y.zz and 7.7.7.7", "old", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, score string")
    out = find_personal_data(df)
    assert out.columns == ["doc_id", "text", "score", "spans"]
    told = out.select("doc_id", digest(F.col("spans")).alias("d"), masked(F.col("spans"), F.col("text")).alias("m")).collect()
    assert sorted(map(tuple, told), key=repr) == [(1, "email:0:6,ip:11:18", "[EMAIL] and [IP]")] * 2 + [(None, "", "")]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_prefix_sums(spark, n):
    values = [(i * 7) % 11 for i in range(n)]
    df = spark.createDataFrame([(values,)], "v array<long>")
    assert df.select(prefix_sums(F.col("v"))).first()[0] == [sum(values[:i]) for i in range(n)]


def test_no_python_in_the_plan(spark):
    df = find_personal_data(spark.createDataFrame([(1, "x")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_columns_named_like_working_columns(spark):
    names = ["text", "found", "found_gaps", "found_steps", "found_before", "row", "every", "__pii", "__pii_gaps"]
    docs = spark.createDataFrame([("mail a@b.com", *range(8))], ", ".join(f"`{n}` {'string' if n == 'text' else 'long'}" for n in names))
    (got,) = find_personal_data(docs).collect()
    assert list(got.asDict()) == [*names, "spans"] and list(got)[:9] == ["mail a@b.com", *range(8)]
    assert [(s["kind"], s["start"], s["end"]) for s in got["spans"]] == [("email", 5, 12)]
