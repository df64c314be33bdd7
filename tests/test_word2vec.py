"""Token vectors of several tasks put tokens of like company near each other."""

import random
from statistics import mean

from codestrata.operators.vectorize import word2vec


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5


def test_company_in_several_tasks(spark):
    rng = random.Random(1)
    groups = [[f"{g}{i}" for i in range(8)] for g in "abc"]
    texts = [(i, [rng.choice(groups[i % 3]) for _ in range(30)]) for i in range(900)] + [(900, []), (901, ["once"])]
    got = word2vec(spark.createDataFrame(texts, "index long, tokens array<string>"), size=24, partitions=4, iterations=3).collect()
    vectors = {r["token"]: r["vec"] for r in got}
    assert set(vectors) == {t for g in groups for t in g} and {len(v) for v in vectors.values()} == {24}
    assert sorted(r["id"] for r in got) == list(range(24))
    near = mean(cosine(vectors[a], vectors[b]) for g in groups for a in g for b in g if a < b)
    far = mean(cosine(vectors[a], vectors[b]) for g in groups for h in groups if g is not h for a in g for b in h)
    assert near > far + 0.3


def test_no_vector_on_the_driver(spark, monkeypatch):
    """Texts are dealt to as many tasks as their tokens ask for, and vectors come from tables only."""
    from codestrata.operators import vectorize

    assert not hasattr(vectorize, "Word2Vec")  # the library's trainer holds the whole matrix on the driver
    monkeypatch.setattr(vectorize, "PART_TOKENS", 100)
    rows = [(i, [f"t{(i + j) % 50}" for j in range(20)]) for i in range(100)] + [(100, None)]
    df = spark.createDataFrame(rows, "index long, tokens array<string>")
    got = {r["token"]: r for r in word2vec(df, size=8, partitions=2).collect()}
    again = {r["token"]: r for r in word2vec(df, size=8, partitions=2).collect()}
    assert len(got) == 50 and sorted(r["id"] for r in got.values()) == list(range(50))
    assert all(max(abs(x - y) for x, y in zip(got[t]["vec"], again[t]["vec"])) < 1e-4 for t in got)
    assert word2vec(df.limit(0), size=8).count() == 0
