"""Folds alike in every label pair, next to the row-by-row greedy rule."""

import random
from collections import Counter

from codestrata.operators.split import stratified_pairs_split

SHARES = {"test": 0.15, "dev": 0.15, "train": 0.7}


def pairs_of(y):
    at = [i for i, v in enumerate(y or []) if v == 1]
    return [(a, b) for a in at for b in at if a <= b] or [None]


def plain(rows):
    """Iterative stratification: rows of the rarest open pair go, one by one, to the fold that wants the pair most."""
    left = dict(rows)
    want = {f: Counter({q: s * n for q, n in Counter(q for y in left.values() for q in pairs_of(y)).items()}) for f, s in SHARES.items()}
    room = {f: s * len(left) for f, s in SHARES.items()}
    folds = {}
    while left:
        open_pairs = Counter(q for y in left.values() for q in pairs_of(y))
        rarest = min(open_pairs, key=lambda q: (open_pairs[q], str(q)))
        for k in [k for k, y in left.items() if rarest in pairs_of(y)]:
            f = max(SHARES, key=lambda f: (want[f][rarest], room[f], f))
            folds[k], room[f] = f, room[f] - 1
            for q in pairs_of(left.pop(k)):
                want[f][q] -= 1
    return folds


def distances(rows, folds):
    total = Counter(q for _, y in rows for q in pairs_of(y))
    got = Counter((q, folds[k]) for k, y in rows for q in pairs_of(y))
    return {(q, f): abs(got[q, f] - s * n) for q, n in total.items() for f, s in SHARES.items()}


def split(spark, rows):
    df = spark.createDataFrame(rows, "index long, Y array<int>")
    got = stratified_pairs_split(df, "index").collect()
    assert len(got) == len(rows)
    return {r["index"]: r["fold"] for r in got}


def labelled(n, labels, seed):
    rng = random.Random(seed)
    rates = [0.6 / (i + 1) for i in range(labels)]
    return [(i, [int(rng.random() < p) for p in rates]) for i in range(n)]


def test_every_pair_near_its_share(spark):
    for n, labels, seed in [(400, 4, 1), (900, 6, 2), (60, 3, 3)]:
        rows = labelled(n, labels, seed)
        ours, theirs = distances(rows, split(spark, rows)), distances(rows, plain(rows))
        total = Counter(q for _, y in rows for q in pairs_of(y))
        assert max(v for (q, _), v in ours.items() if total[q] >= 7) <= 1
        assert max(ours.values()) <= max(1, *theirs.values())


def test_repeats_and_order_do_not_matter(spark):
    rows = labelled(200, 4, 5)
    assert split(spark, rows) == split(spark, rows[::-1])


def test_hot_set_and_odd_rows(spark):
    rows = [(i, [1, 0, 0]) for i in range(500)] + [(500 + i, [1, 1, 0]) for i in range(20)] + [(600 + i, None) for i in range(20)] + [(700 + i, []) for i in range(20)]
    folds = split(spark, rows)
    assert Counter(folds[i] for i in range(500)) == {"test": 75, "dev": 75, "train": 350}
    assert max(distances(rows, folds).values()) <= 1
    same = spark.createDataFrame([(1, [1, 0])] * 100, "index long, Y array<int>")
    clashing = same.selectExpr("*", "7 AS test", "8 AS dev", "9 AS n", "1 AS pairs", "2 AS round")
    assert {tuple(r)[2:] for r in stratified_pairs_split(clashing, "index").drop("fold").collect()} == {(7, 8, 9, 1, 2)}
    assert Counter(r["fold"] for r in stratified_pairs_split(same, "index").collect()) == {"test": 15, "dev": 15, "train": 70}
    assert stratified_pairs_split(same.limit(0), "index").columns == ["index", "Y", "fold"]
    assert stratified_pairs_split(same.limit(0), "index").collect() == []
