"""SimHash near-duplicates against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from codestrata.llm.components import components, forest
from codestrata.llm.simhash_dedup import BLOCK, _numbered, close_stars, drop_near_copies, fingerprint, grow, route, simhash_components


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """[(id, fingerprint, smallest id reachable)] by comparing all pairs."""
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted([(rows[i][0], fps[i], least.get(find(i))) for i in range(len(rows))], key=repr)


def got(df):
    return sorted([(r["id"], r["fp"] % 2**64, r["component_id"]) for r in df.collect()], key=repr)


def sentences(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    base = [" ".join(rng.choices(words, k=300)) for _ in range(12)]
    rows = []
    for i in range(n):
        text = base[rng.randrange(len(base))].split()
        for _ in range(rng.randrange(5)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))
    return rows


CASES = {
    "empty": [],
    "nulls and blanks": [(1, None), (2, ""), (None, " \t\n"), (3, "One"), (4, "oNE"), (5, "one  two"), (None, None)],
    "no ids": [(None, "a b c d"), (None, "a b c d"), (None, "quite another text here")],
    "repeated rows": [(7, "a b c d e"), (7, "a b c d e"), (7, "something else entirely, said twice"), (2, "A B\tC d e")],
    "not ascii": [(1, "É é   x y"), (2, "é é   x y"), (3, "\x1c a b c")],
    "very long": [(1, "word " * 200_000), (2, "word " * 199_999), (3, "x" * 300_000)],
    "near": sentences(5, 250),
}


@pytest.mark.parametrize("case", CASES)
def test_by_definition(spark, case):
    rows = CASES[case]
    assert got(simhash_components(spark.createDataFrame(rows, "doc_id long, text string"))) == plain_components(rows)


def test_one_of_each_component_stays(spark):
    rows = CASES["near"] + CASES["repeated rows"]
    rows = [(k, t, f"s{k}", k) for k, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, mark long")
    out = drop_near_copies(df)
    assert out.columns == df.columns
    roots = {}
    for r in simhash_components(df).collect():
        roots.setdefault(r["component_id"], []).append(r["id"])
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(min(v) for v in roots.values())
    assert {tuple(r) for r in out.collect()} <= set(rows)


def balls(rng, n):
    centres = rng.integers(0, 2**63, 20, dtype=np.uint64)
    points = centres[rng.integers(0, 20, n)]
    for _ in range(3):
        points = points ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    return np.unique(np.concatenate((points, rng.integers(0, 2**63, n, dtype=np.uint64))))


def linked(points, a, b):
    """Partition of the points by the edges."""
    nodes, root = forest(a, b)
    of = dict(zip(nodes.tolist(), root.tolist()))
    return [of.get(p, p) for p in points.tolist()]


def test_tree_loses_no_pair():
    rng = np.random.default_rng(2)
    points = balls(rng, 3 * BLOCK)
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 2
    i, j = np.nonzero(np.triu(near, 1))
    assert len(i) > 100
    want = linked(points, points[i], points[j])
    a, b = close_stars(points)
    assert linked(points, a, b) == want
    tree, leaves = _numbered(grow(points[::3], 32, rng))
    assert leaves > 8
    edges = [close_stars(points[at]) for _, at in route(points, tree)]
    assert linked(points, np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])) == want


def test_components_of_a_long_chain(spark):
    rows = [(i, i + 1) for i in range(0, 500)] + [(1000, 1000), (2000, 1999), (2000, 1999)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(16)
    found = {r["node"]: r["root"] for r in components(df).collect()}
    assert found == {i: 0 for i in range(501)} | {1999: 1999, 2000: 1999}
    assert components(df.limit(0)).count() == 0


def test_few_edges_take_no_rounds(spark, monkeypatch):
    from codestrata.llm import components as module

    df = spark.createDataFrame([(i, i + 1) for i in range(500)], "a long, b long").repartition(16)
    written = []
    monkeypatch.setattr(module, "cut", lambda d, real=module.cut: written.append(1) or real(d))
    want = {i: 0 for i in range(501)}
    assert {r["node"]: r["root"] for r in components(df).collect()} == want
    assert len(written) == 2  # every round is a chain of shuffles and one more table
    assert {r["node"]: r["root"] for r in components(df, per_task=40).collect()} == want


def test_few_words():
    assert fingerprint(b"") == 0
    assert fingerprint(b"Two words") == xxhash.xxh64_intdigest(b"two words", seed=42)
