"""Near copies by shingles against brute force over all pairs."""

import random
import re

import corpus_pipeline
from codestrata.llm.near_copies import band_keys, drop_similar, shingles, similar, similar_components


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(rows):
    """{id: smallest id reachable} by comparing all pairs."""
    sets = {k: plain_set(t) for k, t in rows}
    root = {k: k for k in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            shared = len(sets[a] & sets[b])
            if 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def edited(seed, groups, copies, most):
    """Texts and copies of them with up to ``most`` of 60 to 300 words replaced."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for _ in range(groups):
        base = rng.choices(words, k=rng.randrange(60, 300))
        for _ in range(copies):
            text = list(base)
            for at in rng.sample(range(len(text)), rng.randrange(most + 1)):
                text[at] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    return rows


def test_against_all_pairs(spark):
    rows = edited(1, 40, 8, 6) + [(1000, None), (1001, " "), (1002, "Two words"), (1003, "two  WORDS"), (1004, "two other")]
    want = plain_components(rows)
    assert 60 < len(set(want.values())) < len(rows) - 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["id"]: r["component_id"] for r in similar_components(docs).collect()} == want
    assert {r["doc_id"] for r in drop_similar(docs).collect()} == set(want.values())


def test_large_group(spark):
    rows = edited(2, 1, 400, 4) + [(k + 400, t) for k, t in edited(3, 1, 60, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["id"]: r["component_id"] for r in similar_components(docs).collect()} == plain_components(rows)


def test_crowded_keys_take_few_turns(spark, monkeypatch):
    """Texts with one passage in common share keys but are not alike; the tables written do not go by the number of leaders."""
    from codestrata.llm import near_copies as module

    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(40)])) for i in range(150)] + edited(6, 3, 20, 6)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    written = []
    monkeypatch.setattr(module, "cut", lambda d, real=module.cut: written.append(1) or real(d))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["id"]: r["component_id"] for r in similar_components(docs).collect()} == plain_components(rows)
    assert len(written) <= 4 + 4 * 4


def test_pairs_at_the_threshold_meet():
    rng = random.Random(4)
    met = 0
    for _ in range(500):
        base = [f"w{rng.randrange(10**6)}" for _ in range(40)]
        a, b = base[:36], base[:36] + base[36:40]  # 32 of 36 shingles, then further from one side
        x, y = shingles(" ".join(a).encode()), shingles(" ".join(b + ["x"] * 4).encode())
        assert similar(x.tobytes(), y.tobytes()) == (len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.8)
        assert similar(x.tobytes(), y.tobytes())
        met += bool(set(band_keys(x)) & set(band_keys(y)))
    assert met == 500


def test_stage_of_the_pipeline(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = set(plain_components([(r["doc_id"], r["text"]) for r in docs.collect()]).values())
    assert {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, "").collect()} == want


def test_stage_links_close_fingerprints_too(spark):
    """Texts that SimHash links below a Jaccard similarity of 0.8 stay once, with all that either of them is linked to."""
    from codestrata.llm.simhash_dedup import RADIUS, fingerprint

    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    apart = lambda a, b: (fingerprint(a.encode()) ^ fingerprint(b.encode())).bit_count()
    alike = lambda a, b: similar(shingles(a.encode()).tobytes(), shingles(b.encode()).tobytes())
    while True:  # one sentence over and over outweighs the words that differ
        often = " ".join(rng.choices(words, k=6))
        a, b = (" ".join([often] * 60 + rng.choices(words, k=20)) for _ in range(2))
        if apart(a, b) <= RADIUS and not alike(a, b):
            break
    c = b + " " + b.split()[-1]  # alike b
    assert alike(b, c) and not alike(a, c)
    rows = [(3, a), (5, b), (4, c), (4, "another text of the same id"), (7, "a text of its own"), (None, b), (8, None), (9, " ")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted([(3, a), (4, "another text of the same id"), (7, "a text of its own"), (8, None)], key=lambda r: r[0])
