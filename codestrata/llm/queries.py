"""The corpus operators as queries over the given tables, and the SQL that checks those that SQL can express."""

from __future__ import annotations

import functools
import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import embedding_dedup, language_id, line_dedup, mixing, phrase_mining, pii, prefix_bpe, sentence_pieces, simhash_dedup, spelling_variants, token_counts, token_store, topk_search
from codestrata.session import own_folder

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
WORD_BPE = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@functools.cache
def _vocabulary(name: str) -> str:
    """A vocabulary file, read on the driver."""
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


@functools.cache
def piece_model() -> sentence_pieces.Model:
    return sentence_pieces.load_model(public_tokenizers.path(PIECES))


def _hex64(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1_SQL = f"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, {BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(rows) AS line, generate_subscripts(rows, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS rows FROM documents))
), repeated AS (
  SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.pos, l.line, r.k IS NOT NULL AND l.doc_id <> r.last AS gone FROM lines l LEFT JOIN repeated r USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


QUERY_STEP = 50  # every vector whose id it divides is a query


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk_search.top_k(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0))


OP2_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, p.vec_id, CAST(list_dot_product(q.x, p.x) AS BIGINT) AS score FROM v q JOIN v p ON q.vec_id <> p.vec_id WHERE q.vec_id % {QUERY_STEP} = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return embedding_dedup.near_duplicates(vectors).select("vec_id", "n_links", "component_id", "kept")


OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
reached(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
roots AS (SELECT a, min(b) AS root FROM reached GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, root AS component_id, root = vec_id AS kept
FROM embeddings JOIN roots ON roots.a = vec_id LEFT JOIN counts ON counts.a = vec_id
"""


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), _vocabulary(BYTE_BPE))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of ids, checksum of the ids as little-endian 32-bit numbers, hash of the text decoded from them."""
    model = piece_model()
    encoded = sentence_pieces.encode_pieces(_table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    decoded = sentence_pieces.decode_pieces(encoded, model, out="decoded")
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = language_id.train(docs.where(~language_id.held_out()))
    found = language_id.predict(docs.select("doc_id", "text"), net)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k.name) for k in pii.KINDS],
        F.sha2(pii.digest(F.col("spans"), base_only=True), 256).alias("base_sha256"),
        pii.digest(F.col("spans")).alias("spans"),
    )


def _op7_kind(no: int, kind: str, pattern: str, ok: str) -> str:
    """Spans of one kind: matches and the gaps between them alternate, so lengths give positions."""
    start = "list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)"
    return f"""
  SELECT doc_id, {no} AS no, '{kind}' AS kind, {start} AS s, {start} + length(hits[i]) AS e
  FROM (SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS i
        FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS hits, string_split_regex(t, '{pattern}') AS gaps FROM d))
  WHERE {ok}"""


DIGITS = "regexp_replace(hits[i], '[^0-9]', '', 'g')"
OP7_LUHN = f"""length({DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length({DIGITS}) + 1),
    lambda p: CASE WHEN p % 2 = 1 THEN CAST(reverse({DIGITS})[p] AS INT) ELSE (CAST(reverse({DIGITS})[p] AS INT) * 2) // 10 + (CAST(reverse({DIGITS})[p] AS INT) * 2) % 10 END)) % 10 = 0"""
OP7_IBAN = """list_reduce(list_prepend(0, list_transform(string_split(substr(replace(hits[i], ' ', ''), 5) || substr(replace(hits[i], ' ', ''), 1, 4), ''), lambda c: ascii(c))),
    lambda a, v: CASE WHEN v >= 65 THEN (a * 100 + v - 55) % 97 ELSE (a * 10 + v - 48) % 97 END) = 1"""
OP7_NEAR = "regexp_matches(lower(right(gaps[i], 48) || ' ' || left(gaps[i + 1], 48)), 'ssn|social security|insurance')"
OP7_KINDS = [
    ("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "true"),
    ("ip", "[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)", "list_max(list_transform(string_split(hits[i], '.'), lambda x: CAST(x AS DOUBLE))) <= 255"),
    ("card", "[0-9](?:[ -]?[0-9])+", OP7_LUHN),
    ("phone", "\\+[0-9][ ().0-9-]+[0-9]", f"length({DIGITS}) BETWEEN 9 AND 15"),
    ("iban", "\\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\\b", OP7_IBAN),
    ("ssn", "\\b[0-9]{3}-[0-9]{2}-[0-9]{4}\\b", OP7_NEAR),
]
OP7_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_op7_kind(no, *k) for no, k in enumerate(OP7_KINDS))})
SELECT d.doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, _, _ in OP7_KINDS)},
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) FILTER (no < 4), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) FILTER (kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
"""

def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{own_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_store.write_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), _vocabulary(BYTE_BPE), path)
    return token_store.read_documents(spark, path).withColumnRenamed("id", "doc_id")


# the target mix: a tree of domain (three parts of the sources), language and source
DOMAIN = "concat('part', try_cast(substr(source, 4) AS int) % 3)"
MIX_WEIGHTS = {"domain": {"part0": 5, "part1": 3, "part2": 2}, "lang": {"en": 6, "de": 2}, "source": {"src0": 4, "src1": 2}}
MIX_SHARE = (1, 2)
MIX_EPOCHS = 2


def mix_levels() -> dict[str, Column]:
    return {"domain": F.expr(DOMAIN), "lang": F.col("lang"), "source": F.col("source")}


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mixing.mix(docs, mix_levels(), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS)
    return mixed.select(F.col("id").alias("doc_id"), "tokens", "epochs", "prefix")


def _op9_level(depth: int) -> str:
    """Quotas of one level of the tree, from those of the level above."""
    names = ["domain", "lang", "source"]
    level, path, parent = names[depth], ", ".join(names[: depth + 1]), ", ".join(names[:depth])
    above = f"JOIN quota{depth - 1} USING ({parent})" if depth else "CROSS JOIN (SELECT least(sum(available) // 2, sum(available) * 2) AS budget FROM leaves)"
    part = f"PARTITION BY {parent}" if parent else ""
    weight = " ".join(f"WHEN '={k}' THEN {w}" for k, w in MIX_WEIGHTS[level].items())
    order = f"({part} ORDER BY cap / weight, {level} ROWS BETWEEN"
    return f"""
nodes{depth} AS (SELECT {path}, cap, weight, budget FROM
  (SELECT {path}, sum(available) * 2 AS cap, CASE {level} {weight} ELSE 1 END AS weight FROM leaves GROUP BY {path}) {above}),
over{depth} AS (SELECT *, max(CASE WHEN cap * rest > weight * (budget - before) THEN 1 ELSE 0 END) OVER {order} UNBOUNDED PRECEDING AND CURRENT ROW) AS open
  FROM (SELECT *, sum(cap) OVER {order} UNBOUNDED PRECEDING AND CURRENT ROW) - cap AS before, sum(weight) OVER {order} CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM nodes{depth})),
part{depth} AS (SELECT *, CASE WHEN open = 1 THEN (weight * remains) // wide ELSE cap END AS part, sum(open) OVER {order} UNBOUNDED PRECEDING AND CURRENT ROW) AS turn
  FROM (SELECT *, budget - sum(CASE WHEN open = 0 THEN cap ELSE 0 END) OVER ({part}) AS remains, sum(CASE WHEN open = 1 THEN weight ELSE 0 END) OVER ({part}) AS wide FROM over{depth})),
quota{depth} AS (SELECT {path}, part + CASE WHEN open = 1 AND turn <= lost THEN 1 ELSE 0 END AS budget
  FROM (SELECT *, remains - sum(CASE WHEN open = 1 THEN part ELSE 0 END) OVER ({part}) AS lost FROM part{depth}))"""


OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens,
    coalesce('=part' || CAST(CAST(substr(source, 4) AS INT) % 3 AS VARCHAR), '') AS domain, coalesce('=' || lang, '') AS lang, coalesce('=' || source, '') AS source FROM documents
), leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS HUGEINT) AS available FROM d GROUP BY ALL),
{",".join(_op9_level(i) for i in range(3))},
q AS (SELECT domain, lang, source, CASE WHEN available > 0 THEN budget // available ELSE 0 END AS whole,
  budget - (CASE WHEN available > 0 THEN budget // available ELSE 0 END) * available AS rest FROM leaves JOIN quota2 USING (domain, lang, source)),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('42:' || whole || ':' || doc_id), doc_id) - tokens AS before FROM d JOIN q USING (domain, lang, source))
SELECT doc_id, tokens, CAST(CASE WHEN tokens > 0 THEN whole ELSE 0 END AS BIGINT) AS epochs, CAST(greatest(0, least(tokens, rest - before)) AS BIGINT) AS prefix FROM r
"""


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.simhash_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), _hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


_OP11_SCORE = "(CAST(1000 AS HUGEINT) * a * n) // (CAST(l AS HUGEINT) * r)"
OP11_SQL = f"""
WITH pieces AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
), lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lists GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
phrases AS (SELECT lang, w[i : i + k - 1] AS p FROM starts, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, p, count(*) AS f FROM phrases GROUP BY lang, p HAVING count(*) >= 100),
cuts AS (SELECT c.lang, c.p, c.f AS a, k, x.f AS l, y.f AS r, n
  FROM (SELECT *, unnest(range(1, len(p))) AS k FROM f WHERE len(p) > 1) c
  JOIN f x ON x.lang = c.lang AND x.p = c.p[1 : k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1 : len(c.p)] JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT *, CAST({_OP11_SCORE} AS BIGINT) AS score, row_number() OVER (PARTITION BY lang, p ORDER BY {_OP11_SCORE}, k) AS turn FROM cuts),
inner_parts AS (SELECT lang, p[i : i + k - 1] AS p, max(f) AS f FROM (SELECT *, unnest(range(1, len(p) - k + 2)) AS i FROM (SELECT *, unnest(range(2, len(p))) AS k FROM f WHERE len(p) > 2)) GROUP BY ALL),
kept AS (SELECT l.* FROM lowest l LEFT JOIN inner_parts s ON s.lang = l.lang AND s.p = l.p WHERE turn = 1 AND (s.f IS NULL OR 100 * s.f < 100 * a)),
ranked AS (SELECT *, array_to_string(p, ' ') AS phrase FROM kept),
numbered AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked)
SELECT lang, rank, phrase, a, l, r, n, score FROM numbered WHERE rank <= 2000
"""


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling_variants.word_counts(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spelling_variants.variant_groups(words)


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = _vocabulary(WORD_BPE)
    encoded = prefix_bpe.encode_words(_table(spark, sf_dir, "documents").select("doc_id", "text"), spec)
    decoded = prefix_bpe.decode_words(encoded, spec, out="decoded")
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_topk_search": op2_topk_search,
    "op3_token_counts": op3_token_counts,
    "op4_sentence_pieces": op4_sentence_pieces,
    "op5_language_id": op5_language_id,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_pii": op7_pii,
    "op8_token_store": op8_token_store,
    "op9_mixing": op9_mixing,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_phrases": op11_phrases,
    "op12_spelling": op12_spelling,
    "op13_word_bpe": op13_word_bpe,
}
ORACLES = {"op1_line_dedup": OP1_SQL, "op2_topk_search": OP2_SQL, "op6_embedding_dedup": OP6_SQL, "op7_pii": OP7_SQL, "op9_mixing": OP9_SQL, "op11_phrases": OP11_SQL}
