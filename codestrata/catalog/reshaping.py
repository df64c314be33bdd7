"""Flattening, look-ups, path contexts, call inlining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.catalog import fixtures as fx
from codestrata.catalog.registry import Tables, query
from codestrata.functions import arrays as A
from codestrata.functions import text as X
from codestrata.operators import aggregate as G
from codestrata.operators import reshape as R
from codestrata.operators.vectorize import mean_vectors

PROBLEMS = (
    fx.LABEL_ROWS
    + f""",
problems AS (
  SELECT r.index, r.tags, {fx.PROBLEM_NAME} AS contest_name, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS lines
  FROM label_rows r JOIN documents d ON r.index = d.doc_id)"""
)


@query(
    "filter_relevant",
    f"WITH {PROBLEMS} SELECT index, cast(len(lines) AS int) AS n FROM problems WHERE len(lines) > 0 AND NOT coalesce(contains(contest_name, 'April Fools'), false)",
)
def _(t: Tables) -> DataFrame:
    return R.filter_relevant(fx.problems(t)).select("index", F.size("solutions").alias("n"))


@query(
    "flatten_solutions",
    f"""WITH {PROBLEMS}, s AS (SELECT index AS p, tags, unnest(lines) AS code, generate_subscripts(lines, 1) - 1 AS i FROM problems)
    SELECT concat(p, '-', i) AS index, md5(code) AS digest, array_to_string(tags, ',') AS tags FROM s""",
)
def _(t: Tables) -> DataFrame:
    return R.flatten(fx.problems(t), ["tags"]).select("index", F.md5("code").alias("digest"), F.array_join("tags", ",").alias("tags"))


@query("with_problem", f"WITH {fx.CORPUS} SELECT index, label, split_part(label, '$', 1) AS problem FROM corpus")
def _(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("doc_id").alias("index"), F.concat("source", F.lit("$"), "lang").alias("label"))
    return R.with_problem(rows).select("index", "label", "problem")


# every document line gets braces by its length, so spans nest, close on one line or stay open
BRACED = "concat({x}, CASE length({x}) % 7 WHEN 0 THEN '{{' WHEN 1 THEN '}}' WHEN 2 THEN '{{}}' ELSE '' END)"


@query(
    "remove_spans",
    f"""WITH lines AS (
      SELECT doc_id AS file, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS l FROM documents),
    code AS (SELECT file, pos, CASE WHEN l = '' THEN '' ELSE {BRACED.format(x='l')} END AS l FROM lines),
    findings AS (SELECT doc_id AS file, unnest([1 + doc_id % 3, 4 + doc_id % 5]) AS start FROM documents WHERE doc_id % 2 = 0),
    span AS (
      SELECT c.file, start, pos, sum(length(l) - length(replace(l, '{{', '')) - length(l) + length(replace(l, '}}', ''))) OVER w AS balance,
             max(CASE WHEN contains(l, '}}') THEN 1 ELSE 0 END) OVER w AS seen
      FROM code c JOIN findings f ON c.file = f.file AND pos >= start - 1 WINDOW w AS (PARTITION BY c.file, start ORDER BY pos)),
    ends AS (SELECT file, start, min(CASE WHEN balance = 0 AND seen = 1 THEN pos END) AS stop FROM span GROUP BY ALL),
    gone AS (SELECT DISTINCT s.file, s.pos FROM span s JOIN ends e ON s.file = e.file AND s.start = e.start AND (stop IS NULL OR pos <= stop)),
    kept AS (SELECT c.* FROM code c LEFT JOIN gone g ON c.file = g.file AND c.pos = g.pos WHERE g.file IS NULL AND (l <> '' OR c.file % 2 = 1))
    SELECT d.doc_id AS file, md5(coalesce(string_agg(l, chr(10) ORDER BY pos), '')) AS digest, count(l) AS n_lines
    FROM documents d LEFT JOIN kept k ON d.doc_id = k.file GROUP BY d.doc_id""",
)
def _(t: Tables) -> DataFrame:
    code = F.expr("array_join(transform(split(text, '\\n'), x -> CASE WHEN x = '' THEN '' ELSE " + BRACED.format(x="x") + " END), '\\n')")
    files = t.spread("documents", "doc_id").select(F.col("doc_id").alias("file"), code.alias("code"))
    findings = t.documents.filter(F.col("doc_id") % 2 == 0).select(
        F.col("doc_id").alias("file"), F.explode(F.array(F.col("doc_id") % 3 + 1, F.col("doc_id") % 5 + 4)).alias("line")
    )
    left = R.remove_spans(files, findings)
    return left.select("file", F.md5("code").alias("digest"), F.when(F.col("code") == "", 0).otherwise(F.size(X.lines_of(F.col("code")))).cast("long").alias("n_lines"))


@query(
    "align_views",
    f"""WITH {fx.HALF_VIEWS} SELECT w.problem, w.index, w.label, round(list_sum(w.x), 6) AS s0, round(list_sum(s.x), 6) AS s1, round(list_sum(v.x), 6) AS s2
    FROM w2v w JOIN callees s USING (index) JOIN vectors v USING (index)""",
)
def _(t: Tables) -> DataFrame:
    rows = R.align_views(fx.half_views(t))
    add = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, b: a + b), 6)
    return rows.select("problem", "index", "label", add("x0").alias("s0"), add("x1").alias("s1"), add("x2").alias("s2"))


# ---- vocabularies -------------------------------------------------------------------------------

WORDS = r"""words AS (
  SELECT doc_id AS index, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token, generate_subscripts(regexp_extract_all(lower(text), '[a-z]+'), 1) - 1 AS pos FROM documents),
vocab AS (
  SELECT token, n, row_number() OVER (ORDER BY n DESC, token) - 1 AS id FROM (SELECT token, count(*) AS n FROM words GROUP BY ALL) WHERE n >= 3)"""


def words(t: Tables) -> DataFrame:
    return t.spread("documents", "doc_id").select(
        F.col("doc_id").alias("index"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("tokens")
    )


def vocabulary(t: Tables) -> DataFrame:
    return R.build_vocab(words(t).select(F.explode("tokens").alias("token")), 3)


@query("build_vocab", f"WITH {WORDS} SELECT token, n, id FROM vocab")
def _(t: Tables) -> DataFrame:
    return vocabulary(t)


TOKEN_VECTOR = "[(id % 7) / 7.3, (id % 11) / 11.3, (id % 13) / 13.3]"


def token_vectors(t: Tables) -> DataFrame:
    i = F.col("id")
    return vocabulary(t).withColumn("vec", F.array((i % 7) / 7.3, (i % 11) / 11.3, (i % 13) / 13.3))


@query(
    "lookup_vectors",
    f"""WITH {WORDS}, v AS (SELECT token, {TOKEN_VECTOR} AS vec FROM vocab)
    SELECT index, count(*) AS n, round(avg(vec[1]), 6) AS m1, round(avg(vec[2]), 6) AS m2, round(avg(vec[3]), 6) AS m3 FROM words JOIN v USING (token) GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    hit = R.lookup_vectors(words(t), token_vectors(t), "index")
    at = lambda i: F.round(F.avg(F.get("vec", F.lit(i))), 6)
    return hit.groupBy("index").agg(F.count(F.lit(1)).alias("n"), at(0).alias("m1"), at(1).alias("m2"), at(2).alias("m3"))


@query(
    "encode_tokens",
    f"""WITH {WORDS}, e AS (SELECT w.index, w.pos, coalesce(v.id, (SELECT count(*) FROM vocab)) AS id, CASE WHEN v.id IS NULL THEN concat('[', w.token, ']') ELSE w.token END AS shown
      FROM words w LEFT JOIN vocab v USING (token))
    SELECT index, string_agg(id, ',' ORDER BY pos) AS ids, md5(string_agg(shown, ' ' ORDER BY pos)) AS shown FROM e GROUP BY index""",
)
def _(t: Tables) -> DataFrame:
    got = R.encode_tokens(words(t), vocabulary(t), "index")
    return got.select("index", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), F.md5(F.array_join("shown", " ")).alias("shown"))


@query(
    "special_vectors",
    f"""WITH {WORDS}, v AS (SELECT token, id, {TOKEN_VECTOR} AS vec FROM vocab), a AS (
      SELECT token, id, vec FROM v UNION ALL SELECT '[UNK]', (SELECT count(*) FROM v), (SELECT [avg(vec[1]), avg(vec[2]), avg(vec[3])] FROM v)
      UNION ALL SELECT '[PAD]', (SELECT count(*) + 1 FROM v), [0.0, 0.0, 0.0])
    SELECT token, id, round(vec[1], 6) AS v1, round(vec[2], 6) AS v2, round(vec[3], 6) AS v3 FROM a""",
)
def _(t: Tables) -> DataFrame:
    got = R.special_vectors(token_vectors(t))
    return got.select("token", "id", *[F.round(F.get("vec", F.lit(i)), 6).alias(f"v{i + 1}") for i in range(3)])


@query(
    "encode_instructions",
    f"""WITH {fx.INSTRUCTION_TOKENS}, counts AS (SELECT token, count(*) AS n FROM itokens GROUP BY ALL),
    ivocab AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS id FROM counts WHERE n >= 4),
    named AS (SELECT function_id, pos, CASE WHEN function_id % 2 = 0 THEN token ELSE replace(token, 'X_', 'A_') END AS token FROM itokens)
    SELECT function_id, string_agg(coalesce(v.id, CASE WHEN contains(n.token, 'X_') THEN 0 ELSE 1 END) + 1, ',' ORDER BY pos) AS ids
    FROM named n LEFT JOIN ivocab v USING (token) GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    toks = fx.instruction_tokens(t)
    vocab = R.build_vocab(toks, 4).select("token", (F.col("id") + 2).alias("id"))
    special = t.spark.createDataFrame([("X_UNK", 0), ("A_UNK", 1)], "token string, id long")
    named = toks.withColumn("token", F.when(F.col("function_id") % 2 == 0, F.col("token")).otherwise(F.replace("token", F.lit("X_"), F.lit("A_"))))
    body = named.groupBy("function_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]).alias("instr")
    )
    got = R.encode_instructions(body, vocab.unionByName(special), "function_id")
    return got.select("function_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


# ---- anti joins, embeddings by id ---------------------------------------------------------------


@query("pending", "SELECT o_orderkey AS id, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(t: Tables) -> DataFrame:
    todo = t.orders.select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    done = t.lineitem.filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("id"))
    return R.pending(todo, done, "id")


@query(
    "labelled_embeddings",
    f"""WITH {fx.FUNCTIONS} SELECT id, concat_ws('/', project, file_name, function_name) AS label,
      concat(function_name, '@', project, '/', compiler, '/', optimization, '/', file_name) AS full_label, round(list_sum(embedding::double[]), 6) AS total
    FROM functions JOIN embeddings ON id = vec_id""",
)
def _(t: Tables) -> DataFrame:
    emb = t.embeddings.select(F.col("vec_id").alias("id"), F.round(F.aggregate(A.as_double(F.col("embedding")), F.lit(0.0), lambda a, b: a + b), 6).alias("total"))
    return R.labelled_embeddings(fx.functions(t), emb)


@query(
    "query_vectors",
    """WITH ids AS (SELECT DISTINCT s_suppkey AS id FROM supplier), hit AS (SELECT embedding::double[] AS x FROM embeddings WHERE vec_id IN (SELECT id FROM ids)),
    long AS (SELECT unnest(x) AS v, generate_subscripts(x, 1) - 1 AS dim FROM hit)
    SELECT cast(dim AS int) AS dim, round(avg(v), 6) AS v FROM long GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    emb = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    mean = R.query_vectors(t.supplier.select(F.col("s_suppkey").alias("id")), emb, mean=True)
    return mean.select(F.posexplode("x").alias("dim", "v")).select("dim", F.round("v", 6).alias("v"))


# ---- path contexts ------------------------------------------------------------------------------
# events stand for contexts: fold ids are small numbers, train knows only part of them

CONTEXTS = """lines AS (
  SELECT event_id // 20 AS file, event_id % 20 AS pos, CASE WHEN event_id % 97 = 0 THEN 'broken' ELSE concat(user_id % 30, ',', event_id % 12, ',', (event_id * 7) % 30) END AS v FROM events),
bad AS (SELECT file, min(pos) AS pos FROM lines WHERE v = 'broken' GROUP BY file),
contexts AS (
  SELECT l.file, l.pos, cast(split_part(v, ',', 1) AS bigint) AS s, cast(split_part(v, ',', 2) AS bigint) AS p, cast(split_part(v, ',', 3) AS bigint) AS e
  FROM lines l LEFT JOIN bad b ON l.file = b.file WHERE b.file IS NULL OR l.pos < b.pos)"""


def contexts(t: Tables) -> DataFrame:
    e = F.col("event_id")
    v = F.when(e % 97 == 0, "broken").otherwise(F.concat_ws(",", (F.col("user_id") % 30).cast("string"), (e % 12).cast("string"), ((e * 7) % 30).cast("string")))
    rows = t.events.select(F.concat(F.lit("src/d/"), F.floor(e / 20).cast("string"), F.lit(".cpp")).alias("key"), (e % 20).alias("pos"), v.alias("v"))
    return R.parse_contexts(
        rows.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("values"))
    )


@query(
    "parse_contexts",
    f"""WITH {CONTEXTS}, f AS (SELECT DISTINCT file FROM lines)
    SELECT concat('src/d/', f.file, '.cpp') AS key, coalesce(string_agg(concat(s, ':', p, ':', e), ' ' ORDER BY pos) FILTER (s IS NOT NULL), '') AS contexts FROM f LEFT JOIN contexts c ON f.file = c.file GROUP BY f.file""",
)
def _(t: Tables) -> DataFrame:
    return contexts(t).select("key", F.array_join(F.transform("contexts", lambda c: F.concat_ws(":", c["start"], c["path_index"], c["end"])), " ").alias("contexts"))


# vocabularies of the fold and of train, derived from the distinct ids that occur: every third token, fifth type is unknown to train
def fold_tables(t: Tables) -> dict[str, DataFrame]:
    ids = t.events.select((F.col("event_id") % 30).alias("i")).distinct()
    small = ids.filter(F.col("i") < 12)
    types = ids.filter(F.col("i") < 8)
    text = lambda p: F.concat(F.lit(p), F.col("i").cast("string"))
    path = lambda shift: F.concat_ws(" ", ((F.col("i") % 8) + shift).cast("string"), (((F.col("i") * 3) % 8) + shift).cast("string"))
    return {
        "fold_tokens": ids.select(text("t").alias("token"), F.col("i").alias("id")),
        "train_tokens": ids.filter(F.col("i") % 3 != 0).select(text("t").alias("token"), (F.col("i") + 100).alias("id")),
        "fold_types": types.select(text("n").alias("node_type"), F.col("i").alias("id")),
        "train_types": types.filter(F.col("i") % 5 != 0).select(text("n").alias("node_type"), (F.col("i") + 50).alias("id")),
        "fold_paths": small.select(path(0).alias("path"), F.col("i").alias("id")),
        "train_paths": small.filter(F.col("i") % 4 != 1).select(path(50).alias("path"), (F.col("i") + 200).alias("id"))
        .groupBy("path").agg(F.min("id").alias("id")),
    }


PATH_TABLES = """ids AS (SELECT DISTINCT event_id % 30 AS i FROM events),
paths AS (SELECT i, i % 8 AS a, (i * 3) % 8 AS b FROM ids WHERE i < 12),
known_tokens AS (SELECT i AS fold_id, i + 100 AS train_id FROM ids WHERE i % 3 <> 0),
known_paths AS (
  SELECT f.i AS fold_id, t.train_id FROM paths f JOIN (SELECT a, b, min(i) + 200 AS train_id FROM paths WHERE i % 4 <> 1 GROUP BY a, b) t ON f.a = t.a AND f.b = t.b
  WHERE f.a % 5 <> 0 AND f.b % 5 <> 0)"""


def _token_id(kind: str) -> str:
    return f"('0x' || substr(md5(concat('{kind}', token)), 1, 12))::bigint"


DOCUMENT_TOKENS = "dt AS (SELECT DISTINCT lang = 'en' AS en, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS token FROM documents)"


@query(
    "match_tokens",
    f"""WITH {DOCUMENT_TOKENS} SELECT {_token_id('fold')} AS fold_id, {_token_id('train')} AS train_id
    FROM dt f JOIN dt t USING (token) WHERE f.en AND NOT t.en""",
)
def _(t: Tables) -> DataFrame:
    """The vocabulary of the English documents matched with that of all others."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]+"), F.lit(0))
    seen = t.documents.select((F.col("lang") == "en").alias("en"), F.explode(words).alias("token")).distinct()
    number = lambda kind: F.conv(F.substring(F.md5(F.concat(F.lit(kind), "token")), 1, 12), 16, 10).cast("long").alias("id")
    return R.match_by_text(seen.filter("en").select("token", number("fold")), seen.filter(~F.col("en")).select("token", number("train")), "token")


def _pair_id(kind: str) -> str:
    return f"('0x' || substr(md5(concat('{kind}', a, ' ', b)), 1, 12))::bigint"


@query(
    "match_paths",
    f"""WITH dw AS (SELECT l.doc_id IS NOT NULL AS fold, regexp_extract_all(lower(text), '[a-zà-ÿ]+') AS w FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
    dp AS (SELECT DISTINCT fold, unnest(w[1:len(w) - 1]) AS a, unnest(w[2:]) AS b FROM dw WHERE len(w) > 1)
    SELECT {_pair_id('fold')} AS fold_id, {_pair_id('train')} AS train_id FROM dp f JOIN dp t USING (a, b) WHERE f.fold AND NOT t.fold""",
)
def _(t: Tables) -> DataFrame:
    """Neighbouring words as paths and words as node types: the labelled documents are matched with all others."""
    labelled = t.labels.select("doc_id", F.lit(True).alias("labelled")).distinct()
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]+"), F.lit(0)).alias("w")
    seen = t.documents.join(labelled, "doc_id", "left").select(F.coalesce("labelled", F.lit(False)).alias("fold"), words)
    number = lambda kind, *c: F.conv(F.substring(F.md5(F.concat(F.lit(kind), *c)), 1, 12), 16, 10).cast("long")
    types = seen.select("fold", F.explode("w").alias("node_type")).distinct()
    pairs = seen.filter(F.size("w") > 1).select("fold", F.explode(F.expr("arrays_zip(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1))")).alias("p"))
    pairs = pairs.select("fold", F.col("p")["0"].alias("a"), F.col("p")["1"].alias("b")).distinct()

    def side(kind: str, own: Column) -> tuple[DataFrame, DataFrame]:
        path = F.concat_ws(" ", number(kind, "a").cast("string"), number(kind, "b").cast("string"))
        return (
            types.filter(own).select("node_type", number(kind, "node_type").alias("id")),
            pairs.filter(own).select(path.alias("path"), number(kind, "a", F.lit(" "), "b").alias("id")),
        )

    (fold_types, fold_paths), (train_types, train_paths) = side("fold", F.col("fold")), side("train", ~F.col("fold"))
    return R.match_vocab(fold_types, train_types, fold_paths, train_paths)


TRANSLATED = f"""{CONTEXTS}, {PATH_TABLES},
translated AS (
  SELECT c.file, c.pos, coalesce(a.train_id, -1) AS s, coalesce(p.train_id, -1) AS p, coalesce(b.train_id, -1) AS e
  FROM contexts c LEFT JOIN known_tokens a ON c.s = a.fold_id LEFT JOIN known_paths p ON c.p = p.fold_id LEFT JOIN known_tokens b ON c.e = b.fold_id)"""


def translated(t: Tables) -> DataFrame:
    v = fold_tables(t)
    tokens = R.match_by_text(v["fold_tokens"], v["train_tokens"], "token")
    paths = R.match_vocab(v["fold_types"], v["train_types"], v["fold_paths"], v["train_paths"])
    return R.translate_contexts(contexts(t), tokens, paths)


@query(
    "translate_contexts",
    f"""WITH {TRANSLATED} SELECT concat('src/d/', file, '.cpp') AS key, string_agg(concat(s, ':', p, ':', e), ' ' ORDER BY pos) AS contexts FROM translated GROUP BY file""",
)
def _(t: Tables) -> DataFrame:
    return translated(t).select("key", F.array_join(F.transform("contexts", lambda c: F.concat_ws(":", c["start"].cast("string"), c["path_index"].cast("string"), c["end"].cast("string"))), " ").alias("contexts"))


def samples(t: Tables) -> DataFrame:
    o = F.col("o_orderkey")
    return t.orders.select(o.cast("string").alias("index"), F.when(o % 5 == 0, "test").otherwise("train").alias("fold"))


@query(
    "attach_contexts",
    f"""WITH {TRANSLATED}, n AS (SELECT file, count(*) AS n FROM translated GROUP BY ALL)
    SELECT cast(o_orderkey AS varchar) AS index, CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS fold, cast(n AS int) AS n FROM orders JOIN n ON o_orderkey = file""",
)
def _(t: Tables) -> DataFrame:
    got = R.attach_contexts(samples(t), translated(t).withColumnRenamed("key", "path"))
    return got.select("index", "fold", F.size("contexts").alias("n"))


@query(
    "context_failures",
    f"""WITH {TRANSLATED} SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS fold, count(*) AS failures FROM orders
    WHERE o_orderkey NOT IN (SELECT file FROM translated) GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    return R.context_failures(samples(t), R.attach_contexts(samples(t), translated(t).withColumnRenamed("key", "path")))


@query(
    "encode_contexts",
    f"""WITH {TRANSLATED}, n AS (SELECT file, count(*) AS n FROM translated GROUP BY ALL),
    last AS (SELECT t.*, n FROM translated t JOIN n USING (file) QUALIFY row_number() OVER (PARTITION BY file ORDER BY pos DESC) <= 15),
    lists AS (SELECT file, list(CASE WHEN s = -1 THEN 130 ELSE s END ORDER BY pos) AS s, list(CASE WHEN p = -1 THEN 212 ELSE p END ORDER BY pos) AS p, list(CASE WHEN e = -1 THEN 130 ELSE e END ORDER BY pos) AS e FROM last GROUP BY ALL)
    SELECT concat('src/d/', file, '.cpp') AS key, array_to_string(list_concat(list_resize([]::bigint[], 15 - len(s), 0), s), ',') AS start,
      array_to_string(list_concat(list_resize([]::bigint[], 15 - len(p), 0), p), ',') AS path, array_to_string(list_concat(list_resize([]::bigint[], 15 - len(e), 0), e), ',') AS "end" FROM lists""",
)
def _(t: Tables) -> DataFrame:
    got = R.encode_contexts(translated(t), 130, 212, 15, ["key"])
    return got.select("key", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("start", "path", "end")])


# ---- calls and blocks ---------------------------------------------------------------------------

CALLS = "calls AS (SELECT event_id // 40 AS function_id, event_id % 40 AS pos, (event_id // 40 + 1 + event_id % 5) % 30 AS callee FROM events WHERE event_id % 40 IN (3, 17) AND event_id % 3 = 0)"


@query(
    "inline_calls",
    f"""WITH {fx.INSTRUCTION_TOKENS}, {CALLS},
    l0 AS (SELECT function_id AS root, function_id, pos, token, [pos] AS path FROM itokens),
    l1 AS (SELECT l0.root, i.function_id, i.pos, i.token, list_append(l0.path, i.pos) AS path FROM l0 JOIN calls c ON l0.function_id = c.function_id AND l0.pos = c.pos JOIN itokens i ON i.function_id = c.callee),
    l2 AS (SELECT l1.root, i.function_id, i.pos, i.token, list_append(l1.path, i.pos) AS path FROM l1 JOIN calls c ON l1.function_id = c.function_id AND l1.pos = c.pos JOIN itokens i ON i.function_id = c.callee),
    a AS (SELECT root, path, token FROM l0 UNION ALL SELECT root, path, token FROM l1 UNION ALL SELECT root, path, token FROM l2)
    SELECT root AS function_id, array_to_string(path, '.') AS path, token FROM a""",
)
def _(t: Tables) -> DataFrame:
    e = F.col("event_id")
    f = F.floor(e / 40)
    calls = t.events.filter((e % 40).isin(3, 17) & (e % 3 == 0)).select(f.alias("function_id"), (e % 40).alias("pos"), ((f + 1 + e % 5) % 30).alias("callee"))
    got = R.inline_calls(fx.instruction_tokens(t), calls, 2)
    return got.select("function_id", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), "token")


# function 7 is called by every function, itself included; the other callees are user ids, of which some are no function
BODY_CALLS = "calls AS (SELECT event_id // 40 AS function_id, event_id % 40 AS pos, CASE WHEN event_id % 40 = 3 THEN 7 ELSE user_id END AS callee FROM events WHERE event_id % 40 IN (3, 17, 29))"


@query(
    "inlined_bodies",
    f"""WITH RECURSIVE {fx.INSTRUCTION_TOKENS}, {BODY_CALLS},
    l AS (SELECT function_id AS root, function_id, pos, token, [pos] AS path FROM itokens
      UNION ALL
      SELECT l.root, i.function_id, i.pos, i.token, list_append(l.path, i.pos) FROM l
      JOIN calls c ON l.function_id = c.function_id AND l.pos = c.pos JOIN itokens i ON i.function_id = c.callee WHERE len(l.path) <= 3)
    SELECT root AS function_id, count(*) AS n_tokens, string_agg(token, ' ' ORDER BY path) AS body FROM l GROUP BY root""",
)
def _(t: Tables) -> DataFrame:
    e = F.col("event_id")
    callee = F.when(e % 40 == 3, 7).otherwise(F.col("user_id"))
    calls = t.events.filter((e % 40).isin(3, 17, 29)).select(F.floor(e / 40).alias("function_id"), (e % 40).alias("pos"), callee.alias("callee"))
    got = R.inlined_bodies(fx.instruction_tokens(t), calls, 3)
    return got.select("function_id", F.size("body").cast("long").alias("n_tokens"), F.array_join("body", " ").alias("body"))


@query(
    "linearize_blocks",
    """WITH b AS (SELECT event_id // 25 AS id, (event_id * 13) % 25 AS addr, event_type AS asm, user_id AS u FROM events)
    SELECT id, string_agg(asm, '' ORDER BY addr) AS asm, string_agg(concat(u, ',', u + 1), ',' ORDER BY addr) AS instr FROM b GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    e = F.col("event_id")
    b = t.events.select(F.floor(e / 25).alias("id"), ((e * 13) % 25).alias("addr"), F.col("event_type").alias("asm"), F.col("user_id").alias("u"))
    got = R.linearize(b.select("id", "addr", "asm"), b.select("id", "addr", F.array(F.col("u"), F.col("u") + 1).alias("features")))
    return got.select("id", "asm", F.array_join(F.col("instr").cast("array<string>"), ",").alias("instr"))


# ---- pooling, set operations --------------------------------------------------------------------


@query(
    "mean_pool",
    f"""WITH {fx.VECTORS} SELECT index, cast(i AS int) AS dim, round((x[i + 1] + x[i + 33]) / 2, 6) AS v FROM vectors, (SELECT unnest(range(0, 32)) AS i)""",
)
def _(t: Tables) -> DataFrame:
    two = F.array(F.slice("x", 1, 32), F.slice("x", 33, 32))
    return fx.vectors(t).select("index", F.posexplode(A.mean_vector(two)).alias("dim", "v")).select("index", "dim", F.round("v", 6).alias("v"))


@query(
    "mean_vectors",
    f"""WITH {fx.VECTORS}, long AS (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS dim FROM vectors)
    SELECT label, cast(dim AS int) AS dim, round(avg(v), 6) AS v FROM long GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    got = mean_vectors(fx.vectors(t), ["label"], "x")
    return got.select("label", F.posexplode("x").alias("dim", "v")).select("label", "dim", F.round("v", 6).alias("v"))


@query(
    "union_folds",
    "SELECT doc_id AS index, 'train' AS fold, NULL AS y FROM documents WHERE lang IN ('en', 'de') UNION ALL SELECT doc_id, 'unlabeled', n_chars FROM documents WHERE lang NOT IN ('en', 'de')",
)
def _(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "lang", "n_chars")
    known = F.col("lang").isin("en", "de")
    train = d.filter(known).select(F.col("doc_id").alias("index"), F.lit("train").alias("fold"))
    other = d.filter(~known).select(F.col("doc_id").alias("index"), F.lit("unlabeled").alias("fold"), F.col("n_chars").alias("y"))
    return train.unionByName(other, allowMissingColumns=True)


@query("vocabulary_intersection", r"""SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents WHERE lang = 'en'
    INTERSECT SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM documents WHERE lang = 'fr'""")
def _(t: Tables) -> DataFrame:
    def tokens(lang: str) -> DataFrame:
        return t.documents.filter(F.col("lang") == lang).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("token"))

    return tokens("en").intersect(tokens("fr"))


@query("distinct_files", f"WITH {fx.FUNCTIONS} SELECT DISTINCT project, file_name FROM functions")
def _(t: Tables) -> DataFrame:
    return fx.functions(t).select("project", "file_name").distinct()


@query("distinct_labels", f"WITH {fx.CORPUS} SELECT DISTINCT label FROM corpus")
def _(t: Tables) -> DataFrame:
    return G.labels(t.documents.select(F.concat("source", F.lit("$"), "lang").alias("label")))
