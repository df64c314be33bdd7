"""Cleaning, tokenising and array expressions over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.catalog import fixtures as fx
from codestrata.catalog.registry import Tables, query, quoted
from codestrata.functions import arrays as A
from codestrata.functions import text as X
from codestrata.operators import reshape as R

NL = "chr(10)"
ASCII = "regexp_replace(code, '[^\\x00-\\x7F]', ' ', 'g')"

# documents with code-like lines mixed in, so that the code cleaners find work in every document
CODE = (
    "concat('#include <', lang, '>', chr(10), text, chr(10), 'int x = 1''000''000; // ', source, chr(10), '  using namespace std;  ', chr(10), "
    "'if (n >= 0x0 and y != .5e-3) { s += \"a b\"; c = ''q''; p->*m <<= ', n_chars, '; }', chr(10), '/* ', source, ' */ return 0.0;', chr(10))"
)


def sources(t: Tables) -> DataFrame:
    return t.spread("documents", "doc_id").select(
        F.col("doc_id").alias("index"), F.expr(CODE.replace("1''000''000", "1\\'000\\'000").replace("''q''", "\\'q\\'")).alias("code"), "lang"
    )


SOURCES = f"sources AS (SELECT doc_id AS index, {CODE} AS code, lang FROM documents)"


@query("filter_size", f"WITH {fx.CORPUS} SELECT index, cast(len(string_split(code, {NL})) AS int) AS n_lines FROM corpus WHERE code <> '' AND len(string_split(code, {NL})) <= 20")
def _(t: Tables) -> DataFrame:
    return R.filter_size(fx.corpus(t), 20).select("index", F.size(X.lines_of(F.col("code"))).alias("n_lines"))


@query("ascii_only", f"WITH {fx.CORPUS} SELECT index, {ASCII} AS code FROM corpus")
def _(t: Tables) -> DataFrame:
    return fx.corpus(t).select("index", X.ascii_only(F.col("code")).alias("code"))


@query(
    "strip_digit_separators",
    f"""WITH {SOURCES} SELECT index, regexp_replace(regexp_replace(code, '([0-9])''([0-9])', '\\1\\2', 'g'), '([0-9])''([0-9])', '\\1\\2', 'g') AS code FROM sources""",
)
def _(t: Tables) -> DataFrame:
    return sources(t).select("index", X.strip_digit_separators(F.col("code")).alias("code"))


KEEP_LINE = "NOT (contains(x, '#include') OR contains(x, 'using namespace') OR contains(x, '#import') OR contains(x, '#pragma'))"


@query("drop_includes", f"WITH {SOURCES} SELECT index, array_to_string(list_filter(string_split(code, {NL}), lambda x: {KEEP_LINE}), {NL}) AS code FROM sources")
def _(t: Tables) -> DataFrame:
    return sources(t).select("index", X.drop_includes(F.col("code")).alias("code"))


def _compact(c: str) -> str:
    lines = f"list_transform(string_split_regex({c}, '\\r\\n|\\r|\\n'), lambda x: regexp_replace(x, '[ \\t\\n\\r\\f\\x0B\\x1c-\\x1f]+$', ''))"
    return f"array_to_string(list_filter({lines}, lambda x: x <> ''), {NL})"


@query("compact_lines", f"WITH {SOURCES} SELECT index, {_compact('code')} AS code FROM sources")
def _(t: Tables) -> DataFrame:
    return sources(t).select("index", X.compact_lines(F.col("code")).alias("code"))


@query(
    "clean_code",
    f"""WITH {SOURCES}, a AS (SELECT index, {ASCII} AS code FROM sources),
    b AS (SELECT index, regexp_replace(regexp_replace(code, '([0-9])''([0-9])', '\\1\\2', 'g'), '([0-9])''([0-9])', '\\1\\2', 'g') AS code FROM a),
    c AS (SELECT index, array_to_string(list_filter(string_split(code, {NL}), lambda x: {KEEP_LINE}), {NL}) AS code FROM b),
    d AS (SELECT index, {_compact('code')} AS code FROM c)
    SELECT index, code FROM d WHERE code <> ''""",
)
def _(t: Tables) -> DataFrame:
    return R.clean_code(sources(t)).select("index", "code")


# every line of a document becomes a comment, a continuation, an import or code, by its length
MARKED = (
    "CASE length({x}) % 6 WHEN 0 THEN concat('// ', {x}, '{bs}{bs}') WHEN 1 THEN concat({x}, '{bs}') WHEN 2 THEN concat('#include ', {x}) "
    "WHEN 3 THEN concat('#pragma ', {x}, '*/') WHEN 4 THEN concat('  //', {x}) ELSE concat('  ', {x}, '  ') END"
)


@query(
    "strip_comment_lines",
    rf"""WITH RECURSIVE lines AS (
      SELECT doc_id AS index, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    trimmed AS (SELECT index, pos, regexp_replace({MARKED.format(x='l', bs=chr(92))}, '^[ \t\n\r\f\x0B\x1c-\x1f]+|[ \t\n\r\f\x0B\x1c-\x1f]+$', '', 'g') AS l FROM lines),
    kinds AS (
      SELECT index, row_number() OVER (PARTITION BY index ORDER BY pos) AS pos, l, starts_with(l, '//') AS comment, ends_with(l, '\\') AS two, ends_with(l, '\') AS one,
             starts_with(l, '#include') OR starts_with(l, '#pragma') OR starts_with(l, 'using namespace') OR starts_with(l, '#import') AS import
      FROM trimmed WHERE l <> ''),
    -- the flag is set by an opening comment, cleared by the first other line that lacks the final backslash, kept by the rest
    marks AS (
      SELECT *, max(CASE WHEN comment AND two THEN pos END) OVER w AS opened, max(CASE WHEN NOT comment AND NOT one THEN pos END) OVER w AS closed
      FROM kinds WINDOW w AS (PARTITION BY index ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    kept AS (
      SELECT index, pos, l FROM marks
      WHERE NOT comment AND NOT coalesce(opened > coalesce(closed, 0), false) AND NOT (import AND NOT contains(l, '*/')))
    SELECT d.doc_id AS index, coalesce(string_agg(k.l, chr(10) ORDER BY k.pos), '') AS code
    FROM documents d LEFT JOIN kept k ON d.doc_id = k.index GROUP BY d.doc_id""",
)
def _(t: Tables) -> DataFrame:
    marked = F.expr(f"array_join(transform(split(text, '\\n'), x -> {MARKED.format(x='x', bs=chr(92) * 2)}), '\\n')")
    return t.spread("documents", "doc_id").select(F.col("doc_id").alias("index"), X.strip_comment_lines(marked).alias("code"))


# ---- tokens -------------------------------------------------------------------------------------

_WORDS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.WORD_OPERATORS.items())
SURFACE = f"""CASE WHEN starts_with(x, '"') THEN '"..."' WHEN starts_with(x, '''') THEN '''.'''
  WHEN regexp_matches(x, {quoted(X.NUMBER_PATTERN)}) AND regexp_matches(x, {quoted(X.ZERO_PATTERN)}) THEN '0' ELSE CASE x {_WORDS} ELSE x END END"""


def tokens_sql(relation: str, col: str = "code") -> str:
    return f"""raw_tokens AS (SELECT *, regexp_extract_all({col}, {quoted(X.TOKEN_PATTERN)}) AS raw FROM {relation}),
    tokens AS (
      SELECT * EXCLUDE raw, CASE WHEN NOT (list_contains(raw, '''') OR list_contains(raw, '"') OR list_contains(raw, '/*'))
        THEN list_transform(list_filter(raw, lambda x: NOT regexp_matches(x, {quoted(X.COMMENT_PATTERN)})), lambda x: {SURFACE}) END AS tokens
      FROM raw_tokens)"""


@query("tokenize_code", f"WITH {SOURCES}, {tokens_sql('sources')} SELECT index, array_to_string(tokens, ' ') AS tokens FROM tokens")
def _(t: Tables) -> DataFrame:
    return sources(t).select("index", F.array_join(X.tokenize_code(F.col("code")), " ").alias("tokens"))


_PLAIN = ", ".join(f"'{k}'" for k in X.CPP_KEYWORDS if k not in X.DIRECTIVE_WORDS and k not in X.WORD_OPERATORS)
_DIRECTIVES = ", ".join(f"'{k}'" for k in X.DIRECTIVE_WORDS)


@query(
    "token_profile",
    f"""WITH {SOURCES}, {tokens_sql('sources')},
    long AS (SELECT index, lang, unnest(tokens) AS tok, generate_subscripts(tokens, 1) AS pos FROM tokens),
    seen AS (SELECT *, lag(tok) OVER (PARTITION BY index ORDER BY pos) AS before FROM long)
    SELECT lang AS label, CASE WHEN regexp_matches(tok, {quoted(X.NUMBER_PATTERN)}) THEN 'NUM' WHEN tok IN ({_PLAIN}) THEN 'KW'
      WHEN tok IN ({_DIRECTIVES}) AND before = '#' THEN 'KW' WHEN regexp_matches(tok, {quoted(X.WORD_PATTERN)}) THEN 'ID' ELSE 'TOK' END AS class, count(*) AS n
    FROM seen GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    toks = sources(t).select("lang", X.tokenize_code(F.col("code")).alias("tokens"))
    return toks.select(F.col("lang").alias("label"), F.explode(X.token_classes(F.col("tokens"))).alias("class")).groupBy("label", "class").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "number_bucket",
    """WITH v AS (SELECT o_orderkey AS index, CASE WHEN o_orderkey % 13 = 0 THEN 0.0 WHEN o_orderkey % 5 = 0 THEN o_totalprice / 1e7 ELSE o_totalprice END AS v FROM orders)
    SELECT index, cast(CASE WHEN v = 0 THEN 0 WHEN ln(v) / ln(10) >= 0 THEN ceil(ln(v) / ln(10)) + 1 ELSE floor(ln(v) / ln(10)) END AS int) AS bucket FROM v""",
)
def _(t: Tables) -> DataFrame:
    v = F.expr("CASE WHEN o_orderkey % 13 = 0 THEN 0.0D WHEN o_orderkey % 5 = 0 THEN o_totalprice / 1e7 ELSE o_totalprice END")
    return t.orders.select(F.col("o_orderkey").alias("index"), X.number_bucket(v).alias("bucket"))


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


@query(
    "tokenize_text",
    rf"""WITH {fx.CORPUS} SELECT index, array_to_string(list_filter(regexp_extract_all(lower(code), '[\p{{L}}\p{{N}}_]+|[^\s\p{{L}}\p{{N}}_]'), lambda x: x NOT IN ({_STOP})), ' ') AS tokens FROM corpus""",
)
def _(t: Tables) -> DataFrame:
    return fx.corpus(t).select("index", F.array_join(X.tokenize_text(F.col("code")), " ").alias("tokens"))


@query(
    "tokenize_bleu",
    f"""WITH {SOURCES}, a AS (SELECT index, regexp_replace(code, '([^A-Za-z0-9_])', ' \\1 ', 'g') AS c FROM sources),
    b AS (SELECT index, regexp_replace(regexp_replace(c, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[\\s\\x0B]+', ' ', 'g') AS c FROM a)
    SELECT index, array_to_string(list_filter(string_split(translate(c, '"''', '``'), ' '), lambda x: x <> ''), ' ') AS tokens FROM b""",
)
def _(t: Tables) -> DataFrame:
    return sources(t).select("index", F.array_join(X.tokenize_bleu(F.col("code")), " ").alias("tokens"))


@query(
    "scrub",
    f"WITH {SOURCES} SELECT index, replace(replace(concat('#include<conio.h>', code, ' void main('), '#include<conio.h>', chr(10)), 'void main(', 'int main(') AS code FROM sources",
)
def _(t: Tables) -> DataFrame:
    return sources(t).select("index", X.scrub(F.concat(F.lit("#include<conio.h>"), F.col("code"), F.lit(" void main("))).alias("code"))


# ---- small scalars ------------------------------------------------------------------------------


@query(
    "normalize_label",
    """SELECT doc_id AS index, translate(lower(trim(concat('  ', CASE WHEN doc_id % 2 = 0 THEN 'ÎNTREGI' ELSE ' Grafţi ' END, text, ' '))), 'ăţâîş', 'atais') AS label
    FROM (SELECT doc_id, regexp_replace(text, '\\s', '_', 'g') AS text FROM documents)""",
)
def _(t: Tables) -> DataFrame:
    text = F.regexp_replace("text", r"\s", "_")
    raw = F.concat(F.lit("  "), F.when(F.col("doc_id") % 2 == 0, "ÎNTREGI").otherwise(" Grafţi "), text, F.lit(" "))
    return t.documents.select(F.col("doc_id").alias("index"), X.normalize_label(raw).alias("label"))


@query(
    "replace_chars",
    f"WITH {SOURCES} SELECT index, replace(replace(replace(code, 'std;', 'Std;'), '->*', '.*'), 'return', 'yield') AS code FROM sources",
)
def _(t: Tables) -> DataFrame:
    return sources(t).select("index", X.replace_chars(F.col("code"), {"std;": "Std;", "->*": ".*", "return": "yield"}).alias("code"))


NUMBER_TEXT = (
    "CASE o_orderkey % 6 WHEN 0 THEN cast(o_custkey AS string) WHEN 1 THEN concat('1.', o_custkey) WHEN 2 THEN concat(o_custkey, 'e3') "
    "WHEN 3 THEN concat('x', o_custkey) WHEN 4 THEN 'nan' ELSE '' END"
)


@query(
    "is_float",
    f"SELECT o_orderkey AS index, coalesce(try_cast(nullif(trim({NUMBER_TEXT}), '') AS double) IS NOT NULL, false) AS is_float FROM orders",
)
def _(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("index"), X.is_float(F.expr(NUMBER_TEXT)).alias("is_float"))


PATH = (
    "concat('results/u/', CASE WHEN o_orderkey % 3 = 0 THEN 'cf' ELSE 'r' END, '/', CASE o_orderkey % 4 WHEN 0 THEN concat(o_custkey, 'abz.cpp') "
    "WHEN 1 THEN concat(o_custkey, '/', 'C.cpp') WHEN 2 THEN concat('D/', o_custkey, '.CPP') ELSE concat('notes', o_custkey, '.txt') END)"
)


@query(
    "problem_id",
    """SELECT o_orderkey AS index, CASE o_orderkey % 4 WHEN 0 THEN concat(o_custkey, 'A.CPP') WHEN 1 THEN concat(o_custkey, 'C.CPP')
         WHEN 2 THEN concat(o_custkey, 'D.CPP') END AS problem FROM orders
    WHERE o_orderkey % 4 <> 3 AND (o_custkey BETWEEN 100 AND 10000 OR o_orderkey % 3 = 0)""",
)
def _(t: Tables) -> DataFrame:
    paths = t.orders.select(F.col("o_orderkey").alias("index"), F.expr(PATH).alias("path"))
    return paths.select("index", X.problem_id(F.col("path")).alias("problem")).filter(F.col("problem").isNotNull())


@query(
    "normalize_instruction",
    f"""WITH {fx.INSTRUCTIONS}, shown AS (
      SELECT function_id, pos, mnemonic, CASE WHEN kind = 0 THEN 'eax' WHEN kind = 1 THEN
          CASE WHEN imm BETWEEN -5000 AND 5000 THEN concat(CASE WHEN imm < 0 THEN '-0x' ELSE '0x' END, lower(to_hex(abs(imm)))) ELSE 'HIMM' END
        WHEN pos % 2 = 0 THEN '[MEM]' ELSE concat('[rbp*', pos % 4, '+', imm, ']') END AS a,
        CASE WHEN pos % 5 <> 0 THEN 'rbx' END AS b FROM instructions)
    SELECT function_id, pos, concat('X_', mnemonic, '_', a, CASE WHEN b IS NOT NULL THEN concat(',_', b) ELSE '' END) AS token FROM shown""",
)
def _(t: Tables) -> DataFrame:
    def op(kind: str, value, base, disp, scale):
        return F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"), base.cast("string").alias("base"), disp.cast("long").alias("disp"), scale.cast("int").alias("scale"))

    none = F.lit(None)
    first = (
        F.when(F.col("kind") == 0, op("reg", F.lit("eax"), none, none, none))
        .when(F.col("kind") == 1, op("imm", F.col("imm"), none, none, none))
        .otherwise(op("mem", none, F.when(F.col("pos") % 2 == 0, "0").otherwise("rbp"), F.col("imm"), F.col("pos") % 4))
    )
    ops = F.when(F.col("pos") % 5 != 0, F.array(first, op("reg", F.lit("rbx"), none, none, none))).otherwise(F.array(first))
    return fx.instructions(t).select("function_id", "pos", X.normalize_instruction(F.col("mnemonic"), ops).alias("token"))


BODY = """body AS (SELECT function_id AS id, list(imm ORDER BY pos) AS instr FROM instructions GROUP BY function_id)"""


def bodies(t: Tables) -> DataFrame:
    """Instruction ids per function; a body has at most 40 entries."""
    return fx.instructions(t).groupBy(F.col("function_id").alias("id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "imm"))), lambda s: s["imm"]).alias("instr")
    )


@query(
    "pad_post",
    f"""WITH {fx.INSTRUCTIONS}, {BODY}
    SELECT id, array_to_string(list_resize(instr[1:30], 30, 0), ',') AS cut, array_to_string(list_resize(instr[1:50], 50, 0), ',') AS padded, cast(least(len(instr), 50) AS int) AS len FROM body""",
)
def _(t: Tables) -> DataFrame:
    """Whole bodies, cut to 30 and padded to 50."""
    joined = lambda c: F.array_join(c.cast("array<string>"), ",")
    cut, _ = A.pad_post(F.col("instr"), 30)
    padded, length = A.pad_post(F.col("instr"), 50)
    return bodies(t).select("id", joined(cut).alias("cut"), joined(padded).alias("padded"), length.alias("len"))


def _pad_pre_sql(n: int) -> str:
    return f"array_to_string(list_concat(list_resize([]::bigint[], greatest({n} - len(instr), 0), -7), instr[greatest(len(instr) - {n - 1}, 1):]), ',')"


@query("pad_pre", f"""WITH {fx.INSTRUCTIONS}, {BODY} SELECT id, {_pad_pre_sql(30)} AS cut, {_pad_pre_sql(50)} AS padded FROM body""")
def _(t: Tables) -> DataFrame:
    padded = lambda n: F.array_join(A.pad_pre(F.col("instr"), n, -7).cast("array<string>"), ",")
    return bodies(t).select("id", padded(30).alias("cut"), padded(50).alias("padded"))


@query(
    "binarize",
    f"""WITH {fx.SCORED_ROWS} SELECT index, array_to_string(list_transform(scores, lambda x: CASE WHEN x >= 0.4 THEN 1 ELSE 0 END), ',') AS p FROM scored_rows""",
)
def _(t: Tables) -> DataFrame:
    return fx.scored_rows(t).select("index", F.array_join(A.binarize(F.col("scores")).cast("array<string>"), ",").alias("p"))


@query(
    "difficulty_class",
    """WITH d AS (SELECT o_orderkey AS index, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE cast(floor(o_totalprice) AS bigint) % 4000 END AS d FROM orders)
    SELECT index, CASE WHEN d IS NULL THEN 'Various' WHEN d <= 1500 THEN 'Easy' WHEN d < 2500 THEN 'Medium' ELSE 'Hard' END AS difficulty_class FROM d""",
)
def _(t: Tables) -> DataFrame:
    d = F.expr("CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE cast(floor(o_totalprice) AS bigint) % 4000 END")
    return t.orders.select(F.col("o_orderkey").alias("index"), A.difficulty_class(d).alias("difficulty_class"))


@query("multi_hot", f"WITH {fx.LABEL_ROWS} SELECT index, array_to_string(Y, '') AS y FROM label_rows")
def _(t: Tables) -> DataFrame:
    return fx.label_rows(t).select("index", F.array_join(A.multi_hot(F.col("tags"), fx.LABELS).cast("array<string>"), "").alias("y"))


@query(
    "split_labelled",
    f"""WITH {fx.LABEL_ROWS} SELECT index, CASE WHEN list_sum(Y) = 0 THEN 'unlabeled' END AS fold, CASE WHEN list_sum(Y) > 0 THEN array_to_string(Y, '') END AS y FROM label_rows""",
)
def _(t: Tables) -> DataFrame:
    from codestrata.operators.split import split_labelled

    return split_labelled(fx.label_rows(t).drop("Y"), fx.LABELS).select("index", "fold", F.array_join(F.col("Y").cast("array<string>"), "").alias("y"))


@query("require_features", f"WITH {SOURCES}, {tokens_sql('sources')} SELECT index, cast(len(tokens) AS int) AS n_tokens FROM tokens WHERE tokens IS NOT NULL")
def _(t: Tables) -> DataFrame:
    rows = sources(t).select("index", X.tokenize_code(F.col("code")).alias("tokens"))
    return R.require(rows, ["tokens"]).select("index", F.size("tokens").alias("n_tokens"))
