"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, validators (part sizes, digit counts, Luhn, mod 97) confirm them and
words near a span adjust its score. The patterns run once over a text: what follows a match is never
scanned again from its middle (possessive repetition, and look-behind at the start), so texts that
almost match cost no more than others. Positions come from the lengths of the matches and of the text
between them, as prefix sums in two levels, so they too are nearly linear in the number of matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import unpacked, whole_row

NEAR = 48  # code points before and after a span whose words count
CHUNK = 64
THRESHOLD = 0.5  # an added span is reported from this score on; spans of the base kinds always are


@dataclass(frozen=True)
class Kind:
    """``hint``: a text without it has no match, which saves the scan."""

    name: str
    pattern: str
    score: float
    words: str
    base: bool = True
    hint: str | None = None


KINDS = [
    # \G: a match may begin where the one before it ended, also inside a run of these characters
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        0.9,
        "mail|contact|write",
        hint="@",
    ),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", 0.6, r"\bip\b|address|host|server", hint="."),
    # exactly the maximal runs of digits with single separators that have 12 to 19 digits
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])", 0.7, "card|visa|credit|payment|account"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "phone|call|tel|mobile|fax", hint="+"),
    Kind("iban", r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9_])", 0.8, "iban|bank|account", base=False),
    Kind("ssn", r"(?<![A-Za-z0-9_-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_-])", 0.3, "ssn|social security|insurance", base=False),
]
BONUS = 0.2
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _mod97(match: Column) -> Column:
    """The number that an IBAN's check rule builds, modulo 97: letters count as two digits, four characters go to the end."""
    flat = F.translate(match, " ", "")
    turned = F.concat(F.substring(flat, 5, 64), F.substring(flat, 1, 4))
    values = F.transform(F.split(turned, ""), lambda c: F.ascii(c))
    return F.aggregate(values, F.lit(0), lambda acc, v: F.when(v >= 65, (acc * 100 + v - 55) % 97).otherwise((acc * 10 + v - 48) % 97))


def confirmed(kind: str, match: Column) -> Column:
    """Whether the kind's validator accepts a proposed span."""
    if kind == "ip":
        return match.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.luhn_check(_digits(match)) if hasattr(F, "luhn_check") else F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return _mod97(match) == 1
    return F.lit(True)


def prefix_sums(values: Column) -> Column:
    """For an array of numbers: the sum of the elements before each one. Two levels keep it far from quadratic."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    n = F.size(values)
    starts = F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))
    sums = F.transform(starts, lambda c: total(F.slice(values, c * CHUNK + 1, F.lit(CHUNK))))
    before = F.aggregate(
        sums,
        F.struct(F.array().cast("array<long>").alias("all"), F.lit(0).cast("long").alias("sum")),
        lambda acc, s: F.struct(F.concat(acc["all"], F.array(acc["sum"])).alias("all"), (acc["sum"] + s).alias("sum")),
        lambda acc: acc["all"],
    )
    # as the one element of an array, so that it is computed once and not for every position
    inner = F.transform(
        F.array(before),
        lambda b: F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.element_at(b, F.floor(i / CHUNK).cast("int") + 1) + total(F.slice(values, F.floor(i / CHUNK).cast("int") * CHUNK + 1, i % CHUNK)),
        ),
    )
    return F.when(n > 0, F.element_at(inner, 1)).otherwise(F.array().cast("array<long>"))


SPAN = "array<struct<start:long,kind_no:int,end:long,kind:string,score:double>>"


def find_personal_data(docs: DataFrame, text_col: str = "text", out: str = "spans", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` plus ``out``: an array of (start, kind_no, end, kind, score) sorted by start, then kind in the order of ``KINDS``.

    Positions are code points, ends exclusive. Matches are leftmost and non-overlapping within a kind;
    one that its validator refuses is dropped and its text not tried again. Spans of different kinds may
    overlap. A score is the kind's own plus ``BONUS`` if one of the kind's words is within ``NEAR`` code
    points (and not beyond the next match of that kind). Base kinds are kept at any score, added kinds from ``threshold``
    on. Null and empty texts have no spans; an input column named ``out`` is replaced.
    """
    work = "found"
    rows = docs.select(whole_row(docs), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    text = F.col("text")
    none = F.array().cast("array<string>")

    def matches(kind: Kind) -> Column:
        found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
        return F.when(F.contains(text, F.lit(kind.hint)), found).otherwise(none) if kind.hint else found

    held = rows.select("row", "text", F.struct(*[matches(k).alias(k.name) for k in KINDS]).alias(work))
    # the text is cut at the matches only where there are some
    gap = lambda k: F.when(F.size(F.col(work)[k.name]) > 0, F.split(text, k.pattern, -1)).otherwise(none)
    held = held.withColumn(f"{work}_gaps", F.struct(*[gap(k).alias(k.name) for k in KINDS]))
    steps = lambda k: F.zip_with(
        F.slice(F.col(f"{work}_gaps")[k.name], F.lit(1), F.size(F.col(work)[k.name])),
        F.col(work)[k.name],
        lambda g, m: (F.length(g) + F.length(m)).cast("long"),
    )
    held = held.withColumn(f"{work}_steps", F.struct(*[steps(k).alias(k.name) for k in KINDS]))
    held = held.withColumn(f"{work}_before", F.struct(*[prefix_sums(F.col(f"{work}_steps")[k.name]).alias(k.name) for k in KINDS]))

    def spans(no: int, kind: Kind) -> Column:
        found, gaps, before = (F.col(f"{work}{part}")[kind.name] for part in ("", "_gaps", "_before"))

        def span(m: Column, i: Column) -> Column:
            left, right = F.element_at(gaps, i + 1), F.element_at(gaps, i + 2)
            start = F.element_at(before, i + 1) + F.length(left)
            near = F.lower(F.concat_ws(" ", F.right(left, F.lit(NEAR)), F.left(right, F.lit(NEAR))))
            score = F.lit(kind.score) + F.when(near.rlike(kind.words), F.lit(BONUS)).otherwise(F.lit(0.0))
            return F.struct(
                start.cast("long").alias("start"),
                F.lit(no).alias("kind_no"),
                (start + F.length(m)).cast("long").alias("end"),
                F.lit(kind.name).alias("kind"),
                F.least(score, F.lit(1.0)).alias("score"),
                confirmed(kind.name, m).alias("ok"),
            )

        kept = F.filter(F.transform(found, span), lambda s: s["ok"] & (F.lit(kind.base) | (s["score"] >= threshold)))
        return F.transform(kept, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "kind_no", "end", "kind", "score")])).cast(SPAN)

    every = F.array_sort(F.concat(*[spans(no, k) for no, k in enumerate(KINDS)]))
    return unpacked(held.withColumn("every", every), "row", [c for c in docs.columns if c != out], {out: F.col("every")})


def digest(spans: Column, base_only: bool = False) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    own = F.filter(spans, lambda s: s["kind"].isin([k.name for k in KINDS if k.base])) if base_only else spans
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(spans: Column, text: Column) -> Column:
    """The text with every span that overlaps no earlier one replaced by ``[KIND]``."""
    text = F.coalesce(text, F.lit(""))
    cut = F.aggregate(
        spans,
        F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(
                F.concat(acc["parts"], F.array(F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("parts"),
                s["end"].alias("at"),
            ),
        ).otherwise(acc),
    )
    return F.concat(F.array_join(cut["parts"], ""), F.substr(text, (cut["at"] + 1).cast("int")))
