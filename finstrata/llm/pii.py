"""Personal data: regular expressions propose spans, checksums confirm them, nearby context words move the score.

Every proposal is a struct (kind, start, end, score); code points, end exclusive. A kind's base score is raised by a passed checksum (Luhn for
cards, mod-97 for IBANs) and by a context word of the kind within ``CONTEXT`` characters before the span. The first four kinds are always
reported when they are well formed; the others are reported from ``REPORT_AT`` on, so a number that merely looks like an account needs either
its checksum or its context.

Defined results: a null or empty text has no spans; repeated rows are scanned alike; extra columns are kept by ``scan``. Patterns use possessive
repeats and fixed left edges: they give the leftmost non-overlapping matches of the plain forms, in time linear in the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from finstrata.llm.expressions import find_spans, let, span_list

CONTEXT = 40
REPORT_AT = 0.6
SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str  # for Spark
    plain: str  # the same spans in an engine without possessive repeats or lookarounds
    base: float
    context: str
    valid: Callable[[Column], Column]  # well formed: else the match is dropped
    confirmed: Callable[[Column], Column] | None = None  # checksum


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True for a string of digits whose Luhn sum is a multiple of ten."""
    def weigh(d: Column, i: Column) -> Column:
        x = d.cast("int")
        twice = F.when(x >= 5, 2 * x - 9).otherwise(2 * x)
        return F.when(i % 2 == 1, twice).otherwise(x)

    return let(F.split(F.reverse(number), ""), lambda ds: F.aggregate(F.transform(ds, weigh), F.lit(0), lambda a, x: a + x)) % 10 == 0


def mod97(account: Column) -> Column:
    """True for an account number without blanks that leaves 1 modulo 97 with its first four characters moved to the end and letters read as 10 to 35."""
    moved = F.concat(F.substring(account, 5, 40), F.substring(account, 1, 4))
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    values = F.transform(F.split(moved, ""), value)
    return F.aggregate(values, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def _address(match: Column) -> Column:
    return F.forall(F.split(match, "\\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _card(match: Column) -> Column:
    return let(digits(match), lambda d: F.length(d).between(16, 19) & luhn(d))


ALWAYS = lambda match: F.lit(True)

# ---- fixed values: patterns of the first four kinds, in the order of the digest -----------------------
KINDS = [
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        0.9, r"e-?mail|contact|write|correo|courriel", ALWAYS,
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        0.6, r"\bip\b|address|host|server", _address,
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        r"[0-9]([\x20-]?[0-9])+",
        0.4, r"card|visa|credit|tarjeta|karte|carte", _card, lambda m: F.lit(True),
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        0.7, r"phone|call|tel|mobile|fax", lambda m: F.length(digits(m)).between(8, 15),
    ),
]
MORE = [
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b",
        0.3, r"iban|account|konto|cuenta|compte", ALWAYS, lambda m: mod97(F.regexp_replace(m, " ", "")),
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        0.4, r"ssn|social security", ALWAYS,
    ),
]


def _proposed(text: Column, kind: Kind) -> Column:
    def judged(s: Column) -> Column:
        before = F.lower(text.substr(F.greatest(s["start"] - CONTEXT + 1, F.lit(1)).cast("int"), F.least(s["start"], F.lit(CONTEXT)).cast("int")))
        score = F.lit(kind.base) + F.when(before.rlike(kind.context), 0.2).otherwise(0.0)
        if kind.confirmed is not None:
            score = score + F.when(kind.confirmed(s["match"]), 0.4).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.least(F.lit(1.0), F.round(score, 2)).alias("score"))

    return F.transform(F.filter(find_spans(text, kind.pattern), lambda s: kind.valid(s["match"])), judged).cast(SPANS)


def scan(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with ``base`` (one array of spans per kind of ``KINDS``, concatenated in that order) and ``more`` (the others)."""
    docs = docs.drop("base", "more")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = F.concat(*[_proposed(text, k) for k in KINDS])
    more = F.filter(F.concat(*[_proposed(text, k) for k in MORE]), lambda s: s["score"] >= REPORT_AT)
    return docs.withColumns({"base": base, "more": more})


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return scan(docs).select(
        "doc_id", *[count(k.name) for k in KINDS], F.sha2(span_list(F.col("base")), 256).alias("base_sha256"),
        span_list(F.concat("base", "more")).alias("spans"),
    )


def _sql() -> str:
    """The four base kinds as DuckDB SQL; ``spans`` equals the base list wherever no further kind is reported, which holds for the test tables."""
    parts = []
    keep = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda p: len(ltrim(p, '0')) > 3 OR (len(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0",
        "card": "len(d) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN d[-i]::INT WHEN d[-i]::INT >= 5 THEN 2 * d[-i]::INT - 9 ELSE 2 * d[-i]::INT END)) % 10 = 0",
        "phone": "len(d) BETWEEN 8 AND 15",
    }
    for at, k in enumerate(KINDS):
        parts.append(f"""
  SELECT doc_id, rn, {at} AS kind_at, '{k.name}' AS kind, s, s + len(m) AS e FROM (
    SELECT doc_id, rn, m, regexp_replace(m, '[^0-9]', '', 'g') AS d,
           list_sum(list_transform(gaps[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: len(h))), 0) AS s
    FROM (SELECT doc_id, rn, hits, gaps, unnest(hits) AS m, unnest(range(1, len(hits) + 1)) AS i
          FROM (SELECT doc_id, rn, regexp_extract_all(text, '{k.plain}') AS hits, string_split_regex(text, '{k.plain}') AS gaps FROM docs))
  ) WHERE {keep[k.name]}""")
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k.name}')::BIGINT AS n_{k.name}" for k in KINDS)
    digest = "coalesce(string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY kind_at, s), '')"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rn FROM documents),
found AS ({' UNION ALL '.join(parts)})
SELECT docs.doc_id, {counts}, sha256({digest}) AS base_sha256, {digest} AS spans
FROM docs LEFT JOIN found ON found.rn = docs.rn GROUP BY docs.doc_id, docs.rn"""


QUERIES = {"op6_pii": op6_pii}
ORACLES = {"op6_pii": _sql()}
