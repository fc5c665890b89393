"""Secret scan over a trigram inverted index.

1. Each rule's regular expression is turned into a Boolean query over trigrams that every match must contain (``trigrams.derive``).
2. The index holds, for the trigrams that the queries mention, the ids of the documents whose lower-cased text contains them: one row per
   trigram and block of ``BUCKET`` ids, so no posting list is ever longer than that, however common the trigram.
3. Queries are answered block by block with set operations on the posting lists.
4. Candidates are verified with the regular expression; a rule without a mandatory trigram scans every text.

Candidates reach the texts by a join on doc_id. They are landed and counted: a short list is broadcast, a longer one shuffled (``rows.sent``).

Defined results: a null or empty text has no spans. Null doc_ids share one entry of the index, and repeated doc_ids theirs: a row is then
verified if any row with its id is a candidate, which costs time but changes no result. Extra columns are kept by ``scan``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from finstrata.llm.expressions import find_spans, let, span_list
from finstrata.llm.rows import NO_ID, sent
from finstrata.llm.trigrams import Query, derive, trigrams_of
from finstrata.sources.landing import land

BUCKET = 1024
MASK = "[secret]"
SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    value: int = 0  # group whose length counts
    least: int = 1  # code points it must have; shorter matches are dropped


# ---- fixed values: patterns of the first three rules --------------------------------------------------
RULES = [
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", value=1, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}", least=24),
]
MORE = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
]


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """bucket, trigram, ids: the posting lists."""
    held = let(F.lower(F.col("text").cast("string")), lambda t: F.filter(F.array(*[F.lit(g) for g in trigrams]), lambda g: F.contains(t, g)))
    rows = docs.select(_id().alias("id"), F.explode(held).alias("trigram"))
    return rows.groupBy(F.floor(F.col("id") / BUCKET).alias("bucket"), "trigram").agg(F.collect_set("id").alias("ids"))


def _answer(query: Query, lists: Column) -> Column:
    if isinstance(query, str):
        return F.coalesce(F.element_at(lists, query), F.array().cast("array<bigint>"))
    first, *rest = [_answer(q, lists) for q in query[1]]
    for other in rest:
        first = F.array_intersect(first, other) if query[0] == "and" else F.array_union(first, other)
    return first


def candidates(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """id, rules (bit r: rule r's query holds) for the rules that have mandatory trigrams."""
    queries = {r: q for r, rule in enumerate(rules) if (q := derive(rule.pattern)) is not True}
    index = build_index(docs, sorted(set().union(*[trigrams_of(q) for q in queries.values()])))
    blocks = index.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("lists"))
    answers = lambda lists: F.array(*[F.struct(F.lit(1 << r).cast("bigint").alias("bit"), _answer(q, lists).alias("ids")) for r, q in queries.items()])
    hits = blocks.select(F.explode(let(F.col("lists"), answers)).alias("a")).select("a.bit", F.explode("a.ids").alias("id"))
    return hits.groupBy("id").agg(F.bit_or("bit").alias("rules"))


def _spans(text: Column, rank: int, rule: Rule) -> Column:
    long_enough = lambda s: F.length(F.regexp_extract(s["match"], rule.pattern, rule.value) if rule.value else s["match"]) >= rule.least
    shaped = lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), s["end"].alias("end"))
    return F.transform(F.filter(find_spans(text, rule.pattern), long_enough), shaped).cast(SPANS)


def scan(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """All columns of ``docs`` with ``secrets``: spans (start, rank of the rule, kind, end) by start, then rank; code points, end exclusive."""
    rules = RULES + MORE if rules is None else rules
    docs = docs.drop("secrets")
    found = land(candidates(docs.select("doc_id", "text"), rules), "secret-candidates")
    side = sent(found.select(F.col("id").alias("_id"), F.col("rules").alias("_rules")))
    joined = docs.withColumn("_key", _id()).join(side, F.col("_key") == F.col("_id"), "left")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast(SPANS)
    each = []
    for rank, rule in enumerate(rules):
        spans = _spans(text, rank, rule)
        must = derive(rule.pattern) is not True
        each.append(F.when(F.col("_rules").bitwiseAND(F.lit(1 << rank).cast("bigint")) != 0, spans).otherwise(none) if must else spans)
    return joined.withColumn("secrets", F.array_sort(F.concat(*each))).drop("_key", "_id", "_rules")


def redact(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """All columns of ``docs``; every secret in ``text`` is replaced by a mark, overlapping ones by one mark, and n_chars follows where it exists."""
    def masked(text: Column, spans: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

        def step(a: Column, s: Column) -> Column:
            gap = text.substr((a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int"))
            piece = F.when(s["start"] >= a["at"], F.concat(a["out"], gap, F.lit(MASK))).otherwise(a["out"])
            return F.struct(F.greatest(a["at"], s["end"]).alias("at"), piece.alias("out"))

        rest = lambda a: F.concat(a["out"], text.substr((a["at"] + 1).cast("int"), F.length(text)))
        return F.aggregate(spans, start, step, rest)

    found = scan(docs, rules)
    clean = found.withColumn("text", F.when(F.size("secrets") > 0, masked(F.col("text"), F.col("secrets"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.size("secrets") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean.select(docs.columns)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = F.filter("secrets", lambda s: s["rank"] < len(RULES))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return scan(docs).select("doc_id", *[count(r.kind) for r in RULES], F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("secrets")).alias("spans"))


def _sql() -> str:
    """The same scan without an index, as DuckDB SQL."""
    parts = []
    for rank, rule in enumerate(RULES + MORE):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""
  SELECT rn, {rank} AS rank, '{rule.kind}' AS kind, s, s + len(m) AS e FROM (
    SELECT rn, m, v, coalesce(list_sum(list_transform(gaps[1:i], lambda g: len(g))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: len(h))), 0) AS s
    FROM (SELECT rn, hits, gaps, unnest(hits) AS m, unnest(vals) AS v, unnest(range(1, len(hits) + 1)) AS i
          FROM (SELECT rn, regexp_extract_all(text, '{pattern}') AS hits, regexp_extract_all(text, '{pattern}', {rule.value}) AS vals, string_split_regex(text, '{pattern}') AS gaps FROM docs))
  ) WHERE len(v) >= {rule.least}""")
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}')::BIGINT AS n_{r.kind}" for r in RULES)
    digest = lambda keep: f"coalesce(string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank) {keep}, '')"
    base = digest(f"FILTER (WHERE rank < {len(RULES)})")
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rn FROM documents),
found AS ({' UNION ALL '.join(parts)})
SELECT docs.doc_id, {counts}, sha256({base}) AS base_sha256, {digest('')} AS spans
FROM docs LEFT JOIN found ON found.rn = docs.rn GROUP BY docs.doc_id, docs.rn"""


QUERIES = {"op4_secrets": op4_secrets}
ORACLES = {"op4_secrets": _sql()}
