"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

The rules are the labelled table: every URL that a rule decides is an example. The model judges the URLs that no rule decides. Features
are the 3- and 4-grams of ``host + path`` with start and end marks, hashed to ``DIMS`` buckets; digits count as one character, so that
page numbers carry nothing. Training, like scoring, runs in Spark's own machine-learning library.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and the model's verdict on the empty string,
which is ``allow`` (nothing known against it). With labels of one kind only, or none, the verdict without a rule is ``allow``.
Repeated rows are judged alike; extra columns are kept by ``judge``.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from finstrata.llm.expressions import ascii_lower, let

# ---- fixed values: rules (verdict, host, path) --------------------------------------------------------
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
DIMS = 1 << 14
MAX_LABELLED = 50_000  # rows of the labelled table at most: the model is fitted on this many of the labelled URLs, taken in hash order
GRAMS = (3, 4)


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does. Rules are few and fixed: a chain of conditions, longest first."""
    name, verdict = None, None
    for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return name, verdict


def grams(host: Column, path: Column) -> Column:
    text = F.concat(F.lit("^"), host, F.lit(" "), F.regexp_replace(path, r"[0-9]+", "0"), F.lit("$"))
    cut = lambda t, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))), lambda i: t.substr(i, F.lit(n)))
    return let(text, lambda t: F.concat(*[cut(t, n) for n in GRAMS]))


def _features(df: DataFrame) -> DataFrame:
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=DIMS, binary=True).transform(df.withColumn("grams", grams(F.col("host"), F.col("path"))))


def labelled_table(judged: DataFrame, max_rows: int = MAX_LABELLED) -> DataFrame:
    """URLs that a rule decides, one row each, at most ``max_rows`` of them in hash order: a small table whatever the input."""
    known = judged.where("rule is not null").groupBy("host", "path").agg(F.first("ruled").alias("ruled"))
    return known.orderBy(F.xxhash64("host", "path"), "host", "path").limit(max_rows).select("host", "path", (F.col("ruled") == "block").cast("double").alias("label"))


def judge(pages: DataFrame, rules=RULES, max_rows: int = MAX_LABELLED) -> DataFrame:
    """All columns of ``pages`` with host, path, rule, verdict and the model's probability of ``block``."""
    base = pages.drop("host", "path", "rule", "verdict", "p_block")
    parsed = base.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    judged = parsed.withColumns({"rule": rule.cast("string"), "ruled": ruled.cast("string")})
    train = _features(labelled_table(judged, max_rows)).select("label", "features").persist()
    kinds = train.agg(F.min("label"), F.max("label")).first()
    if kinds[0] is None or kinds[0] == kinds[1]:
        train.unpersist()
        return judged.withColumns({"verdict": F.coalesce("ruled", F.lit("allow")), "p_block": F.lit(None).cast("double")}).drop("ruled")
    model = LogisticRegression(maxIter=50, regParam=1e-3).fit(train)
    train.unpersist()
    scored = model.transform(_features(judged)).withColumn("p_block", vector_to_array("probability")[1])
    learnt = F.when((F.col("p_block") >= 0.5) & (F.length("host") > 0), "block").otherwise("allow")
    return scored.withColumn("verdict", F.coalesce("ruled", learnt)).select(*base.columns, "host", "path", "rule", "verdict", "p_block")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op7_url_filter": op7_url_filter}
ORACLES: dict[str, str] = {}
