"""Readers: nested fact documents, filing lists, registries, splits, labelled CSV tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..constants import INDICATORS, SPLITS

FACT_ENTRY = T.StructType([
    T.StructField("start", T.StringType()), T.StructField("end", T.StringType()), T.StructField("val", T.LongType()),
    T.StructField("accn", T.StringType()), T.StructField("fy", T.IntegerType()), T.StructField("fp", T.StringType()),
    T.StructField("form", T.StringType()), T.StructField("filed", T.StringType()), T.StructField("frame", T.StringType()),
])
UNITS = T.StructType([T.StructField("units", T.MapType(T.StringType(), T.ArrayType(FACT_ENTRY)))])
FACT_DOCUMENT = T.StructType([
    T.StructField("cik", T.LongType()), T.StructField("entityName", T.StringType()),
    T.StructField("facts", T.MapType(T.StringType(), T.MapType(T.StringType(), UNITS))),
])
SOURCE = T.StructType([T.StructField("method", T.StringType()), T.StructField("facts", T.ArrayType(T.MapType(T.StringType(), T.StringType())))])
PANEL_ROW = T.StructType(
    [T.StructField("ticker", T.StringType()), T.StructField("fiscal_year", T.IntegerType()),
     T.StructField("fiscal_quarter", T.IntegerType()), T.StructField("period_start", T.DateType()),
     T.StructField("period_end", T.DateType()), T.StructField("available_on", T.DateType()),
     T.StructField("currency", T.StringType())]
    + [T.StructField(f"{i}_vnd", T.StringType()) for i in INDICATORS]
    + [T.StructField("sources", T.MapType(T.StringType(), SOURCE))]
)
PANEL_DOCUMENT = T.StructType([
    T.StructField("ticker", T.StringType()), T.StructField("entity_name", T.StringType()),
    T.StructField("currency", T.StringType()), T.StructField("indicator_count", T.IntegerType()),
    T.StructField("rows", T.ArrayType(PANEL_ROW)),
])
REGISTRY = T.MapType(T.StringType(), T.StructType([
    T.StructField("cik", T.LongType()), T.StructField("entity_name", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("sha256", T.StringType()), T.StructField("downloaded_at", T.StringType())]))
SAMPLE_CSV = T.StructType(
    [T.StructField("fiscal_year", T.IntegerType()), T.StructField("fiscal_quarter", T.IntegerType()),
     T.StructField("period_start", T.DateType()), T.StructField("period_end", T.DateType()),
     T.StructField("available_on", T.DateType())]
    + [T.StructField(f"{i}_vnd", T.LongType()) for i in INDICATORS[:10]]
)


def flatten_facts(documents: DataFrame, keys: Sequence[str] = ("entity",)) -> DataFrame:
    """Nested taxonomy -> tag -> unit -> entries as long rows. Three generators in a row, no shuffle."""
    t = documents.select(*keys, F.explode("facts").alias("taxonomy", "tags"))
    t = t.select(*keys, "taxonomy", F.explode("tags").alias("tag", "body"))
    t = t.select(*keys, "taxonomy", "tag", F.explode("body.units").alias("unit", "entries"))
    t = t.select(*keys, "taxonomy", "tag", "unit", F.explode("entries").alias("e"))
    return t.select(
        *keys, "taxonomy", "tag", "unit", F.col("e.start").try_cast("date").alias("start_d"),
        F.col("e.end").try_cast("date").alias("end_d"), F.col("e.val").alias("val"), F.col("e.accn").alias("accn"),
        F.col("e.fy").alias("fy"), F.col("e.fp").alias("fp"), F.col("e.form").alias("form"),
        F.col("e.filed").try_cast("date").alias("filed"), F.col("e.frame").alias("frame"),
    )


def parse_fact_documents(texts: DataFrame, text: str = "doc") -> DataFrame:
    """(entity, doc JSON) -> long facts."""
    parsed = texts.select("entity", F.from_json(text, FACT_DOCUMENT).alias("d")).select("entity", "d.facts")
    return flatten_facts(parsed)


def read_fact_documents(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file per entity; the entity is the file name up to the first dash. Land the result as Parquet once
    (``land_facts``) so that later tag and unit filters are pushed into the scan."""
    docs = spark.read.schema(FACT_DOCUMENT).option("multiLine", True).json(path)
    entity = F.regexp_extract(F.col("_metadata.file_name"), r"^([^-]+)-", 1)
    return flatten_facts(docs.select(entity.alias("entity"), "cik", "entityName", "facts"), ["entity", "cik"])


def read_panel_documents(spark: SparkSession, path: str) -> DataFrame:
    """Entity documents with a ``rows`` array as panel rows."""
    docs = spark.read.schema(PANEL_DOCUMENT).option("multiLine", True).json(path)
    return docs.select(F.explode("rows").alias("r")).select("r.*")


def panel_from_documents(rows: DataFrame) -> DataFrame:
    """String money to exact integers under the plain indicator names."""
    return rows.select(
        F.col("ticker").alias("entity"), "fiscal_year", "fiscal_quarter", "period_start", "period_end", "available_on",
        *[F.col(f"{i}_vnd").try_cast("decimal(38,0)").alias(i) for i in INDICATORS],
    )


def indicator_fields(df: DataFrame, suffix: str = "_vnd") -> list[str]:
    return [c for c in df.columns if c.endswith(suffix)]


def order_by_corpus(docs: DataFrame, corpus: DataFrame) -> DataFrame:
    """Attach the position of each entity in the corpus; entities not listed come last, by name."""
    return docs.join(corpus.select("entity", "corpus_pos"), "entity", "left")


def parse_registry(texts: DataFrame, text: str = "doc") -> DataFrame:
    """{ticker: {cik, entity_name, url, sha256, downloaded_at}} -> rows."""
    return texts.select(F.explode(F.from_json(text, REGISTRY)).alias("ticker", "r")).select("ticker", "r.*")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return parse_registry(spark.read.option("wholetext", True).text(path), "value")


def zip_filings(pages: DataFrame, keys: Sequence[str] = ("entity",)) -> DataFrame:
    """Column-oriented filing lists (parallel arrays) to one row per filing."""
    arrays = ["form", "filingDate", "accessionNumber", "items"]
    return pages.select(*keys, F.explode(F.arrays_zip(*arrays)).alias("f")).select(
        *keys, F.col("f.form").alias("form"), F.col("f.filingDate").try_cast("date").alias("filing_date"),
        F.col("f.accessionNumber").alias("accession"), F.col("f.items").alias("items"),
    )


def all_filings(recent: DataFrame, extra: DataFrame, keys: Sequence[str] = ("entity",)) -> DataFrame:
    return zip_filings(recent, keys).unionByName(zip_filings(extra, keys))


def entities_from_files(files: DataFrame, name: str = "file_name") -> DataFrame:
    """Distinct entities named by files like ``LOW-16-indicators.json``."""
    return files.select(F.regexp_extract(name, r"^([^-]+)-", 1).alias("entity")).where("entity <> ''").distinct()


def load_split(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One split of a dataset written with ``partitionBy('split')``: only its folder is read."""
    if name not in SPLITS:
        raise ValueError(f"unknown split {name!r}; expected one of {SPLITS}")
    return spark.read.parquet(root).where(F.col("split") == name)


def load_json_split(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    """A split kept as one JSON array file. A missing file raises."""
    if name not in SPLITS:
        raise ValueError(f"unknown split {name!r}; expected one of {SPLITS}")
    return spark.read.schema(schema).option("multiLine", True).json(f"{root}/{name}.json")


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def check_labelled(df: DataFrame, target: str) -> DataFrame:
    """The target must exist and hold only 0 and 1."""
    if target not in df.columns:
        raise KeyError(f"target column {target!r} not found; columns: {df.columns}")
    bad = F.col(target).isNull() | ~F.col(target).isin(0, 1)
    if df.where(bad).limit(1).count():
        raise ValueError(f"target column {target!r} must hold only 0 and 1")
    return df


def read_labelled_csv(spark: SparkSession, path: str, target: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("enforceSchema", False)
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    return check_labelled(df, target)


def labelled_from_csv_lines(lines: DataFrame, schema: str, line: str = "line") -> DataFrame:
    return lines.select(F.from_csv(line, schema).alias("r")).select("r.*")


def read_sample_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLE_CSV).option("header", True).csv(path)


def row_text(cols: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols])
