"""Writers: splits, manifests, ranked tables, ledgers, entity documents, content hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..constants import INDICATORS
from .documents import row_text


def write_splits(samples: DataFrame, root: str, fmt: str = "parquet") -> None:
    """One folder per split, rows clustered so that each split is written by the tasks that hold it."""
    samples.write.mode("overwrite").partitionBy("split").format(fmt).save(root)


def land_facts(facts: DataFrame, root: str, buckets: int = 64) -> None:
    """Long facts as Parquet in ``buckets`` files by ranges of (tag, entity, period end): an entity or tag with a third of all facts still spreads
    over many files, and a filter on tag skips the files and row groups of the others."""
    order = ["tag", "entity", "end_d"] if "end_d" in facts.columns else ["tag", "entity"]
    facts.repartitionByRange(buckets, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(root)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 per file. Files are entity snapshots of a few megabytes; each is one binary row."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), F.sha2("content", 256).alias("sha256"), "length"
    )


def content_fingerprint(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Order-independent hash of a set of rows: count plus the sum of a 40-bit slice of each row's SHA-256.

    Partial sums combine map-side, unlike a hash over the sorted rows.
    """
    part = F.conv(F.substring(F.sha2(row_text(cols), 256), 1, 10), 16, 10).cast("bigint")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(part.cast("decimal(38,0)")).cast("decimal(38,0)").cast("string").alias("fingerprint"))


def build_manifest(samples: DataFrame) -> DataFrame:
    """Counts, positives and test range per split, as rows."""
    return samples.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_distressed").alias("positives"),
        F.countDistinct("entity").alias("entities"), F.min("target_period_start").alias("first_start"),
        F.max("target_period_end").alias("last_end"),
    )


def manifest_json(manifest: DataFrame) -> DataFrame:
    return manifest.select("split", F.to_json(F.struct(*[c for c in manifest.columns if c != "split"])).alias("body"))


def ranked(scored: DataFrame, score: str = "p", key: str = "entity") -> DataFrame:
    """Highest score first, ties by key. A sort with range partitions, so every task writes one slice."""
    return scored.orderBy(F.col(score).desc(), F.col(key))


def write_ranked_csv(scored: DataFrame, path: str, score: str = "p", key: str = "entity") -> None:
    """Excel-friendly: the first header carries a byte-order mark."""
    out = ranked(scored, score, key)
    first = out.columns[0]
    out.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("header", True).csv(path)


def error_cases(scored: DataFrame, features: DataFrame, evidence: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Misclassified samples with the features that explain them."""
    wrong = scored.withColumn("predicted", (F.col("p") >= threshold).cast("int")).where("predicted <> y")
    return wrong.join(features.select("sample_id", *evidence), "sample_id")


def ledger_rows(trials: DataFrame, params: Sequence[str]) -> DataFrame:
    """Hyper-parameter columns folded into one JSON column."""
    rest = [c for c in trials.columns if c not in params]
    return trials.select(*rest, F.to_json(F.struct(*params)).alias("params"))


def append_ledger(trials: DataFrame, params: Sequence[str], path: str) -> None:
    ledger_rows(trials, params).write.mode("append").json(path)


def entity_documents(cells_wide: DataFrame, rate: int, fields: Sequence[str] = tuple(INDICATORS)) -> DataFrame:
    """Rows of one entity gathered into its document (bounded by the number of quarters)."""
    item = F.struct(
        "period_end", "fiscal_year", "fiscal_quarter", "period_start", "available_on", F.lit("VND").alias("currency"),
        *[F.col(f).cast("string").alias(f"{f}_vnd") for f in fields],
    )
    return cells_wide.groupBy("entity").agg(F.array_sort(F.collect_list(item)).alias("rows")).select(
        "entity", F.lit("VND").alias("currency"), F.lit(len(fields)).alias("indicator_count"),
        F.lit(rate).alias("vnd_per_usd"), "rows",
    )


def result_rows(metrics: DataFrame, ids: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Mean and spread (population) of every metric over folds, one row per id."""
    aggs: list[Column] = []
    for n in names:
        aggs += [F.avg(n).alias(f"{n}_mean"), F.stddev_pop(n).alias(f"{n}_std")]
    return metrics.groupBy(*ids).agg(*aggs)
