"""Naming rows by doc_id and text, so that ids may be null or repeat, and leaving out a list of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

NO_ID = -(2**63)  # stands for a null doc_id
MAX_BROADCAST = 1_000_000  # rows of a landed, counted list that are broadcast; more are shuffled


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with _did (doc_id) and _tid (a hash of the text)."""
    return docs.withColumns({"_did": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)), "_tid": F.xxhash64(F.col("text").cast("string"))})


def sent(rows: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """A landed list, marked for broadcast if it is short."""
    return F.broadcast(rows) if rows.count() <= most else rows
