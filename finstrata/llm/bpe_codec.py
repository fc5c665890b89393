"""Byte-level BPE: encoding whole texts by a finite-state transducer, decoding by an incremental UTF-8 state machine.

Each Arrow batch of texts is cut by the pattern, each piece goes through the transducer of ``transducer``; workers remember the ids of short pieces
within a bound. Nothing is exchanged. The rank file is read by every worker from its path, which all of them must reach.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows are encoded each; null doc_ids are kept; an empty table
gives no rows; extra columns are ignored. Ids that do not form UTF-8 decode to their bytes with ``well_formed`` false. An id that is not in the
vocabulary is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from finstrata.llm.lean import lean
from finstrata.llm.transducer import Pieces, Transducer, read_ranks
from finstrata.llm.utf8_stream import TokenMachine
from finstrata.session import ship

RANKS = "byte_bpe_multi_50k.tiktoken"
ROWS = 64


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return read_ranks(file.read())


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(Transducer(_ranks(path)))


@lru_cache(maxsize=2)
def _machine(path: str) -> TokenMachine:
    return TokenMachine({rank: token for token, rank in _ranks(path).items()})


@lru_cache(maxsize=4)
def _pattern(pattern: str) -> regex.Pattern:
    """White space is the Unicode property, which leaves out the four separators U+001C to U+001F."""
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def encode_text(text: str, pieces: Pieces, pattern: regex.Pattern) -> np.ndarray:
    return np.fromiter(chain.from_iterable(map(pieces.__getitem__, pattern.findall(text))), np.int32)


def encode(docs: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids (array<int>) of every text."""
    ship(docs.sparkSession)

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, cut = _pieces(ranks), _pattern(pattern)
        for batch in lean(batches, ROWS):
            rows = [encode_text(text or "", pieces, cut) for text in batch["text"].to_pylist()]
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows)))
            yield pa.record_batch([batch["doc_id"], ids], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(batches_of, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """doc_id, ids, bytes (binary), well_formed of every row of ``encoded`` (doc_id, ids)."""
    ship(encoded.sparkSession)

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(ranks)
        for batch in lean(batches, ROWS):
            column = batch["ids"]
            ends, values = column.offsets.to_numpy(), column.values.to_numpy()
            out = [machine.decode(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.record_batch(
                [batch["doc_id"], column, pa.array([d for d, _ in out], pa.binary()), pa.array([w for _, w in out])],
                names=["doc_id", "ids", "bytes", "well_formed"],
            )

    return encoded.select("doc_id", "ids").mapInArrow(batches_of, "doc_id bigint, ids array<int>, bytes binary, well_formed boolean")


def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path(RANKS)
    decoded = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks), ranks)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
        "well_formed",
    )


QUERIES = {"op12_bpe_codec": op12_bpe_codec}
#: SQL has no merges; tests/llm compares with the tiktoken library and with the texts themselves.
ORACLES: dict[str, str] = {}
