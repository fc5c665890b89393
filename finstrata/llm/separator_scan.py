"""Token counts by a separator scan over flat token files.

A flat file is nothing but ids, each document closed by a separator id; no index says where documents begin. Blocks of a file are scanned apart,
each by one vectorised comparison. What a block cannot know, how many documents end before it and where the last of them ends, comes from
a prefix scan over one row per block. Ids past the last separator of a file form an unterminated document.

Defined results: a null or empty text has 0 tokens; the separator is not counted; repeated rows are counted each; an empty table has no counts;
extra columns are ignored. The separator must be an id that no text encodes to: names of special tokens in texts are ordinary text here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from finstrata.llm.encoding import encoder_for
from finstrata.llm.files import system, task_name
from finstrata.llm.lean import lean
from finstrata.session import ship
from finstrata.sources.landing import land, new_folder

BLOCK = 1 << 22  # ids of a block


def write_flat(docs: DataFrame, folder: str, tokenizer: str, separator: int) -> DataFrame:
    """One flat file per task, in scan order. Returns the landed names of documents: file, ordinal, doc_id, width (bytes of an id)."""
    ship(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer, special_as_text=True)
        end = np.array([separator], encoder.dtype).tobytes()
        found, root = system(folder)
        name, sink, n = task_name(), None, 0
        for batch in lean(batches):
            sink = sink or found.open_output_stream(f"{root}/{name}.bin")
            for ids in encoder.encode(batch["text"]):
                sink.write(ids.tobytes() + end)
            ordinals = pa.array(np.arange(n, n + batch.num_rows))
            n += batch.num_rows
            yield pa.record_batch([pa.array([name] * batch.num_rows), ordinals, batch["doc_id"], pa.array([len(end)] * batch.num_rows, pa.int32())], names=["file", "ordinal", "doc_id", "width"])
        if sink is not None:
            sink.close()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return land(rows.mapInArrow(encode, "file string, ordinal bigint, doc_id bigint, width int"), "flat-names")


def scan(files: DataFrame, folder: str, separator: int, block: int = BLOCK) -> DataFrame:
    """file, ordinal, start, n_tokens, terminated of every document. ``files``: file, width."""
    ship(files.sparkSession)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, root = system(folder)
        for batch in batches:
            for file, width in zip(batch["file"].to_pylist(), batch["width"].to_pylist()):
                n = -(-found.get_file_info(f"{root}/{file}.bin").size // (block * width))
                yield pa.record_batch([pa.array([file] * n, pa.string()), pa.array([width] * n, pa.int32()), pa.array(np.arange(n), pa.int64())], names=["file", "width", "block"])

    def separators(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per separator (nth of its block, where it lies, where the one before lies if that is in the block) and one with nth null for the end of the block."""
        found, root = system(folder)
        for batch in batches:
            for file, width, at in zip(*(batch[c].to_pylist() for c in ("file", "width", "block"))):
                with found.open_input_file(f"{root}/{file}.bin") as source:
                    source.seek(at * block * width)
                    ids = np.frombuffer(source.read(block * width), f"<u{width}")
                places = np.flatnonzero(ids == separator) + at * block
                n = len(places)
                columns = [
                    pa.array([file] * (n + 1), pa.string()), pa.array(np.full(n + 1, at), pa.int64()), pa.array([*range(n), None], pa.int64()),
                    pa.array(np.append(places, at * block + len(ids)), pa.int64()), pa.array(([None, *places[:-1], None] if n else [None]), pa.int64()),
                ]
                yield pa.record_batch(columns, names=["file", "block", "nth", "place", "previous"])

    dealt = files.select("file", "width").mapInArrow(blocks, "file string, width int, block bigint").repartition("file", "block")
    found = land(dealt.mapInArrow(separators, "file string, block bigint, nth bigint, place bigint, previous bigint"), "separators")
    is_end = F.col("nth").isNotNull()
    each = found.groupBy("file", "block").agg(F.count("nth").alias("n"), F.max(F.when(is_end, F.col("place"))).alias("last"), F.max(F.when(~is_end, F.col("place"))).alias("end"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    state = each.select(
        "file", "block", "end", "n", "last",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ended"),
        F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("carry"),
        (F.max("block").over(Window.partitionBy("file")) == F.col("block")).alias("is_last"),
    )
    after = lambda place: (place + 1).alias("start")
    before = F.coalesce(F.col("previous"), F.col("carry"))
    closed = found.where(is_end).join(state, ["file", "block"]).select("file", (F.col("ended") + F.col("nth")).alias("ordinal"), after(before), (F.col("place") - before - 1).alias("n_tokens"), F.lit(True).alias("terminated"))
    tail = F.coalesce(F.col("last"), F.col("carry"))
    open_ = state.where(F.col("is_last") & (F.col("end") > tail + 1)).select("file", (F.col("ended") + F.col("n")).alias("ordinal"), after(tail), (F.col("end") - tail - 1).alias("n_tokens"), F.lit(False).alias("terminated"))
    return closed.unionByName(open_)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens of every document, with the file and the place where it begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder, separator = new_folder(spark, "flat-tokens"), 50256
    names = write_flat(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), separator)
    counts = scan(names.groupBy("file").agg(F.first("width").alias("width")), folder, separator)
    return names.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens", "start", "file", "ordinal")


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLES: dict[str, str] = {}
