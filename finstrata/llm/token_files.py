"""Token ids as Arrow stream files of fixed-size-list batches.

A file holds the ids of consecutive documents (ascending doc_id), each closed by ``end_id``, cut into rows of ``length`` ids. Three columns: ``ids``,
``mask`` (false on the padding of the last row) and ``ends`` (true on each document's last id; an id equal to ``end_id`` inside a text is no end).
All batches but the last have ``ROWS`` rows, so row i lies at a computable place and a mapped file gives it without a copy (``TokenFile``). A second
small stream per file names the documents. The manifest, one row per file, is what readers start from.

Defined results: a null text is an empty one, of ``end_id`` alone; null doc_ids come first; repeated rows are written as often as they occur; an
empty table gives an empty manifest; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from finstrata.llm.encoding import encoder_for
from finstrata.llm.files import open_mapped, system, task_name
from finstrata.llm.lean import lean
from finstrata.session import ship
from finstrata.sources.landing import land, new_folder

ROWS = 128  # of a batch
MANIFEST = "part int, file string, n_docs bigint, n_tokens bigint, n_rows bigint"
NAMES = pa.schema([("doc_id", pa.int64())])


def _schema(dtype: type, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length)), ("ends", pa.list_(pa.bool_(), length))])


class _Writer:
    """One file: takes the ids of document after document."""

    def __init__(self, folder: str, name: str, dtype: type, length: int):
        self.found, root = system(folder)
        self.length, self.schema = length, _schema(dtype, length)
        self.sinks = [self.found.open_output_stream(f"{root}/{name}{kind}") for kind in (".arrows", ".docs.arrows")]
        self.ids = pa.ipc.new_stream(self.sinks[0], self.schema)
        self.names = pa.ipc.new_stream(self.sinks[1], NAMES)
        self.pending: list[np.ndarray] = []
        self.ended: list[int] = []  # places of document ends in what is pending
        self.size = self.n_docs = self.n_tokens = self.n_rows = 0

    def add(self, ids: np.ndarray) -> None:
        self.pending.append(ids)
        self.size += len(ids)
        self.ended.append(self.size - 1)
        self.n_docs += 1
        self.n_tokens += len(ids)
        if self.size >= ROWS * self.length:
            self._flush(ROWS * self.length)

    def _flush(self, unit: int) -> None:
        flat = np.concatenate(self.pending)
        whole = len(flat) // unit * unit
        ends = np.zeros(len(flat), bool)
        ends[self.ended] = True
        for at in range(0, whole, ROWS * self.length):
            to = min(whole, at + ROWS * self.length)
            self._write(flat[at:to], np.ones(to - at, bool), ends[at:to])
        self.pending, self.size = [flat[whole:]], len(flat) - whole
        self.ended = list(np.flatnonzero(ends[whole:]))

    def _write(self, ids: np.ndarray, mask: np.ndarray, ends: np.ndarray) -> None:
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask, ends)]
        self.ids.write_batch(pa.record_batch(columns, schema=self.schema))
        self.n_rows += len(ids) // self.length

    def close(self) -> None:
        if self.size:
            pad = -self.size % self.length
            flat = np.concatenate([*self.pending, np.zeros(pad, self.pending[0].dtype)])
            mask, ends = np.arange(len(flat)) < self.size, np.zeros(len(flat), bool)
            ends[self.ended] = True
            self._write(flat, mask, ends)
        self.ids.close()
        self.names.close()
        for sink in self.sinks:
            sink.close()


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, length: int = 2048) -> DataFrame:
    """Writes the files and returns the landed manifest. Ids are two bytes wide where the vocabulary allows it."""
    ship(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer)
        end = np.array([end_id], encoder.dtype)
        out = None
        for batch in lean(batches):
            if out is None:
                name = task_name()
                out = _Writer(folder, name, encoder.dtype, length)
            out.names.write_batch(pa.record_batch([batch["doc_id"].cast(pa.int64())], schema=NAMES))
            for ids in encoder.encode(batch["text"]):
                out.add(np.concatenate([ids, end]))
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([x], t) for x, t in ((int(name.split("-")[1]), pa.int32()), (name, pa.string()), (out.n_docs, pa.int64()), (out.n_tokens, pa.int64()), (out.n_rows, pa.int64()))], names=["part", "file", "n_docs", "n_tokens", "n_rows"])

    return land(ordered.mapInArrow(encode, MANIFEST), "token-manifest")


class TokenFile:
    """Random access to the rows of one file."""

    def __init__(self, folder: str, file: str):
        found, root = system(folder)
        self.batches = pa.ipc.open_stream(open_mapped(found, f"{root}/{file}.arrows")).read_all().to_batches()

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of row i; the ids are a view of the file."""
        batch, row = self.batches[i // ROWS], i % ROWS
        ids, mask = batch["ids"], batch["mask"]
        length = ids.type.list_size
        return ids.values.to_numpy(zero_copy_only=True)[row * length : (row + 1) * length], mask.values.slice(row * length, length).to_numpy(zero_copy_only=False)


def documents_of(folder: str, file: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document of a file, batch after batch."""
    found, root = system(folder)
    with open_mapped(found, f"{root}/{file}.docs.arrows") as source:
        names = iter(pa.ipc.open_stream(source).read_all()["doc_id"].to_pylist())
    rest: list[np.ndarray] = []
    with open_mapped(found, f"{root}/{file}.arrows") as source:
        for batch in pa.ipc.open_stream(source):
            ids = batch["ids"].values.to_numpy(zero_copy_only=True)
            at = 0
            for end in np.flatnonzero(batch["ends"].values.to_numpy(zero_copy_only=False)):
                yield next(names), np.concatenate([*rest, ids[at : end + 1]]) if rest else ids[at : end + 1]
                rest, at = [], end + 1
            if at < len(ids):
                rest.append(ids[at:].copy())


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of unsigned 32-bit little-endian ids), file: from the files, one task per file at most."""
    ship(manifest.sparkSession)
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per file
    files = manifest.select("file", before.alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch["file"].to_pylist(), batch["before"].to_pylist()):
                out: list[tuple] = []
                for doc_id, ids in documents_of(folder, file):
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), file))
                    start += len(ids)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["doc_id", "start", "n_tokens", "ids_crc32", "file"])

    n = max(manifest.count(), 1)
    return files.repartition(n).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, file string")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = new_folder(spark, "token-files")
    return read_documents(write(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2), folder).drop("file")


QUERIES = {"op1_token_files": op1_token_files}
ORACLES: dict[str, str] = {}
