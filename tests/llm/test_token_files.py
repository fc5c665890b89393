"""Token files: an exact round trip, row access, and the digest of whole documents."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from finstrata.llm import token_files
from finstrata.sources.landing import new_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, file string, start int"


def expected(rows):
    t, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_table(spark, sf):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = token_files.op1_token_files(spark, sf).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected(rows)


def test_edge_rows_and_row_access(spark):
    rows = [(5, "a # b"), (5, "a # b"), (None, "x"), (2, None), (3, ""), (9, "word " * 30_000), (-4, "日本")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    folder = new_folder(spark, "tokens")
    manifest = token_files.write(docs, folder, PATH, 2, length=64)
    got = token_files.read_documents(manifest, folder).orderBy("start").collect()
    assert [tuple(r)[:4] for r in got] == expected(rows)
    for m in manifest.collect():
        f = token_files.TokenFile(folder, m.file)
        assert len(f) == m.n_rows
        flat = np.concatenate([ids[mask] for ids, mask in (f[i] for i in range(len(f)))])
        assert flat.tolist() == np.concatenate([ids for _, ids in token_files.documents_of(folder, m.file)]).tolist()
        assert not f[0][0].flags.owndata


def test_empty_table(spark):
    folder = new_folder(spark, "tokens")
    assert token_files.read_documents(token_files.write(spark.createDataFrame([], SCHEMA), folder, PATH, 2), folder).count() == 0
