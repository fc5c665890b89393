"""The transducer against the tiktoken library, round trips, the UTF-8 machine against Python's decoder."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from finstrata.llm import bpe_codec, transducer
from finstrata.llm.transducer import Pieces, Transducer, read_ranks
from finstrata.llm.utf8_stream import ACCEPT, Stream, TokenMachine, run

NAMES = ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"]


def ranks_of(name):
    with open(public_tokenizers.path(name), "rb") as file:
        return read_ranks(file.read())


def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


RANKS = ranks_of(NAMES[0])
PIECES = Pieces(Transducer(RANKS))
LIBRARY = library(RANKS)
PATTERN = bpe_codec._pattern(public_tokenizers.PATTERN)
TEXT = st.text(alphabet=st.one_of(st.sampled_from("aeinrst  '0.\n\t\x1c\x85\xa0​中文ß😀"), st.characters(codec="utf-8")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_ids_are_the_library_s(text):
    ids = bpe_codec.encode_text(text, PIECES, PATTERN)
    assert ids.tolist() == LIBRARY.encode_ordinary(text)


@pytest.mark.parametrize("name", NAMES)
def test_pieces_of_tokens(name):
    ranks = ranks_of(name)
    pieces, other = Pieces(Transducer(ranks)), library(ranks)
    draw = np.random.default_rng(5)
    tokens = list(ranks)
    for _ in range(3000):
        text = b"".join(tokens[i] for i in draw.integers(0, len(tokens), draw.integers(1, 5))).decode("utf-8", "ignore")
        assert bpe_codec.encode_text(text, pieces, PATTERN).tolist() == other.encode_ordinary(text), text


def test_long_pieces_and_forgotten_states(monkeypatch):
    text = "a" * 9000 + "ab" * 5000 + "thereo" * 3000 + " " * 5000 + "=" * 4500
    assert bpe_codec.encode_text(text, PIECES, PATTERN).tolist() == LIBRARY.encode_ordinary(text)
    monkeypatch.setattr(transducer, "MAX_STATES", 50)
    small = Pieces(Transducer(RANKS))
    for text in [text, "Thatin ndeawhst astheandou the bleer", "intonation" * 700]:
        assert bpe_codec.encode_text(text, small, PATTERN).tolist() == LIBRARY.encode_ordinary(text)
    assert len(small.transducer.readings) <= 51 + 8


def test_tokens_are_printed_after_bounded_lookahead():
    machine = Transducer(RANKS)
    text = b"intonationandonanonwhereasthen" * 30
    read = 0

    def feed():
        nonlocal read
        for byte in text:
            read += 1
            yield byte

    printed, delays = 0, []
    out = []
    for token in machine.stream(feed()):
        out.append(token)
        printed += len(machine.tokens[token])
        delays.append(read - printed)
    assert tuple(out) == machine.encode(text)
    assert max(delays) < 40


def test_a_small_vocabulary_against_plain_merging():
    ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate([b"ab", b"bc", b"abc", b"ca", b"bca", b"aa", b"aab", b"cab", b"zzq"])}
    pieces, other = Transducer(ranks), library(ranks)
    draw = np.random.default_rng(1)
    for _ in range(3000):
        text = "".join(draw.choice(list("abcz"), draw.integers(1, 30)))
        assert list(pieces.encode(text.encode())) == other.encode_ordinary(text), text
    assert pieces.encode(b"zzq") == (ranks[b"zzq"],)  # no merges lead to it, but the whole piece is a token
    with pytest.raises(ValueError):
        Transducer({b"a": 0})


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=12))
def test_machine_accepts_what_python_decodes(data):
    try:
        data.decode()
        fine = True
    except UnicodeDecodeError:
        fine = False
    assert (run(ACCEPT, data) == ACCEPT) == fine
    machine = TokenMachine({b: bytes([b]) for b in range(256)})
    assert machine.decode(np.array(list(data), np.int64)) == (data, fine)


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_stream_gives_whole_characters(text):
    machine = TokenMachine({rank: token for token, rank in RANKS.items()})
    ids = bpe_codec.encode_text(text, PIECES, PATTERN)
    assert machine.decode(ids) == (text.encode(), True)
    stream = Stream(machine)
    out = []
    for i in ids.tolist():
        out.append(stream.push(i))
        assert text.startswith("".join(out))
    stream.close()
    assert "".join(out) == text


def test_rows(spark):
    path = public_tokenizers.path(NAMES[0])
    rows = [(1, "Hello  world"), (1, "Hello  world"), (None, "x"), (4, None), (5, ""), (6, "ab " * 20000)]
    docs = spark.createDataFrame([(i, t, "mine", 7) for i, t in rows], "doc_id bigint, text string, ids string, bytes int")
    got = sorted(bpe_codec.decode(bpe_codec.encode(docs, path), path).collect(), key=lambda r: (r["doc_id"] or -1, r["bytes"]))
    assert [bytes(r["bytes"]).decode() for r in got] == [t or "" for _, t in sorted(rows, key=lambda r: (r[0] or -1, r[1] or ""))]
    assert all(r["ids"] == LIBRARY.encode_ordinary(bytes(r["bytes"]).decode()) and r["well_formed"] for r in got)
    assert bpe_codec.decode(bpe_codec.encode(docs.limit(0), path), path).count() == 0


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in bpe_codec.op12_bpe_codec(spark, sf).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = LIBRARY.encode_ordinary(text or "")
        assert got[doc_id]["n_tokens"] == len(ids)
        assert got[doc_id]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
