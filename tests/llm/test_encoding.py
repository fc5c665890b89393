"""The chunked encoder gives exactly the library's ids."""

import random

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from finstrata.llm import encoding
from finstrata.llm.encoding import encoder_for

PATH = public_tokenizers.path("byte_bpe_50k.json")
AWKWARD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  ", "  a", "\n\na", " \n a", "don't", "don't've", " 's", "'s", "''s", "x's's", "'sandy", "it'll go", "'re 're", "'l", "'r", "'ve", "we'v",
    "a b", "  b", "\u0085x", "\x1cx y", "tab\tsep", "a\t\tb", "1234 567", "a1b2", "é à ü ß", "naïve café", "日本語 text", "emoji 😀 x", "<|endoftext|>", "a<|endoftext|>b", "x" * 5000,
    "0123456789abcdef" * 40, "!!! ??? ...", " !", "  !!", "\r\n\r\n x", "²³¹ ½", "ª º", "ǅ ȉ", "'", " '", "' ", "'\n", "a'", "a'é", "'ſ", "\x00\x01", "a\x0bb\x0cc",
]


def plain(texts):
    t = encoder_for(PATH).tokenizer
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_awkward_texts():
    for texts in (AWKWARD, AWKWARD[::-1], [x for x in AWKWARD for _ in range(2)]):
        assert [list(x) for x in encoder_for(PATH).encode(pa.array(texts, pa.string()))] == plain(texts)


def test_random_texts():
    rng = random.Random(5)
    signs = "  \n\t'stmdrevl aAé9.,! -"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(3000)]
    assert [list(x) for x in encoder_for(PATH).encode(pa.array(texts))] == plain(texts)


def test_test_table(sf):
    texts = pq.read_table(f"{sf}/documents.parquet", columns=["text"])["text"]
    assert [list(x) for x in encoder_for(PATH).encode(texts)] == plain(texts.to_pylist())


def test_long_texts_are_cut_where_pieces_begin(monkeypatch):
    monkeypatch.setattr(encoding, "CHARS", 50)
    rng = random.Random(6)
    texts = ["".join(rng.choice(["the ", "a  ", "don't ", "\n", "9 ", "x"]) for _ in range(400)) for _ in range(20)]
    assert [list(x) for x in encoder_for(PATH).encode(pa.array(texts))] == plain(texts)


@pytest.mark.parametrize("slots", [1])
def test_clashing_slots(monkeypatch, slots):
    e = encoding.Encoder(PATH)
    e.keys[:] = 0
    texts = [f"word{i} and{i % 7}" for i in range(5000)]
    assert [list(x) for x in e.encode(pa.array(texts + texts))] == plain(texts + texts)
