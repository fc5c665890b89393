"""Quality rules: counts that speak for themselves, and perplexity bands for each language.

A text fails outright if it has fewer than ``MIN_WORDS`` words or if more than half of its words lie in repeated 3-word windows. Of the others, a text
is kept if both of its perplexities under the corpus's own models, that of characters in nats a character and that of word pairs in nats a word, lie
within its language's bands: ``HIGH`` times the spread between the quartiles above the median and ``LOW`` or ``WORD_LOW`` times below it, ``FLOOR`` at
least. Noise scores high; stock characters, stock phrases and lists in which one sign follows another score low. The lower bound of the characters is wider,
since plain prose with a small vocabulary has a long tail there.

Defined results: a null or blank text has no words and fails; a null language is a language of its own; repeated rows are judged alike; an
empty table gives an empty result; ``filter_documents`` keeps every column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from finstrata.llm import word_model
from finstrata.llm.kneser_ney import Model, distinct_words, fit, grams_of, quantiles
from finstrata.llm.lean import lean
from finstrata.llm.rows import NO_ID, keyed, sent
from finstrata.llm.words import BLANK_CUT_CASED, Words, chunks, mix, shingle_hashes, words_of
from finstrata.session import ship
from finstrata.sources.landing import land

MIN_WORDS = 50
HIGH = 4.0
LOW = 6.0
WORD_LOW = 4.0
FLOOR = 0.1
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_text(w: Words, flags: np.ndarray, places: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[places[1:]] - sums[places[:-1]]


def _repeated(w: Words) -> np.ndarray:
    """Words that lie in a 3-word window which its text has at least twice."""
    n = len(w.hashes)
    covered = np.zeros(n, bool)
    if n < 3:
        return covered
    text = np.repeat(np.arange(len(w.rows) - 1), np.diff(w.rows))
    inside = np.flatnonzero(text[:-2] == text[2:])
    key = mix(shingle_hashes(w.hashes, 3)[inside] + text[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    for k in range(3):
        covered[inside[again] + k] = True
    return covered


def _repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def measure(docs: DataFrame, model: Model, known: word_model.Vocabulary) -> DataFrame:
    """_did, _tid (names of the row), lang, the counts, the sum of log probabilities of the characters, the number of n-grams;
    piece and payload (numbers of its words) in one row of each piece."""
    ship(docs.sparkSession)
    spread = docs.sparkSession.sparkContext.broadcast((model, known))
    names = ["_did", "_tid", "lang", *COUNTS, "log_p", "n_grams", "piece", "payload"]
    types = [*[pa.int64()] * 5, pa.float64(), pa.int64()]

    def rows(held: list[tuple]) -> pa.RecordBatch:
        *columns, sizes, numbers, names_, langs = zip(*held)
        dids, tids = [np.concatenate(x) for x in zip(*names_)]
        piece, payload = word_model.piece_of(dids, tids, np.concatenate(sizes), np.concatenate(numbers))
        rest = [None] * (len(dids) - 1)
        arrays = [pa.array(np.concatenate(c)).cast(t) for c, t in zip(columns, types)]
        return pa.record_batch([pa.array(dids), pa.array(tids), pa.concat_arrays(langs), *arrays, pa.array([piece, *rest], pa.int64()), pa.array([payload, *rest], pa.binary())], names=names)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        characters, words_known = spread.value
        held: list[tuple] = []
        n_held = 0
        for batch in lean(batches):
            all_dids, all_tids = batch["_did"].to_numpy(), batch["_tid"].to_numpy()
            for at, texts in chunks(batch["text"]):
                w = words_of(texts, BLANK_CUT_CASED)
                buf = np.frombuffer(w.data, np.uint8)
                heads = BLANK_CUT_CASED.inside[buf] & ((buf & 0xC0) != 0x80)
                row = [np.diff(w.rows), _per_text(w, heads, w.texts), _per_text(w, _SYMBOL[buf], w.texts), np.array([_repeated_lines(t) for t in texts]), _per_text(w, _repeated(w), w.rows)]
                log_p, n = np.zeros(len(w.starts)), np.zeros(len(w.starts), np.int64)
                if len(w.starts):
                    words, which, _ = distinct_words(w)
                    grams, sizes = grams_of(words)
                    some, back = np.unique(grams, return_inverse=True)
                    sums = np.add.reduceat(characters.log_p(some)[back], np.cumsum(sizes) - sizes)
                    log_p, n = sums[which], sizes[which]
                numbers, own = words_known.number(w.hashes), slice(at, at + len(texts))
                held.append((*row, np.round(_per_text(w, log_p, w.rows), 6), _per_text(w, n, w.rows), np.diff(w.rows), numbers, (all_dids[own], all_tids[own]), batch["lang"].slice(at, len(texts))))
                n_held += len(numbers) + len(texts)
                if n_held >= word_model.PIECE:
                    yield rows(held)
                    held, n_held = [], 0
        if held:
            yield rows(held)

    texts = keyed(docs).select("_did", "_tid", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = ", ".join(f"{c} bigint" for c in COUNTS)
    return texts.mapInArrow(one, f"_did bigint, _tid bigint, lang string, {counts}, log_p double, n_grams bigint, piece bigint, payload binary")


def judge(docs: DataFrame, high: float = HIGH, low: float = LOW, word_low: float = WORD_LOW, floor: float = FLOOR) -> DataFrame:
    """_did, _tid, _lang (names of the row), the counts, base_failed, kept, log_perplexity (of word pairs), char_log_perplexity, low, high, word_low,
    word_high for every row."""
    docs = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    known = word_model.vocabulary(docs)
    measured = land(measure(docs, fit(docs), known), "quality-measures")
    pieces, n = measured.where("piece is not null").select("piece", "payload"), word_model.buckets(docs, known)
    answered = word_model.answers(pieces, n)
    words = word_model.scores(pieces, answered, word_model.fit(answered, len(known)), n)
    scored = measured.drop("piece", "payload").join(words, ["_did", "_tid"], "left").withColumns({
        "base_failed": failed, "char_log_perplexity": F.when(F.col("n_grams") > 0, -F.col("log_p") / F.col("n_grams")),
        "log_perplexity": F.when(F.col("n_words") > 0, -F.col("word_log_p") / F.col("n_words")), "_lang": F.coalesce("lang", F.lit("")),
    })
    scored = land(scored, "quality-scores")
    q, r = [quantiles(scored.where("not base_failed"), "_lang", c, [0.25, 0.5, 0.75]) for c in ("char_log_perplexity", "log_perplexity")]
    reach = lambda width: F.greatest(width * (F.col("q2") - F.col("q0")), F.lit(floor))
    bands = q.select("_lang", (F.col("q1") - reach(low)).alias("low"), (F.col("q1") + reach(high)).alias("high"))
    bands = bands.join(r.select("_lang", (F.col("q1") - reach(word_low)).alias("word_low"), (F.col("q1") + reach(high)).alias("word_high")), "_lang")
    inside = F.coalesce(F.col("char_log_perplexity").between(F.col("low"), F.col("high")) & F.col("log_perplexity").between(F.col("word_low"), F.col("word_high")), F.lit(False))
    kept = (~F.col("base_failed") & inside).alias("kept")
    return scored.join(bands, "_lang", "left").select("_did", "_tid", "_lang", *COUNTS, "base_failed", kept, "log_perplexity", "char_log_perplexity", "low", "high", "word_low", "word_high")


def filter_documents(docs: DataFrame, high: float = HIGH, low: float = LOW, word_low: float = WORD_LOW, floor: float = FLOOR) -> DataFrame:
    """The rows of ``docs`` that are kept, every column as it was."""
    row = ["_did", "_tid", "_lang"]
    gone = land(judge(docs, high, low, word_low, floor).where("not kept").select(row).distinct(), "rejected")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    return keyed(docs).withColumn("_lang", lang).join(sent(gone), row, "left_anti").select(docs.columns)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    doc_id = F.when(F.col("_did") != NO_ID, F.col("_did")).alias("doc_id")
    return judge(docs).select(doc_id, *COUNTS, "base_failed", "kept", "log_perplexity")


QUERIES = {"op5_quality": op5_quality}
ORACLES: dict[str, str] = {}
