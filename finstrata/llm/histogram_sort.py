"""Sharding by histogram sort: shards of near-equal bytes from exact counts below candidate boundaries, and one exchange.

The sort key is (hash of the text, doc_id, row number of the landed table), so equal texts are neighbours and no two rows tie. A splitter is
searched digit by digit: each pass counts, over all partitions, the exact bytes below 65,536 candidate boundaries inside every interval
that still holds an open splitter, keeps the one interval that crosses the target, and stops as soon as a candidate is within tolerance.
A large group of equal texts is one value of the first key part; only then do the passes go on into doc_id and row number, which splits
it. A pass returns at most ``65,536 x open splitters`` sums, whatever the input. Twelve passes exhaust the key; two are usual.

Defined results: a null text has no bytes, size 1 and the checksum of nothing, 0; null doc_ids sort first; repeated rows get slots of
their own; an empty table gives an empty result; extra columns are ignored by ``assign`` and kept by ``write_shards``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from finstrata.llm.numbering import numbered
from finstrata.sources.landing import land

DIGIT = 16  # bits per pass
PARTS = ("k_text", "k_doc", "k_row")
DIGITS = 64 // DIGIT * len(PARTS)
LAW = "bytes"


def _keys(docs: DataFrame) -> DataFrame:
    """Narrow rows with the sort key. Landed, because the row number must not change between passes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return land(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("k_text"),
            F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("k_doc"),
            F.monotonically_increasing_id().alias("k_row"),
        ),
        "shard-keys",
    )


def _digit(level: int) -> Column:
    """Digit ``level`` of the key, most significant first; flipping the sign bit makes unsigned digits sort like signed numbers."""
    part, place = divmod(level, 64 // DIGIT)
    flipped = F.col(PARTS[part]).bitwiseXOR(F.lit(-(2**63)).cast("bigint"))
    return F.shiftrightunsigned(flipped, 64 - DIGIT * (place + 1)).bitwiseAND(F.lit(2**DIGIT - 1).cast("bigint"))


def _parts(prefix: tuple[int, ...]) -> tuple[int, ...]:
    """The smallest key that begins with these digits, as three signed numbers."""
    full = [*prefix, *[0] * (DIGITS - len(prefix))]
    each = 64 // DIGIT
    return tuple(int.from_bytes(b"".join(d.to_bytes(DIGIT // 8) for d in full[p * each : (p + 1) * each])) - 2**63 for p in range(len(PARTS)))


def find_splitters(keys: DataFrame, shards: int, tolerance: float = 0.001) -> list[tuple[int, ...] | None]:
    """The first key of every shard but the first; None: no rows from here on. ``tolerance`` is the allowed error of a boundary as a share of a shard."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    near = total / shards * tolerance
    done: dict[int, tuple[int, ...] | None] = {}
    open_: dict[int, tuple[tuple[int, ...], int]] = {i: ((), 0) for i in range(1, shards)}  # splitter: digits so far, bytes below them
    for level in range(DIGITS):
        prefixes = {prefix: n for n, prefix in enumerate(dict.fromkeys(p for p, _ in open_.values()))}
        inside = F.lit(0) if level == 0 else None
        for prefix, n in prefixes.items() if level else ():
            same = F.lit(True)
            for at, d in enumerate(prefix):
                same &= _digit(at) == d
            inside = F.when(same, n) if inside is None else inside.when(same, n)
        sums = keys.select(inside.alias("interval"), _digit(level).alias("digit"), "size").where("interval is not null").groupBy("interval", "digit").agg(F.sum("size").alias("size"))
        found: dict[int, list[tuple[int, int]]] = {}
        for interval, digit, size in sums.collect():  # at most 2^DIGIT sums for each open splitter
            found.setdefault(interval, []).append((digit, size))
        left = {}
        for i, (prefix, below) in open_.items():
            target = total * i / shards
            for digit, size in sorted(found.get(prefixes[prefix], [])):
                if below + size < target:
                    below += size
                    continue
                cuts = [(abs(below - target), (*prefix, digit)), (abs(below + size - target), (*prefix, digit + 1))]
                error, cut = min(cuts)
                if error <= near or level == DIGITS - 1:
                    done[i] = _parts(_carry(cut)) if _carry(cut) else None
                else:
                    left[i] = ((*prefix, digit), below)
                break
            else:
                done[i] = None
        open_ = left
        if not open_:
            break
    return [done[i] for i in range(1, shards)]


def _carry(digits: tuple[int, ...]) -> tuple[int, ...]:
    """A digit past the last one moves to the place before; nothing is left if there is none."""
    while digits and digits[-1] == 2**DIGIT:
        digits = (*digits[:-2], digits[-2] + 1) if len(digits) > 1 else ()
    return digits


def shard_of(splitters: list[tuple[int, ...] | None]) -> Column:
    """The number of splitters at or below the row's key."""
    key = [F.col(p) for p in PARTS]
    out = F.lit(0)
    for s in splitters:
        if s is not None:
            at_or_above = (key[0] > s[0]) | ((key[0] == s[0]) & ((key[1] > s[1]) | ((key[1] == s[1]) & (key[2] >= s[2]))))
            out = out + at_or_above.cast("int")
    return out


def assign(docs: DataFrame, shards: int = 8, tolerance: float = 0.001) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: not the ``key`` law) for every row.

    The rows are exchanged once, by ranges of shard and key, and numbered where they then lie.
    """
    keys = _keys(docs)
    split = keys.withColumn("shard", shard_of(find_splitters(keys, shards, tolerance)))
    placed = numbered(split, ["shard"], list(PARTS), "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, tolerance: float = 0.001) -> None:
    """The rows themselves, every column kept, as one folder per shard, sorted by text hash and doc_id. Texts are exchanged once.

    A splitter inside rows that repeat both text and doc_id puts all of them into one shard here; ``assign`` splits them.
    """
    keys = _keys(docs)
    bounds = [s and (s[0], s[1], -(2**63)) for s in find_splitters(keys, shards, tolerance)]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumns({"k_text": F.xxhash64(text), "k_doc": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))), "k_row": F.lit(0).cast("bigint")})
    out = keyed.withColumn("shard", shard_of(bounds)).repartitionByRange("shard", "k_text", "k_doc").sortWithinPartitions("shard", "k_text", "k_doc")
    out.drop(*PARTS).write.partitionBy("shard").parquet(path)


def op10_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=8)


QUERIES = {"op10_histogram_sort": op10_histogram_sort}
ORACLES: dict[str, str] = {}
