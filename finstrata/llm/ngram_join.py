"""Near duplicates by an n-gram Jaccard join: grouped prefix join (after Bouros, Ge and Mamoulis, "Spatio-textual similarity joins", 2012, and Mann,
Augsten and Bouros, "An empirical evaluation of set similarity join techniques", 2016).

A document is its set of distinct 5-word shingles, as 64-bit hashes. Two link if the sets' Jaccard similarity is at least 0.8. The result holds the
connected components of all links; no link between different texts is lost.

1. Equal sets are one class. Only classes take part from here on.
2. Shingles are counted over the corpus. The frequent ones (more than ``limit`` classes) come last in the order of every set; the rest are ordered by hash.
   The first ``n - ceil(0.8 n) + 1`` shingles of a set in that order are its prefix: two sets that link share one.
3. Classes with the same prefix and size are one group. Groups meet where prefixes share a shingle. A pair of groups is dropped there if the sizes, or
   the shingles that follow in both orders, are too few for a link; a pair that links passes at the first shingle it shares. Pairs of groups are
   expanded into pairs of members, and those are verified on the whole texts.
4. Where more than ``limit`` groups meet at one shingle, or a group has more than ``RARE`` members, pairs would grow with the square of their number.
   Such places are dealt with last, and only if their members are not all linked by then: places that overlap form a cluster, a cluster is split
   into blocks of ``BLOCK`` documents, each pair of blocks is one task that compares all its sets through an inverted index and returns a
   spanning forest of the links. Nothing is capped.

What is exchanged in bulk are arrays of numbers, one row per task and target partition, not a row per shingle. The list of frequent shingles is
broadcast: fewer than ``MOST_FREQUENT`` of them exceed ``limit = max(RARE, all shingles / MOST_FREQUENT)``, 4 bytes each. Any list gives exact results; it
only decides where pairs meet. (Over 270 million shingles the limit, and with it the pairs at a shingle, grow with the corpus; raise MOST_FREQUENT with the
executors' memory.)

Defined results: a null or blank text has no shingles, n_shingles 0, and is its own component; fewer than five words are one shingle; repeated
rows are in one class; a component's id is its smallest doc_id (null only if all are); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from finstrata.llm.components import components
from finstrata.llm.lean import lean
from finstrata.llm.numbering import numbered
from finstrata.llm.rows import NO_ID, keyed, sent
from finstrata.llm.words import BLANK_CUT, chunks, mix, shingle_hashes, words_of
from finstrata.session import ship
from finstrata.sources.landing import land

N = 5
PERCENT = 80
RARE = 16
MOST_FREQUENT = 1 << 24
BLOCK = 512
FLUSH = 1 << 18  # numbers a task gathers before it sends them
MEMBER, PAIR, PLACE = 0, 1, 2
_ODD = 0x9E3779B97F4A7C15


def sets_of(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    w = words_of(texts, BLANK_CUT)
    for a, b in zip(w.rows[:-1], w.rows[1:]):
        if b - a >= N:
            yield np.unique(shingle_hashes(w.hashes[a:b], N))
        else:
            yield shingle_hashes(w.hashes[a:b], b - a) ^ np.uint64(b - a) if b > a else w.hashes[:0]


def _summary(values: np.ndarray, n: int, salt: int) -> int:
    """A 64-bit name of a set of hashes and a number."""
    return int(mix(np.array([int(mix(values ^ np.uint64(salt)).sum(dtype=np.uint64)) + n * _ODD & 2**64 - 1], np.uint64))[0])


def signature(values: np.ndarray) -> int:
    return _summary(values, len(values), 0x51)


def _signed(x: np.ndarray | list[int]) -> np.ndarray:
    return np.array(x, np.uint64).view(np.int64)


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def describe(docs: DataFrame) -> DataFrame:
    """_did, _tid, n_shingles, sig for every row."""
    ship(docs.sparkSession)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            sizes, sigs = [], []
            for _, texts in chunks(batch["text"]):
                for s in sets_of(texts):
                    sizes.append(len(s))
                    sigs.append(signature(s))
            yield pa.record_batch([batch["_did"], batch["_tid"], pa.array(sizes, pa.int64()), pa.array(_signed(sigs))], names=["_did", "_tid", "n_shingles", "sig"])

    rows = keyed(docs).select("_did", "_tid", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(one, "_did bigint, _tid bigint, n_shingles bigint, sig bigint")


def _sets_once(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(signature, set) of the non-empty sets of a task, each once."""
    seen: set[int] = set()
    for batch in lean(batches):
        for _, texts in chunks(batch["text"]):
            for s in sets_of(texts):
                if len(s) and (sig := signature(s)) not in seen:
                    seen.add(sig)
                    yield sig, s


def _part_bounds(parts: int, bits: int) -> np.ndarray:
    return np.array([(p << bits) // parts for p in range(1, parts)], np.uint64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"))


def frequent(docs: DataFrame, limit: int) -> np.ndarray:
    """Sorted upper halves of the hashes that more than ``limit`` classes have. Halves are enough: a clash makes a shingle count as frequent."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _part_bounds(parts, 32)

        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held))
            cuts = [0, *np.searchsorted(keys, bounds), len(keys)]
            full = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
            return pa.record_batch([pa.array(full, pa.int32()), pa.array([keys[cuts[p] : cuts[p + 1]].tobytes() for p in full], pa.binary())], names=["part", "keys"])

        held: list[np.ndarray] = []
        size = 0
        for _, s in _sets_once(batches):
            held.append((s >> np.uint64(32)).astype(np.uint32))
            size += len(s)
            if size >= 4 * FLUSH:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(k, np.uint32) for batch in batches for k in batch["keys"].to_pylist()]
        if held:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.record_batch([pa.array(keys[n > limit].astype(np.int64))], names=["key"])

    found = _texts(docs).mapInArrow(send, "part int, keys binary").repartitionById(parts, F.col("part")).mapInArrow(count, "key bigint")
    return np.sort(found.toArrow()["key"].to_numpy()).astype(np.uint32)  # fewer than MOST_FREQUENT


def _is_frequent(values: np.ndarray, listed: np.ndarray, slots: np.ndarray) -> np.ndarray:
    keys = (values >> np.uint64(32)).astype(np.uint32)
    out = slots[keys >> np.uint32(10)]
    some = np.flatnonzero(out)
    if len(some):
        at = np.minimum(np.searchsorted(listed, keys[some]), len(listed) - 1)
        out[some] = listed[at] == keys[some]
    return out


def meet(docs: DataFrame, listed: np.ndarray, limit: int) -> DataFrame:
    """kind, a, b: members (group, class), pairs of groups with few others at their shingle, and crowded places (shingle, group)."""
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = spark.sparkContext.broadcast(listed)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _part_bounds(parts, 64)
        listed = spread.value
        slots = np.zeros(1 << 22, bool)
        slots[listed >> np.uint32(10)] = True

        def flush(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(columns[0])
            columns = [c[order] for c in columns]
            cuts = [0, *np.searchsorted(columns[0], bounds), len(order)]
            full = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
            packed = [pa.array([c[cuts[p] : cuts[p + 1]].tobytes() for p in full], pa.binary()) for c in columns]
            return pa.record_batch([pa.array(full, pa.int32()), pa.array([kind] * len(full), pa.int32()), *packed], names=["part", "kind", *"abni"])

        def both(shingles: list[np.ndarray], groups: list[int], sigs: list[int], sizes: list[int]) -> Iterator[pa.RecordBatch]:
            g, s, n = np.array(groups, np.uint64), np.array(sigs, np.uint64), np.array(sizes, np.uint32)
            each = list(map(len, shingles))
            place = np.concatenate([np.minimum(np.arange(k), 65535).astype(np.uint16) for k in each])  # never above the real one: the filter only gets weaker
            yield flush(PLACE, np.concatenate(shingles), np.repeat(g, each), np.repeat(n, each), place)
            yield flush(MEMBER, g, s, n, np.zeros(len(g), np.uint16))

        held: tuple[list, ...] = ([], [], [], [])
        size = 0
        for sig, s in _sets_once(batches):
            often = _is_frequent(s, listed, slots)
            prefix = np.concatenate([s[~often], s[often]])[: _prefix_length(len(s))]
            for to, x in zip(held, (prefix, _summary(prefix, len(s), 0xC3), sig, len(s))):
                to.append(x)
            size += len(prefix)
            if size >= FLUSH:
                yield from both(*held)
                held, size = ([], [], [], []), 0
        if size:
            yield from both(*held)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[tuple]] = {MEMBER: [], PLACE: []}
        for batch in batches:
            for kind, *packed in zip(*(batch[c].to_pylist() for c in ("kind", *"abni"))):
                got[kind].append(tuple(np.frombuffer(x, t) for x, t in zip(packed, (np.uint64, np.uint64, np.uint32, np.uint16))))

        def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["kind", "a", "b"])

        def sorted_once(rows: list[tuple]) -> tuple[np.ndarray, ...]:
            a, b, n, i = (np.concatenate(c) for c in zip(*rows))
            order = np.lexsort((b, n, a))
            a, b, n, i = a[order], b[order], n[order], i[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            return a[new], b[new], n[new], i[new]

        if got[MEMBER]:
            g, s, *_ = sorted_once(got.pop(MEMBER))
            yield out(MEMBER, g, s)
        if got[PLACE]:
            w, g, n, i = sorted_once(got.pop(PLACE))
            first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            crowd = np.repeat(np.diff(np.append(first, len(w))), np.diff(np.append(first, len(w))))
            crowded = crowd > limit
            yield out(PLACE, w[crowded], g[crowded])
            some = (crowd > 1) & ~crowded
            w, g, n = w[some], g[some], n[some].astype(np.int64)
            left = n - i[some]  # shingles from here on
            pairs = []
            for step in range(1, min(limit, len(w))):
                meets = np.flatnonzero((w[step:] == w[:-step]) & (100 * n[:-step] >= PERCENT * n[step:]))
                if not len(meets) and not (w[step:] == w[:-step]).any():
                    break  # no place has more than ``step`` groups
                # sets that link share at least PERCENT / (100 + PERCENT) of both sizes together
                far = meets + step
                enough = (100 + PERCENT) * np.minimum(left[meets], left[far]) >= PERCENT * (n[meets] + n[far])
                x, y = g[meets[enough]], g[far[enough]]
                pairs.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
            if pairs:
                once = np.unique(np.concatenate(pairs), axis=0)
                yield out(PAIR, np.ascontiguousarray(once[:, 0]), np.ascontiguousarray(once[:, 1]))

    sent_out = _texts(docs).mapInArrow(send, "part int, kind int, a binary, b binary, n binary, i binary")
    return sent_out.repartitionById(parts, F.col("part")).mapInArrow(join, "kind int, a bigint, b bigint")


def _with_texts(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (with _did, _tid) and the texts they name. Requests are landed, so they can be counted before they are broadcast."""
    rows = keyed(docs).select("_did", "_tid", F.col("text").cast("string").alias("text"))
    return rows.join(sent(requests), ["_did", "_tid"])


def verify(docs: DataFrame, pairs: DataFrame, where: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link. ``where``: sig, _did, _tid of one row of each class.

    A class's text is sent once for up to an eighth of its partners. Rows arrive sorted, the class first and then its partners, so a task
    holds one set at a time.
    """
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(8)))
    asked = dealt.select(F.col("a").alias("key"), "salt", F.lit(0).alias("role"), F.col("a").alias("sig")).distinct().unionAll(dealt.select(F.col("a").alias("key"), "salt", F.lit(1).alias("role"), F.col("b").alias("sig")))
    requests = land(asked.join(where, "sig"), "pair-requests")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base = None, np.empty(0, np.uint64)
        for batch in lean(batches):
            keys, roles, sigs = (batch[c].to_pylist() for c in ("key", "role", "sig"))
            a, b = [], []
            for first, texts in chunks(batch["text"]):
                for i, s in enumerate(sets_of(texts), first):
                    if roles[i] == 0:
                        key, base = keys[i], s
                    elif key == keys[i] and linked(base, s):
                        a.append(key)
                        b.append(sigs[i])
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    order = ["key", "salt", "role", "sig"]
    return _with_texts(docs, requests).repartition("key", "salt").sortWithinPartitions(*order).select(*order, "text").mapInArrow(compare, "a bigint, b bigint")


def _forest(sets: list[np.ndarray], sigs: list[int], left: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all linked sets, at least one of each pair in ``left``: overlaps come from an inverted index, pairs that are already joined are passed over."""
    k = len(sets)
    sizes = np.array([len(s) for s in sets])
    shingles, owner = np.concatenate(sets), np.repeat(np.arange(k), sizes)
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], owner[order]
    edges = np.flatnonzero(np.concatenate([[True], shingles[1:] != shingles[:-1], [True]]))
    run = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    of = np.empty(len(order), np.int64)
    of[order] = run
    starts = np.concatenate([[0], np.cumsum(sizes)])
    joined = np.arange(k)
    out = []
    for x in np.flatnonzero(left):
        if (joined == joined[x]).all():
            continue
        runs = of[starts[x] : starts[x + 1]]
        lengths = edges[runs + 1] - edges[runs]
        at = np.repeat(edges[runs] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        both = np.bincount(owner[at], minlength=k)
        for y in np.flatnonzero((100 * both >= PERCENT * (sizes + sizes[x] - both)) & (joined != joined[x])):
            if joined[y] != joined[x]:
                joined[joined == joined[y]] = joined[x]
                out.append((sigs[x], sigs[y]))
    return out


def verify_clusters(docs: DataFrame, clusters: DataFrame, where: DataFrame) -> DataFrame:
    """Links (a, b) that join all linked classes of each cluster. ``clusters``: cluster, sig."""
    ranked = numbered(clusters, ["cluster"], ["sig"], "rank").withColumn("block", F.floor(F.col("rank") / BLOCK))
    blocks = ranked.groupBy("cluster").agg((F.max("block") + 1).alias("blocks"))
    dealt = ranked.join(blocks, "cluster").withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    asked = dealt.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("role"), "sig")
    requests = land(asked.join(where, "sig"), "block-requests")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sets, sigs, roles = None, [], [], []

        def done() -> pa.RecordBatch:
            links = _forest(sets, sigs, np.array(roles) == 0) if sets else []
            return pa.record_batch([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in lean(batches):
            columns = [batch[c].to_pylist() for c in ("cluster", "i", "j", "role", "sig")]
            for first, texts in chunks(batch["text"]):
                for at, s in enumerate(sets_of(texts), first):
                    cluster, i, j, role, sig = (c[at] for c in columns)
                    if (cluster, i, j) != key:
                        yield done()
                        key, sets, sigs, roles = (cluster, i, j), [], [], []
                    sets.append(s)
                    sigs.append(sig)
                    roles.append(role)
        yield done()

    order = ["cluster", "i", "j", "role", "sig"]
    return _with_texts(docs, requests).repartition("cluster", "i", "j").sortWithinPartitions(*order).select(*order, "text").mapInArrow(compare, "a bigint, b bigint")


def _labelled(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``nodes`` (with sig) and the label of their component, their own name if they have no link."""
    return nodes.join(found.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))


def find_links(docs: DataFrame, described: DataFrame) -> DataFrame:
    """Links (a, b) of classes that join everything that links."""
    spark = docs.sparkSession
    total = described.agg(F.sum("n_shingles")).first()[0] or 0
    limit = max(RARE, total // MOST_FREQUENT)
    met = land(meet(docs, frequent(docs, limit), limit), "met")
    where = described.where("n_shingles > 0").groupBy("sig").agg(F.min(F.struct("_did", "_tid")).alias("row")).select("sig", "row.*")
    of_kind = lambda kind, a, b: met.where(F.col("kind") == kind).select(F.col("a").alias(a), F.col("b").alias(b))
    members = of_kind(MEMBER, "g", "sig")
    sizes = members.groupBy("g").agg(F.count("*").alias("size"))
    small = land(members.join(sizes.where(F.col("size") <= RARE), "g").groupBy("g").agg(F.sort_array(F.collect_list("sig")).alias("sigs")), "groups")  # at most RARE each
    large = members.join(sizes.where(F.col("size") > RARE), "g").select("g", "sig")
    ordered = lambda: (F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    other = small.select(F.col("g").alias("h"), F.col("sigs").alias("others"))
    pairs = of_kind(PAIR, "g", "h").distinct()
    across = pairs.join(small, "g").join(other, "h").select(F.explode("sigs").alias("x"), "others").select("x", F.explode("others").alias("y")).select(*ordered())
    within = small.where(F.size("sigs") > 1).select(F.explode("sigs").alias("x"), "sigs").select("x", F.explode("sigs").alias("y")).where("x < y").select(*ordered())
    links = land(verify(docs, land(across.unionAll(within).distinct(), "pairs"), where), "links")
    # crowded places, as (place, class): at a shingle, within a large group, or where a large group meets another
    crowd = of_kind(PLACE, "place", "g").join(members, "g").select("place", "sig")
    group = large.select(F.col("g").alias("place"), "sig")
    big = pairs.join(large.select("g").distinct(), "g", "left_semi").unionAll(pairs.join(large.select(F.col("g").alias("h")).distinct(), "h", "left_semi").select("g", "h")).distinct()
    ends = big.select(F.xxhash64("g", "h").alias("place"), F.explode(F.array("g", "h")).alias("g"))
    met_groups = ends.join(members, "g").select("place", "sig")
    places = land(_labelled(crowd.unionAll(group).unionAll(met_groups), components(links)), "places")
    open_ = places.groupBy("place").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("sig").alias("first")).where("low != high")
    tied = land(places.join(open_.select("place", "first"), "place").select(F.col("first").alias("a"), F.col("sig").alias("b")), "ties")
    clusters = components(tied).select(F.col("label").alias("cluster"), F.col("node").alias("sig"))
    return links.unionAll(land(verify_clusters(docs, clusters, where), "cluster-links"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """_did, _tid, n_shingles, component_id for every row of ``docs``; _did is doc_id with null as the smallest number."""
    described = land(describe(docs), "described")
    found = land(_labelled(described.where("n_shingles > 0"), components(find_links(docs, described))), "labelled")
    real = F.when(F.col("_did") != NO_ID, F.col("_did"))
    least = found.groupBy("label").agg(F.min(real).alias("component_id"))
    whole = found.join(least, "label").select("_did", "_tid", "n_shingles", "component_id", "label")
    return whole.unionAll(described.where("n_shingles = 0").select("_did", "_tid", "n_shingles", real.alias("component_id"), F.lit(None).cast("bigint").alias("label")))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs``, every column, with one row of each component: the one with the smallest doc_id (then text hash). Rows without words all stay."""
    found = near_duplicates(docs).where("label is not null")
    row = F.struct("_did", "_tid")
    stays = found.groupBy("label").agg(F.min(row).alias("stays"))
    marked = land(found.join(stays, "label").groupBy("_did", "_tid").agg(F.first(row == F.col("stays")).alias("stays"), F.count("*").alias("copies")), "marked")
    row = ["_did", "_tid"]
    named = keyed(docs)
    kept = named.join(sent(marked.where("not stays").select(row)), row, "left_anti")
    again = marked.where("stays and copies > 1").select(row)
    if not again.isEmpty():  # rows that repeat both id and text: one of them stays
        kept = kept.join(sent(again), row, "left_anti").unionByName(named.join(sent(again), row, "left_semi").dropDuplicates(row))
    return kept.select(docs.columns)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    doc_id = F.when(F.col("_did") != NO_ID, F.col("_did")).alias("doc_id")
    return near_duplicates(docs).select(doc_id, "n_shingles", "component_id")


QUERIES = {"op2_ngram_join": op2_ngram_join}
ORACLES: dict[str, str] = {}
