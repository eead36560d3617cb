"""SimHash near-dedup with pigeonring filtering.

A fingerprint is cut into threshold + 1 segments that stand in a ring. If two fingerprints differ at
`threshold` bits or fewer, then some segment begins a chain in which the first l segments together differ at
l - 1 bits at most, for every l (the pigeonring principle). The first two links of the chain are
a join key: a segment, and the next one without one of its bits. In each group of equal keys
the chain's longer prefixes prune pairs before the full Hamming check.

A group never yields all its pairs: of up to `group` distinct fingerprints the links that
connect them, and beyond that every fingerprint of the group goes another exact way: it is a key
together with all fingerprints within half the threshold of it. Two fingerprints within the threshold share such a key, and those that share one are
within it, so each links to the first of its key.

Defined cases: null or empty texts and texts without words have fingerprint zero, linked like any other; rows with
null ids are fingerprinted and linked, but a component's id is the smallest id that is not null; repeated
rows are rows of their own; other columns are kept out; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsift.llm import common, graph, textbuf

BITS = 64
THRESHOLD = 4
SHINGLE = 4
GROUP = 256
#: A key with more rows comes in parts of about so many.
_PART = 1 << 16

_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Of one text in UTF-8: the bits that are set in over half of its shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64), len(words) - k + 1
    for i in range(0, n, 8192):
        j = min(i + 8192, n)
        h = np.array([digest(line[a:b], 42) for a, b in zip(starts[i:j].tolist(), ends[i + k - 1 : j + k - 1].tolist())], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (long: the fingerprint's 64 bits)."""

    def run(batches):
        for b in textbuf.slices(batches, 1):
            fps = np.array([fingerprint(t or b"", shingle) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def segments(threshold: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    m = threshold + 1
    edges = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _cut(fps: np.ndarray, segment: tuple[int, int]) -> np.ndarray:
    return (fps >> np.uint64(segment[0])) & np.uint64((1 << segment[1]) - 1)


def chain_keys(fps: np.ndarray, threshold: int) -> np.ndarray:
    """For each fingerprint its keys: (start of the chain, bit left out, first segment, second segment without the bit)."""
    ring, out = segments(threshold), []
    for i, first in enumerate(ring):
        second = ring[(i + 1) % len(ring)]
        a, b = _cut(fps, first), _cut(fps, second)
        for bit in range(second[1]):
            tag = np.uint64(i << 6 | bit)
            out.append((tag << np.uint64(48)) | (a << np.uint64(24)) | (b & ~np.uint64(1 << bit)))
    return np.stack(out, axis=1)


def close(fps: np.ndarray, start: int, threshold: int) -> np.ndarray:
    """Which pairs of a group are within the threshold: the chain's budgets first, then all bits."""
    ring = segments(threshold)
    x = fps[:, None] ^ fps[None, :]
    i, j = np.nonzero(np.triu(np.ones(x.shape, dtype=bool), 1))
    sum_, at = np.zeros(len(i), dtype=np.int64), start
    for length in range(1, len(ring) + 1):
        sum_ = sum_ + np.bitwise_count(_cut(x[i, j], ring[at % len(ring)]))
        held = sum_ <= length - 1
        i, j, sum_, at = i[held], j[held], sum_[held], at + 1
        if not len(i):
            break
    return np.stack((i, j), axis=1)  # the last budget is the threshold over all segments


def _groups(batches):
    """(key, fingerprints, whether the key goes on) of rows sorted by key. Keys with one row are left out; of a very large key come parts."""
    key, held = None, []
    for b in batches:
        k, f = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(k):
            continue
        edges = np.concatenate(([0], np.flatnonzero(np.diff(k)) + 1, [len(k)]))
        last = len(edges) - 2
        for n in sorted({0, last, *np.flatnonzero(np.diff(edges) > 1).tolist()}):
            i, j = int(edges[n]), int(edges[n + 1])
            if k[i] != key:
                if held:
                    yield key, np.concatenate(held), False
                key, held = k[i], []
            held.append(f[i:j])
            if n < last:
                yield key, np.concatenate(held), False
                key, held = None, []
            elif sum(map(len, held)) > _PART:
                yield key, np.concatenate(held), True
                held = [f[:0]]
    if held:
        yield key, np.concatenate(held), False


def _batched(pairs):
    """Arrow batches of many small arrays a, b; b None stands for nulls."""
    a, b, n = [], [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.concat_arrays(b)], schema=_EDGES)

    for x, y in pairs:
        a.append(x)
        b.append(pa.nulls(len(x), pa.int64()) if y is None else pa.array(y))
        n += len(x)
        if n >= 10_000:
            yield out()
            a, b, n = [], [], 0
    if n:
        yield out()


def _forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """Of the pairs of n nodes those that first connect two parts."""
    root, kept = list(range(n)), []

    def top(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, j in pairs.tolist():
        x, y = top(i), top(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((i, j))
    return np.array(kept).reshape(-1, 2)


def _links(threshold: int, group: int):
    def pairs(batches):
        hot = None
        for key, fps, more in _groups(batches):
            if more or hot == key or len(fps) > group:
                hot = key if more else None
                yield fps, None
            elif len(fps) > 1:
                found = close(fps.view(np.uint64), int(key) >> 54, threshold)
                if len(found):
                    i, j = _forest(found, len(fps)).T
                    yield fps[i], fps[j]

    return lambda batches: _batched(pairs(batches))


def _ball(threshold: int):
    """All fingerprints within half the threshold, as masks."""
    return [np.uint64(sum(1 << b for b in bits)) for r in range(threshold // 2 + 1) for bits in combinations(range(BITS), r)]


def _star(batches):
    def pairs():
        now, first = None, 0
        for key, fps, _ in _groups(batches):
            if key != now and len(fps):
                now, first = key, fps[0]
            yield np.full(len(fps), first), fps

    return _batched(pairs())


def link(fps: DataFrame, threshold: int = THRESHOLD, group: int = GROUP) -> DataFrame:
    """fp (long, distinct) to edges a, b: not all links, but enough to connect whatever links connect."""
    if threshold % 2 or not 2 <= threshold <= 8:
        raise ValueError("the threshold must be even, from 2 to 8")
    spark, n = fps.sparkSession, common.partitions(fps.sparkSession)
    key_schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])

    def keyed(make):
        def run(batches):
            for b in batches:
                all_ = b.column(0).to_numpy().view(np.uint64)
                for i in range(0, len(all_), 2048):
                    f = all_[i : i + 2048]
                    keys = make(f)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(f, keys.shape[1]).view(np.int64))], schema=key_schema)

        return run

    def dealt(df, make):
        return df.select("fp").mapInArrow(keyed(make), "key long, fp long").repartition(n, "key").sortWithinPartitions("key", "fp")

    found = common.materialize(dealt(fps, lambda f: chain_keys(f, threshold)).mapInArrow(_links(threshold, group), "a long, b long"), "links")
    hot = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    masks = np.array(_ball(threshold), dtype=np.uint64)
    stars = dealt(hot, lambda f: f[:, None] ^ masks[None, :]).mapInArrow(_star, "a long, b long").where("a <> b").distinct()
    return found.where("b is not null").unionByName(stars)


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, fp, component_id (the smallest doc_id that links reach, its own included)."""
    prints = common.materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    least = common.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    reached = graph.components(link(least, threshold))
    joined = least.join(reached, least.fp == reached.node, "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("component"))
    joined = common.materialize(joined, "reached")
    named = common.materialize(joined.groupBy("component").agg(F.min("least").alias("component_id")), "named")
    by_fp = common.materialize(joined.join(named, "component").select("fp", "component_id", "n"), "components")
    return common.spread_join(prints, by_fp, ["fp"], "n", ["doc_id"]).select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int | None = None) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id (null last; of rows with equal ids one), all columns as they are.

    Near: of the sets of five-word shingles 0.8 or more are common. At that bound 39 of 256 bits of a fingerprint differ, so a segment that is equal, or a chain of them, singles out too little to be
    a join key; candidates share a sampled key of their shingles instead, the pigeonring's chains over 256 bits and the full Hamming check prune them, and the rest is compared exactly (`shingles`).
    Which rows stay is decided on row keys alone; the texts are joined once with those that go.
    """
    from capsift.llm import shingles

    key, many = "__capsift_row", "__capsift_times"
    keyed = docs.withColumn(key, common.row_key(id_col, text_col))
    with common.scratch(docs.sparkSession):
        prints = keyed.select(F.col(key).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        prints = common.materialize(prints.mapInArrow(shingles._prints, "row binary, id long, sig long, n long, fp binary, keys array<long>"), "prints")
        first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "n", "fp", "keys")).alias("first")
        distinct = common.materialize(prints.groupBy("sig").agg(first).select("sig", "first.*"), "distinct")
        edges = common.materialize(shingles.link(keyed, distinct, key, text_col, block or shingles.BLOCK), "links")
        reached = graph.components(edges)
        joined = distinct.join(reached, distinct.sig == reached.node, "left").groupBy(F.coalesce("component", "sig").alias("component"))
        kept = joined.agg(F.min(F.struct("no_id", "id", "row")).alias("first")).select(F.col("first.row").alias("row"))
        # of rows that are equal in id and text one stays: their keys are marked, and only these rows are dealt by key
        again = prints.groupBy("row").agg(F.count("*").alias("times")).where("times > 1")
        kept = common.materialize(kept.join(again, "row", "left").select(F.col("row").alias(key), F.coalesce("times", F.lit(1)).alias(many)), "kept", keep=True)
    mine = keyed.join(kept.hint("merge"), key)
    return mine.where(F.col(many) == 1).select(*docs.columns).unionByName(mine.where(F.col(many) > 1).dropDuplicates([key]).select(*docs.columns))
