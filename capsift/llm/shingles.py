"""Sets of word shingles for near-dedup: sampled keys, wide SimHash fingerprints, exact similarity. `simhash.drop_near_duplicates` uses them.

Candidates share a band: MinHash values, of which BAND make a band, in BANDS bands. A pair at the bound of 0.8 shares no band in 3 of
a million cases, a closer one more seldom. Texts that share a band are gathered at its smallest signature (the pivot), once. There the chains of the fingerprints'
segments prune pairs (pigeonring), then all bits are counted, and what is left is compared exactly, shingle by shingle.

A group of up to `block` texts is one task's, and of the links found only those that connect two parts leave it. In a larger one each text
is compared with the pivot; what that leaves in several parts is grouped anew by rare shingles: of two texts at the bound, each has one of the other's rarest fifth,
so texts that share boilerplate alone part, and copies of one text are one part before. Only where such a group is large again, and still in parts, blocks
outside its largest part meet all blocks.

Defined cases: words are parted by ASCII space and lower-cased in ASCII; texts under five words are one shingle; null, empty and blank
texts have none and are equal to each other only; equal sets are one signature before anything is compared; an empty table gives no rows.
"""

from __future__ import annotations

from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capsift.llm import common, graph, simhash, textbuf

SHINGLE = 5
#: Similar: PARTS[0] of PARTS[1] shingles or more.
PARTS = (4, 5)
BANDS, BAND = 24, 4
#: Bits of the fingerprints, and how many may differ. Of two texts at 0.8 a bit differs in 0.152 of cases by the usual formula, so 39 of 256 do; over 64 do in 6 of a million cases.
BITS, DIFFER, SEGMENTS = 256, 64, 16
#: A block has about so many texts, and shingles.
BLOCK, BLOCK_SHINGLES = 256, 1 << 18
_COLUMNS = 4096
_BYTES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)
_LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
_STEPS = textbuf.mix(np.arange(1, 17, dtype=np.uint64)) | np.uint64(1)
_HASHES = textbuf.mix(np.arange(101, 101 + BANDS * BAND, dtype=np.uint64)) | np.uint64(1)


def sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each text's distinct shingles in order, where each text's begin and at the end the number of all)."""
    words = textbuf.Words(column)
    words.data = _LOWER[words.data]
    k = np.minimum(words.counts, SHINGLE)
    n = np.where(k > 0, words.counts - k + 1, 0)
    at, width = textbuf.ragged(words.first[:-1], n), np.repeat(k, n)
    doc = np.repeat(np.arange(len(n)), n)
    hashes = np.concatenate((*words.hashes(), np.zeros(SHINGLE, dtype=np.uint64)))
    h = width.astype(np.uint64)
    for j in range(SHINGLE):
        h = h + np.where(j < width, hashes[at + j] * _STEPS[j], np.uint64(0))
    h = textbuf.mix(h)
    order = np.lexsort((h, doc))
    h = h[order]  # doc is in order as it is
    new = np.concatenate(([True], (np.diff(doc) > 0) | (h[1:] != h[:-1]))) if len(h) else np.zeros(0, dtype=bool)
    return h[new], np.concatenate(([0], np.cumsum(np.bincount(doc[new], minlength=len(n)))))


def band_keys(h: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each text with shingles a row of BANDS keys."""
    starts = edges[:-1][np.diff(edges) > 0]
    keys = np.zeros((len(starts), BANDS), dtype=np.uint64)
    for b in range(BANDS if len(starts) else 0):
        for r in range(BAND):
            keys[:, b] += np.minimum.reduceat(h * _HASHES[b * BAND + r], starts) * _STEPS[r]
        keys[:, b] = textbuf.mix(keys[:, b] + np.uint64(b))
    return keys


def fingerprints(h: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """SimHash of each set that is not empty: rows of BITS / 64 words. Bits are counted by bytes: how often each set has each value of a byte, times the bits of the values."""
    n = np.diff(edges)[np.diff(edges) > 0]
    out = np.zeros((len(n), BITS // 64), dtype=np.uint64)
    row = np.repeat(np.arange(len(n)) * 256, n)
    for w in range(BITS // 64 if len(n) else 0):
        x = textbuf.mix(h * _STEPS[w] + np.uint64(w)).view(np.uint8).reshape(-1, 8)
        ones = [np.bincount(row + x[:, b], minlength=256 * len(n)).reshape(-1, 256) @ _BYTES for b in range(8)]
        out[:, w] = np.packbits(2 * np.concatenate(ones, axis=1) > n[:, None], axis=1).view("<u8")[:, 0]
    return out


def chained(fps: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Which of the allowed pairs i < j differ at DIFFER bits or fewer: first a chain of consecutive segments must exist whose sums stay within their parts of DIFFER."""
    i, j = np.nonzero(np.triu(allowed, 1))
    for k in range(0, len(i), 1 << 18):
        a, b = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
        found = np.bitwise_count((fps[a] ^ fps[b]).view(np.uint16)).astype(np.int16)
        budget, held = DIFFER // SEGMENTS, np.zeros(len(a), dtype=bool)
        for start in range(SEGMENTS):
            ok, sum_ = np.ones(len(a), dtype=bool), 0
            for length in range(1, 5):
                sum_ = sum_ + found[:, (start + length - 1) % SEGMENTS]
                ok &= sum_ <= budget * length
            held |= ok
        held[held] = found[held].sum(axis=1) <= DIFFER
        yield np.stack((a[held], b[held]), axis=1)


def _prints(batches):
    for b in textbuf.slices(batches, 2):
        h, edges = sets(b.column(2))
        data, keys, fps = h.astype("<u8").tobytes(), band_keys(h, edges), fingerprints(h, edges)
        some = np.diff(edges) > 0
        sig = np.array([xxhash.xxh64_intdigest(data[8 * i : 8 * j], 42) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist())], dtype=np.uint64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(some * BANDS))).astype(np.int32)), pa.array(keys.ravel().view(np.int64)))
        bits = np.zeros((len(some), BITS // 64), dtype="<u8")
        bits[some] = fps
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:2], pa.array(sig.view(np.int64)), pa.array(np.diff(edges)), pa.array([x.tobytes() for x in bits], pa.binary()), lists], names=["row", "id", "sig", "n", "fp", "keys"]
        )


def _shingled(batches):
    for b in textbuf.slices(batches, 1):
        h, edges = sets(b.column(1))
        data = h.astype("<u8").tobytes()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([data[8 * i : 8 * j] for i, j in zip(edges[:-1].tolist(), edges[1:].tolist())], pa.binary())], names=["sig", "shingles"])


def similar(found: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Of the pairs (i, j) of sets of distinct hashes those that are similar."""
    if not len(pairs):
        return pairs
    p, q = PARTS  # common / (sum - common) >= p / q
    size = np.array([len(x) for x in found])
    pairs = pairs[q * size[pairs].min(axis=1) >= p * size[pairs].max(axis=1)]
    used, at = np.unique(pairs, return_inverse=True)
    pairs_in, g = at.reshape(pairs.shape), len(used)
    if not g:
        return pairs
    _, column, times = np.unique(np.concatenate([found[i] for i in used]), return_inverse=True, return_counts=True)
    row, held = np.repeat(np.arange(g), size[used]), times[column] > 1
    row, number = row[held], np.cumsum(times > 1) - 1
    column = number[column[held]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common_ = np.zeros((g, g), dtype=np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + _COLUMNS))
        has = np.zeros((g, min(_COLUMNS, int(column[-1]) + 1 - lo)), dtype=np.float32)
        has[row[a:b], column[a:b] - lo] = 1
        common_ += has @ has.T
    both = common_[pairs_in[:, 0], pairs_in[:, 1]].astype(np.int64)
    return pairs[(p + q) * both >= p * size[pairs].sum(axis=1)]


def _links(batches):
    """Rows group, i, j, sig, x, fp, shingles, sorted by (group, i, j). i = j: all pairs; i < j: those of block i with block j; i = -1: those of the one row with x = -1."""

    def rows():
        for b in batches:
            for *item, sig, x, fp, data in zip(*(b.column(c).to_pylist() for c in range(6)), b.column(6)):
                yield tuple(item), sig, x, fp, data

    def pairs():
        for (_, i, j), of in groupby(rows(), key=lambda r: r[0]):
            _, sigs, blocks, fps, data = zip(*of)
            if len(sigs) < 2:
                continue
            x = np.array(blocks)
            allowed = np.ones((len(x), len(x)), dtype=bool) if i == j else x[:, None] != x[None, :]
            sets_ = [np.frombuffer(d.as_buffer(), dtype="<u8") for d in data]
            for near in chained(np.frombuffer(b"".join(fps), dtype="<u8").reshape(len(x), -1), allowed):
                near = similar(sets_, near)
                if len(near):
                    a, b = simhash._forest(near, len(sigs)).T
                    yield np.array(sigs, dtype=np.int64)[a], np.array(sigs, dtype=np.int64)[b]

    return simhash._batched(pairs())


def _compared(items: DataFrame, shingled: DataFrame) -> DataFrame:
    """items: group, i, j, sig, x, fp. The links found."""
    held = items.join(shingled.hint("merge"), "sig").select("group", "i", "j", "sig", "x", "fp", "shingles")
    n = common.partitions(items.sparkSession)
    return held.repartition(n, "group", "i", "j").sortWithinPartitions("group", "i", "j", "sig").mapInArrow(_links, "a long, b long")


def _sized(members: DataFrame, block: int) -> DataFrame:
    """members: group, sig, n, fp. Adds blocks: how many parts the group makes."""
    sizes = members.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / BLOCK_SHINGLES), F.lit(1)).alias("blocks"))
    return members.join(sizes, "group").withColumn("x", F.pmod(F.xxhash64("sig"), F.col("blocks")))


def _rare(shingled: DataFrame, large: DataFrame) -> DataFrame:
    """large: sig, fp, part. Of each text its rarest shingles, by how many of these texts have them: group (the least signature that has the shingle), sig, n, fp, part."""

    def spread(batches):
        for b in batches:
            lists = [np.frombuffer(d.as_buffer(), dtype="<u8") for d in b.column(1)]
            size = np.array([len(x) for x in lists])
            for k in range(len(lists)):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy()[k : k + 1], size[k])), pa.array(lists[k].view(np.int64)), pa.array(np.repeat(size[k : k + 1], size[k]))], names=["sig", "h", "n"])

    each = common.materialize(shingled.join(large.select("sig"), "sig", "left_semi").mapInArrow(spread, "sig long, h long, n long"), "spread")
    often = each.groupBy("h").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("sig").orderBy("df", "h"))
    first = each.join(often, "h").withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * PARTS[0] / PARTS[1]) + 1).where("df > 1")
    held = first.select("sig", "h", "n").join(large, "sig")
    groups = held.groupBy("h").agg(F.min("sig").alias("group"), F.min("part").alias("a"), F.max("part").alias("z")).where("a < z").select("h", "group")
    return held.join(groups, "h").select("group", "sig", "n", "fp", "part").distinct()


def link(keyed: DataFrame, distinct: DataFrame, row: str, text_col: str, block: int = BLOCK) -> DataFrame:
    """Edges a, b between signatures, enough to connect whatever similar texts connect. distinct: sig, n, fp, keys and a row of docs for each signature."""
    bands = distinct.select("sig", F.explode("keys").alias("key"))
    pivots = bands.groupBy("key").agg(F.min("sig").alias("group"), F.count("*").alias("k")).where("k > 1").drop("k")
    members = common.materialize(bands.join(pivots, "key").select("group", "sig").distinct().join(distinct.select("sig", "n", "fp"), "sig").select("group", "sig", "n", "fp"), "members")
    wanted = distinct.join(members.select("sig").distinct(), "sig", "left_semi").select(F.col("row").alias(row), "sig")
    texts = keyed.select(row, F.col(text_col).alias("text")).join(wanted.hint("merge"), row).select("sig", "text")
    shingled = common.materialize(texts.mapInArrow(_shingled, "sig long, shingles binary").dropDuplicates(["sig"]), "shingles")
    sized = common.materialize(_sized(members, block), "sized")
    zero = F.lit(0).cast("long")
    small = sized.where("blocks = 1").select("group", zero.alias("i"), zero.alias("j"), "sig", "x", "fp")
    large = sized.where("blocks > 1").select("group", "sig", "n", "fp", "blocks", "x")
    # the pivot goes to each block of its group
    pivot = large.where("sig = group").select("group", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("j"), "sig", F.lit(-1).cast("long").alias("x"), "fp")
    star = large.where("sig <> group").select("group", F.col("x").alias("j"), "sig", F.lit(0).cast("long").alias("x"), "fp").unionByName(pivot)
    first = common.materialize(_compared(small.unionByName(star.select("group", F.lit(-1).cast("long").alias("i"), "j", "sig", "x", "fp")), shingled), "links")
    if large.isEmpty():
        return first
    parts = graph.components(first)
    apart = large.join(parts, large.sig == parts.node, "left").select("group", "sig", "fp", F.coalesce("component", "sig").alias("part"))
    open_ = apart.groupBy("group").agg(F.min("part").alias("a"), F.max("part").alias("z")).where("a < z").select("group")
    apart = common.materialize(apart.join(open_, "group", "left_semi").select("sig", "fp", "part").distinct(), "apart")
    again = common.materialize(_sized(_rare(shingled, apart), block), "again")
    most = again.groupBy("group", "part").agg(F.count("*").alias("k")).groupBy("group").agg(F.max_by("part", F.struct("k", "part")).alias("most"))
    again = again.join(most, "group").withColumn("z", F.when(F.col("part") == F.col("most"), F.col("x")).otherwise(F.col("x") + F.col("blocks")))
    # blocks 0 .. blocks - 1 hold the largest part, those from `blocks` on the others; the largest part's blocks don't meet each other
    meets = F.when(F.col("z") < F.col("blocks"), F.sequence(F.col("blocks"), 2 * F.col("blocks") - 1)).otherwise(F.sequence(zero, 2 * F.col("blocks") - 1))
    dealt = again.withColumn("y", F.explode(meets)).select("group", F.least("z", "y").alias("i"), F.greatest("z", "y").alias("j"), "sig", F.col("z").alias("x"), "fp")
    return first.unionByName(common.materialize(_compared(dealt, shingled), "links"))
