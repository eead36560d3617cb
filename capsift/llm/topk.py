"""Exact top-k by inner product with pivot-table elimination.

The table holds every vector's distances to `pivots` pivots. For a query q and a vector x no distance |q - x| is
less than |d(q, p) - d(x, p)| for any pivot p; the greatest of these, the maximum lower bound, bounds the inner product from above:
q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2. A query's candidates are evaluated in the order of their bounds until no bound
reaches the k-th best score so far; a bound that equals it is still evaluated, since ties go to the smaller id.

Candidates stand by their nearest pivot and their distance from it, and are packed in blocks in that order; a block's summary is the range of its distances to each pivot, and its longest vector.
A query block first meets the blocks whose summaries promise most, which gives each of its queries a k-th best score to beat; then only those blocks whose summaries can
beat it for one of its queries are joined with it: pairs of blocks are ruled out by summaries alone, before any vector is shipped. The pivots come from a sample of at most `SAMPLE` rows,
farthest first.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows without an id; rows equal in id
and vector count once; a query is not compared with rows of its own id; shorter vectors count as padded with zeros; fewer
candidates than k give all; an empty table gives no rows; other columns are kept out. Scores are exact: by floating point where they fit in 53 bits, else in 64-bit integers;
if a score could pass 63 bits, `top_k` raises an error that says so.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capsift.llm import common

K = 5
PIVOTS = 32
SAMPLE = 2000
SCALE = 256
BLOCK = 2048
QUERIES = 512
#: Blocks that give a query block its first scores, and summaries that travel together.
FIRST, SUMMARIES = 2, 1024
#: Queries of a block that stand for it where its first blocks are chosen.
PROBES = 8
_NAMES = ["block", "n", "dim", "ids", "v", "d", "lo", "hi", "top"]
_BLOCKS = "block long, n long, dim long, ids binary, v binary, d binary, lo array<double>, hi array<double>, top double"


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, as a double that may be too large for a long; null for vectors that take no part."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def whole(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)  # from 2^53 on every double is whole

    return F.when(usable, F.transform(vector, whole))


def choose_pivots(sample: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Farthest first, from the sample's row farthest from its mean."""
    if not len(sample):
        return np.zeros((0, 0))
    far = ((sample - sample.mean(axis=0)) ** 2).sum(axis=1)
    chosen = [int(far.argmax())]
    near = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(pivots, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim))
    row = np.repeat(np.arange(len(column)), sizes)
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, at] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (v**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * v @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _nearest(pivots: np.ndarray, batches):
    """id, v with the number of the nearest pivot and the distance from it."""
    for b in batches:
        d = distances(_matrix(b.column(1), pivots.shape[1]), pivots)
        near = d.argmin(axis=1)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], names=["id", "v", "near", "far"])


def _pack(pivots: np.ndarray, size: int, batches):
    """Blocks of (id, v): ids, whole numbers, distances to the pivots; the least and greatest of these, and the greatest square of a length."""
    from pyspark import TaskContext

    dim, block = pivots.shape[1], TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []

    def out(part):
        nonlocal block
        v = _matrix(part.column(1).combine_chunks(), dim)
        d = distances(v, pivots)
        cols = [[block], [len(v)], [dim], [part.column(0).to_numpy().astype("<i8").tobytes()], [v.astype("<f8").tobytes()], [d.astype("<f8").tobytes()], [d.min(axis=0).tolist()], [d.max(axis=0).tolist()], [float((v**2).sum(axis=1).max())]]
        block += 1
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=_NAMES)

    for b in batches:
        held.append(b.select(["id", "v"]))
        while sum(x.num_rows for x in held) >= size:
            t = pa.Table.from_batches(held)
            yield out(t.slice(0, size))
            held = t.slice(size).to_batches()
    if sum(x.num_rows for x in held):
        yield out(pa.Table.from_batches(held))


def block_bounds(square: np.ndarray, d: np.ndarray, lo: np.ndarray, hi: np.ndarray, top: np.ndarray) -> np.ndarray:
    """No score of a query (its squared length, its distances to the pivots) with a vector of a block can be above: queries x blocks."""
    low = np.zeros((len(d), len(top)))
    for p in range(d.shape[1]):
        np.maximum(low, np.maximum(lo[None, :, p] - d[:, p, None], d[:, p, None] - hi[None, :, p]), out=low)
    total = square[:, None] + top[None, :]
    return (total - low**2) / 2 + 1e-6 * total + 1e-3


def _narrow(batches):
    """Of query blocks what rules out lists of summaries: their ranges, the least score that one of their queries must beat, and the squared lengths and distances of PROBES of their queries."""
    for b in batches:
        least = [float(np.frombuffer(x.as_buffer(), "<i8").min()) if x.is_valid else float("-inf") for x in b.column("floor")]
        square, d = [], []
        for n, v, own in zip(b.column("n").to_pylist(), b.column("v"), b.column("d")):
            some = np.unique(np.linspace(0, n - 1, min(n, PROBES)).astype(np.int64))
            square.append((np.frombuffer(v.as_buffer(), "<f8").reshape(n, -1)[some] ** 2).sum(axis=1).tolist())
            d.append(np.frombuffer(own.as_buffer(), "<f8").reshape(n, -1)[some].ravel().tolist())
        doubles = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("block", "lo", "hi", "top")), pa.array(least), pa.array(square, doubles), pa.array(d, doubles)], names=["block", "lo", "hi", "top", "least", "square", "d"])


def _lengths(batches):
    """Of query blocks what rules out single blocks: squared lengths, distances and scores to beat of their queries, without the vectors."""
    for b in batches:
        square = [(np.frombuffer(v.as_buffer(), "<f8").reshape(n.as_py(), -1) ** 2).sum(axis=1).astype("<f8").tobytes() for v, n in zip(b.column("v"), b.column("n"))]
        yield pa.RecordBatch.from_arrays([b.column("block"), b.column("n"), pa.array(square, pa.binary()), b.column("d"), b.column("floor")], names=["block", "n", "square", "d", "floor"])


def _rows(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _rough(first: bool, batches):
    """Rows: a query block's ranges and a list of summaries. First: the blocks that promise most to the probes; else the summaries that the ranges leave."""
    for row in _rows(batches):
        s = row["summaries"]
        lo, hi, top = np.array([x["lo"] for x in s]), np.array([x["hi"] for x in s]), np.array([x["top"] for x in s])
        own_lo, own_hi = np.array(row["lo"]), np.array(row["hi"])
        if first:
            square = np.array(row["square"])
            promise = block_bounds(square, np.array(row["d"]).reshape(len(square), -1), lo, hi, top).mean(axis=0)
            stay = np.argsort(-promise, kind="stable")[:FIRST]
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(stay)), pa.array([s[i]["block"] for i in stay], pa.int64()), pa.array(promise[stay])], names=["q", "c", "promise"])
            continue
        low = np.maximum(np.maximum(lo - own_hi, own_lo - hi), 0).max(axis=1)
        total = row["top"] + top
        stay = np.flatnonzero((total - low**2) / 2 + 1e-6 * total + 1e-3 >= row["least"])
        if len(stay):
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([[s[i] for i in stay]], _SUMMARIES)], names=["block", "summaries"])


_SUMMARY = "array<struct<block: bigint, lo: array<double>, hi: array<double>, top: double>>"
_SUMMARIES = pa.list_(pa.struct([("block", pa.int64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("top", pa.float64())]))


def _ruled(batches):
    """Rows: of a query block the lengths, distances and scores to beat of its queries, and summaries. The pairs of blocks q, c that stay, with what the block promises."""
    for row in _rows(batches):
        n, s = row["n"], row["summaries"]
        square, d = np.frombuffer(row["square"], "<f8"), np.frombuffer(row["d"], "<f8").reshape(n, -1)
        upper = block_bounds(square, d, np.array([x["lo"] for x in s]), np.array([x["hi"] for x in s]), np.array([x["top"] for x in s]))
        promise = upper.max(axis=0)
        stay = np.flatnonzero((upper >= np.frombuffer(row["floor"], "<i8").astype(np.float64)[:, None]).any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(stay), row["block"])), pa.array([s[i]["block"] for i in stay], pa.int64()), pa.array(promise[stay])], names=["q", "c", "promise"])


_NONE = -(2**63) + 1


class Best:
    """The k best (score, id) of each query of a block so far. exact: scores pass 53 bits. floor: what a score must reach at least."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, d: np.ndarray, k: int, exact: bool = False, floor: np.ndarray | None = None):
        self.ids, self.v, self.d, self.k, self.exact = ids, v, d, k, exact
        self.square = (v**2).sum(axis=1)
        self.scores = np.full((len(ids), k), _NONE, dtype=np.int64)
        self.found = np.zeros((len(ids), k), dtype=np.int64)
        self.floor = np.full(len(ids), _NONE, dtype=np.int64) if floor is None else floor
        self.evaluated = 0

    def bounds(self, v: np.ndarray, d: np.ndarray) -> np.ndarray:
        """No score can be above: queries x candidates."""
        low = np.zeros((len(self.ids), len(v)))
        for p in range(d.shape[1]):
            np.maximum(low, np.abs(self.d[:, p, None] - d[None, :, p]), out=low)
        total = self.square[:, None] + (v**2).sum(axis=1)[None, :]
        return (total - low**2) / 2 + 1e-6 * total + 1e-3  # more than rounding can take away

    def least(self, q: int) -> float:
        return float(max(self.scores[q, -1], self.floor[q]))

    def products(self, v: np.ndarray, q: int) -> np.ndarray:
        if self.exact:
            return v.astype(np.int64) @ self.v[q].astype(np.int64)
        return np.rint(v @ self.v[q]).astype(np.int64)

    def add(self, ids: np.ndarray, v: np.ndarray, d: np.ndarray) -> None:
        upper = self.bounds(v, d)
        upper[self.ids[:, None] == ids[None, :]] = -np.inf
        least = np.maximum(self.scores[:, -1], self.floor).astype(np.float64)
        for q in np.flatnonzero(upper.max(axis=1, initial=-np.inf) >= least).tolist():
            able = np.flatnonzero((upper[q] >= least[q]) & (upper[q] > -np.inf))
            order = able[np.argsort(-upper[q, able], kind="stable")]
            at, step = 0, 64
            while at < len(order) and upper[q, order[at]] >= self.least(q):
                some = order[at : at + step]
                score = np.concatenate((self.scores[q], self.products(v[some], q)))
                name = np.concatenate((self.found[q], ids[some]))
                top = np.lexsort((name, -score))[: self.k]
                self.scores[q], self.found[q] = score[top], name[top]
                self.evaluated += len(some)
                at, step = at + step, step * 2


def _search(k: int, exact: bool, batches):
    """Rows: a query block, the scores to beat (or null), a candidate block; those of one query block follow each other. Returns query_id, vec_id, score of the best."""
    schema = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    best, now = None, None

    def rows():
        q, i = np.nonzero(best.scores > _NONE)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(q), now)), pa.array(best.ids[q]), pa.array(best.found[q, i]), pa.array(best.scores[q, i])], schema=schema)

    def arrays(b, row, at):
        n, dim = b.column(at + 1)[row].as_py(), b.column(at + 2)[row].as_py()
        ids, v, d = (np.frombuffer(b.column(at + i)[row].as_buffer(), kind) for i, kind in ((3, "<i8"), (4, "<f8"), (5, "<f8")))
        return ids, v.reshape(n, dim), d.reshape(n, -1)

    for b in batches:
        for row in range(b.num_rows):
            if (block := b.column(0)[row].as_py()) != now:
                if best:
                    yield rows()
                floor = b.column(6)[row].as_py()
                now, best = block, Best(*arrays(b, row, 0), k, exact, None if floor is None else np.frombuffer(floor, "<i8"))
            best.add(*arrays(b, row, 7))
    if best:
        yield rows()


def _met(pairs: DataFrame, asked: DataFrame, blocks: DataFrame, k: int, exact: bool) -> DataFrame:
    """pairs: q, c. The best of each query in the candidate blocks that its block meets."""
    n = common.partitions(pairs.sparkSession)
    names = _NAMES[:6]
    q = asked.select(F.col("block").alias("q"), *(F.col(x).alias(f"q_{x}") for x in names), "floor")
    c = blocks.select(F.col("block").alias("c"), *(F.col(x).alias(f"c_{x}") for x in names))
    held = pairs.select("q", "c", "slot").join(c.hint("merge"), "c").join(q.hint("merge"), "q").repartition(n, "slot", "q").sortWithinPartitions("q", "c")
    return held.select(*(f"q_{x}" for x in names), "floor", *(f"c_{x}" for x in names)).mapInArrow(partial(_search, k, exact), "q long, query_id long, vec_id long, score long")


def block_pairs(asked: DataFrame, blocks: DataFrame, first: bool) -> DataFrame:
    """q, c, promise: which candidate blocks a query block must meet (asked with floor), or should meet first.

    Summaries travel in lists of about SUMMARIES, so no task holds all. A query block meets a list with its ranges alone and a few probes (some kB); its queries' lengths and distances go only to the summaries that these
    leave, and no vector goes anywhere before a pair of blocks stays."""
    lists = max(1, -(-blocks.count() // SUMMARIES))
    grouped = blocks.select(F.pmod(F.xxhash64("block"), F.lit(lists)).alias("list"), F.struct("block", "lo", "hi", "top").alias("s")).groupBy("list").agg(F.collect_list("s").alias("summaries"))
    ranges = asked.select("block", "n", "v", "d", "lo", "hi", "top", "floor").mapInArrow(_narrow, "block long, lo array<double>, hi array<double>, top double, least double, square array<double>, d array<double>")
    each = ranges.withColumn("list", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lists - 1).cast("long"))))
    met = each.join(grouped, "list").select("block", "lo", "hi", "top", "least", "square", "d", "summaries")
    if first:
        return met.mapInArrow(partial(_rough, True), "q long, c long, promise double")
    left = met.mapInArrow(partial(_rough, False), f"block long, summaries {_SUMMARY}")
    lengths = asked.select("block", "n", "v", "d", "floor").mapInArrow(_lengths, "block long, n long, square binary, d binary, floor binary")
    return left.join(lengths, "block").select("block", "n", "square", "d", "floor", "summaries").mapInArrow(_ruled, "q long, c long, promise double")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best of every row that is_query (of the columns id and v) names."""
    n = common.partitions(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), whole_numbers(F.col(vector_col), scale).alias("v")).where("id is not null and v is not null").distinct()
    rows = common.materialize(rows, "vectors")
    longest = F.max(F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))))
    dim, queries, most = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count(F.when(is_query, 1)), F.coalesce(longest, F.lit(0.0))).first()
    if dim * most**2 >= 2.0**63:
        raise ValueError(f"scores of vectors of {dim} components up to {most:g} (scaled by {scale}) may not fit in 64 bits")
    exact = dim * most**2 >= 2.0**53
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    chosen = choose_pivots(_matrix(sample, dim), pivots) if len(sample) else np.zeros((1, dim))
    near = rows.mapInArrow(partial(_nearest, chosen), "id long, v array<double>, near int, far double")
    dealt = near.repartitionByRange(n, "near", "far", "id").sortWithinPartitions("near", "far", "id").select("id", "v")
    blocks = common.materialize(dealt.mapInArrow(partial(_pack, chosen, BLOCK), _BLOCKS), "blocks")
    parts = min(max(1, -(-queries // QUERIES)), n)
    mine = near.where(is_query).repartitionByRange(parts, "near", "far", "id").sortWithinPartitions("near", "far", "id").select("id", "v")
    asked = common.materialize(mine.mapInArrow(partial(_pack, chosen, QUERIES), _BLOCKS), "queries")
    none = F.lit(None).cast("binary").alias("floor")
    promised = block_pairs(asked.select("*", none), blocks, True)
    order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("promise"), "c"))
    begun = common.materialize(promised.withColumn("slot", order).where(F.col("slot") <= FIRST), "first pairs")
    early = common.materialize(_met(begun, asked.select("*", none), blocks, k, exact), "first")
    # the k-th best so far of each query, in the order of its block's ids
    kth = early.groupBy("q", "query_id", "vec_id").agg(F.max("score").alias("score")).groupBy("q", "query_id").agg(F.array_sort(F.collect_list("score"), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)).alias("s"))
    kth = kth.groupBy("q").agg(F.collect_list(F.struct("query_id", F.get("s", k - 1).alias("least"))).alias("least"))
    floored = asked.join(kth, asked.block == kth.q, "left").mapInArrow(_floors, _BLOCKS + ", floor binary")
    floored = common.materialize(floored, "floors")
    pairs = block_pairs(floored, blocks, False).join(begun.select("q", "c"), ["q", "c"], "left_anti")
    pairs = common.materialize(pairs.withColumn("slot", F.pmod(F.xxhash64("c"), F.lit(n))), "pairs")
    found = early.unionByName(_met(pairs, floored, blocks, k, exact)).drop("q").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def _floors(batches):
    """Query blocks with the scores to beat, in the order of their ids."""
    for b in batches:
        ids = [np.frombuffer(x.as_buffer(), "<i8") for x in b.column("ids")]
        floors = []
        for own, least in zip(ids, b.column("least").to_pylist()):
            by = {x["query_id"]: x["least"] for x in least or [] if x["least"] is not None}
            floors.append(np.array([by.get(i, _NONE) for i in own.tolist()], dtype="<i8").tobytes())
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _NAMES), pa.array(floors, pa.binary())], names=[*_NAMES, "floor"])


def op7_pivot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def sql() -> str:
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT * FROM (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s) WHERE rank <= {K}"""
