"""Filter interaction audit: what each order of a set of filters removes, from a packed bitmap index.

Each partition packs its documents into NumPy bitsets, one for each filter's failures, one for each label, the documents of a part side by side and filled up to whole bytes. For each subset of the
filters that may have run before, AND-NOT leaves the survivors, AND and a popcount give what the next filter removes of them and how many of those carry a label; sums over the bytes of a part are the partition's
counts. The partitions' counts are summed; no order is run over the documents, only the subsets, 2^filters, are. What orders and shares need follows from the counts of subsets.

Nothing grows with an order or a part: a partition's bitsets hold `ROWS` documents at a time (a bit each for each filter and label), and it sends a row for each part, subset and next filter.

Defined cases: a null text is an empty one; a null source is the part of the empty string; documents without a label, or with a null one, carry none, and one of several labels of a document counts if any is 1; a document
without an id is equal to no earlier one and makes no other one equal; rows equal in id don't duplicate each other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capsift.llm import common

NAMES = "ABCDE"
LABELS = ["good", "toxic"]
#: Documents whose bits are held at once.
ROWS = 1 << 20
_COUNTS = "part string, subset int, filter int, kept long, removed long, good_lost long, toxic_lost long"


def _equal_earlier(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) without the text, and `fail_equal`: whether a smaller id has the same text anywhere in the table."""
    keyed = common.materialize(docs.withColumn("key", F.unhex(F.sha2(F.col("text"), 256))).drop("text"), "keyed")
    first = keyed.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = common.materialize(first, "first")
    joined = common.spread_join(keyed, first, ["key"], "n", ["doc_id", "part", "row"], "left")
    return joined.withColumn("fail_equal", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("key", "first", "row")


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part and a boolean for each filter, of documents with columns doc_id, text, source."""
    text = F.coalesce("text", F.lit(""))
    words: Column = common.words(F.col("text"))
    split = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text")).withColumn("w", words)
    n, upper = F.size("w"), F.length("text") - F.length(F.regexp_replace("text", "[A-Z]", ""))
    tests = [n < 200, 100 * F.size(F.array_distinct("w")) < 50 * n, 100 * upper.cast("long") > 2 * F.length("text").cast("long"), F.col("text").rlike("[#$%&*|]")]
    judged = split.select("doc_id", "part", "text", *(t.alias(f"fail_{i}") for i, t in enumerate(tests))).withColumn("row", F.monotonically_increasing_id())
    return _equal_earlier(judged).withColumnRenamed("fail_equal", "fail_4")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with `good` and `toxic`."""
    each = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.coalesce("quality", F.lit(0)) == 1)).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1)).alias("toxic"))
    joined = rows.join(each.hint("merge"), "doc_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in LABELS})


def bitset_counts(parts: np.ndarray, fails: np.ndarray, labels: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """parts: of each document the number of its part, ascending; fails, labels: booleans, a row for each filter and label. Returns subset, next filter, and a row for each of kept, removed and the labels lost, with a count for each part."""
    numbers, sizes = np.unique(parts, return_counts=True)
    wide = (sizes + 7) // 8
    first = np.cumsum(wide) - wide
    at = np.arange(len(parts)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first * 8, sizes)

    def packed(bits: np.ndarray) -> np.ndarray:
        out = np.zeros(int(wide.sum()) * 8, dtype=bool)
        out[at] = bits
        return np.packbits(out)

    def count(bits: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.bitwise_count(bits).astype(np.int64), first)

    everyone, failed, marks = packed(np.ones(len(parts), dtype=bool)), [packed(x) for x in fails], [packed(x) for x in labels]
    out = []
    for size in range(len(failed)):
        for before in combinations(range(len(failed)), size):
            left = everyone.copy()
            for f in before:
                left &= ~failed[f]
            for f in set(range(len(failed))) - set(before):
                gone = left & failed[f]
                out.append((sum(1 << b for b in before), f, np.stack([count(left & ~failed[f]), count(gone), *(count(gone & m) for m in marks)])))
    return out


def _index(filters: int, batches):
    """Rows: part, filters, labels. Counts of each run of ROWS documents, part by part."""

    def counts(held):
        t = pa.Table.from_batches(held)
        names = t.column(0).combine_chunks().dictionary_encode()
        code = names.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        bits = np.stack([c.to_numpy(zero_copy_only=False).astype(bool)[order] for c in t.columns[1:]])
        found = np.unique(code)
        for subset, f, n in bitset_counts(code[order], bits[:filters], bits[filters:]):
            same = np.full(len(found), subset, np.int32), np.full(len(found), f, np.int32)
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(found)).cast(pa.string()), *map(pa.array, same), *map(pa.array, n)], names=[x.split()[0] for x in _COUNTS.split(", ")])

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= ROWS:
            yield from counts(held)
            held = []
    if sum(x.num_rows for x in held):
        yield from counts([x for x in held if x.num_rows])


def subset_counts(rows: DataFrame, filters: int = len(NAMES)) -> DataFrame:
    """part, subset (of the filters that ran before, as bits), filter (next), kept, removed, good_lost, toxic_lost. rows: part, fail_0 .. , good, toxic."""
    sent = rows.select("part", *(f"fail_{i}" for i in range(filters)), *LABELS)
    each = sent.mapInArrow(partial(_index, filters), _COUNTS)
    return each.groupBy("part", "subset", "filter").agg(*(F.sum(c).alias(c) for c in ("kept", "removed", "good_lost", "toxic_lost")))


def audit(rows: DataFrame, names: str = NAMES) -> DataFrame:
    """A row for each part, order of the filters and step; rows as in `subset_counts`."""
    k = len(names)
    counts = common.materialize(subset_counts(rows, k), "subsets")
    weight = F.element_at(F.array(*(F.lit(factorial(i) * factorial(k - 1 - i)) for i in range(k))), F.bit_count("subset") + 1)
    own = F.call_function("shiftleft", F.lit(1), F.col("filter"))
    each = counts.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("subset") == 0, F.col("removed")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("subset") + own == (1 << k) - 1, F.col("removed")).otherwise(0)).alias("unique_fails"),
        F.sum(F.col("removed") * weight).cast("long").alias("shapley"),
    )
    steps = [("".join(names[f] for f in order), s + 1, sum(1 << f for f in order[:s]), order[s]) for order in permutations(range(k)) for s in range(k)]
    # of fixed size: filters! x filters rows
    orders = F.broadcast(rows.sparkSession.createDataFrame(steps, "filter_order string, step int, subset int, filter int"))
    told = counts.join(each, ["part", "filter"]).join(orders, ["subset", "filter"])
    return told.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return audit(labelled(failures(docs), labels))


def sql() -> str:
    orders = ", ".join(f"('{''.join(o)}')" for o in permutations(NAMES))
    fails = {f: f"f{f.lower()}" for f in NAMES}
    before = " OR ".join(f"({c} AND position('{f}' IN pre) > 0)" for f, c in fails.items())
    own = "CASE f " + " ".join(f"WHEN '{f}' THEN {c}" for f, c in fails.items()) + " END"
    others = " OR ".join(f"({c} AND f <> '{f}')" for f, c in fails.items())
    return f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
j AS (SELECT part, len(w) < 200 AS fa, 100 * len(list_distinct(w)) < 50 * len(w) AS fb, 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) AS fc,
  regexp_matches(text, '[#$%&*|]') AS fd, coalesce(w.doc_id > first, false) AS fe, coalesce(good, 0) = 1 AS good, coalesce(lab.toxic, 0) = 1 AS toxic FROM w LEFT JOIN lab ON w.doc_id = lab.doc_id),
g AS (SELECT part, fa, fb, fc, fd, fe, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM j GROUP BY ALL),
o AS (SELECT filter_order, step::INT AS step, filter_order[1:step - 1] AS pre, filter_order[step:step] AS f FROM (VALUES {orders}) AS v(filter_order), range(1, 6) AS s(step)),
c AS (SELECT part, filter_order, step, f, n, good, toxic, ({before}) AS gone, {own} AS own, ({others}) AS other FROM g, o),
r AS (SELECT part, filter_order, step, f, sum(n) FILTER (NOT gone AND NOT own) AS kept, sum(n) FILTER (NOT gone AND own) AS removed, sum(n) FILTER (gone AND own) AS redundant,
  sum(n) FILTER (own AND NOT other) AS unique_fails, sum(good) FILTER (NOT gone AND own) AS good_lost, sum(toxic) FILTER (NOT gone AND own) AS toxic_lost FROM c GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r"""
