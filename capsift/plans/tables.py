"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one key from which on numbered() deals them out by range.
ROWS = 1_000_000
_open: ContextVar[list[str] | None] = ContextVar("capsift_tables", default=None)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where the session names none and runs in local mode (tests), one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="capsift-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write once and read back: cuts the lineage, survives the loss of executors. Within `noted` the table's owner knows of it."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    if (paths := _open.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def noted(paths: list[str]) -> Iterator[list[str]]:
    """What is written within is added to `paths`."""
    token = _open.set(paths)
    try:
        yield paths
    finally:
        _open.reset(token)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys over as many tasks as shuffles have. Spark does not put such partitions together again, as it would by their packed size: 64 MB of packed rows can be a gigabyte in a task that sorts or groups them."""
    return df.repartition(partitions(df.sparkSession), *keys)


def fan_out(rows: DataFrame, table: DataFrame, counts: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """rows joined with table by `keys`, each of which may stand in both any number of times; counts: the keys with `n`, how many rows each has.

    A key with more than a quarter of a task's share of all rows is dealt over several tasks by a salt from the columns `by`, and its rows of the table go to each of them. Fewer than four keys a partition can be so
    frequent, whatever the data, so their list is small enough to broadcast."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    bound = max(1000, total // (4 * partitions(rows.sparkSession)))
    parts, salt = "__capsift_parts", "__capsift_salt"
    hot = F.broadcast(counts.where(F.col("n") > bound).select(*keys, F.ceil(F.col("n") / bound).cast("int").alias(parts)))
    dealt = rows.join(hot, keys, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(*by), F.col(parts)), F.lit(0)).cast("int")).drop(parts)
    copied = table.join(hot, keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))).drop(parts)
    return dealt.join(copied.hint("merge"), [*keys, salt]).drop(salt)


def large_groups(a: DataFrame, b: DataFrame, keys: list[str], pairs: int) -> DataFrame | None:
    """The keys whose rows of a and b make more than `pairs` pairs; None if there are none."""
    of = lambda df, x, y: df.select(*keys, F.lit(x).cast("long").alias("n_a"), F.lit(y).cast("long").alias("n_b"))
    n = of(a, 1, 0).unionByName(of(b, 0, 1)).groupBy(*keys).agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b")).withColumn("pairs", F.col("n_a").cast("double") * F.col("n_b"))
    if (n.agg(F.max("pairs")).first()[0] or 0) <= pairs:
        return None
    return materialize(n.where(F.col("pairs") > pairs).select(*keys), "large")


def numbered(df: DataFrame, order: list[Column], name: str, sums: dict[str, Column] | None = None, key: str = "skill_key", of: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """df with `name`, the place (from 1) of each row among those of its key by `order`, and for each of `sums` the running sum up to and with the row. Rows that are equal in key and order get their places in any order;
    null keys are one key. of: a table, cheap to read, that has about as many rows of each key as df.

    If no key has more than `rows` rows, a window by key does it. Else all rows are dealt out by ranges of (key, order), numbered within their range, and moved on by what the earlier ranges hold of their key: only a
    range's first key can go on from an earlier range, so there is one offset a range at most, and no task holds a key."""
    sums = sums or {}
    most = (df if of is None else of).groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= (ROWS if rows is None else rows):
        of_key = Window.partitionBy(key).orderBy(*order)
        upto = of_key.rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: F.row_number().over(of_key)} | {n: F.sum(c).over(upto) for n, c in sums.items()})
    part, first, places = "__capsift_part", "__capsift_key", [f"__capsift_order{i}" for i in range(len(order))]
    terms, totals = {name: F.lit(1)} | sums, {n: f"__capsift_sum{i}" for i, n in enumerate([name, *sums])}
    placed = df.withColumns(dict(zip(places, order)) | {totals[n]: c.cast("long") for n, c in terms.items()})
    placed = materialize(placed.repartitionByRange(partitions(df.sparkSession), key, *places).withColumn(part, F.spark_partition_id()), "placed")
    runs = placed.groupBy(part, key).agg(*(F.sum(t).alias(t) for t in totals.values()))
    earlier = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(F.col(part), F.col(key).alias(first), *(F.sum(t).over(earlier).alias(f"{t}_before") for t in totals.values())).where(F.col(f"{totals[name]}_before").isNotNull())
    own = Window.partitionBy(part, key).orderBy(*places).rowsBetween(Window.unboundedPreceding, 0)
    counted = placed.withColumns({n: F.sum(t).over(own) for n, t in totals.items()}).join(F.broadcast(offsets), part, "left")
    moved = {n: F.col(n) + F.when(F.col(key).eqNullSafe(F.col(first)), F.coalesce(f"{t}_before", F.lit(0))).otherwise(0) for n, t in totals.items()}
    kinds = {name: "int"} | dict.fromkeys(sums, "long")
    return counted.withColumns(moved).select(*df.columns, *(F.col(n).cast(k).alias(n) for n, k in kinds.items()))
