"""What the operators share: reading tables, the shared folder, cutting lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words: space and \t \n \v \f \r.
WS = " \t\n\x0b\f\r"
WS_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where the session names none and runs in local mode (tests), one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="capsift-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Where materialize() notes what it writes: the innermost scratch of this thread, and around it what the owner of the results keeps.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("capsift_scratch", default=())


def materialize(df: DataFrame, what: str = "step", keep: bool = False) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage, survives the loss of executors.

    Within `scratch` the table goes at its end, unless it is to be kept: then it belongs to the scratch around it. What belongs to none stays, since a result that was handed out reads it."""
    path = new_dir(df.sparkSession, what)
    lists = _open.get()
    at = len(lists) - (2 if keep else 1)
    if 0 <= at:
        lists[at].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written step that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def noted(paths: list[str]) -> Iterator[None]:
    """What is written within is added to `paths`, whose owner deletes it."""
    token = _open.set((*_open.get(), paths))
    try:
        yield
    finally:
        _open.reset(token)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written within are deleted at the end; what is needed later must be written with keep."""
    paths: list[str] = []
    try:
        with noted(paths):
            yield
    finally:
        for path in paths:
            remove(spark, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], n: str, by: list[str], how: str = "inner") -> DataFrame:
    """rows joined with table, which has each key once and, in column n, how many of the rows have it; n doesn't come out.

    A key with more than its part of all rows (a quarter of a task's) is cut into as many salted keys as it has such parts. Fewer than four keys a partition can hold so many rows, whatever
    the data, so the list of them is small enough to broadcast: it tells a row whether to take a salt, by its columns `by`."""
    total = table.agg(F.sum(n)).first()[0] or 0
    bound = max(1000, total // (4 * partitions(rows.sparkSession)))
    parts, salt = "__capsift_parts", "__capsift_salt"
    cut = table.withColumn(parts, F.ceil(F.col(n) / bound).cast("int")).drop(n)
    hot = cut.where(F.col(parts) > 1).select(*keys, parts)
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(*by), F.col(parts)), F.lit(0)).cast("int")).drop(parts)
    salted = cut.withColumn(salt, F.explode(F.sequence(F.lit(0), F.col(parts) - 1))).drop(parts)
    return dealt.join(salted.hint("merge"), [*keys, salt], how).drop(salt)


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits of a row's id and text, nulls told from values: what stands for the row where its text is not at hand."""
    part = lambda c: F.when(c.isNull(), "n").otherwise(F.concat(F.lit("v"), c))
    return F.unhex(F.md5(F.concat(part(F.col(id_col).cast("string")), F.lit("\0"), part(F.col(text_col).cast("string")))))


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    line = F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" "))
    odd = reduce(lambda a, b: a | b, (F.contains(line, F.lit(c)) for c in "\t\x0b\f\r"))
    # a split at one plain character needs no pattern
    plain = F.when(odd, F.regexp_replace(line, WS_RUN, " ")).otherwise(line)
    return F.array_remove(F.split(plain, " "), "")


def count_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")
