"""Connected components over an edge table, by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsift.llm import common


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long, not null). Returns node, component: the least node that each node reaches. Nodes without an edge to another are left out.

    Every round is written to the shared folder; it ends when a round changes nothing. The number of rounds grows with the logarithm of the longest path.
    """
    spark = edges.sparkSession
    written: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        path = common.new_dir(spark, "stars")
        df.write.parquet(path)
        written.append(path)
        return spark.read.schema("a long, b long").parquet(path)

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    now = state(e)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        e = keep(small.where("a > b").distinct())
        before, now = now, state(e)
        if before == now:
            break
    for path in written[:-1]:
        common.remove(spark, path)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
