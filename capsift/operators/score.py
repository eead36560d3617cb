"""Scores, levels and summaries of packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsift.functions import risk


def score(packages: DataFrame, risks: DataFrame, report: dict) -> DataFrame:
    """packages: skill_key. risks: skill_key, type, severity, risk_seq. Returns skill_key, score, risk_level, summary of every package: the worst severity's base score and the uplift of each type once."""
    base = F.coalesce(*(F.when(F.col("severity") == s, F.lit(float(v))) for s, v in report["baseScore"].items()), F.lit(0.0))
    uplift = F.coalesce(*(F.when(F.col("type") == t, F.lit(float(v))) for t, v in report["uplift"].items()), F.lit(0.0))
    rank = risk.severity_rank(F.col("severity"))
    # a row for each type of a package first: later sums see few rows
    types = risks.groupBy("skill_key", "type").agg(F.max(base).alias("base"), F.min(F.struct(rank.alias("rank"), "risk_seq")).alias("first"), F.first(uplift).alias("uplift"))
    got = types.groupBy("skill_key").agg(F.max("base").alias("base"), F.sum("uplift").alias("uplift"), F.array_sort(F.collect_list(F.struct("first", "type"))).alias("types"))
    worst = F.filter("types", lambda t: t["first"]["rank"] == F.get("types", 0)["first"]["rank"])
    every = packages.select("skill_key").distinct().join(got, "skill_key", "left")
    every = every.withColumn("score", F.greatest(F.coalesce("base", F.lit(0.0)), F.lit(0.0)) + F.coalesce("uplift", F.lit(0.0)))
    level = risk.risk_level(F.col("score"), report["thresholds"])
    return every.withColumn("risk_level", level).select("skill_key", "score", "risk_level", risk.summary(F.col("risk_level"), F.transform(worst, lambda t: t["type"])).alias("summary"))


def groups(risks: DataFrame) -> DataFrame:
    """skill_key, shown_key, n, rank, severity, first_seq: risks as the text report groups them."""
    key = F.coalesce("group_key", F.concat_ws(":", "type", "file", F.col("line").cast("string")))
    rank = risk.severity_rank(F.col("severity"))
    got = risks.groupBy("skill_key", key.alias("shown_key")).agg(F.count("*").alias("n"), F.min(rank).alias("rank"), F.min_by("severity", rank).alias("severity"), F.min("risk_seq").alias("first_seq"))
    return got
