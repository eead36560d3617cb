"""Analysis of packages as they arrive: an extension, since the analysis itself is a batch.

A file source watches a folder of parquet files of the relation `files`; each micro-batch is analysed by the batch plan and its reports are
appended, once for each batch id, so a repeated batch leaves the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from capsift.plans.analyze import analyze

SCHEMA = "skill_key string, path string, size long, content_type string, content string, list_seq int"


def reports_stream(spark: SparkSession, source: str, target: str, checkpoint: str, config: dict | None = None) -> StreamingQuery:
    """Start a query that analyses what is there and ends (availableNow). A package must arrive whole in one file."""

    def batch(df: DataFrame, number: int) -> None:
        with analyze(df, config) as found:
            found.reports.write.mode("overwrite").parquet(f"{target}/batch={number}")

    files = spark.readStream.schema(SCHEMA).parquet(source)
    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
