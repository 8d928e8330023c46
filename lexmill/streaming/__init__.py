"""Checking files as they arrive (an extension): a file source, the check on each batch, a clean-file cache as state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def documents(spark: SparkSession, folder: str, schema: str = "doc_id long, text string", **options: str) -> DataFrame:
    """A stream of Parquet documents."""
    return spark.readStream.schema(schema).options(**options).parquet(folder)


def check_stream(docs: DataFrame, check: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Issues of each batch, written as Parquet under a folder for the batch, so a rerun batch replaces its own rows."""

    def run(batch: DataFrame, number: int) -> None:
        check(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return docs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()


def issue_rate(issues: DataFrame, at: str = "ts", window: str = "5 minutes", late: str = "10 minutes", *groups: str) -> DataFrame:
    """Issues by time window, with a watermark for late rows."""
    return issues.withWatermark(at, late).groupBy(F.window(at, window), *groups).agg(F.count("*").alias("issues")).select("window.start", "window.end", *groups, "issues")
