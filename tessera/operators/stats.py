"""Run counters and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_summary(log: DataFrame) -> DataFrame:
    """Totals, failures, successes and the error rate of a run log with a status."""
    failed = (F.col("status") == "failed").cast("long")
    return log.agg(F.count("*").alias("total"), F.sum(failed).alias("failed"), F.sum((F.col("status") == "success").cast("long")).alias("success"), F.round(F.coalesce(F.avg(failed.cast("double")), F.lit(0.0)), 6).alias("error_rate"))


def error_histogram(log: DataFrame) -> DataFrame:
    return log.where("status = 'failed'").groupBy("error_type").count()


def over_threshold(log: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The summary if the error rate lies above the threshold, no row otherwise."""
    return run_summary(log).where(F.col("error_rate") > threshold)


def batch_summary(sections: DataFrame) -> DataFrame:
    """Files of a batch by how they ended, and the sections they gave, from rows (path, status) of parsed files."""
    ended = sections.groupBy("path").agg(F.min("status").alias("status"), F.sum((F.col("status") == "success").cast("long")).alias("documents"))
    one = lambda status: F.coalesce(F.sum((F.col("status") == status).cast("long")), F.lit(0)).alias(status)
    return ended.agg(F.count("*").alias("total"), one("success"), one("failed"), one("skipped"), F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"))
