"""The query log as a stream: how often nodes come up in each window of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessergraph.sources.audit import parse_audit


def audit_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Records as they are appended in files of a folder."""
    return parse_audit(spark.readStream.text(folder))


def node_counts(records: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """``(start, id, count)``: occurrences among the top nodes in each window of the records' own time; records later
    than the watermark are dropped, so state stays bounded. Works for streams and tables alike."""
    timed = records.withColumn("at", F.to_timestamp("timestamp")).withWatermark("at", late)
    hits = timed.select("at", F.explode("top_nodes").alias("id"))
    return hits.groupBy(F.window("at", window).alias("w"), "id").agg(F.count("*").alias("count")).select(F.col("w.start").alias("start"), "id", "count")
