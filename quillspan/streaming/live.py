"""The survey over streams: classification as it is, first observations within a watermark, and event correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators import classify, dedup


def first_seen(exchanges: DataFrame, event_time: str, late: str = "10 minutes", threshold: float = classify.DEFAULT_THRESHOLD) -> DataFrame:
    """Classified exchanges of a stream, each key once within the watermark; works on a batch as well."""
    classified = classify.classify(exchanges.withColumn("dedup_key", dedup.dedup_key()), classify.FOR_TYPE["auto"], threshold)
    if not exchanges.isStreaming:
        return classified.dropDuplicates(["dedup_key"])
    return classified.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["dedup_key"])


def detected_over_time(exchanges: DataFrame, event_time: str, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Counts of API exchanges by type in tumbling windows; late rows within the watermark still count."""
    classified = classify.classify(exchanges, classify.FOR_TYPE["auto"])
    marked = classified.withWatermark(event_time, late) if exchanges.isStreaming else classified
    return marked.groupBy(F.window(event_time, window).alias("window"), "api_type").agg(F.count("*").alias("exchanges"))


def correlate(requests: DataFrame, responses: DataFrame, late: str = "1 minute") -> DataFrame:
    """Requests with their responses by request_id; a request without an answer in time is given without one.

    requests: (request_id, asked_at, method, url); responses: (request_id, told_at, status).
    """
    left = requests.withWatermark("asked_at", late)
    right = responses.withColumnRenamed("request_id", "answered_id").withWatermark("told_at", late)
    same = (F.col("request_id") == F.col("answered_id")) & (F.col("told_at") >= F.col("asked_at")) & (F.col("told_at") <= F.col("asked_at") + F.expr(f"INTERVAL {late}"))
    return left.join(right, same, "left").drop("answered_id")
