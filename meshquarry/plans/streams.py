"""Streaming queries, run to the end over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquarry.session import table
from meshquarry.streaming import manifests as M

S_ = SparkSession


def stream_event_windows(spark: S_, d: str) -> DataFrame:
    """Six-hour windows of events by type, from a stream; the windows that the watermark never passes stay open and out."""
    e = M.table_stream(spark, d, "events", table(spark, d, "events").schema)
    return M.run_to_table(M.windowed(e, "ts", "6 hours", "0 seconds", ["event_type"], {"cents": F.sum(F.round(F.col("value") * 100).cast("long"))}))


def stream_distinct_evaluations(spark: S_, d: str) -> DataFrame:
    """Evaluation records of a stream with those sent twice dropped, by stage."""
    e = M.table_stream(spark, d, "evaluation_record", table(spark, d, "evaluation_record").schema)
    e = e.select("eval_id", "stage", F.col("ingested_at").cast("timestamp").alias("ingested_at")).withWatermark("ingested_at", "400 days").dropDuplicatesWithinWatermark(["eval_id"])
    return M.run_to_table(e).groupBy("stage").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (stream_event_windows, stream_distinct_evaluations)}

ORACLE = {
    "stream_event_windows": "WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2) SELECT * FROM w WHERE window_start + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events)",
    "stream_distinct_evaluations": "SELECT stage, count(DISTINCT eval_id) AS n FROM evaluation_record GROUP BY 1",
}
