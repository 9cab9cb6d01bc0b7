"""Structured Streaming over run records and events (extensions: the batch world has no streams).

Kernels and operators take and return columns, so the same expressions serve batch and stream.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meshquarry.operators.manifest import latest
from meshquarry.session import shared_dir


def table_stream(spark: SparkSession, folder: str, name: str, schema, files_per_trigger: int | None = None) -> DataFrame:  # noqa: ANN001
    """A Parquet table (a file or a folder of files) as a stream."""
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(f"{folder}/{name}.parque[t]")  # a pattern may also match a single file


def manifest_stream(spark: SparkSession, folder: str, schema: str, at: str, late: str = "1 hour", keys: Sequence[str] = ("stage", "mesh_id", "finished_at")) -> DataFrame:
    """JSON manifest lines as they are appended, reported-twice records dropped while the watermark keeps them."""
    s = spark.readStream.schema(schema).json(folder).withColumn("at", F.timestamp_seconds(F.col(at)))
    return s.withWatermark("at", late).dropDuplicatesWithinWatermark(list(keys))


def windowed(events: DataFrame, at: str, window: str, late: str, by: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """window_start, keys, n and the named aggregates per time window; windows close when the watermark passes them."""
    e = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    g = e.groupBy(F.window(at, window).alias("w"), *by).agg(F.count("*").alias("n"), *(c.alias(k) for k, c in aggs.items()))
    return g.select(F.col("w.start").alias("window_start"), *by, "n", *aggs)


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it wrote, from the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/meshquarry/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def keep_latest(stream: DataFrame, path: str, keys: Sequence[str], at: Sequence[str]) -> StreamingQuery:
    """Keep at ``path`` the latest record per key, merged batch by batch into a new version folder (path/v=N).

    A batch that is run again writes its version anew, so a restart loses and doubles nothing.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, n: int) -> None:
        before = spark.read.schema(batch.schema).parquet(f"{path}/v={n - 1}") if n else batch.limit(0)
        latest(before.unionByName(batch), list(keys), [F.col(c) for c in at]).write.mode("overwrite").parquet(f"{path}/v={n}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
