"""Percentiles of very large columns from mergeable logarithmic histograms.

Values are counted in signed logarithmic buckets of fixed relative width. Histograms of
partitions, files or days merge by adding the counts of equal buckets, and give every
percentile with a guaranteed relative error of at most ``alpha``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshquarry.functions.text import category_key, name_key

#: Relative error of a percentile.
ALPHA = 0.01
PERCENTILES = (0.5, 0.9, 0.95, 0.99)


def bucket(value: Column, alpha: float = ALPHA) -> Column:
    """Signed bucket of a finite value: 0 for 0, else sign * (index + offset) so that buckets are ordered as their values.

    Bucket i of the positive values holds (g^(i-1), g^i] with g = (1 + alpha) / (1 - alpha).
    """
    g = math.log((1 + alpha) / (1 - alpha))
    offset = math.ceil(745.2 / g) + 1  # beyond the least index of any double, so that positive buckets are > 0
    i = F.ceil(F.log(F.abs(value)) / F.lit(g)) + F.lit(offset)
    return F.when(value == 0, F.lit(0)).when(value > 0, i).otherwise(-i).cast("long")


def bucket_value(b: Column, alpha: float = ALPHA) -> Column:
    """The value that stands for a bucket, within alpha of each of its members."""
    ratio = (1 + alpha) / (1 - alpha)
    g = math.log(ratio)
    offset = math.ceil(745.2 / g) + 1
    mid = F.exp((F.abs(b) - F.lit(offset)) * F.lit(g)) * F.lit(2 / (1 + ratio))
    return F.when(b == 0, F.lit(0.0)).when(b > 0, mid).otherwise(-mid)


def histogram(df: DataFrame, groups: list[str], metrics: dict[str, Column], alpha: float = ALPHA) -> DataFrame:
    """groups, metric, bucket, n: the counts of the finite values of each metric (nulls, NaN and infinities left out).

    Counts are combined within partitions before the shuffle, so a hot group costs a row per bucket and partition.
    """
    long = df.select(*groups, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), c.cast("double").alias("x")) for m, c in metrics.items()))).alias("e")).select(*groups, "e.*")
    finite = long.filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < F.lit(float("inf"))))
    return finite.groupBy(*groups, "metric", bucket(F.col("x"), alpha).alias("bucket")).agg(F.count("*").alias("n"))


def merge(histograms: DataFrame, groups: list[str]) -> DataFrame:
    """One histogram per group from those of partitions or days (the other columns are given up)."""
    return histograms.groupBy(*groups, "metric", "bucket").agg(F.sum("n").alias("n"))


def percentiles(histograms: DataFrame, groups: list[str], ps: tuple[float, ...] = PERCENTILES, alpha: float = ALPHA) -> DataFrame:
    """groups, metric, n, p50, ... and rel_error from merged histograms.

    The p-percentile is the value of rank ceil(p * n), 1 at least. A group has at most a few thousand buckets, whatever
    its size, so the running sum over them is small.
    """
    by = [*groups, "metric"]
    w = W.partitionBy(*by)
    h = histograms.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    at = lambda p: F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("total")))
    picks = [F.min(F.when(F.col("upto") >= at(p), F.col("bucket"))).alias(f"p{p * 100:g}".replace(".", "_")) for p in ps]
    out = h.groupBy(*by).agg(F.max("total").alias("n"), *picks)
    return out.select(*by, "n", *(bucket_value(F.col(c), alpha).alias(c) for c in out.columns if c not in (*by, "n")), F.lit(alpha).alias("rel_error"))


def pack(histograms: DataFrame, groups: list[str]) -> DataFrame:
    """One row per group and metric: ``buckets`` (rising) and their ``counts``; a row holds at most a few thousand buckets."""
    h = histograms.groupBy(*groups, "metric").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("_h"))
    return h.select(*groups, "metric", F.col("_h.bucket").alias("buckets"), F.col("_h.n").alias("counts"))


def unpack(packed: DataFrame, groups: list[str]) -> DataFrame:
    """The histograms that :func:`pack` packed, ready to be merged."""
    return packed.select(*groups, "metric", F.explode(F.arrays_zip("buckets", "counts")).alias("_h")).select(*groups, "metric", F.col("_h.buckets").alias("bucket"), F.col("_h.counts").alias("n"))


def evaluation_histogram(records: DataFrame) -> DataFrame:
    """Histograms of bvs and elapsed_sec by category, stage and day of evaluated_at of evaluation records.

    A record sent twice (same eval_id on the same day) counts once, by its last ingested_at (ties: the larger values), so
    a day's histogram is made from the rows of that day alone; when copies arrive late, that day is made again. Records
    without an eval_id each count. A bvs below 0 is the sentinel of a failed run and left out; negative times are
    counted like any value. Category and stage are brought to one spelling; those not known are ``unknown``; records without
    a time form the day null.
    """
    day = F.to_date("evaluated_at").alias("day")
    alone = F.when(F.col("eval_id").isNull(), F.monotonically_increasing_id()).alias("_alone")
    category = F.coalesce(category_key(F.col("category")), F.lit("unknown")).alias("category")
    stage = F.coalesce(F.nullif(name_key(F.col("stage")), F.lit("")), F.lit("unknown")).alias("stage")
    r = records.select("eval_id", day, alone, F.struct("ingested_at", "bvs", "elapsed_sec", category, stage).alias("r"))
    r = r.groupBy("eval_id", "day", "_alone").agg(F.max("r").alias("r")).select("day", "r.*")
    return histogram(r, ["category", "stage", "day"], {"bvs": F.when(~(F.col("bvs") < 0), F.col("bvs")), "elapsed_sec": F.col("elapsed_sec")})


def delta_histogram(gate_rows: DataFrame) -> DataFrame:
    """Histograms of the signed changes delta_avg_bvs and delta_avg_viou of gate rows by category (``unknown`` where not known)."""
    category = F.coalesce(category_key(F.col("category")), F.lit("unknown")).alias("category")
    return histogram(gate_rows.select(category, "delta_avg_bvs", "delta_avg_viou"), ["category"], {m: F.col(m) for m in ("delta_avg_bvs", "delta_avg_viou")})
