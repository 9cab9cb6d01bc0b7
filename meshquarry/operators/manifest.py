"""Operators over run records: latest per key, summaries, failure classes, resume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], at: Sequence[Column], *also: Column) -> DataFrame:
    """One row per key: the last by ``at`` (nulls first), as a combining aggregation rather than a window.

    A hot key costs one row per partition. ``at`` should end in a unique column; equal rows are interchangeable. Null keys
    are a key of their own. ``also`` are aliased aggregates over the key's rows.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("_r"), *also)
    return best.select(*keys, "_r.*", *best.columns[len(keys) + 1 :])


def latest_success(df: DataFrame, keys: Sequence[str], at: Sequence[Column], status: str = "status", seq: str | None = None) -> DataFrame:
    """The latest of each key's records that have status ``success``; with ``seq``, ``first_seq`` is where the key first appears."""
    ok = df.filter(F.col(status) == "success")
    return latest(ok, keys, at, *([F.min(seq).alias("first_seq")] if seq else []))


#: Ordered rules of the failure classes: the first whose words stand in the error holds (fixed values).
FAILURE_RULES = (("timeout", ("timeout", "timed out", "timed_out")), ("killed", ("sigkill", "signal", "killed", "oom")), ("memory", ("memory", "bad_alloc")), ("missing_input", ("not found", "no such file", "missing")), ("invalid_mesh", ("watertight", "manifold", "empty mesh", "degenerate", "self-intersect")), ("exit_code", ("exit", "return code", "returned non-zero")))


def failure_class(error: Column, status: Column) -> Column:
    """Class of a failed record by its error text; ``unknown`` without a rule, null for records that didn't fail."""
    text = F.lower(F.coalesce(error, F.lit("")))
    c = F.when(text == "", F.lit("no_message"))
    for name, words in FAILURE_RULES:
        hit = text.contains(words[0])
        for w in words[1:]:
            hit = hit | text.contains(w)
        c = c.when(hit, F.lit(name))
    failed = F.lower(F.trim(status)).isin("failed", "error", "timeout")
    return F.when(failed, c.otherwise(F.lit("unknown")))


def return_code_class(code: Column) -> Column:
    """success for 0, signal for negative or above 128, timeout for 124, else error; null stays null."""
    return F.when(code == 0, "success").when((code < 0) | (code > 128), "signal").when(code == 124, "timeout").when(code.isNotNull(), "error")


def status_counts(df: DataFrame, by: str = "stage") -> DataFrame:
    return df.groupBy(by, "status").agg(F.count("*").alias("n"))


def metric_summary(df: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """total, success, failed and the mean of each metric over successes; nulls and numbers that aren't finite are skipped."""
    ok = F.col("status") == "success"
    mean = lambda m: F.avg(F.when(ok & ~F.isnan(m) & (F.abs(m) < F.lit(float("inf"))), F.col(m)))
    return df.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(ok).alias("success"), F.count_if(~ok | F.col("status").isNull()).alias("failed"), *(F.round(mean(m), 6).alias(f"avg_{m}") for m in metrics))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group with their ``rank`` (Spark keeps k per partition before it shuffles)."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)
