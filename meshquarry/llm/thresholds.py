"""Hash-threshold selection: take a budget per group by a random-looking hash, without sorting.

Weights are summed by group and hash bucket; the running sum over a group's buckets
finds the bucket in which the budget ends. Only that bucket is refined: its rows are summed by
the next digits of the hash, and so on until one row is left, which gives the group's threshold.
Hashes are the random order, so thresholds of growing budgets are nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshquarry.session import spill

#: Buckets per group and refinement (a power of two).
BUCKETS = 4096
_BITS = 62


def hash_rank(*cols: Column, seed: int = 0) -> Column:
    """A 62-bit hash that serves as a random order."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << _BITS))


def thresholds(df: DataFrame, group: list[str], weight: Column, rank: Column, budgets: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """group, threshold: the rows of a group whose rank is below its threshold make up its budget.

    ``budgets`` has one row per group, which the driver holds: the group's columns and ``budget``; groups without one, or
    with 0, get no threshold. A row is taken if the sum of the weights before it, plus half its own, is at most the
    budget, so that the taken sum is as near to the budget as whole rows allow; rows of equal rank count as one.
    """
    spark = df.sparkSession
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in budgets.select(*group).schema.fields)
    open_ = {tuple(r[:-1]): (float(r.budget), 0, 0.0) for r in budgets.filter(F.col("budget") > 0).select(*group, "budget").collect()}
    d = df.select(*group, weight.cast("double").alias("_w"), rank.alias("_rank"))
    width, level, done = 1 << _BITS, 0, []
    while open_:
        step = max(1, width // buckets)
        now = spark.createDataFrame([(*k, *v) for k, v in open_.items()], f"{kinds}, _budget double, _lo long, _before double")
        inside = d.join(F.broadcast(now), group).filter((F.col("_rank") >= F.col("_lo")) & (F.col("_rank") - F.col("_lo") < width))
        if level == 1:  # the boundary buckets alone, a share of 1 / buckets of the rows
            d = spill(inside.select(*group, "_w", "_rank"), "edge")
            inside = d.join(F.broadcast(now), group)
            inside = inside.filter((F.col("_rank") >= F.col("_lo")) & (F.col("_rank") - F.col("_lo") < width))
        sums = inside.groupBy(*group, "_budget", "_lo", "_before", F.floor((F.col("_rank") - F.col("_lo")) / F.lit(step)).alias("_b")).agg(F.sum("_w").alias("_s"), F.count("*").alias("_n"))
        upto = F.col("_before") + F.sum("_s").over(W.partitionBy(*group).orderBy("_b"))  # at most `buckets` rows a group
        edge = sums.withColumn("_upto", upto).filter(F.col("_upto") > F.col("_budget"))
        edge = edge.groupBy(*group).agg(F.min_by(F.struct("_b", "_upto", "_s", "_n"), "_b").alias("e"))
        found = {tuple(r[:-1]): r.e for r in edge.collect()}
        later = {}
        for k, (budget, lo, _) in open_.items():
            if k not in found:
                done.append((*k, lo + width))
                continue
            e = found[k]
            at, start = lo + e["_b"] * step, e["_upto"] - e["_s"]
            if step == 1 or e["_n"] == 1:
                done.append((*k, at + step if start + e["_s"] / 2 <= budget else at))
            else:
                later[k] = (budget, at, start)
        open_, width, level = later, step, level + 1
    return spark.createDataFrame(done, f"{kinds}, threshold long")


def take_by_hash(df: DataFrame, group: list[str], weight: Column, rank: Column, budgets: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows of ``df`` below the thresholds of their groups: one pass beside the search for these; groups without one give nothing."""
    t = thresholds(df, group, weight, rank, budgets, buckets)
    return df.join(F.broadcast(t), group).filter(rank < F.col("threshold")).drop("threshold")
