"""Score cutoff per source that keeps a target fraction: distributed quickselect.

Each round takes the median of every partition per source, makes the weighted median
of these the source's pivot, counts the scores above and at the pivot, and discards the
side that can't hold the target rank. The rounds end when few enough scores per source
are left to be ranked directly. Only one row per target leaves the cluster per round.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshquarry.functions.text import source_key
from meshquarry.session import spill

#: Scores per source that are ranked directly.
SMALL = 2048
MAX_ROUNDS = 200


def counted_states(scores: DataFrame) -> DataFrame:
    """state_id, source, score: each state once, by the row last in scored_at, if that score is finite.

    Rows at the same last time: the largest score wins. A null scored_at comes first. Null state_ids and sources are dropped.
    """
    s = scores.filter(F.col("state_id").isNotNull()).groupBy("state_id").agg(F.max(F.struct("scored_at", F.col("score").cast("double").alias("score"), source_key(F.col("source")).alias("source"))).alias("r"))
    s = s.select("state_id", "r.source", "r.score")
    return s.filter(F.col("source").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < F.lit(float("inf")))).withColumn("score", F.col("score") + F.lit(0.0))


def keep_rank(n: int, fraction: float) -> int:
    """Smallest k with k / n at least the fraction (0: keep nothing)."""
    k = max(0, min(n, math.ceil(fraction * n)))
    while k > 0 and (k - 1) / n >= fraction:
        k -= 1
    while k < n and k / n < fraction:
        k += 1
    return k


def quickselect(values: DataFrame, targets: dict[str, float]) -> dict[str, tuple[float, int, int]]:
    """For each source its cutoff, the number kept and the number of all its scores.

    ``values`` has source and finite score; ``targets`` the fraction to keep by source (one row per target: the only
    state the driver holds). The cutoff is the largest score at which the share of scores at or above it reaches the
    fraction. Sources without scores, or with a fraction of 0 or less, are left out.
    """
    spark = values.sparkSession
    active = spill(values.filter(F.col("source").isin(*targets)).select("source", "score"), "scores") if targets else values.limit(0)
    total = {r.source: r.n for r in active.groupBy("source").agg(F.count("*").alias("n")).collect()}
    rank = {s: k for s, n in total.items() if (k := keep_rank(n, targets[s])) > 0}  # rank from the top among the active
    above = dict.fromkeys(rank, 0)  # scores discarded on the upper side
    size, done = {s: total[s] for s in rank}, {}
    written = sum(size.values())
    for _ in range(MAX_ROUNDS):
        open_ = [s for s in rank if s not in done and size[s] > SMALL]
        if not open_:
            break
        act = active.filter(F.col("source").isin(*open_))
        medians = act.groupBy("source", F.spark_partition_id().alias("p")).agg(F.percentile_approx("score", 0.5, 1000).alias("m"), F.count("*").alias("n"))
        w = W.partitionBy("source").orderBy("m", "p")
        run = medians.withColumn("before", F.sum("n").over(w) - F.col("n")).withColumn("all", F.sum("n").over(W.partitionBy("source")))
        pivots = run.filter((F.col("before") * 2 < F.col("all")) & ((F.col("before") + F.col("n")) * 2 >= F.col("all"))).groupBy("source").agg(F.min("m").alias("pivot"))
        pivot = {r.source: r.pivot for r in pivots.collect()}
        side = F.create_map(*(x for s, p in pivot.items() for x in (F.lit(s), F.lit(p))))[F.col("source")]
        counts = act.groupBy("source").agg(F.count(F.when(F.col("score") > side, 1)).alias("hi"), F.count(F.when(F.col("score") == side, 1)).alias("eq"), F.min("score").alias("lo")).collect()
        keep = F.lit(False)
        for r in counts:
            s, p = r.source, pivot[r.source]
            if rank[s] <= r.hi:
                keep, size[s] = keep | ((F.col("source") == s) & (F.col("score") > p)), r.hi
            elif rank[s] <= r.hi + r.eq:
                done[s] = (p, above[s] + r.hi + r.eq, total[s])
            else:
                keep, size[s] = keep | ((F.col("source") == s) & (F.col("score") < p)), size[s] - r.hi - r.eq
                rank[s], above[s] = rank[s] - r.hi - r.eq, above[s] + r.hi + r.eq
        rest = F.col("source").isin(*[s for s in rank if s not in done and s not in open_])
        active = active.filter(keep | rest)
        if sum(size[s] for s in rank if s not in done) * 4 <= written:  # each copy is a fourth of the last at most
            active, written = spill(active, "scores"), sum(size[s] for s in rank if s not in done)
    left = [s for s in rank if s not in done]
    if left:
        w = W.partitionBy("source").orderBy(F.desc("score"))
        at = F.create_map(*(x for s in left for x in (F.lit(s), F.lit(rank[s]))))[F.col("source")]
        few = active.filter(F.col("source").isin(*left)).groupBy("source", "score").agg(F.count("*").alias("n"))
        ranked = few.withColumn("upto", F.sum("n").over(w)).filter((F.col("upto") >= at) & (F.col("upto") - F.col("n") < at))
        done |= {r.source: (r.score, above[r.source] + r.upto, total[r.source]) for r in ranked.collect()}
    return done


def cutoffs(states: DataFrame, targets: DataFrame) -> DataFrame:
    """source, cutoff, kept, states, kept_share, target of each source of ``targets`` (source, target_open_rate, threshold) that has states.

    A target above 1 is in percent; null targets are left out; of several rows for one source the largest target holds.
    """
    spark = states.sparkSession
    t = targets.select(source_key(F.col("source")).alias("source"), F.when(F.col("target_open_rate") > 1, F.col("target_open_rate") / 100).otherwise(F.col("target_open_rate")).alias("target"))
    want = {r.source: r.target for r in t.filter(F.col("source").isNotNull() & F.col("target").isNotNull() & ~F.isnan("target")).groupBy("source").agg(F.max("target").alias("target")).collect()}
    found = quickselect(states, want)
    return spark.createDataFrame([(s, float(c), int(k), int(n), k / n, want[s]) for s, (c, k, n) in sorted(found.items())], "source string, cutoff double, kept long, states long, kept_share double, target double")


def kept_states(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """state_id, source and score of each counted state that reaches its source's cutoff."""
    states = spill(counted_states(scores), "states")
    c = cutoffs(states, targets).select("source", "cutoff")  # one row per target
    return states.join(F.broadcast(c), "source").filter(F.col("score") >= F.col("cutoff")).select("state_id", "source", "score")
