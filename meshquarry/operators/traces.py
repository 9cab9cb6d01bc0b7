"""Operators over action traces: priors, baselines, weights, returns, sampling, splits, pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshquarry.functions import search as X
from meshquarry.operators.manifest import top_per_group
from meshquarry.operators.ranking import row_numbers
from meshquarry.session import maybe_broadcast


def key_grid(df: DataFrame, scales: Column) -> DataFrame:
    """coord, scale: six bounds times the scales, and one recenter (6, 0); ``scales`` is an aggregate over ``df`` (one row)."""
    n = df.agg(scales.alias("s"))
    bounds = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda c: F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda k: F.struct(c.alias("coord"), k.alias("scale")))))
    grid = F.concat(bounds, F.array(F.struct(F.lit(6).alias("coord"), F.lit(0).alias("scale"))))
    return n.select(F.explode(grid).alias("g")).select(F.col("g.coord").cast("int").alias("coord"), F.col("g.scale").cast("int").alias("scale"))


def smoothed_prior(df: DataFrame, grid: DataFrame, reward: Column, min_reward: float, power: float, smoothing: float) -> DataFrame:
    """coord, scale, weight, n, log_prior: log of the smoothed share of each key of the grid.

    A row weighs max(reward, 0)^power (1 for power 0); rows below ``min_reward`` are left out; keys never seen keep the
    smoothing alone.
    """
    w = F.lit(1.0) if power == 0 else F.pow(F.greatest(reward, F.lit(0.0)), F.lit(float(power)))
    seen = df.filter(reward >= min_reward).groupBy("coord", "scale").agg(F.sum(w).alias("weight"), F.count("*").alias("n"))
    g = grid.join(maybe_broadcast(seen), ["coord", "scale"], "left").na.fill({"weight": 0.0, "n": 0})
    all_ = W.partitionBy(F.lit(0))  # one row per key of the grid
    return g.withColumn("log_prior", F.log((F.col("weight") + smoothing) / (F.sum("weight").over(all_) + smoothing * F.count("*").over(all_))))


def with_baseline(df: DataFrame, reward: str, mode: str, mesh: str = "mesh", category: str = "category") -> DataFrame:
    """``df`` with ``baseline``: the mean reward of the row's mesh or category, of all rows (``global``), or 0 (``none``).

    Means are aggregated and joined, so no window gathers a group. A null mesh or category is a group of its own.
    """
    if mode == "none":
        return df.withColumn("baseline", F.lit(0.0))
    if mode == "global":
        return df.withColumn("baseline", F.lit(df.agg(F.avg(reward).alias("m")).first().m))
    key = {"mesh": mesh, "category": category}[mode]
    g = df.groupBy(F.col(key).alias("_k")).agg(F.avg(reward).alias("baseline"))
    return df.join(maybe_broadcast(g), F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")


def group_advantage(df: DataFrame, group: Sequence[str], reward: str, overall: float) -> DataFrame:
    """``advantage``: reward less the mean of its group, or less ``overall`` in groups of one row.

    Group means are aggregated before they are joined back, so a hot group isn't gathered by a window.
    """
    g = df.groupBy(*group).agg(F.avg(reward).alias("_m"), F.count("*").alias("_n"))
    return df.join(maybe_broadcast(g), list(group)).withColumn("advantage", F.col(reward) - F.when(F.col("_n") > 1, F.col("_m")).otherwise(F.lit(overall))).drop("_m", "_n")


def standardised(c: Column, mean: Column, std: Column, clip: float) -> Column:
    """(c - mean) / std between -clip and clip; the deviation is 1e-12 at least."""
    return F.greatest(F.lit(-clip), F.least(F.lit(clip), (c - mean) / F.greatest(std, F.lit(1e-12))))


def balanced_weights(df: DataFrame, sign: str, category: str) -> DataFrame:
    """``w``: inverse frequency of the class (sign) times that of the category, brought to a mean of 1."""
    n = df.groupBy(category, sign).agg(F.count("*").alias("n"))
    all_ = W.partitionBy(F.lit(0))  # one row per category and class
    share = lambda *by: F.sum("n").over(all_) / F.sum("n").over(W.partitionBy(*by))
    raw = n.withColumn("raw", share(sign) * share(category))
    w = raw.withColumn("w", F.col("raw") / (F.sum(F.col("raw") * F.col("n")).over(all_) / F.sum("n").over(all_)))
    return df.join(maybe_broadcast(w.select(category, sign, "w")), [category, sign])


def discounted_returns(df: DataFrame, group: Sequence[str], order: Sequence[str], reward: str, gamma: float) -> DataFrame:
    """Discounted return of each group's rewards in order, with their number and running average.

    An episode is one array in one row; episodes are bounded by the search's step limit.
    """
    g = df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(reward).alias("_r")))).alias("_e"))
    r = F.transform("_e", lambda x: x["_r"].cast("double"))
    return g.select(*group, F.size("_e").alias("steps"), X.discounted(r, gamma).alias("ret"), X.running_average(r).alias("mean"))


def n_step_returns(df: DataFrame, group: Sequence[str], order: Sequence[str], reward: str, done: str, n: int, gamma: float) -> DataFrame:
    """``ret``: the next n rewards discounted, up to the first that ends an episode; ``stop_after`` rows further it ends."""
    w = W.partitionBy(*group).orderBy(*order).rowsBetween(0, n - 1)
    steps = F.collect_list(F.struct(F.col(reward).cast("double").alias("r"), F.col(done).alias("d"))).over(w)
    out = df.withColumn("_s", steps)
    end = F.array_position(F.transform("_s", lambda x: x["d"]), True)  # 0: none
    used = F.when(end > 0, end).otherwise(F.size("_s").cast("long"))
    rewards = F.transform(F.slice("_s", F.lit(1), used.cast("int")), lambda x: x["r"])
    return out.withColumn("ret", X.discounted(rewards, gamma)).withColumn("stop_after", (used - 1).cast("int")).drop("_s")


def ring_buffer(df: DataFrame, order: Sequence[Column], capacity: int) -> DataFrame:
    """The last ``capacity`` rows by ``order`` (a top-k, not a sort of all), with ``slot`` when ``order`` ends in the row's number."""
    return df.orderBy(*(c.desc() for c in order)).limit(capacity)


def priority_draws(df: DataFrame, key: str, priority: Column, draws: int, beta: float, seed: int = 0, buckets: int = 1024, bucket: Column | None = None) -> DataFrame:
    """draw, key, probability, weight: ``draws`` proportional draws by prefix sums.

    The running sum goes over bucket sums first (few rows), then within a bucket, so no task sees all rows. Draw i falls on
    (i + u) / draws of the sum, u from the seed. The weight is (probability * N)^-beta over the largest such. Rows go in order
    of ``bucket`` (0 ... buckets - 1, by default a hash of the key), then of the key.
    """
    d = df.select(F.col(key).alias("k"), priority.cast("double").alias("p"), (bucket if bucket is not None else F.lit(0)).alias("_b")).filter(F.col("p") > 0).withColumn("b", F.col("_b") if bucket is not None else F.pmod(F.xxhash64("k"), F.lit(buckets)))
    sums = d.groupBy("b").agg(F.sum("p").alias("s"), F.count("*").alias("n"), F.min("p").alias("least"))
    one = W.partitionBy(F.lit(0))  # at most `buckets` rows
    starts = sums.select("b", (F.sum("s").over(one.orderBy("b")) - F.col("s")).alias("start"), F.sum("s").over(one).alias("all"), F.sum("n").over(one).alias("n_all"), F.min("least").over(one).alias("least"))
    d = d.join(F.broadcast(starts), "b").withColumn("hi", F.col("start") + F.sum("p").over(W.partitionBy("b").orderBy("k"))).withColumn("lo", F.col("hi") - F.col("p"))
    u = (seed * 0.6180339887498949) % 1.0 or 0.5
    # draws at (i + u) / draws: those that fall into [lo, hi)
    first, last = F.ceil(F.col("lo") / F.col("all") * draws - u), F.ceil(F.col("hi") / F.col("all") * draws - u) - 1
    hit = d.filter(last >= first).withColumn("draw", F.explode(F.sequence(first, last))).filter((F.col("draw") >= 0) & (F.col("draw") < draws))
    prob = F.col("p") / F.col("all")
    return hit.select("draw", F.col("k").alias(key), prob.alias("probability"), (F.pow(prob * F.col("n_all"), F.lit(-beta)) / F.pow(F.col("least") / F.col("all") * F.col("n_all"), F.lit(-beta))).alias("weight"))


def validation_meshes(df: DataFrame, mesh: str, fraction: float) -> DataFrame:
    """mesh and ``is_validation``: the last round(n * fraction) meshes by name, one at least and n - 1 at most (banker's rounding)."""
    m = df.select(mesh).filter(F.col(mesh).isNotNull()).distinct()
    n = m.count()
    k = 0 if n < 2 else min(n - 1, max(1, round(n * min(max(fraction, 0.0), 0.9))))
    if not k:
        return m.withColumn("is_validation", F.lit(False))
    last = m.orderBy(F.desc(mesh)).limit(k).agg(F.min(mesh).alias("cut"))  # a top-k; one row
    cut = last.first().cut
    return m.withColumn("is_validation", F.col(mesh) >= F.lit(cut))


def interleave(df: DataFrame, category: str, name: str, size: int) -> DataFrame:
    """chunk and ``turn`` of each row: chunks of ``size`` by name within a category, taken from the categories in turn."""
    d = row_numbers(df, [category], [F.col(name)], "_rn").withColumn("chunk", F.floor((F.col("_rn") - 1) / size).cast("int")).drop("_rn")
    chunks = d.groupBy(category).agg((F.max("chunk") + 1).alias("n"))
    per = chunks.withColumn("_all", F.collect_list(F.struct(F.col(category).alias("c"), F.col("n"))).over(W.partitionBy(F.lit(0)))).select(category, "_all")  # one row per category
    j = d.join(maybe_broadcast(per), category)
    # all chunks of earlier rounds, and in this round those of the categories up to this one
    earlier = F.aggregate("_all", F.lit(0).cast("long"), lambda a, x: a + F.least(x["n"], F.col("chunk")))
    here = F.size(F.filter("_all", lambda x: (x["n"] > F.col("chunk")) & (x["c"] <= F.col(category))))
    return j.withColumn("turn", earlier + here).drop("_all")


def reward_pairs(df: DataFrame, group: str, key: str, target: str, max_pairs: int) -> DataFrame:
    """hi, lo, gap: every positive row of a group against every row that isn't, the ``max_pairs`` widest gaps of all groups.

    Ties go to the lower ids. A pair of a group's i-th largest positive and j-th smallest other row comes after at least
    i * j - 1 pairs of the group, so only ranks with i * j <= max_pairs meet; a hot group gives ``max_pairs`` rows a side.
    """
    side = lambda c, order, name, rank: top_per_group(df.filter(c).select(group, F.col(key).alias(name), F.col(target).alias(f"_{name}")), [group], [order, F.col(name)], max_pairs).withColumnRenamed("rank", rank)
    hi = side(F.col(target) > 0, F.desc("_hi"), "hi", "_i")
    lo = side(F.col(target) <= 0, F.asc("_lo"), "lo", "_j")
    gap = F.col("_hi") - F.col("_lo")
    j = hi.join(lo, group).filter(F.col("_i") * F.col("_j") <= max_pairs)
    return j.filter(gap > 1e-12).select(group, "hi", "lo", gap.alias("gap")).orderBy(F.desc("gap"), "hi", "lo").limit(max_pairs)
