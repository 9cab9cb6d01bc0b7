"""Selection: ties, two-stage ranking, thresholds, guarded choice, cascades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshquarry.session import maybe_broadcast

#: Metrics of a run, whether larger is better, and the tolerance of a guard (fixed values).
GUARDED = {"bvs": (False, 1e-3), "mov": (False, 1e-3), "tov": (False, 1e-3), "covered": (True, 1e-3), "viou": (True, 1e-3), "cub_cd": (False, 1e-3)}


def tied_argmax(df: DataFrame, group: Sequence[str], score: str, key: str, pick: int) -> DataFrame:
    """group, best, ties and the ``pick % ties``-th of the best rows by key.

    The best score is found first (combining), so only its rows are ever numbered. Null and NaN scores don't count.
    """
    ok = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).select(*group, F.col(score).alias("_s"), key)
    best = ok.groupBy(*group).agg(F.max("_s").alias("best"))
    tied = ok.join(maybe_broadcast(best), list(group)).filter(F.col("_s") == F.col("best"))
    w = W.partitionBy(*group)
    n = tied.withColumn("ties", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy(key)) - 1)
    return n.filter(F.col("_i") == F.pmod(F.lit(pick), F.col("ties"))).select(*group, "best", "ties", key)


def reranked(df: DataFrame, group: Sequence[str], first: Sequence[Column], second: Sequence[Column], keep: int) -> DataFrame:
    """``rank``: by ``first``, then the best ``keep`` of these again by ``second``; the rest stay in order."""
    a = F.row_number().over(W.partitionBy(*group).orderBy(*first))
    d = df.withColumn("_a", a)
    top = (F.col("_a") <= keep).cast("int")
    order = [F.desc(top), *(F.when(F.col("_a") <= keep, c).asc() for c in second), F.asc("_a")]
    return d.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).drop("_a")


def first_rule(df: DataFrame, rules: Sequence[tuple[str, str, float, str]], tol: float = 1e-12) -> Column:
    """The outcome of the first rule (column, operator, threshold, outcome) that holds; null without one. Equality has a tolerance."""
    ops = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "==": lambda a, b: F.abs(a - b) <= tol, "!=": lambda a, b: F.abs(a - b) > tol}
    out = F.lit(None).cast("string")
    for col, op, value, result in reversed(rules):
        out = F.when(ops[op](F.col(col).cast("double"), F.lit(float(value))), F.lit(result)).otherwise(out)
    return out


def gains(candidate: Column, base: Column, larger: bool) -> Column:
    return candidate - base if larger else base - candidate


def guarded_choice(runs: DataFrame, keys: Sequence[str], label: str, baseline: str, metrics: dict[str, tuple[bool, float]] = GUARDED, speed: str | None = None) -> DataFrame:
    """keys, chosen, improved, weighted_gain: the candidate that is worse than the baseline in no metric and gains most.

    A metric is worse if it loses more than its tolerance, improved if it gains more; null metrics compare as equal. Among
    those not worse the one with the larger summed gain wins (ties: more improved, then less ``speed``, then the label); none
    left, or none that gains, keeps the baseline. Keys without a baseline take the first label.
    """
    base = runs.filter(F.col(label) == baseline).select(*keys, *(F.col(m).alias(f"_b_{m}") for m in metrics), F.lit(True).alias("_has"))
    j = runs.join(maybe_broadcast(base), list(keys), "left")
    g = {m: F.coalesce(gains(F.col(m), F.col(f"_b_{m}"), up), F.lit(0.0)) for m, (up, _) in metrics.items()}
    worse = sum((g[m] < -tol).cast("int") for m, (_, tol) in metrics.items())
    better = sum((g[m] > tol).cast("int") for m, (_, tol) in metrics.items())
    gain = sum(g.values())
    j = j.withColumn("_worse", worse).withColumn("improved", better).withColumn("weighted_gain", F.round(gain, 6)).withColumn("_quick", -F.col(speed) if speed else F.lit(0.0))
    ok = F.when(F.col("_has").isNull(), F.lit(0)).when(F.col(label) == baseline, 0).when((F.col("_worse") == 0) & (F.col("weighted_gain") > 0), 1).otherwise(-1)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(ok), F.desc("weighted_gain"), F.desc("improved"), F.desc("_quick"), F.asc(label)))  # one row per candidate
    return j.withColumn("_r", rank).filter(F.col("_r") == 1).select(*keys, F.col(label).alias("chosen"), "improved", "weighted_gain")


def cascade(df: DataFrame, group: Sequence[str], proxy: Column, exact: Column, key: str, keep: int) -> DataFrame:
    """group, key, exact, checked, skipped: the exact best of each group's ``keep`` best by the cheap proxy.

    ``exact`` is only computed for those. Ties go to the lower key.
    """
    d = df.withColumn("_p", proxy)
    d = d.withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy(F.desc_nulls_last("_p"), F.asc(key))))
    n = df.groupBy(*group).agg(F.count("*").alias("_n"))
    top = d.filter(F.col("_r") <= keep).withColumn("_e", exact)
    best = top.groupBy(*group).agg(F.max(F.struct(F.col("_e").alias("e"), (-F.col(key)).alias("k"))).alias("b"), F.count("*").alias("checked"))
    return best.join(maybe_broadcast(n), list(group)).select(*group, (-F.col("b.k")).alias(key), F.col("b.e").alias("exact"), "checked", (F.col("_n") - F.col("checked")).alias("skipped"))


def learned_order(df: DataFrame, group: Sequence[str], learned: str, prior: Column, rank: Column) -> DataFrame:
    """``df`` with ``value``: the learned score (its group's mean where there is none), plus 1e-9 of the prior and 1e-12 / (rank + 1) to break ties."""
    x = F.nanvl(F.col(learned).cast("double"), F.lit(None).cast("double"))
    mean = df.groupBy(*group).agg(F.avg(x).alias("_m"))
    return df.join(maybe_broadcast(mean), list(group)).withColumn("value", F.coalesce(x, F.col("_m"), F.lit(0.0)) + 1e-9 * prior + 1e-12 / (rank + 1)).drop("_m")


def bounded_best(df: DataFrame, group: Sequence[str], bound: Column, exact: Column, key: str, first: int) -> DataFrame:
    """group, key, exact, checked, skipped: the exact best of each group, computed only where it may be.

    The ``first`` rows by upper bound (ties: the lower key) are computed, then those whose bound beats the best of these; the
    others can't win. Ties in the exact value go to the lower key. Rows of a group aren't gathered: a group costs its
    first rows and one number that is joined back.
    """
    from meshquarry.session import salted_join, spill

    d = spill(df.withColumn("_b", bound.cast("double")), "bounds")
    order = F.row_number().over(W.partitionBy(*group).orderBy(F.desc_nulls_last("_b"), F.asc(key)))
    top = d.withColumn("_r", order).filter(F.col("_r") <= first).withColumn("_e", exact.cast("double"))
    k = F.struct(*group)
    found = top.groupBy(k.alias("_k")).agg(F.max("_e").alias("_found"), F.collect_list(key).alias("_first"))
    j = salted_join(d.withColumn("_k", k), found, "_k", F.xxhash64(key), how="inner")
    live = F.array_contains("_first", F.col(key)) | (F.col("_b") > F.col("_found"))
    j = j.withColumn("_e", F.when(live, exact.cast("double")))
    best = F.max(F.when(live, F.struct(F.col("_e").alias("e"), (-F.col(key)).alias("k"))))
    g = j.groupBy(*group).agg(best.alias("b"), F.count_if(live).alias("checked"), F.count_if(~live).alias("skipped"))
    return g.select(*group, (-F.col("b.k")).alias(key), F.col("b.e").alias("exact"), "checked", "skipped")


def diverse_escape(df: DataFrame, group: Sequence[str], score: str, action: str, bbox: str, coord: str, keep: int) -> DataFrame:
    """group, picks: ``keep`` actions by score that repeat no used box together with a used coord, the last slot free, then filled by score.

    A group's candidates are the edits of one state; the pass over them is one fold of an array, in order of score, then action.
    """
    s = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(action).alias("a"), F.col(bbox).alias("b"), F.col(coord).alias("c"))))
    g = df.filter(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(*group).agg(s.alias("_l"))
    none = F.struct(F.array().cast("array<bigint>").alias("p"), F.array().cast("array<int>").alias("b"), F.array().cast("array<int>").alias("c"))

    def take(acc: Column, x: Column) -> Column:
        full = F.size(acc["p"]) >= keep
        again = F.array_contains(acc["b"], x["b"].cast("int")) & F.array_contains(acc["c"], x["c"].cast("int")) & (F.size(acc["p"]) < keep - 1)
        new = F.struct(F.array_append(acc["p"], x["a"].cast("long")).alias("p"), F.array_append(acc["b"], x["b"].cast("int")).alias("b"), F.array_append(acc["c"], x["c"].cast("int")).alias("c"))
        return F.when(full | again, acc).otherwise(new)

    first = F.aggregate("_l", none, take, lambda acc: acc["p"])
    g = g.withColumn("_p", first)
    rest = F.filter(F.transform("_l", lambda x: x["a"].cast("long")), lambda a: ~F.array_contains("_p", a))
    return g.select(*group, F.slice(F.concat("_p", rest), 1, keep).alias("picks"))


def greedy_assignment(costs: DataFrame, group: str, left: str, right: str, cost: str) -> DataFrame:
    """group, left, right, cost: pairs taken by cost (ties: left, right), each side once, in rounds of pairs that are best for both."""
    from meshquarry.session import spill

    open_ = spill(costs.select(group, left, right, cost), "costs")
    out = open_.limit(0)
    while not open_.isEmpty():
        key = F.struct(cost, left, right)
        l = open_.groupBy(group, left).agg(F.min(key).alias("_l"))
        r = open_.groupBy(group, right).agg(F.min(key).alias("_r"))
        won = spill(open_.join(l, [group, left]).join(r, [group, right]).filter((F.col("_l") == key) & (F.col("_r") == key)).select(group, left, right, cost), "won")
        out = out.union(won)
        open_ = spill(open_.join(won.select(group, left), [group, left], "left_anti").join(won.select(group, right), [group, right], "left_anti").select(group, left, right, cost), "costs")
    return out
