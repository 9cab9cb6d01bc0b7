"""Rules that grant budgets and rank programs: linear gates, program and memory scores, repeats, portfolios, buckets."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshquarry.functions.boxes import total
from meshquarry.session import maybe_broadcast

#: z-scores beyond this count as this.
CLIP = 10.0


def safe(x: Column, default: float = 0.0) -> Column:
    """A number; the default for null and NaN."""
    return F.coalesce(F.nanvl(x.cast("double"), F.lit(None).cast("double")), F.lit(default))


def linear_gate(features: Mapping[str, Column], mean: Mapping[str, Column | float], std: Mapping[str, Column | float], weights: Mapping[str, float]) -> Column:
    """Weighted sum of clipped z-scores; spreads below 1e-6 count as 1, missing values as 0."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    spread = lambda s: F.when(F.abs(safe(s, 1.0)) < 1e-6, F.lit(1.0)).otherwise(safe(s, 1.0))
    z = {n: F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), (safe(c) - safe(lit(mean[n]))) / spread(lit(std[n])))) for n, c in features.items()}
    return total([z[n] * float(w) for n, w in weights.items()])


def gate_budget(score: Column, threshold: Column, low: int, high: int) -> Column:
    """The high budget from the threshold on, else the low one; between 1 and the high one."""
    return F.greatest(F.lit(1), F.least(F.lit(high), F.when(score >= threshold, F.lit(high)).otherwise(F.lit(low))))


#: Extra score of a family of programs: (family, category or None, least program length, bonus) (fixed values).
FAMILY_BONUS = (("recenter_then_shrink", None, 5, 0.65), ("shrink_slack_face", "table", 0, 0.15))


def program_score(mean_delta: Column, support: Column, family: Column, category: Column, length: Column) -> Column:
    """Mean gain, a thousandth of the logarithm of the support, and the bonuses of :data:`FAMILY_BONUS`."""
    extra = [F.when((family == f) & (length >= n) & (F.lit(True) if c is None else category == c), b).otherwise(0.0) for f, c, n, b in FAMILY_BONUS]
    return safe(mean_delta) + 0.001 * F.log1p(F.greatest(F.lit(0.0), safe(support))) + total(extra)


def memory_score(df: DataFrame, tables: Mapping[str, tuple[DataFrame, Sequence[str]]], weights: Mapping[str, float], fallback: float = 0.0) -> DataFrame:
    """``df`` with ``memory_score``: the weighted mean of the scores found in several tables, over the sum of absolute weights.

    A table has its key columns and ``score``; a row whose key it lacks scores ``fallback`` there. Tables of weight below
    1e-12 play no part.
    """
    live = {k: float(w) for k, w in weights.items() if abs(w) >= 1e-12}
    out = df
    for k in live:
        t, keys = tables[k]
        out = out.join(maybe_broadcast(t.select(*keys, F.col("score").alias(f"_s_{k}"))), list(keys), "left")
    whole = max(1e-9, sum(abs(w) for w in live.values()))
    score = total([safe(F.col(f"_s_{k}"), fallback) * w for k, w in live.items()]) / whole if live else F.lit(0.0)
    return out.withColumn("memory_score", score).drop(*(f"_s_{k}" for k in live))


#: Words of a stop condition that let a step repeat up to its observed range (fixed values).
OPEN_ENDED = ("score_stalls", "coverage_margin_low", "coverage_recovered", "exact_reward_delta_positive")


def repeat_budget(op: Column, observed: Column, repeat_max: Column, until: Column, most: int, median: bool = False) -> Column:
    """How often a step may run: once for a recentring, the observed repeat, or its range where the stop condition is open-ended; at most ``most``."""
    seen = F.greatest(F.lit(1), F.coalesce(observed.cast("int"), F.lit(1)))
    far = F.greatest(seen, F.coalesce(repeat_max.cast("int"), seen))
    free = F.lit(False)
    for w in OPEN_ENDED:
        free = free | F.coalesce(until.contains(w), F.lit(False))
    n = seen if median else F.when(free, far).otherwise(seen)
    return F.when(F.lit(most) <= 0, 0).when(F.coalesce(op, F.lit("")).isin("recenter", "recenter_box"), 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(most), n)))


def portfolio_rank(df: DataFrame, category: str, key: str, delta: str, steps: str) -> DataFrame:
    """``df`` (one row per category and key) with ``rank`` by (delta, steps), both falling; ties go to the key."""
    w = W.partitionBy(category).orderBy(F.desc_nulls_last(delta), F.desc_nulls_last(steps), F.asc(key))
    return df.withColumn("rank", F.row_number().over(w))


def stable_bucket(name: Column, buckets: int) -> Column:
    """The bucket of a name by its 8-byte BLAKE2b digest (little-endian), the same on every machine; null stays null.

    For a few distinct names; hash many rows by ``xxhash64`` instead.
    """

    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        known = {v: int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little") % buckets for v in s.dropna().unique()}
        return s.map(known).astype("Int32")

    return run(name)


def run_name(base: Column, epsilon: Column, tilted: Column, seed: Column) -> Column:
    """Name of a run from its settings: base, merge epsilon, ``_t`` for turned boxes, seed."""
    return F.concat(base, F.lit("_eps"), F.regexp_replace(F.format_string("%.4f", epsilon), r"\.?0+$", ""), F.when(tilted, "_t").otherwise(""), F.format_string("_s%d", seed))
