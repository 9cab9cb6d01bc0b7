"""Search and return kernels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

INF = float("inf")


def ucb(q: Column, n: Column, parent: Column, c: float) -> Column:
    """q + c * sqrt(2 ln N / n); +inf for a child or parent without visits."""
    return F.when((n <= 0) | (parent <= 0), F.lit(INF)).otherwise(q + c * F.sqrt(2 * F.log(F.greatest(parent, F.lit(1)).cast("double")) / n))


def ucb_prior(q: Column, n: Column, parent: Column, prior: Column, c: float) -> Column:
    """The other form: q + c * sqrt(ln(N + 2) / (n + 1)) + prior / (n + 1)."""
    return q + c * F.sqrt(F.log(parent + 2) / (n + 1)) + prior / (n + 1)


def softmax(v: Column, w: WindowSpec, scale: float = 1.0) -> Column:
    """Softmax over a window, shifted by the largest value; uniform where the sum is 0 or no number."""
    e = F.exp((v - F.max(v).over(w)) / scale)
    s = F.sum(e).over(w)
    return F.when((s > 0) & ~F.isnan(s), e / s).otherwise(1 / F.count(F.lit(1)).over(w))


def puct_bonus(logit: Column, n: Column, parent: Column, weight: float, w: WindowSpec) -> Column:
    """weight * softmax(logit) * sqrt(N) / (1 + n)."""
    return weight * softmax(logit, w) * F.sqrt(F.greatest(parent, F.lit(1)).cast("double")) / (1 + n)


def weighted_score(base: Column, prior: Column, value: Column, base_scale: float, prior_weight: float, value_weight: float) -> Column:
    """base * scale + prior * w1 + value * w2; -inf where that is no number."""
    return F.nanvl(F.coalesce(base * base_scale + prior * prior_weight + value * value_weight, F.lit(float("nan"))), F.lit(-INF))


def skip_probability(max_q: Column, best: Column, rate: float) -> Column:
    """max_q / (best + 1e-9), kept between 0 and the rate."""
    return F.least(F.lit(rate), F.greatest(F.lit(0.0), max_q / (best + 1e-9)))


def discounted(rewards: Column, gamma: float) -> Column:
    """Sum of gamma^i * r_i of an ordered array; 0 for an empty one."""
    return F.aggregate(F.reverse(rewards), F.lit(0.0), lambda a, r: a * gamma + r)


def running_average(values: Column) -> Column:
    """Fold of prev / (n + 1) * n + v / (n + 1) over an ordered array."""
    zero = F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("n"))
    return F.aggregate(values, zero, lambda a, v: F.struct((a["m"] / (a["n"] + 1) * a["n"] + v / (a["n"] + 1)).alias("m"), (a["n"] + 1).alias("n")), lambda a: a["m"])


def linear_schedule(progress_left: Column, start: float, end: float, end_fraction: float) -> Column:
    """From start to end while the done share (1 - progress_left) grows to end_fraction, then end."""
    done = 1 - progress_left
    return F.when(done > end_fraction, F.lit(end)).otherwise(F.lit(start) + done * (end - start) / end_fraction)
