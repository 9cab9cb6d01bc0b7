"""Linear softmax prior by full-batch gradient descent: an epoch is one aggregation over the data."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshquarry.functions.boxes import total
from meshquarry.session import spill


def _logits(x: Sequence[str], w: list[list[float]], b: list[float]) -> list[Column]:
    return [total([F.lit(bk), *(F.col(c) * wk for c, wk in zip(x, row))]) for row, bk in zip(w, b)]


def softmax_columns(z: Sequence[Column]) -> list[Column]:
    top = F.greatest(*z)
    e = [F.exp(c - top) for c in z]
    return [c / total(e) for c in e]


def fit_softmax(df: DataFrame, features: Sequence[str], label: str, classes: int, weight: str, epochs: int, rate: float, l2: float) -> tuple[list[list[float]], list[float], list[float]]:
    """Weights, biases and loss per epoch of a softmax model of ``label`` (0 ... classes - 1) on ``features``.

    Weighted mean cross-entropy, L2 on the weights only, zero start, no randomness: the result depends on the data
    alone, up to the order of sums. Only the gradient (classes x features numbers) leaves the cluster. Rows with nulls are
    left out; without rows the model is zero.
    """
    d = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)), F.col(label).cast("int").alias("y"), F.col(weight).cast("double").alias("w")).dropna()
    d = spill(d.filter((F.col("y") >= 0) & (F.col("y") < classes) & (F.col("w") > 0)), "train")
    x = [f"x{i}" for i in range(len(features))]
    w, b, losses = [[0.0] * len(x) for _ in range(classes)], [0.0] * classes, []
    for _ in range(epochs):
        p = softmax_columns(_logits(x, w, b))
        q = d.select(*x, "y", "w", *(c.alias(f"p{k}") for k, c in enumerate(p)))
        gap = [F.col("w") * (F.col(f"p{k}") - (F.col("y") == k).cast("double")) for k in range(classes)]
        chosen = F.array(*(F.col(f"p{k}") for k in range(classes)))[F.col("y")]
        g = q.agg(F.sum("w").alias("w"), F.sum(-F.col("w") * F.log(chosen)).alias("loss"), *(F.sum(gap[k]).alias(f"b{k}") for k in range(classes)), *(F.sum(gap[k] * F.col(c)).alias(f"g{k}_{i}") for k in range(classes) for i, c in enumerate(x))).first()
        if not g.w:
            break
        losses.append(g.loss / g.w + 0.5 * l2 * math.fsum(v * v for row in w for v in row))
        b = [bk - rate * g[f"b{k}"] / g.w for k, bk in enumerate(b)]
        w = [[v - rate * (g[f"g{k}_{i}"] / g.w + l2 * v) for i, v in enumerate(row)] for k, row in enumerate(w)]
    return w, b, losses
