"""Model scores and their quality, as aggregations."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshquarry.operators.ranking import running_sum
from meshquarry.session import maybe_broadcast


def scaler(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and sample deviation (1 where below 1e-12) of each column; nulls and NaN count as 0."""
    aggs = []
    for c in columns:
        x = F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
        s = F.stddev_samp(x)
        aggs += [F.avg(x).alias(f"{c}_mean"), F.when(F.coalesce(s, F.lit(0.0)) < 1e-12, 1.0).otherwise(s).alias(f"{c}_std")]
    return df.groupBy(*by).agg(*aggs)


def sigmoid(x: Column) -> Column:
    """1 / (1 + e^-x) with x kept within 60 of 0."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), x))))


def linear(columns: Sequence[Column], weights: Sequence[float], bias: float) -> Column:
    out = F.lit(float(bias))
    for c, w in zip(columns, weights):
        out = out + c * float(w)
    return out


def gelu(x: Column) -> Column:
    """x times the normal distribution function at x; null stays null. Spark has no erf, so this goes through Arrow batches."""

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(0.5 * v * (1 + np.array([math.erf(y / math.sqrt(2)) for y in v.to_numpy(float, na_value=math.nan)])))

    return F.when(x.isNotNull(), run(x))


def mlp(columns: Sequence[Column], hidden: Sequence[Sequence[float]], hidden_bias: Sequence[float], out: Sequence[float], bias: float, activation: str = "tanh") -> Column:
    """One hidden layer (tanh, or GELU by erf itself)."""
    act = {"tanh": F.tanh, "gelu": gelu}[activation]
    return linear([act(linear(columns, w, b)) for w, b in zip(hidden, hidden_bias)], out, bias)


def layer_norm(values: Column, eps: float = 1e-5) -> Column:
    """An array with its mean taken off and divided by its deviation."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    return F.transform(values, lambda x: (x - mean) / F.sqrt(var + eps))


def confusion(df: DataFrame, label: Column, score: Column, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by, threshold, tp, fp, tn, fn, accuracy, precision, recall, f1 at every threshold, in one pass."""
    d = df.select(*by, label.cast("int").alias("_y"), score.alias("_p")).filter(F.col("_y").isNotNull() & F.col("_p").isNotNull())
    cells = [F.sum(((F.col("_p") >= t) & (F.col("_y") == 1)).cast("long")).alias(f"_tp{i}") for i, t in enumerate(thresholds)]
    cells += [F.sum(((F.col("_p") >= t) & (F.col("_y") == 0)).cast("long")).alias(f"_fp{i}") for i, t in enumerate(thresholds)]
    g = d.groupBy(*by).agg(F.sum((F.col("_y") == 1).cast("long")).alias("_pos"), F.sum((F.col("_y") == 0).cast("long")).alias("_neg"), *cells)
    rows = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_tp{i}").alias("tp"), F.col(f"_fp{i}").alias("fp")) for i, t in enumerate(thresholds)))
    r = g.select(*by, "_pos", "_neg", F.explode(rows).alias("r")).select(*by, "r.*", (F.col("_neg") - F.col("r.fp")).alias("tn"), (F.col("_pos") - F.col("r.tp")).alias("fn"))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    p, c = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    r = r.withColumn("accuracy", share(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))).withColumn("precision", p).withColumn("recall", c)
    return r.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def best_f1(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The threshold of the best F1; ties by accuracy, then the first."""
    keep = [c for c in conf.columns if c not in by]
    return conf.groupBy(*by).agg(F.max_by(F.struct(*keep), F.struct(F.round("f1", 12), F.round("accuracy", 12), -F.col("threshold"))).alias("r")).select(*by, "r.*")


def roc_auc(df: DataFrame, label: Column, score: Column, by: Sequence[str] = ()) -> DataFrame:
    """by, auc, positives, negatives: the share of (positive, negative) pairs in order, ties half; null with one class only.

    Counts per score come first, so the running sums go over the distinct scores.
    """
    d = df.select(*by, label.cast("int").alias("_y"), score.alias("_p")).filter(F.col("_y").isNotNull() & F.col("_p").isNotNull())
    c = d.groupBy(*by, "_p").agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg"))
    c = running_sum(c, list(by), ["_p"], "neg", "below").withColumn("below", F.col("below") - F.col("neg"))
    g = c.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    return g.select(*by, F.try_divide(F.col("u").cast("double"), F.col("positives") * F.col("negatives")).alias("auc"), "positives", "negatives")


def group_out_means(df: DataFrame, fold: str, label: Column) -> DataFrame:
    """fold, held_out, n_train, train_rate: the label's rate over all other folds (total less own)."""
    g = df.filter(F.col(fold).isNotNull() & label.isNotNull()).groupBy(fold).agg(F.count("*").alias("held_out"), F.sum(label.cast("double")).alias("s"))
    one = W.partitionBy(F.lit(0))  # one row per fold
    return g.select(fold, "held_out", (F.sum("held_out").over(one) - F.col("held_out")).alias("n_train"), F.try_divide(F.sum("s").over(one) - F.col("s"), F.sum("held_out").over(one) - F.col("held_out")).alias("train_rate"))


def fold_thresholds(df: DataFrame, fold: str, label: Column, score: Column) -> DataFrame:
    """fold, held_out, threshold, mean_label, accuracy: a cut fitted on all other folds, tried on the fold left out.

    The cut is the middle between the mean scores of the two classes in training (all sums less the fold's own, so no fold is
    fitted by itself); where training has one class only, the threshold is null and its mean label is predicted. Rows
    without fold, label or finite score are left out.
    """
    x = F.nanvl(score.cast("double"), F.lit(None).cast("double"))
    d = df.select(F.col(fold).alias("_f"), label.cast("int").alias("_y"), x.alias("_x")).filter(F.col("_f").isNotNull() & F.col("_y").isNotNull() & F.col("_x").isNotNull())
    sums = lambda v: [F.sum(F.when(F.col("_y") == v, 1).otherwise(0)).alias(f"n{v}"), F.sum(F.when(F.col("_y") == v, F.col("_x")).otherwise(0.0)).alias(f"s{v}")]
    g = d.groupBy("_f").agg(*sums(0), *sums(1))
    one = W.partitionBy(F.lit(0))  # one row per fold
    rest = {c: F.sum(c).over(one) - F.col(c) for c in ("n0", "s0", "n1", "s1")}
    t = g.select("_f", (F.try_divide(rest["s0"], rest["n0"]) / 2 + F.try_divide(rest["s1"], rest["n1"]) / 2).alias("threshold"), F.try_divide(rest["n1"], rest["n0"] + rest["n1"]).alias("mean_label"))
    j = d.join(maybe_broadcast(t), "_f")
    guess = F.when(F.col("threshold").isNotNull(), (F.col("_x") >= F.col("threshold")).cast("int")).otherwise((F.col("mean_label") >= 0.5).cast("int"))
    return j.groupBy(F.col("_f").alias(fold)).agg(F.count("*").alias("held_out"), F.max("threshold").alias("threshold"), F.max("mean_label").alias("mean_label"), F.avg((guess == F.col("_y")).cast("double")).alias("accuracy"))


def weighted_errors(df: DataFrame, predicted: Column, target: Column, weight: Column, by: Sequence[str] = ()) -> DataFrame:
    """Weighted mean squared and absolute error and share of right signs."""
    e = predicted - target
    return df.groupBy(*by).agg((F.sum(weight * e * e) / F.sum(weight)).alias("mse"), (F.sum(weight * F.abs(e)) / F.sum(weight)).alias("mae"), (F.sum(F.when(F.signum(predicted) == F.signum(target), weight).otherwise(0.0)) / F.sum(weight)).alias("sign_accuracy"))


def with_stats(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.join(maybe_broadcast(stats), list(by))
