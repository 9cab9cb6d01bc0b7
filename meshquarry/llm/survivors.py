"""Best representative of each duplicate group, chosen field by field.

Fields are unpivoted to long rows; each row votes for its normalised value with the
trust in its record times a recency decay. The votes of equal values are summed (a
grouped aggregation that combines before it shuffles), then the winner of each field is
taken by ``max_by`` while pivoting back to one record per group. No
group is ever gathered: a hot group is spread over its (field, value) keys, and its winners
combine within partitions.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshquarry.functions.text import epoch_seconds, is_success, name_key

#: Bounds of the decay's exponent; a record without a time decays to the lower one.
_LIMIT = 100.0
#: A trust beside which no decay of another record counts.
DECISIVE = 2.0**256


@dataclass(frozen=True)
class Field:
    """A field that takes part in the vote.

    ``value`` is what survives, ``norm`` what counts as the same value (default: the value itself),
    ``half_life_days`` the time in which a vote halves, ``trust`` the weight of a record in this field (default: that of
    the vote).
    """

    name: str
    value: Column
    norm: Column | None = None
    half_life_days: float = 180.0
    trust: Column | None = None


def vote(df: DataFrame, keys: list[str], fields: list[Field], trust: Column, seen_at: Column, tie: Column) -> DataFrame:
    """One row per group with the winning value of every field (as strings).

    ``trust`` is the non-negative weight of a record's source, ``seen_at`` epoch seconds (null: unknown,
    decays fully), ``tie`` an integer that breaks ties. Null values don't vote; a field in which
    nobody votes is null. Ties go to the latest, then to the largest ``tie``. Repeated rows each vote.
    """
    # 2^(t / half-life): only ratios within a group matter, so no reference time has to be found first
    halvings = lambda h: F.greatest(F.lit(1 - _LIMIT), F.least(F.lit(_LIMIT), (F.col("_at") - 1.6e9) / (86400.0 * h)))
    decay = lambda h: F.pow(F.lit(2.0), F.when(F.col("_at").isNotNull(), halvings(h)).otherwise(-_LIMIT))
    own = [f"_key{i}" for i in range(len(keys))]
    # where nothing is normalised the value is carried once, as the key
    each = [F.struct(F.lit(i).alias("_f"), (f.norm if f.norm is not None else f.value).cast("string").alias("_k"), (F.when(f.norm.isNotNull(), f.value) if f.norm is not None else F.lit(None)).cast("string").alias("_v"), f.value.isNotNull().alias("_is"), (F.col("_trust") if f.trust is None else f.trust.cast("double")).alias("_t"), F.lit(float(f.half_life_days)).alias("_h")) for i, f in enumerate(fields)]
    base = df.withColumn("_trust", trust.cast("double"))
    base = base.select(*(F.col(k).alias(o) for k, o in zip(keys, own)), seen_at.cast("double").alias("_at"), tie.cast("long").alias("_tie"), F.explode(F.array(*each)).alias("_e"))
    long = base.filter("_e._is").select(*own, "_at", "_tie", "_e._f", F.coalesce("_e._k", "_e._v").alias("_k"), "_e._v", (F.col("_e._t") * decay(F.col("_e._h"))).alias("_w"))
    order = F.struct(F.coalesce(F.col("_at"), F.lit(float("-inf"))).alias("_at"), F.col("_tie"))
    votes = long.groupBy(*own, "_f", "_k").agg(F.sum("_w").alias("_w"), F.max(F.struct(order.alias("o"), F.col("_v").alias("v"))).alias("_best"))
    pick = lambda i, c: F.when(F.col("_f") == i, c)
    # sums differ in their last digits with the order of the rows; equal ones must tie
    rank = F.struct(F.round(F.coalesce(F.log2("_w"), F.lit(float("-inf"))), 9).alias("w"), "_best.o")
    wide = votes.groupBy(*own).agg(*(F.max_by(pick(i, F.coalesce("_best.v", "_k")), pick(i, rank)).alias(f"_o{i}") for i in range(len(fields))))
    return wide.select(*(F.col(o).alias(k) for o, k in zip(own, keys)), *(F.col(f"_o{i}").alias(f.name) for i, f in enumerate(fields)))


#: Trust in a stage record by its status, which is all that the table says of its source.
SUCCESS_TRUST, OTHER_TRUST = 2.0, 1.0


def stage_survivors(records: DataFrame, only: Collection[str] | None = None) -> DataFrame:
    """One record per (stage, mesh) of ``records``, however written, with the best value of each field.

    ``survivor`` is the record_id of the record that stands for the group, ``status`` and ``finished_at`` are its own; the
    other fields are voted on one by one. A success is trusted decisively where the run itself is chosen, and twice as
    much elsewhere. Records without stage or mesh form groups of
    their own kind (null keys compare equal). Columns beyond those of stage records play no part. A success votes for
    no error, so that its group doesn't keep the error of a failed run. ``only`` names the fields wanted; the others are
    neither read nor shuffled.
    """
    r = records.select(
        F.coalesce(name_key(F.col("stage")), F.lit("")).alias("stage_key"), F.coalesce(name_key(F.col("mesh_id")), F.lit("")).alias("mesh_key"),
        "record_id", "stage", "mesh_id", "category", "status", "started_at", "finished_at", "output_path", "log_path", "command", "error", "metadata",
    )
    ok = is_success(F.col("status"))
    at = epoch_seconds(F.col("finished_at"))
    trust = F.when(ok, SUCCESS_TRUST).otherwise(OTHER_TRUST)
    first = F.when(ok, DECISIVE).otherwise(OTHER_TRUST)
    said = F.when(ok, F.lit("success")).otherwise(F.lower(F.trim("status")))
    run = F.col("record_id") if only == {"survivor"} else F.to_json(F.struct(F.col("record_id").alias("id"), said.alias("status"), at.alias("at")))
    fields = [
        Field("survivor", run, F.col("record_id"), trust=first),
        Field("category", F.col("category"), name_key(F.col("category"))),
        Field("output_path", F.col("output_path")),
        Field("log_path", F.col("log_path")),
        Field("metadata", F.col("metadata")),
        Field("stage", F.col("stage")),
        Field("mesh_id", F.col("mesh_id")),
        Field("started_at", epoch_seconds(F.col("started_at"))),
        Field("error", F.when(ok, F.coalesce("error", F.lit(""))).otherwise(F.col("error")), trust=first),
        Field("command", F.to_json("command")),
    ]
    out = vote(r, ["stage_key", "mesh_key"], [f for f in fields if only is None or f.name in only], trust, at, F.col("record_id"))
    if only == {"survivor"}:
        return out.withColumn("survivor", F.col("survivor").cast("long"))
    of_run = F.from_json("survivor", "id long, status string, at double")
    back = {"started_at": F.col("started_at").cast("double"), "error": F.nullif("error", F.lit("")), "command": F.from_json("command", "array<string>")}
    out = out.withColumn("_run", of_run).withColumns({k: v for k, v in back.items() if k in out.columns})
    rest = [c for c in out.columns if c not in ("stage_key", "mesh_key", "survivor", "_run")]
    return out.select("stage_key", "mesh_key", F.col("_run.id").alias("survivor"), F.col("_run.status").alias("status"), F.col("_run.at").alias("finished_at"), *rest)


def superseded(records: DataFrame) -> DataFrame:
    """record_id of each record that is not the survivor of its group."""
    kept = stage_survivors(records, {"survivor"}).select(F.col("survivor").alias("record_id"))
    return records.select("record_id").join(kept, "record_id", "left_anti")
