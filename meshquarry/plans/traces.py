"""Queries over action traces; every event is a trace record of its user's episode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshquarry.functions import search as X
from meshquarry.operators import traces as T
from meshquarry.session import maybe_broadcast, table

S_ = SparkSession


def _trace(spark: S_, d: str) -> DataFrame:
    """event_id, ts, user_id, category, k (action), reward, coord, scale."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", "ts", "user_id", F.col("event_type").alias("category"), k.alias("k"), F.round(F.col("value") - 10, 2).alias("reward"), F.pmod(k, F.lit(7)).alias("coord"), F.when(F.pmod(k, F.lit(7)) == 6, 0).otherwise(F.floor(k / 7) % 4).cast("int").alias("scale"))


def action_prior(spark: S_, d: str) -> DataFrame:
    """Smoothed log prior over coord and scale from rewarded actions."""
    t = _trace(spark, d)
    grid = T.key_grid(t, F.greatest(F.max("scale") + 1, F.lit(2)))
    p = T.smoothed_prior(t, grid, F.col("reward"), 0.5, 0.5, 1.0)
    return p.select("coord", "scale", F.round("weight", 4).alias("weight"), "n", F.round("log_prior", 6).alias("log_prior"))


def filtered_rewards(spark: S_, d: str) -> DataFrame:
    """Actions of some categories with a large reward, remapped to a win, loss or draw."""
    t = _trace(spark, d).filter(F.col("category").isin("click", "purchase", "view") & (F.abs("reward") >= 0.25))
    win = F.when(F.col("reward") >= 5, 1).when(F.col("reward") <= -5, -1).otherwise(0)
    return t.groupBy("category", win.alias("outcome")).agg(F.count("*").alias("n"), F.round(F.sum("reward"), 2).alias("reward"))


def advantages(spark: S_, d: str) -> DataFrame:
    """Per category: standardised and clipped advantages against the group mean of user and category."""
    t = _trace(spark, d).select("user_id", "category", "reward")
    overall = float(t.agg(F.avg("reward").alias("m")).first().m or 0.0)
    a = T.group_advantage(t, ["user_id", "category"], "reward", overall)
    m = a.groupBy("category").agg(F.avg("advantage").alias("m"), F.stddev_pop("advantage").alias("s"))
    z = T.standardised(F.col("advantage"), F.col("m"), F.col("s"), 3.0)
    return a.join(maybe_broadcast(m), "category").groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("advantage"), 6).alias("mean_advantage"), F.round(F.avg(z), 6).alias("mean_z"), F.round(F.max(z), 6).alias("max_z"), F.count_if(F.abs(z) >= 3).alias("clipped"))


def value_weights(spark: S_, d: str) -> DataFrame:
    """Class and category balanced weights of the traces."""
    t = _trace(spark, d).withColumn("sign", F.signum("reward").cast("int"))
    return T.balanced_weights(t, "sign", "category").groupBy("category", "sign").agg(F.count("*").alias("n"), F.round(F.max("w"), 6).alias("w"))


def episode_returns(spark: S_, d: str) -> DataFrame:
    """Discounted return and running average per user."""
    r = T.discounted_returns(_trace(spark, d), ["user_id"], ["ts", "event_id"], "reward", 0.9)
    return r.select("user_id", "steps", F.round("ret", 6).alias("ret"), F.round("mean", 8).alias("mean"))


def n_step_returns(spark: S_, d: str) -> DataFrame:
    """Three-step returns within users; an error event ends an episode."""
    t = _trace(spark, d).withColumn("done", F.col("category") == "error")
    r = T.n_step_returns(t.select("event_id", "ts", "user_id", "reward", "done"), ["user_id"], ["ts", "event_id"], "reward", "done", 3, 0.5)
    return r.select("event_id", F.round("ret", 6).alias("ret"), "stop_after")


def replay_buffer(spark: S_, d: str) -> DataFrame:
    """The last 256 records and their slots in a ring."""
    t = _trace(spark, d).select("event_id", "user_id", "reward")
    return T.ring_buffer(t, [F.col("event_id")], 256).withColumn("slot", F.col("event_id") % 256)


def priority_sample(spark: S_, d: str) -> DataFrame:
    """500 draws in proportion to the absolute reward, with importance weights."""
    s = T.priority_draws(_trace(spark, d), "event_id", F.abs("reward"), 500, 0.4, bucket=F.pmod("event_id", F.lit(1024)))
    return s.select("draw", "event_id", F.round("probability", 9).alias("probability"), F.round("weight", 6).alias("weight"))


def validation_split(spark: S_, d: str) -> DataFrame:
    """A fifth of the users, the last by id, held out."""
    return T.validation_meshes(_trace(spark, d), "user_id", 0.2)


def balanced_chunks(spark: S_, d: str) -> DataFrame:
    """Models in chunks of 25 per category, in turn."""
    m = T.interleave(table(spark, d, "mesh_model").select("mesh_id", "category"), "category", "mesh_id", 25)
    return m.groupBy("category", "chunk", "turn").agg(F.count("*").alias("n"), F.min("mesh_id").alias("first_mesh"))


def contrast_pairs(spark: S_, d: str) -> DataFrame:
    """Each user's rewarded actions against its unrewarded ones, widest first, 1000 at most."""
    return T.reward_pairs(_trace(spark, d), "user_id", "event_id", "reward", 1000).select("user_id", "hi", "lo", F.round("gap", 2).alias("gap"))


def reward_baselines(spark: S_, d: str) -> DataFrame:
    """Summed squared distance of rewards from their baseline in each of the four modes."""
    t, out = _trace(spark, d), None
    for mode in ("mesh", "category", "global", "none"):
        b = T.with_baseline(t, "reward", mode, "user_id", "category")
        b = b.groupBy(F.lit(mode).alias("mode"), "category").agg(F.count("*").alias("n"), F.round(F.sum((F.col("reward") - F.col("baseline")) ** 2), 4).alias("spread"))
        out = b if out is None else out.union(b)
    return out


def action_softmax(spark: S_, d: str) -> DataFrame:
    """Bandit statistics per user and action group: visits, mean, UCB in both forms, softmax and PUCT bonus."""
    t = _trace(spark, d).filter(F.col("coord").isNotNull())
    g = t.groupBy("user_id", "coord").agg(F.count("*").alias("n"), F.avg("reward").alias("q"))
    w = W.partitionBy("user_id")  # seven rows
    g = g.withColumn("parent", F.sum("n").over(w))
    prior = X.softmax(F.col("q"), w, 10.0)
    return g.select("user_id", "coord", "n", F.round("q", 6).alias("q"), F.round(X.ucb(F.col("q"), F.col("n"), F.col("parent"), 0.5), 6).alias("ucb"), F.round(X.ucb_prior(F.col("q"), F.col("n"), F.col("parent"), prior, 0.5), 6).alias("ucb_prior"), F.round(prior, 6).alias("prior"), F.round(X.puct_bonus(F.col("q") / 10, F.col("n"), F.col("parent"), 1.5, w), 6).alias("bonus"), F.round(X.skip_probability(F.col("q"), F.max("q").over(w), 0.7), 6).alias("skip"))


def stall_lengths(spark: S_, d: str) -> DataFrame:
    """The longest run of records per user without a new best reward."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    t = _trace(spark, d).withColumn("best", F.max("reward").over(w))
    t = t.withColumn("new", (F.lag("best").over(w).isNull() | (F.col("best") > F.lag("best").over(w))).cast("int"))
    t = t.withColumn("island", F.sum("new").over(w))
    r = t.groupBy("user_id", "island").agg((F.count("*") - 1).alias("stall"), F.max("best").alias("best"))
    return r.groupBy("user_id").agg(F.max("stall").alias("longest_stall"), F.max("best").alias("best"), F.count("*").alias("improvements"))


QUERIES = {f.__name__: f for f in (action_prior, filtered_rewards, advantages, value_weights, episode_returns, n_step_returns, replay_buffer, priority_sample, validation_split, balanced_chunks, contrast_pairs, reward_baselines, action_softmax, stall_lengths)}

_T = "t AS (SELECT *, CASE WHEN k % 7 = 6 THEN 0 ELSE k // 7 % 4 END AS scale, k % 7 AS coord FROM (SELECT event_id, ts, user_id, event_type AS category, CAST(json_extract(props, '$.k') AS INT) AS k, round(value - 10, 2) AS reward FROM events))"
_N = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {0} FOLLOWING AND {0} FOLLOWING)"

ORACLE = {
    "action_prior": f"""WITH {_T}, s AS (SELECT greatest(max(scale) + 1, 2) AS s FROM t), g AS (SELECT c AS coord, k AS scale FROM range(6) AS r(c), s, range(s.s) AS q(k) UNION ALL SELECT 6, 0),
w AS (SELECT coord, scale, sum(sqrt(greatest(reward, 0))) AS weight, count(*) AS n FROM t WHERE reward >= 0.5 GROUP BY 1, 2), j AS (SELECT coord, scale, coalesce(weight, 0) AS weight, coalesce(n, 0) AS n FROM g LEFT JOIN w USING (coord, scale))
SELECT coord, scale, round(weight, 4) AS weight, n, round(ln((weight + 1) / (sum(weight) OVER () + count(*) OVER ())), 6) AS log_prior FROM j""",
    "filtered_rewards": f"WITH {_T} SELECT category, CASE WHEN reward >= 5 THEN 1 WHEN reward <= -5 THEN -1 ELSE 0 END AS outcome, count(*) AS n, round(sum(reward), 2) AS reward FROM t WHERE category IN ('click', 'purchase', 'view') AND abs(reward) >= 0.25 GROUP BY 1, 2",
    "advantages": f"""WITH {_T}, a AS (SELECT category, reward - CASE WHEN count(*) OVER w > 1 THEN avg(reward) OVER w ELSE avg(reward) OVER () END AS adv FROM t WINDOW w AS (PARTITION BY user_id, category)),
z AS (SELECT category, adv, greatest(-3, least(3, (adv - avg(adv) OVER c) / greatest(stddev_pop(adv) OVER c, 1e-12))) AS z FROM a WINDOW c AS (PARTITION BY category))
SELECT category, count(*) AS n, round(avg(adv), 6) + 0.0 AS mean_advantage, round(avg(z), 6) AS mean_z, round(max(z), 6) AS max_z, count(*) FILTER (WHERE abs(z) >= 3) AS clipped FROM z GROUP BY 1""",
    "value_weights": f"""WITH {_T}, n AS (SELECT category, CAST(sign(reward) AS INT) AS sign, count(*) AS n FROM t GROUP BY 1, 2), r AS (SELECT *, (sum(n) OVER () / sum(n) OVER (PARTITION BY sign)) * (sum(n) OVER () / sum(n) OVER (PARTITION BY category)) AS raw FROM n)
SELECT category, sign, n, round(raw / (sum(raw * n) OVER () / sum(n) OVER ()), 6) AS w FROM r""",
    "episode_returns": f"WITH {_T}, i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM t) SELECT user_id, count(*) AS steps, round(sum(pow(0.9, i) * reward), 6) AS ret, round(avg(reward), 8) AS mean FROM i GROUP BY 1",
    "n_step_returns": f"""WITH {_T}, e AS (SELECT event_id, reward AS r0, category = 'error' AS d0, coalesce(first(reward) OVER {_N.format(1)}, 0) AS r1, first(category) OVER {_N.format(1)} AS c1, coalesce(first(reward) OVER {_N.format(2)}, 0) AS r2, first(category) OVER {_N.format(2)} AS c2 FROM t)
SELECT event_id, round(CASE WHEN d0 THEN r0 WHEN c1 = 'error' THEN r0 + r1 / 2 ELSE r0 + r1 / 2 + r2 / 4 END, 6) AS ret, CASE WHEN d0 OR c1 IS NULL THEN 0 WHEN c1 = 'error' OR c2 IS NULL THEN 1 ELSE 2 END AS stop_after FROM e""",
    "replay_buffer": f"WITH {_T} SELECT event_id, user_id, reward, event_id % 256 AS slot FROM t ORDER BY event_id DESC LIMIT 256",
    "validation_split": "WITH u AS (SELECT DISTINCT user_id FROM events), n AS (SELECT count(*) AS n FROM u) SELECT user_id, row_number() OVER (ORDER BY user_id DESC) <= least(n - 1, greatest(1, round_even(n * 0.2, 0))) AS is_validation FROM u, n",
    "balanced_chunks": "WITH p AS (SELECT *, (row_number() OVER (PARTITION BY category ORDER BY mesh_id) - 1) // 25 AS chunk FROM mesh_model), c AS (SELECT category, chunk, count(*) AS n, min(mesh_id) AS first_mesh FROM p GROUP BY 1, 2) SELECT category, chunk, row_number() OVER (ORDER BY chunk, category) AS turn, n, first_mesh FROM c",
    "contrast_pairs": f"WITH {_T} SELECT b.user_id, b.event_id AS hi, t.event_id AS lo, round(b.reward - t.reward, 2) AS gap FROM t b JOIN t USING (user_id) WHERE b.reward > 0 AND t.reward <= 0 ORDER BY b.reward - t.reward DESC, hi, lo LIMIT 1000",
    "priority_sample": f"""WITH {_T}, p AS (SELECT event_id, abs(reward) AS p FROM t WHERE abs(reward) > 0), c AS (SELECT *, sum(p) OVER (ORDER BY event_id % 1024, event_id) AS hi, sum(p) OVER () AS al, count(*) OVER () AS n, min(p) OVER () AS least FROM p),
h AS (SELECT *, ceil((hi - p) / al * 500 - 0.5::DOUBLE) AS first, ceil(hi / al * 500 - 0.5::DOUBLE) - 1 AS last FROM c)
SELECT unnest(range(first::BIGINT, last::BIGINT + 1)) AS draw, event_id, round(p / al, 9) AS probability, round(pow(p / al * n, -0.4::DOUBLE) / pow(least / al * n, -0.4::DOUBLE), 6) AS weight FROM h WHERE last >= first""",
    "reward_baselines": f"""WITH {_T}, b AS (SELECT *, avg(reward) OVER (PARTITION BY user_id) AS m, avg(reward) OVER (PARTITION BY category) AS c, avg(reward) OVER () AS g FROM t)
SELECT unnest(['mesh', 'category', 'global', 'none']) AS mode, category, n, round(unnest([sm, sc, sg, s0]), 4) AS spread FROM (SELECT category, count(*) AS n, sum((reward - m) ** 2) AS sm, sum((reward - c) ** 2) AS sc, sum((reward - g) ** 2) AS sg, sum(reward ** 2) AS s0 FROM b GROUP BY 1)""",
    "action_softmax": f"""WITH {_T}, g AS (SELECT user_id, coord, count(*) AS n, avg(reward) AS q FROM t WHERE coord IS NOT NULL GROUP BY 1, 2), p AS (SELECT *, sum(n) OVER w AS parent, exp((q - max(q) OVER w) / 10) AS e, max(q) OVER w AS best FROM g WINDOW w AS (PARTITION BY user_id)),
s AS (SELECT *, e / sum(e) OVER (PARTITION BY user_id) AS prior FROM p)
SELECT user_id, coord, n, round(q, 6) AS q, round(q + 0.5 * sqrt(2 * ln(parent) / n), 6) AS ucb, round(q + 0.5 * sqrt(ln(parent + 2) / (n + 1)) + prior / (n + 1), 6) AS ucb_prior, round(prior, 6) AS prior, round(1.5 * prior * sqrt(parent) / (1 + n), 6) AS bonus, round(least(0.7, greatest(0, q / (best + 1e-9))), 6) AS skip FROM s""",
    "stall_lengths": f"""WITH {_T}, b AS (SELECT *, max(reward) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS best FROM t), n AS (SELECT *, CASE WHEN lag(best) OVER w IS NULL OR best > lag(best) OVER w THEN 1 ELSE 0 END AS new FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM n), r AS (SELECT user_id, island, count(*) - 1 AS stall, max(best) AS best FROM i GROUP BY 1, 2)
SELECT user_id, max(stall) AS longest_stall, max(best) AS best, count(*) AS improvements FROM r GROUP BY 1""",
}
