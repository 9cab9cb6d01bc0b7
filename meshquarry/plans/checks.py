"""Further queries: bounds that prune, soft coverage, targets and losses, failure details, normalised vertices, open actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquarry.functions import boxes as B
from meshquarry.functions.text import category_key, is_success, name_key
from meshquarry.operators import manifest as M
from meshquarry.operators import scoring as C
from meshquarry.operators import selection as S
from meshquarry.operators.bad_rows import valid_vertices
from meshquarry.plans import frames as D
from meshquarry.plans.geometry import _OBJ
from meshquarry.plans.manifests import CAT, K
from meshquarry.session import salted_join, spill, table

S_ = SparkSession


def bounded_states(spark: S_, d: str) -> DataFrame:
    """Exact best state of each source: three by their upper bound, then every other whose bound beats the best of these."""
    g = table(spark, d, "gate_score").filter(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < 1e300) & F.col("source").isNotNull())
    g = g.groupBy("source", "state_id").agg(F.max("score").alias("score"))
    return S.bounded_best(g, ["source"], F.floor("score") + 1, F.col("score"), "state_id", 3)


def soft_coverage(spark: S_, d: str) -> DataFrame:
    """Weight of each mesh's points by their smooth membership in its best box."""
    b = D.indexed_boxes(spark, d).groupBy("mesh").agg(F.collect_list(F.struct(*B.BOUNDS)).alias("bs"))
    j = salted_join(D.points(spark, d), b, "mesh", F.xxhash64(*B.AXES), how="inner")
    soft = F.array_max(F.transform("bs", lambda x: B.soft_inside([x[c] for c in B.BOUNDS], [F.col(a) for a in B.AXES], 0.5)))
    return j.groupBy("mesh").agg(F.round(F.sum(F.col("weight") * soft) / F.sum("weight"), 6).alias("soft"))


def target_errors(spark: S_, d: str) -> DataFrame:
    """Huber loss of events' values against a bootstrapped target, by type."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    err = B.td_target(F.col("value"), F.col("k") % 5 == 0, F.col("k"), 0.9) - F.col("value")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(B.huber(err, 10.0)), 6).alias("huber"))


def record_paths(spark: S_, d: str) -> DataFrame:
    """Evaluation records by the first of their paths that is there, and how many of their meshes have a stage record."""
    e = table(spark, d, "evaluation_record").select(name_key(F.col("mesh_id")).alias("mesh"), F.coalesce("bbox_path", "surface_path", "mesh_path").alias("path"))
    have = table(spark, d, "stage_record").select(name_key(F.col("mesh_id")).alias("mesh")).distinct().withColumn("known", F.lit(True))
    kind = F.split_part(F.coalesce("path", F.lit("none")), F.lit("/"), F.lit(1))
    j = salted_join(e, have, "mesh", F.xxhash64("path"))
    return j.groupBy(kind.alias("root")).agg(F.count("*").alias("n"), F.count("known").alias("known"), F.countDistinct("path").alias("paths"))


def failure_details(spark: S_, d: str) -> DataFrame:
    """What the messages of failed records hold: class of the return code, pieces, elements short of the least."""
    r = table(spark, d, "stage_record").filter(F.col("error").isNotNull())
    number = lambda p, g=1: F.nullif(F.regexp_extract("error", p, g), F.lit("")).cast("long")
    short = number(r"below minimum: \d+ < (\d+)") - number(r"below minimum: (\d+)")
    return r.groupBy(name_key(F.col("stage")).alias("stage"), M.return_code_class(number(r"rc=(-?\d+)")).alias("code")).agg(F.count("*").alias("n"), F.sum(number(r"components: (\d+)")).alias("pieces"), F.sum(short).alias("short"), F.count_if(F.col("error").contains("watertight")).alias("open_surface"))


def readiness_blockers(spark: S_, d: str) -> DataFrame:
    """Required stages without a success, by the class of the mesh's last failure there."""
    need = ["normalize", "tetra", "merge", "refine"]
    r = table(spark, d, "stage_record").select(name_key(F.col("mesh_id")).alias("mesh"), name_key(F.col("stage")).alias("stage"), "record_id", is_success(F.col("status")).alias("ok"), M.failure_class(F.col("error"), F.col("status")).alias("fc"))
    g = r.filter(F.col("stage").isin(need)).groupBy("mesh", "stage").agg(F.bool_or("ok").alias("ok"), F.max_by("fc", F.when(F.col("fc").isNotNull(), F.col("record_id"))).alias("blocker"))
    return g.filter(~F.col("ok")).groupBy("stage", F.coalesce("blocker", F.lit("never failed")).alias("blocker")).agg(F.count("*").alias("meshes"))


def normalised_vertices(spark: S_, d: str) -> DataFrame:
    """Valid vertices moved to their file's centre and scaled to an extent of 1: spread per file."""
    v = spill(valid_vertices(table(spark, d, "obj_line")).select("obj_file", *B.AXES), "vertices")
    s = v.groupBy("obj_file").agg(*((F.min(a) + F.max(a)).alias(f"m{a}") for a in B.AXES), F.greatest(*(F.max(a) - F.min(a) for a in B.AXES)).alias("extent"), *((F.max(a) > F.min(a)).cast("int").alias(f"d{a}") for a in B.AXES))
    j = salted_join(v, s, "obj_file", F.xxhash64(*B.AXES), how="inner").filter(F.col("extent") > 0)
    n = [(F.col(a) - F.col(f"m{a}") / 2) / F.col("extent") for a in B.AXES]
    return j.groupBy("obj_file").agg(F.count("*").alias("n"), F.max(F.col("dx") + F.col("dy") + F.col("dz")).alias("varying"), F.round(F.sum(B.total([x * x for x in n])), 6).alias("spread"))


def best_untried(spark: S_, d: str) -> DataFrame:
    """Per user the action of the best overall mean reward that the user hasn't tried, the lowest at ties."""
    e = table(spark, d, "events").select("user_id", (F.get_json_object("props", "$.k").cast("int") % 40).alias("action"), "value").filter(F.col("action").isNotNull())
    means = e.groupBy("action").agg(F.round(F.avg("value"), 6).alias("mean"))
    order = means.agg(F.array_sort(F.collect_list(F.struct((-F.col("mean")).alias("m"), "action"))).alias("o")).first().o  # at most forty actions
    ranked = F.array(*(F.lit(r.action) for r in order)) if order else F.array().cast("array<int>")
    tried = e.groupBy("user_id").agg(F.collect_set("action").alias("t"))
    left = F.filter(ranked, lambda a: ~F.array_contains("t", a))
    return tried.select("user_id", F.size("t").alias("tried"), F.get(left, F.lit(0)).alias("action"))


def learned_ranks(spark: S_, d: str) -> DataFrame:
    """The two best states per source by learned score, states without one at the source's mean."""
    g = table(spark, d, "gate_score").filter(F.col("source").isNotNull() & (F.col("score").isNull() | F.isnan("score") | (F.abs("score") < 1e300))).groupBy("source", "state_id").agg(F.max(F.nanvl("score", F.lit(None).cast("double"))).alias("score"))
    o = S.learned_order(g, ["source"], "score", 1 / (F.col("state_id") % 7 + 1), F.col("state_id") % 100)
    return M.top_per_group(o, ["source"], [F.desc("value"), F.asc("state_id")], 2).select("source", "state_id", "rank", F.round("value", 9).alias("value"))


def fold_accuracy(spark: S_, d: str) -> DataFrame:
    """Accuracy on each profile of a cut of the vIoU change fitted on the other profiles."""
    r = C.fold_thresholds(table(spark, d, "gate_row"), "profile", F.col("label_not_worse"), F.col("delta_avg_viou"))
    return r.select("profile", "held_out", *(F.round(c, 9).alias(c) for c in ("threshold", "mean_label", "accuracy")))


def target_boxes(spark: S_, d: str) -> DataFrame:
    """Per mesh the box with the longest side, the thinnest one, the most slack for its weight, and the first; ties within 1e-9 go to the lowest index."""
    b = D.indexed_boxes(spark, d)
    e = B.extents(B.box())
    r9 = lambda c: F.round(c, 9)
    at = lambda c: -F.max(F.struct(r9(c).alias("v"), (-F.col("bbox_idx")).alias("k")))["k"]
    return b.groupBy("mesh").agg(at(F.greatest(*e)).alias("longest"), at(-F.least(*e)).alias("thinnest"), at(B.volume(B.box()) / F.col("weight")).alias("slack"), F.min("bbox_idx").alias("first"))


def metadata_distincts(spark: S_, d: str) -> DataFrame:
    """Sorted categories and the number of different meshes of the records of each stage."""
    r = table(spark, d, "stage_record").select(name_key(F.col("stage")).alias("stage"), category_key(F.col("category")).alias("category"), name_key(F.col("mesh_id")).alias("mesh"))
    return r.groupBy("stage").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), F.countDistinct("mesh").alias("meshes"))


QUERIES = {f.__name__: f for f in (bounded_states, soft_coverage, target_errors, record_paths, failure_details, readiness_blockers, normalised_vertices, best_untried, learned_ranks, fold_accuracy, target_boxes, metadata_distincts)}

_SIG = " * ".join(f"(1 / (1 + exp(-0.5::DOUBLE * (x.{a} - b.min_{a})))) * (1 / (1 + exp(-0.5::DOUBLE * (b.max_{a} - x.{a}))))" for a in "xyz")
_FC = "CASE WHEN lower(trim(status)) IN ('failed', 'error', 'timeout') THEN CASE WHEN lower(coalesce(error, '')) = '' THEN 'no_message' " + " ".join("WHEN " + " OR ".join(f"contains(lower(coalesce(error, '')), '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in M.FAILURE_RULES) + " ELSE 'unknown' END END"
_OK = "coalesce(regexp_replace(lower(status), '[^\\pL\\pN]+', '', 'g') IN ('success','succeeded','successful','succeed','ok','okay','done','passed','pass','complete','completed','finished'), false)"
_NUM = lambda p: f"TRY_CAST(nullif(regexp_extract(error, '{p}', 1), '') AS BIGINT)"
ORACLE = {
    "bounded_states": """WITH g AS (SELECT source, state_id, max(score) AS score, floor(max(score)) + 1 AS bound FROM gate_score WHERE score IS NOT NULL AND NOT isnan(score) AND abs(score) < 1e300 AND source IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY bound DESC, state_id) AS k FROM g), t AS (SELECT source, max(score) AS found FROM r WHERE k <= 3 GROUP BY 1),
c AS (SELECT r.*, k <= 3 OR bound > found AS done FROM r JOIN t USING (source))
SELECT source, arg_max(state_id, (score, -state_id)) AS state_id, max(score) AS exact, count(*) FILTER (WHERE done) AS checked, count(*) FILTER (WHERE NOT done) AS skipped FROM c GROUP BY 1""",
    "soft_coverage": f"""WITH {D.BOXES}, n AS (SELECT row_number() OVER () AS id, * FROM p), m AS (SELECT x.id, x.mesh, x.weight, max({_SIG}) AS soft FROM n x JOIN b ON x.mesh = b.mesh GROUP BY 1, 2, 3)
SELECT mesh, round(sum(weight * soft) / sum(weight), 6) AS soft FROM m GROUP BY 1""",
    "target_errors": """WITH e AS (SELECT event_type, CASE WHEN CAST(json_extract(props, '$.k') AS INT) % 5 = 0 THEN 0 ELSE 0.9::DOUBLE * CAST(json_extract(props, '$.k') AS DOUBLE) END AS e FROM events)
SELECT event_type, count(*) AS n, round(avg(CASE WHEN abs(e) <= 10 THEN 0.5 * e * e ELSE 10 * (abs(e) - 5) END), 6) AS huber FROM e GROUP BY 1""",
    "record_paths": f"""WITH e AS (SELECT {K("mesh_id")} AS mesh, coalesce(bbox_path, surface_path, mesh_path) AS path FROM evaluation_record), s AS (SELECT DISTINCT {K("mesh_id")} AS mesh FROM stage_record)
SELECT split_part(coalesce(path, 'none'), '/', 1) AS root, count(*) AS n, count(s.mesh) AS known, count(DISTINCT path) AS paths FROM e LEFT JOIN s USING (mesh) GROUP BY 1""",
    "failure_details": f"""WITH r AS (SELECT {K("stage")} AS stage, error, {_NUM("rc=(-?[0-9]+)")} AS rc, {_NUM("components: ([0-9]+)")} AS pieces, {_NUM("below minimum: [0-9]+ < ([0-9]+)")} - {_NUM("below minimum: ([0-9]+)")} AS short FROM stage_record WHERE error IS NOT NULL)
SELECT stage, CASE WHEN rc = 0 THEN 'success' WHEN rc < 0 OR rc > 128 THEN 'signal' WHEN rc = 124 THEN 'timeout' WHEN rc IS NOT NULL THEN 'error' END AS code, count(*) AS n, sum(pieces) AS pieces, sum(short) AS short, count(*) FILTER (WHERE contains(error, 'watertight')) AS open_surface FROM r GROUP BY 1, 2""",
    "readiness_blockers": f"""WITH r AS (SELECT {K("mesh_id")} AS mesh, {K("stage")} AS stage, record_id, {_OK} AS ok, {_FC} AS fc FROM stage_record), g AS (SELECT mesh, stage, bool_or(ok) AS ok, arg_max(fc, record_id) FILTER (WHERE fc IS NOT NULL) AS blocker FROM r WHERE stage IN ('normalize', 'tetra', 'merge', 'refine') GROUP BY 1, 2)
SELECT stage, coalesce(blocker, 'never failed') AS blocker, count(*) AS meshes FROM g WHERE NOT ok GROUP BY 1, 2""",
    "normalised_vertices": _OBJ
    + """, s AS (SELECT obj_file, min(x) + max(x) AS mx, min(y) + max(y) AS my, min(z) + max(z) AS mz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS extent, (max(x) > min(x))::INT + (max(y) > min(y))::INT + (max(z) > min(z))::INT AS varying FROM v GROUP BY 1)
SELECT obj_file, count(*) AS n, max(varying) AS varying, round(sum(((x - mx / 2) / extent) ** 2 + ((y - my / 2) / extent) ** 2 + ((z - mz / 2) / extent) ** 2), 6) AS spread FROM v JOIN s USING (obj_file) WHERE extent > 0 GROUP BY 1""",
    "learned_ranks": """WITH g AS (SELECT source, state_id, max(CASE WHEN isnan(score) THEN NULL ELSE score END) AS score FROM gate_score WHERE source IS NOT NULL AND (score IS NULL OR isnan(score) OR abs(score) < 1e300) GROUP BY 1, 2),
v AS (SELECT source, state_id, coalesce(score, avg(score) OVER (PARTITION BY source), 0) + 1e-9 * (1 / (state_id % 7 + 1)) + 1e-12 / (state_id % 100 + 1) AS value FROM g)
SELECT source, state_id, row_number() OVER (PARTITION BY source ORDER BY value DESC, state_id) AS rank, round(value, 9) AS value FROM v QUALIFY rank <= 2""",
    "fold_accuracy": """WITH d AS (SELECT profile, label_not_worse AS y, delta_avg_viou AS x FROM gate_row WHERE profile IS NOT NULL AND label_not_worse IS NOT NULL AND delta_avg_viou IS NOT NULL AND NOT isnan(delta_avg_viou)),
t AS (SELECT f.profile, avg(x) FILTER (WHERE y = 0) / 2 + avg(x) FILTER (WHERE y = 1) / 2 AS threshold, avg(y) AS mean_label FROM (SELECT DISTINCT profile FROM d) f JOIN d ON d.profile <> f.profile GROUP BY 1)
SELECT profile, count(*) AS held_out, round(max(threshold), 9) AS threshold, round(max(mean_label), 9) AS mean_label, round(avg((CASE WHEN threshold IS NULL THEN mean_label >= 0.5 ELSE x >= threshold END = (y = 1))::INT), 9) AS accuracy FROM d JOIN t USING (profile) GROUP BY 1""",
    "target_boxes": f"""WITH {D.BOXES}, e AS (SELECT mesh, bbox_idx, greatest(max_x - min_x, max_y - min_y, max_z - min_z) AS l, least(max_x - min_x, max_y - min_y, max_z - min_z) AS s, {D.VOLUME} / weight AS k FROM b)
SELECT mesh, -max((round(l, 9), -bbox_idx))[2] AS longest, -max((round(-s, 9), -bbox_idx))[2] AS thinnest, -max((round(k, 9), -bbox_idx))[2] AS slack, min(bbox_idx) AS first FROM e GROUP BY 1""",
    "metadata_distincts": f"""WITH r AS (SELECT {K("stage")} AS stage, {CAT("category")} AS category, {K("mesh_id")} AS mesh FROM stage_record) SELECT stage, coalesce(string_agg(DISTINCT category, ',' ORDER BY category), '') AS categories, count(DISTINCT mesh) AS meshes FROM r GROUP BY 1""",
    "best_untried": """WITH e AS (SELECT user_id, CAST(json_extract(props, '$.k') AS INT) % 40 AS action, value FROM events), m AS (SELECT action, round(avg(value), 6) AS mean FROM e GROUP BY 1), t AS (SELECT DISTINCT user_id, action FROM e), n AS (SELECT user_id, count(*) AS tried FROM t GROUP BY 1),
u AS (SELECT n.user_id, m.action, mean FROM n, m WHERE NOT EXISTS (FROM t WHERE t.user_id = n.user_id AND t.action = m.action) QUALIFY row_number() OVER (PARTITION BY n.user_id ORDER BY mean DESC, m.action) = 1)
SELECT n.user_id, tried, u.action FROM n LEFT JOIN u USING (user_id)""",
}
