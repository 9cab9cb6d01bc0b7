"""Further queries: volumes, edit roles, escape sets, assignment, readiness, retries, a trained prior."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshquarry.functions import boxes as B
from meshquarry.functions.text import is_success, name_key
from meshquarry.operators import manifest as M
from meshquarry.operators import selection as S
from meshquarry.operators import spatial as P
from meshquarry.operators import training as T
from meshquarry.operators import volumes as V
from meshquarry.plans import frames as D
from meshquarry.plans import geometry as G
from meshquarry.session import spill, table

S_ = SparkSession


def box_overlap_metrics(spark: S_, d: str) -> DataFrame:
    """BVS, Covered, TOV, vIoU and MOV of the boxes of open items against those of closed items."""
    o = P.fit_boxes(D.points(spark, d).filter(F.col("status") == "O"), ["mesh", "part"])
    m = V.overlap_metrics(D.part_boxes(spark, d), o, "mesh")
    return m.select("mesh", *(F.round(c, 6).alias(c) for c in ("bvs", "covered", "tov", "viou", "mov")))


def tet_clip_metrics(spark: S_, d: str) -> DataFrame:
    """Each OBJ file's surface, closed to a fan of tetrahedra at its mean vertex, against two boxes."""
    v, t = G.obj_mesh(spark, d)
    v = spill(v, "vertices")
    t = P.gather_corners(t, v, "obj_file")
    c = v.groupBy("obj_file").agg(*(F.avg(a).alias(f"d{a}") for a in B.AXES), *(F.min(a).alias(f"min_{a}") for a in B.AXES), *(F.max(a).alias(f"max_{a}") for a in B.AXES))
    mid = {a: (F.col(f"min_{a}") + F.col(f"max_{a}")) / 2 for a in B.AXES}
    low = c.select("obj_file", *(F.col(n) for n in B.LOWS), mid["x"].alias("max_x"), F.col("max_y"), F.col("max_z"))
    core = c.select("obj_file", *(((F.col(f"min_{a}") + mid[a]) / 2).alias(f"min_{a}") for a in B.AXES), *(((F.col(f"max_{a}") + mid[a]) / 2).alias(f"max_{a}") for a in B.AXES))
    m = V.tet_box_metrics(t.join(c.select("obj_file", "dx", "dy", "dz"), "obj_file"), low.select("obj_file", *B.BOUNDS).union(core.select("obj_file", *B.BOUNDS)), "obj_file")
    return m.select("obj_file", *(F.round(c, 6).alias(c) for c in ("volume", "bvs", "covered", "tov", "viou")))


def label_sets(spark: S_, d: str) -> DataFrame:
    """How much weight lies in which combination of a mesh's segment boxes."""
    b = D.part_boxes(spark, d).groupBy("mesh").agg(F.array_sort(F.collect_list(F.struct("part", *B.BOUNDS))).alias("bs"))
    p = D.points(spark, d).join(b, "mesh", "left")
    xyz = [F.col(a) for a in B.AXES]
    label = F.array_join(F.transform(F.filter("bs", lambda s: B.contains([s[c] for c in B.BOUNDS], xyz)), lambda s: s["part"]), "")
    return p.groupBy(F.coalesce(label, F.lit("")).alias("label")).agg(F.count("*").alias("n"), F.countDistinct("mesh").alias("meshes"), F.sum("weight").alias("weight"))


def prefix_bounds(spark: S_, d: str) -> DataFrame:
    """Bounds volume of the boxes before each box and of all boxes but it."""
    b = D.indexed_boxes(spark, d)
    w = W.partitionBy("mesh").orderBy("bbox_idx")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    pre = [F.min(c).over(before) for c in B.LOWS] + [F.max(c).over(before) for c in B.HIGHS]
    v = B.volume(B.box())
    return b.select("mesh", "bbox_idx", F.round(F.coalesce(B.volume(pre), F.lit(0.0)), 6).alias("before"), F.round(F.sum(v).over(W.partitionBy("mesh")) - v, 6).alias("others"))


def edit_roles(spark: S_, d: str) -> DataFrame:
    """Edits of every box by role, and how many move the major or the minor axis."""
    b = D.indexed_boxes(spark, d)
    major, minor = B.axis_rank(B.box())
    g = P.edit_grid(b.select("mesh", "bbox_idx", *B.BOUNDS), 2, 0.5)
    axis = F.when(F.col("coord_idx") < 6, F.col("coord_idx") % 3)
    size = B.named_bucket(B.volume(B.box()), [1000.0, 10000.0], ["small", "middle", "large"])
    return g.groupBy(size.alias("size"), B.role(F.col("coord_idx"), F.col("delta")).alias("role")).agg(F.count("*").alias("n"), F.count_if(axis == major).alias("major"), F.count_if(axis == minor).alias("minor"), F.count_if(B.is_valid([F.col(f"e_{c}") for c in B.BOUNDS])).alias("valid"))


def escape_sets(spark: S_, d: str) -> DataFrame:
    """Four diverse edits of each mesh by upper bound."""
    b = D.indexed_boxes(spark, d).withColumn("v", B.volume(B.box())).withColumn("all", F.sum("v").over(W.partitionBy("mesh"))).filter(F.col("all") > 0)
    g = P.edit_grid(b.select("mesh", "bbox_idx", *B.BOUNDS, "v", "all"), 2, 0.5).filter(F.col("coord_idx") < 6)
    e = [F.col(f"e_{c}") for c in B.BOUNDS]
    g = g.withColumn("upper", F.round(B.upper_reward(F.col("all") - F.col("v") + B.volume(e), F.col("all") * 0.9, F.lit(0.0)), 6))
    return S.diverse_escape(g, ["mesh"], "upper", "action", "bbox_idx", "coord_idx", 4).select("mesh", F.array_join(F.transform("picks", lambda x: x.cast("string")), ",").alias("picks"))


def box_assignment(spark: S_, d: str) -> DataFrame:
    """Boxes of closed items matched to those of open items by the mean distance of their bounds, greedily (the fallback of J20)."""
    a = D.indexed_boxes(spark, d).select("mesh", F.col("bbox_idx").alias("l"), *(F.col(c).alias(f"a_{c}") for c in B.BOUNDS))
    o = P.fit_boxes(D.points(spark, d).filter(F.col("status") == "O"), ["mesh", "part"])
    o = o.select("mesh", F.when(F.col("part") == "A", 0).when(F.col("part") == "N", 1).otherwise(2).alias("r"), *(F.col(c).alias(f"b_{c}") for c in B.BOUNDS))
    cost = F.round(B.total([F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in B.BOUNDS]) / 6, 6)
    return S.greedy_assignment(a.join(o, "mesh").select("mesh", "l", "r", cost.alias("cost")), "mesh", "l", "r", "cost")


def readiness(spark: S_, d: str) -> DataFrame:
    """All meshes by the stages of a required set in which they have no success, however worded."""
    need = ["normalize", "tetra", "merge", "refine"]
    r = table(spark, d, "stage_record").select(name_key(F.col("mesh_id")).alias("mesh"), name_key(F.col("stage")).alias("stage"), is_success(F.col("status")).alias("ok"))
    have = r.groupBy("mesh").agg(F.collect_set(F.when(F.col("ok") & F.col("stage").isin(need), F.col("stage"))).alias("have"))
    lack = F.array_join(F.array_except(F.array(*(F.lit(n) for n in need)), "have"), ",")
    return have.groupBy(lack.alias("lacking")).agg(F.count("*").alias("meshes"), F.bool_and(lack == "").alias("ready"))


#: What is tried again after which failure, and how often (fixed values).
RETRIES = {"timeout": ("longer", 2), "killed": ("smaller", 1), "memory": ("smaller", 2), "exit_code": ("same", 1), "unknown": ("same", 1), "no_message": ("same", 1)}


def retry_plan(spark: S_, d: str) -> DataFrame:
    """Attempts still to make per stage: failed keys by failure class, less the attempts made."""
    r = table(spark, d, "stage_record").select(name_key(F.col("stage")).alias("stage"), name_key(F.col("mesh_id")).alias("mesh"), M.failure_class(F.col("error"), F.col("status")).alias("fc"), "record_id")
    g = r.groupBy("stage", "mesh").agg(F.count("fc").alias("failed"), F.max_by("fc", "record_id").alias("last"))
    how = F.create_map(*(F.lit(x) for k, (h, _) in RETRIES.items() for x in (k, h)))
    most = F.create_map(*(F.lit(x) for k, (_, n) in RETRIES.items() for x in (k, n)))
    left = F.greatest(F.lit(0), F.coalesce(most[F.col("last")], F.lit(0)) + 1 - F.col("failed").cast("int"))
    return g.filter(F.col("last").isNotNull()).groupBy("stage", F.coalesce(how[F.col("last")], F.lit("none")).alias("variant")).agg(F.count("*").alias("keys"), F.sum(left).alias("attempts"))


def untried_actions(spark: S_, d: str) -> DataFrame:
    """Actions each user hasn't tried, nor their opposites, of the 13 of a one-box state."""
    e = table(spark, d, "events").select("user_id", F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(13)).cast("long").alias("a")).distinct()
    pair = F.when(F.col("a").isNotNull(), F.array(F.col("a"), B.opposite(F.col("a"), 2).cast("bigint")))
    masked = e.groupBy("user_id").agg(F.array_distinct(F.flatten(F.collect_list(pair))).alias("m"))
    left = F.array_sort(F.array_except(F.sequence(F.lit(0), F.lit(12)).cast("array<bigint>"), "m"))
    return masked.select("user_id", F.size("m").alias("masked"), F.array_join(left.cast("array<string>"), ",").alias("untried"))


def trained_prior(spark: S_, d: str) -> DataFrame:
    """A softmax prior of the action group on two features, ten epochs, one aggregation each."""
    e = table(spark, d, "events")
    x = e.select((F.hour("ts") / 24.0).alias("hour"), F.log1p(F.greatest("value", F.lit(0.0))).alias("size"), F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(3)).alias("y"), (1 + F.coalesce("value", F.lit(0.0)) / 100).alias("w"))
    w, b, loss = T.fit_softmax(x, ["hour", "size"], "y", 3, "w", 10, 0.5, 1e-3)
    p = T.softmax_columns(T._logits(["hour", "size"], w, b))
    best = F.array_max(F.array(*(F.struct(c.alias("p"), F.lit(k).alias("k")) for k, c in enumerate(p))))
    return x.select("y", best.alias("b")).groupBy("y", F.col("b.k").alias("predicted")).agg(F.count("*").alias("n"), F.round(F.avg("b.p"), 5).alias("mean_p"), F.lit(round(loss[-1], 6) if loss else None).alias("last_loss"))


QUERIES = {f.__name__: f for f in (box_overlap_metrics, tet_clip_metrics, label_sets, prefix_bounds, edit_roles, escape_sets, box_assignment, readiness, retry_plan, untried_actions, trained_prior)}

_K = "regexp_replace(regexp_replace(regexp_replace(trim(lower({0}), e' \\t\\r\\n'), '^.*[/\\\\]', ''), '\\.(obj|off|ply|stl|msh|json|jsonl|csv|tsv|txt|parquet|log)$', ''), '[^\\pL\\pN]+', '', 'g')"
_FC = "CASE WHEN lower(trim(status)) IN ('failed', 'error', 'timeout') THEN CASE WHEN lower(coalesce(error, '')) = '' THEN 'no_message' " + " ".join("WHEN " + " OR ".join(f"contains(lower(coalesce(error, '')), '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in M.FAILURE_RULES) + " ELSE 'unknown' END END"

_OPEN = f"o AS (SELECT mesh, part, CASE part WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS bbox_idx, {D.FIT} FROM p WHERE status = 'O' GROUP BY 1, 2)"


def _meets(name: str, of: str) -> str:
    """CTE of the intersections of one, two and three of a set's boxes, with the sign of inclusion and exclusion."""
    many = lambda *n: "SELECT a.mesh, " + ", ".join(f"greatest({', '.join(f'{x}.min_{a}' for x in n)}) AS min_{a}, least({', '.join(f'{x}.max_{a}' for x in n)}) AS max_{a}" for a in "xyz")
    valid = f"{name}v AS (SELECT * FROM {of} WHERE min_x < max_x AND min_y < max_y AND min_z < max_z)"
    return f"""{valid}, {name} AS ({many("a")}, 1 AS sign FROM {name}v a UNION ALL {many("a", "b")}, -1 FROM {name}v a JOIN {name}v b ON a.mesh = b.mesh AND a.bbox_idx < b.bbox_idx
UNION ALL {many("a", "b", "c")}, 1 FROM {name}v a JOIN {name}v b ON a.mesh = b.mesh AND a.bbox_idx < b.bbox_idx JOIN {name}v c ON a.mesh = c.mesh AND b.bbox_idx < c.bbox_idx)"""


def _volume(*n: str) -> str:
    return " * ".join(f"greatest(0, least({', '.join(f'{x}.max_{a}' for x in n)}, 1e300) - greatest({', '.join(f'{x}.min_{a}' for x in n)}, -1e300))" for a in "xyz")


ORACLE = {
    "box_overlap_metrics": f"""WITH {D.BOXES}, {_OPEN}, {_meets("s", "b")}, {_meets("q", "o")},
vs AS (SELECT mesh, sum(sign * {_volume("s")}) AS s FROM s GROUP BY 1), vq AS (SELECT mesh, sum(sign * {_volume("q")}) AS b FROM q GROUP BY 1),
sh AS (SELECT s.mesh, sum(s.sign * q.sign * {_volume("s", "q")}) AS shared FROM s JOIN q USING (mesh) GROUP BY 1),
i AS (SELECT x.mesh, x.bbox_idx, {_volume("x")} AS v, sum(s.sign * {_volume("s", "x")}) AS i FROM qv x JOIN s USING (mesh) GROUP BY ALL),
m AS (SELECT mesh, max(CASE WHEN i > 1e-10 THEN (v - i) / i ELSE 0 END) AS mov, sum(v) AS total FROM i GROUP BY 1)
SELECT mesh, round(total / s, 6) AS bvs, round(shared / s, 6) AS covered, round((b - shared) / s, 6) + 0.0 AS tov, round(shared / (s + b - shared), 6) AS viou, round(mov, 6) + 0.0 AS mov FROM vs JOIN vq USING (mesh) JOIN sh USING (mesh) JOIN m USING (mesh) WHERE s > 1e-10""",
    "box_assignment": f"""WITH {D.BOXES}, {_OPEN}, k AS (SELECT mesh, b.bbox_idx AS l, o.bbox_idx AS r, round(({" + ".join(f"abs(b.{c} - o.{c})" for c in B.BOUNDS)}) / 6, 6) AS cost FROM b JOIN o USING (mesh)),
a1 AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY mesh ORDER BY cost, l, r) = 1),
a2 AS (SELECT k.* FROM k JOIN a1 USING (mesh) WHERE k.l <> a1.l AND k.r <> a1.r QUALIFY row_number() OVER (PARTITION BY mesh ORDER BY k.cost, k.l, k.r) = 1),
a3 AS (SELECT k.* FROM k JOIN a1 USING (mesh) JOIN a2 USING (mesh) WHERE k.l NOT IN (a1.l, a2.l) AND k.r NOT IN (a1.r, a2.r) QUALIFY row_number() OVER (PARTITION BY mesh ORDER BY k.cost, k.l, k.r) = 1)
SELECT mesh, l, r, cost FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3""",
    "escape_sets": G._EDITS.replace("UNIT", "0.5").replace("WITH ", "WITH RECURSIVE ", 1)
    + """, u AS (SELECT mesh, action, bbox_idx AS b, coord_idx AS c, row_number() OVER (PARTITION BY mesh ORDER BY round(-abs((al - v + greatest(b0 - a0, 0) * greatest(b1 - a1, 0) * greatest(b2 - a2, 0)) / (al * 0.9) - 1), 6) DESC, action) AS k, count(*) OVER (PARTITION BY mesh) AS n FROM e WHERE al > 0 AND coord_idx < 6),
r AS (SELECT DISTINCT mesh, 0::BIGINT AS k, n, []::BIGINT[] AS p, []::BIGINT[] AS bs, []::BIGINT[] AS cs FROM u
UNION ALL SELECT r.mesh, u.k, u.n, CASE WHEN skip THEN p ELSE list_append(p, action) END, CASE WHEN skip THEN bs ELSE list_append(bs, b) END, CASE WHEN skip THEN cs ELSE list_append(cs, c) END
FROM r JOIN (SELECT * FROM u) u ON r.mesh = u.mesh AND u.k = r.k + 1, LATERAL (SELECT len(p) >= 4 OR (len(p) < 3 AND list_contains(bs, b) AND list_contains(cs, c)) AS skip)),
f AS (SELECT mesh, p FROM r WHERE k = n), x AS (SELECT mesh, p, list(action ORDER BY u.k) FILTER (WHERE NOT list_contains(p, action)) AS rest FROM f JOIN u USING (mesh) GROUP BY 1, 2)
SELECT mesh, array_to_string(list_concat(p, coalesce(rest, []))[:4], ',') AS picks FROM x""",
    "label_sets": f"""WITH {D.BOXES}, l AS (SELECT p.i, p.mesh, p.weight, coalesce(string_agg(b.part, '' ORDER BY b.part), '') AS label FROM (SELECT row_number() OVER () AS i, * FROM p) p LEFT JOIN b ON p.mesh = b.mesh AND p.x BETWEEN b.min_x AND b.max_x AND p.y BETWEEN b.min_y AND b.max_y AND p.z BETWEEN b.min_z AND b.max_z GROUP BY 1, 2, 3)
SELECT label, count(*) AS n, count(DISTINCT mesh) AS meshes, sum(weight) AS weight FROM l GROUP BY 1""",
    "prefix_bounds": f"""WITH {D.BOXES}, w AS (SELECT mesh, bbox_idx, {" * ".join(f"(max(max_{a}) OVER q - min(min_{a}) OVER q)" for a in "xyz")} AS pre, sum({D.VOLUME}) OVER (PARTITION BY mesh) - {D.VOLUME} AS rest FROM b WINDOW q AS (PARTITION BY mesh ORDER BY bbox_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT mesh, bbox_idx, round(coalesce(pre, 0), 6) AS before, round(rest, 6) AS others FROM w""",
    "edit_roles": G._EDITS.replace("UNIT", "0.5")
    + """, x AS (SELECT *, CASE WHEN v < 1000 THEN 'small' WHEN v < 10000 THEN 'middle' ELSE 'large' END AS size, CASE WHEN coord_idx = 6 THEN 'recenter' WHEN (coord_idx < 3) = (delta < 0) THEN 'expand' ELSE 'shrink' END AS role, max_x - min_x AS s0, max_y - min_y AS s1, max_z - min_z AS s2 FROM e),
r AS (SELECT *, CASE WHEN s0 >= greatest(s0, s1, s2) - 1e-9 THEN 0 WHEN s1 >= greatest(s0, s1, s2) - 1e-9 THEN 1 ELSE 2 END AS major, CASE WHEN s0 <= least(s0, s1, s2) + 1e-9 THEN 0 WHEN s1 <= least(s0, s1, s2) + 1e-9 THEN 1 ELSE 2 END AS minor FROM x)
SELECT size, role, count(*) AS n, count(*) FILTER (WHERE coord_idx < 6 AND coord_idx % 3 = major) AS major, count(*) FILTER (WHERE coord_idx < 6 AND coord_idx % 3 = minor) AS minor, count(*) FILTER (WHERE a0 < b0 AND a1 < b1 AND a2 < b2) AS valid FROM r GROUP BY 1, 2""",
    "readiness": f"""WITH h AS (SELECT {_K.format('mesh_id')} AS mesh, list(DISTINCT {_K.format('stage')}) FILTER (WHERE regexp_replace(lower(status), '[^\\pL\\pN]+', '', 'g') IN ('success','succeeded','successful','succeed','ok','okay','done','passed','pass','complete','completed','finished')) AS have FROM stage_record GROUP BY 1), l AS (SELECT array_to_string(list_filter(['normalize', 'tetra', 'merge', 'refine'], lambda n: NOT list_contains(coalesce(have, []), n)), ',') AS lacking FROM h)
SELECT lacking, count(*) AS meshes, lacking = '' AS ready FROM l GROUP BY 1""",
    "retry_plan": f"""WITH r AS (SELECT {_K.format('stage')} AS stage, {_K.format('mesh_id')} AS mesh, {_FC} AS fc, record_id FROM stage_record), g AS (SELECT stage, mesh, count(fc) AS failed, arg_max(fc, record_id) AS last, arg_max(coalesce(fc, '-'), record_id) AS newest FROM r GROUP BY 1, 2),
m AS (SELECT *, CASE newest WHEN 'timeout' THEN 'longer' WHEN 'killed' THEN 'smaller' WHEN 'memory' THEN 'smaller' WHEN 'exit_code' THEN 'same' WHEN 'unknown' THEN 'same' WHEN 'no_message' THEN 'same' ELSE 'none' END AS variant, CASE newest WHEN 'timeout' THEN 2 WHEN 'memory' THEN 2 WHEN 'killed' THEN 1 WHEN 'exit_code' THEN 1 WHEN 'unknown' THEN 1 WHEN 'no_message' THEN 1 ELSE 0 END AS most FROM g WHERE newest <> '-')
SELECT stage, variant, count(*) AS keys, sum(greatest(0, most + 1 - failed)) AS attempts FROM m GROUP BY 1, 2""",
    "untried_actions": """WITH k AS (SELECT user_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events), e AS (SELECT DISTINCT user_id, k % 13 AS a FROM k), m AS (SELECT user_id, a FROM e UNION SELECT user_id, CASE WHEN a = 12 THEN 12 WHEN a % 2 = 0 THEN a + 1 ELSE a - 1 END FROM e)
SELECT user_id, count(*) AS masked, array_to_string(list_filter(range(13), lambda x: NOT list_contains(list(a), x)), ',') AS untried FROM m GROUP BY 1""",
}
