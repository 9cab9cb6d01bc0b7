"""Queries of the iterative procedures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquarry.functions import boxes as B
from meshquarry.operators import loops as L
from meshquarry.operators import refine as R
from meshquarry.operators import spatial as S
from meshquarry.plans import frames as D
from meshquarry.plans.geometry import _CUT, _VOL
from meshquarry.session import table

S_ = SparkSession


def tet_components(spark: S_, d: str) -> DataFrame:
    """Connected pieces of each mesh's face-sharing tetrahedra."""
    c = L.components(S.face_ties(D.tets(spark, d), "mesh"), "mesh").filter(F.col("v") >= 0)
    return c.groupBy("mesh", "component").agg(F.min("v").alias("first"), F.count("*").alias("tets")).select("mesh", F.col("first").alias("component"), "tets")


def box_suppression(spark: S_, d: str) -> DataFrame:
    """Boxes kept when those overlapping a heavier one by more than 0.4 fall."""
    k = L.suppress(D.indexed_boxes(spark, d), "mesh", "bbox_idx", F.col("weight"), 0.4)
    return k.select("mesh", "bbox_idx", "weight")


def farthest_items(spark: S_, d: str) -> DataFrame:
    """Four items of each part far from each other."""
    l = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("mesh"), F.col("l_orderkey").alias("pid")).agg(F.max("l_quantity").alias("x"), (F.max("l_extendedprice") / 1000).alias("y"), (F.max("l_discount") * 100).alias("z"))
    return L.farthest_points(l, "mesh", "pid", 4)


def _segments(spark: S_, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    pid = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 2).otherwise(4) + F.when(F.col("l_linestatus") == "F", 0).otherwise(1)
    return l.select(F.col("l_partkey").alias("mesh"), pid.cast("long").alias("pid"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"), F.col("l_quantity").alias("weight"), "l_linenumber")


def segment_merge(spark: S_, d: str) -> DataFrame:
    """Greedy merging of each part's segments, neighbours if they share a line number."""
    p = _segments(spark, d)
    boxes = S.fit_boxes(p, ["mesh", "pid"])
    o = p.select("mesh", "l_linenumber", "pid").distinct()
    adj = o.select("mesh", "l_linenumber", F.col("pid").alias("l")).join(o.select("mesh", "l_linenumber", F.col("pid").alias("r")), ["mesh", "l_linenumber"]).filter(F.col("l") < F.col("r")).select("mesh", "l", "r").distinct()
    shape = S.fit_boxes(p, ["mesh"]).select("mesh", B.volume(B.box()).alias("shape")).filter(F.col("shape") > 0)
    return L.greedy_merge(boxes, adj, "mesh", "pid", shape, eps=0.05)


def _refined(spark: S_, d: str, **how: object) -> DataFrame:
    b = D.indexed_boxes(spark, d)
    shape = b.groupBy("mesh").agg((F.sum(B.volume(B.box())) * 0.9).alias("shape")).filter(F.col("shape") > 0)
    return R.greedy_refine(D.points(spark, d), b.join(shape, "mesh"), "mesh", F.col("shape"), 2, 1.0, **how)


def box_refinement(spark: S_, d: str) -> DataFrame:
    """The best edit per mesh, again and again until none gains."""
    return _refined(spark, d).select("mesh", "bbox_idx", *(F.round(c, 6).alias(c) for c in B.BOUNDS), F.round("score", 5).alias("score"), "steps")


def box_rollout(spark: S_, d: str) -> DataFrame:
    """The same for sixteen edits with a mask: a box whose best edit loses leaves the search."""
    r = _refined(spark, d, steps=16, masked=True)
    return r.select("mesh", "bbox_idx", *(F.round(c, 6).alias(c) for c in B.BOUNDS), F.round("score", 5).alias("score"), "steps", "open")


def recentred_boxes(spark: S_, d: str) -> DataFrame:
    """Each box turned and moved to the principal frame of the points in it."""
    b = D.indexed_boxes(spark, d).withColumn("rotation", F.array(*(F.lit(float(i % 4 == 0)) for i in range(9))))
    p = D.points(spark, d).select("mesh", *B.AXES, *(F.col(a).alias(f"in_{a}") for a in B.AXES))
    r = R.recentred(p, b, "mesh")
    return r.select("mesh", "bbox_idx", *(F.round(c, 5).alias(c) for c in B.BOUNDS), "moved")


def coverage_calibration(spark: S_, d: str) -> DataFrame:
    """The factor by which each mesh's boxes must grow to cover 95 % of its weight."""
    return L.coverage_scale(D.points(spark, d), D.part_boxes(spark, d), "mesh", 0.95).select("mesh", F.round("scale", 6).alias("scale"))


def principal_frames(spark: S_, d: str) -> DataFrame:
    """Principal axes of each part's points."""
    f = L.principal_frames(D.points(spark, d), ["mesh"])
    return f.select("mesh", "n", *(F.round(F.col("variances")[i], 5).alias(f"var_{i}") for i in range(3)), *(F.round(F.col("frame")[i], 5).alias(f"axis_{i}") for i in range(3)))


QUERIES = {f.__name__: f for f in (tet_components, box_suppression, farthest_items, segment_merge, box_refinement, box_rollout, recentred_boxes, coverage_calibration, principal_frames)}

_NEED = "greatest(abs(x - (b.min_x + b.max_x) / 2) / ((b.max_x - b.min_x) / 2), abs(y - (b.min_y + b.max_y) / 2) / ((b.max_y - b.min_y) / 2), abs(z - (b.min_z + b.max_z) / 2) / ((b.max_z - b.min_z) / 2))"
_FAR = "(a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2"

ORACLE = {
    "tet_components": f"""WITH RECURSIVE {D.TETS}, f AS (SELECT mesh, tet_id, unnest([[v0,v1,v2],[v0,v1,v3],[v0,v2,v3],[v1,v2,v3]]) AS face FROM t), k AS (SELECT mesh, tet_id, list_sort(face) AS key FROM f),
e AS (SELECT DISTINCT a.mesh, a.tet_id AS src, b.tet_id AS dst FROM k a JOIN k b ON a.mesh = b.mesh AND a.key = b.key AND a.tet_id <> b.tet_id),
r AS (SELECT mesh, src, dst FROM e UNION SELECT r.mesh, r.src, e.dst FROM r JOIN e ON r.mesh = e.mesh AND r.dst = e.src)
SELECT mesh, component, count(*) AS tets FROM (SELECT mesh, src, min(dst) AS component FROM r GROUP BY 1, 2) GROUP BY 1, 2""",
    "box_suppression": f"""WITH {D.BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY mesh ORDER BY weight DESC, bbox_idx) AS k FROM b),
ov AS (SELECT a.mesh, a.k AS ka, b.k AS kb, {_CUT("a", "b")} AS i, {_VOL("a")} + {_VOL("b")} AS s FROM r a JOIN r b ON a.mesh = b.mesh AND a.k < b.k), o AS (SELECT mesh, ka, kb FROM ov WHERE s - i > 1e-12 AND i / (s - i) > 0.4),
two AS (SELECT mesh FROM o WHERE ka = 1 AND kb = 2)
SELECT mesh, bbox_idx, weight FROM r WHERE k = 1 OR (k = 2 AND mesh NOT IN (SELECT mesh FROM two)) OR (k = 3 AND mesh NOT IN (SELECT mesh FROM o WHERE ka = 1 AND kb = 3) AND (mesh IN (SELECT mesh FROM two) OR mesh NOT IN (SELECT mesh FROM o WHERE ka = 2 AND kb = 3)))""",
    "farthest_items": f"""WITH p AS (SELECT l_partkey AS mesh, l_orderkey AS pid, max(l_quantity) AS x, max(l_extendedprice) / 1000 AS y, max(l_discount) * 100 AS z FROM lineitem GROUP BY 1, 2),
c0 AS (SELECT mesh, min(pid) AS pid FROM p GROUP BY 1), s0 AS (SELECT p.* FROM p JOIN c0 USING (mesh, pid)),
d1 AS (SELECT a.*, {_FAR} AS d FROM p a JOIN s0 b ON a.mesh = b.mesh), s1 AS (SELECT * FROM d1 WHERE d > 0 QUALIFY row_number() OVER (PARTITION BY mesh ORDER BY d DESC, pid) = 1),
d2 AS (SELECT a.mesh, a.pid, a.x, a.y, a.z, least(a.d, {_FAR}) AS d FROM d1 a JOIN s1 b ON a.mesh = b.mesh), s2 AS (SELECT * FROM d2 WHERE d > 0 QUALIFY row_number() OVER (PARTITION BY mesh ORDER BY d DESC, pid) = 1),
d3 AS (SELECT a.mesh, a.pid, a.x, a.y, a.z, least(a.d, {_FAR}) AS d FROM d2 a JOIN s2 b ON a.mesh = b.mesh), s3 AS (SELECT * FROM d3 WHERE d > 0 QUALIFY row_number() OVER (PARTITION BY mesh ORDER BY d DESC, pid) = 1)
SELECT mesh, 0 AS pick, pid FROM s0 UNION ALL SELECT mesh, 1, pid FROM s1 UNION ALL SELECT mesh, 2, pid FROM s2 UNION ALL SELECT mesh, 3, pid FROM s3""",
    "coverage_calibration": f"""WITH {D.BOXES}, n AS (SELECT p.mesh, p.weight, p.x, p.y, p.z, round(min({_NEED}), 9) AS scale FROM (SELECT row_number() OVER () AS i, * FROM p) p JOIN b ON p.mesh = b.mesh AND min_x < max_x AND min_y < max_y AND min_z < max_z GROUP BY p.i, 1, 2, 3, 4, 5),
g AS (SELECT mesh, scale, sum(weight) AS weight FROM n GROUP BY 1, 2), c AS (SELECT mesh, scale, sum(weight) OVER (PARTITION BY mesh ORDER BY scale) AS upto, sum(weight) OVER (PARTITION BY mesh) AS al FROM g)
SELECT mesh, round(min(scale), 6) AS scale FROM c WHERE upto >= 0.95 * al - 1e-9 GROUP BY 1""",
}
