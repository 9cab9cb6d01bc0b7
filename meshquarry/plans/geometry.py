"""Geometry queries: boxes, coverage, edits, meshes, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshquarry.functions import boxes as B
from meshquarry.functions import vectors as V
from meshquarry.operators import bad_rows
from meshquarry.operators import spatial as S
from meshquarry.operators.ranking import row_numbers
from meshquarry.plans import frames as D
from meshquarry.plans.text_rows import LINE
from meshquarry.session import salted_join, spill, table

S_ = SparkSession
CONTAINS = "x BETWEEN {0}min_x AND {0}max_x AND y BETWEEN {0}min_y AND {0}max_y AND z BETWEEN {0}min_z AND {0}max_z"


def box_fit_score(spark: S_, d: str) -> DataFrame:
    """Box volumes, weighted coverage, BVS and score of every mesh."""
    p, b = D.points(spark, d), D.part_boxes(spark, d)
    whole = S.fit_boxes(p, ["mesh"]).select("mesh", B.volume(B.box()).alias("shape"))
    vol = b.groupBy("mesh").agg(F.sum(B.volume(B.box())).alias("total"), F.count("*").alias("boxes"), F.count(F.when(B.is_valid(B.box()), 1)).alias("valid"), *(F.min(f"min_{a}").alias(f"min_{a}") for a in B.AXES), *(F.max(f"max_{a}").alias(f"max_{a}") for a in B.AXES))
    cov = S.covered(p, b.select("mesh", *B.BOUNDS), "mesh").groupBy("mesh").agg(F.count("*").alias("n_points"), (F.sum(F.when(F.col("n_boxes") > 0, F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("covered"))
    j = cov.join(whole, "mesh").join(vol, "mesh").filter(F.col("shape") > 0)
    bvs = F.col("total") / F.col("shape")
    return j.select("mesh", "n_points", "boxes", "valid", F.round("total", 6).alias("total_volume"), F.round(B.volume(B.box()), 6).alias("union_bounds_volume"), F.round("covered", 6).alias("covered"), F.round(bvs, 6).alias("bvs"), F.round(B.score(bvs, F.col("covered"), 100.0, 1.0), 6).alias("score"))


def box_grid_coverage(spark: S_, d: str) -> DataFrame:
    """Range join of all points with one small box per part by grid cells, summed per box without its pairs."""
    boxes = table(spark, d, "part").select("p_partkey", (F.col("p_size") - 1.5).alias("min_x"), (F.col("p_size") + 1.5).alias("max_x"), (F.col("p_retailprice") / 25 - 1).alias("min_y"), (F.col("p_retailprice") / 25 + 1).alias("max_y"), F.pmod("p_partkey", F.lit(9)).cast("double").alias("min_z"), (F.pmod("p_partkey", F.lit(9)) + 2.0).alias("max_z"))
    held = S.grid_sums(D.points(spark, d), boxes, (3.0, 2.0, 2.0), "weight")
    return held.groupBy("p_partkey").agg(F.sum("n_points").alias("n_points"), F.round(F.sum("weight"), 4).alias("weight"))


def box_union_volume(spark: S_, d: str) -> DataFrame:
    """Exact volume of the union of each mesh's boxes."""
    return S.union_volume(D.part_boxes(spark, d), "mesh").select("mesh", "boxes", F.round("union_volume", 6).alias("union_volume"))


def box_pair_iou(spark: S_, d: str) -> DataFrame:
    """IoU of the boxes of a mesh."""
    return S.pair_overlaps(D.indexed_boxes(spark, d), "mesh", "bbox_idx").select("mesh", "idx_a", "idx_b", F.round("iou", 6).alias("iou"), F.round("shared_volume", 6).alias("shared_volume"))


def box_corners(spark: S_, d: str) -> DataFrame:
    """The eight corners of every box."""
    b = D.indexed_boxes(spark, d).select("mesh", "bbox_idx", F.posexplode(B.corners(B.box())).alias("corner", "c"))
    return b.select("mesh", "bbox_idx", "corner", *(F.round(f"c.{a}", 6).alias(a) for a in B.AXES))


def box_occupancy(spark: S_, d: str) -> DataFrame:
    """Per mesh: sum of part share times box share (A06), BAVF with alpha 100 (X13), mean aspect and fill (A11), geometry guard."""
    b = D.part_boxes(spark, d).withColumn("v", B.volume(B.box())).filter(F.col("v") > 0)
    w = W.partitionBy("mesh")
    e = B.extents(B.box())
    b = b.withColumn("aspect", F.greatest(*e) / F.least(*e)).withColumn("share", F.col("weight") / F.sum("weight").over(w))
    g = b.groupBy("mesh").agg(F.sum(F.col("share") * F.col("weight") / F.col("v")).alias("occ"), F.max(B.bavf(F.col("weight"), F.col("v"), 100.0)).alias("best_bavf"), F.avg("aspect").alias("aspect"), F.sum("v").alias("v"), *(F.min(f"min_{a}").alias(f"min_{a}") for a in B.AXES), *(F.max(f"max_{a}").alias(f"max_{a}") for a in B.AXES))
    fill = F.col("v") / B.volume(B.box())
    return g.select("mesh", F.round("occ", 6).alias("occ"), F.round("best_bavf", 4).alias("best_bavf"), F.round("aspect", 10).alias("mean_aspect"), F.round(fill, 6).alias("fill_ratio"), ((F.col("aspect") >= 8) | (fill < 0.5)).alias("blocked"))


def edit_upper_bounds(spark: S_, d: str) -> DataFrame:
    """The three edits of the highest upper bound of each mesh, two scales per bound."""
    b = D.indexed_boxes(spark, d).withColumn("v", B.volume(B.box())).withColumn("all", F.sum("v").over(W.partitionBy("mesh"))).filter(F.col("all") > 0)
    g = S.edit_grid(b.select("mesh", "bbox_idx", *B.BOUNDS, "v", "all"), 2, 0.5)
    e = [F.col(f"e_{c}") for c in B.BOUNDS]
    upper = F.round(B.upper_reward(F.col("all") - F.col("v") + B.volume(e), F.col("all") * 0.9, F.lit(0.0)), 6)
    g = g.filter(B.is_valid(e)).withColumn("upper", upper)
    r = F.row_number().over(W.partitionBy("mesh").orderBy(F.desc("upper"), "action"))
    return g.withColumn("rank", r).filter(F.col("rank") <= 3).select("mesh", "rank", "action", "bbox_idx", "coord_idx", "scale_idx", B.opposite(F.col("action"), 2).alias("opposite"), "upper")


def edit_proxy_rewards(spark: S_, d: str) -> DataFrame:
    """The best bound edit of each mesh by the centroid proxy."""
    b = D.indexed_boxes(spark, d)
    shape = F.lit(0.9) * F.sum(B.volume(B.box())).over(W.partitionBy("mesh"))
    b = b.withColumn("shape", shape).filter(F.col("shape") > 0)
    r = S.proxy_rewards(D.points(spark, d), b, "mesh", 2, 1.0, F.col("shape"), F.lit(0.0), 100.0, 1.0)
    r = r.withColumn("reward", F.round("reward", 5))
    best = r.groupBy("mesh").agg(F.max(F.struct("reward", (-F.col("action")).alias("a"), F.round("covered", 6).alias("covered"))).alias("m"))
    return best.select("mesh", (-F.col("m.a")).alias("action"), "m.reward", "m.covered")


def mesh_adjacency(spark: S_, d: str) -> DataFrame:
    """Tetrahedra that share a face."""
    return S.tet_adjacency(D.tets(spark, d), "mesh")


def mesh_surface(spark: S_, d: str) -> DataFrame:
    """Surface faces per mesh and whether its surface is watertight."""
    f = S.surface_faces(D.tets(spark, d), "mesh")
    v = lambda i: F.col("face")[i]
    e = f.select("mesh", F.explode(F.array(*(F.array_sort(F.array(v(i), v(j))) for i, j in ((0, 1), (1, 2), (0, 2))))).alias("edge")).groupBy("mesh", "edge").count()
    edges = e.groupBy("mesh").agg(F.count("*").alias("edges"), F.bool_and(F.col("count") == 2).alias("watertight"))
    return f.groupBy("mesh").agg(F.count("*").alias("faces"), F.min("tet_id").alias("first_tet")).join(edges, "mesh")


def obj_vertex_stats(spark: S_, d: str) -> DataFrame:
    """Extent, diagonal, centre and radius of the valid vertices of each file, and how it is normalised."""
    v = spill(bad_rows.valid_vertices(table(spark, d, "obj_line")).select("obj_file", *B.AXES), "vertices")
    s = v.groupBy("obj_file").agg(F.count("*").alias("n"), *(f(a).alias(f"{n}_{a}") for a in B.AXES for n, f in (("min", F.min), ("max", F.max))))
    mid = [(F.col(f"min_{a}") + F.col(f"max_{a}")) / 2 for a in B.AXES]
    side = [F.col(f"max_{a}") - F.col(f"min_{a}") for a in B.AXES]
    s = s.select("obj_file", "n", *(m.alias(f"c{a}") for a, m in zip(B.AXES, mid)), F.greatest(*side).alias("extent"), F.sqrt(B.total([x * x for x in side])).alias("diagonal"))
    far = v.join(s.select("obj_file", *(f"c{a}" for a in B.AXES)), "obj_file").groupBy("obj_file").agg(F.sqrt(F.max(V.distance2([F.col(a) for a in B.AXES], [F.col(f"c{a}") for a in B.AXES]))).alias("radius"))
    j = s.join(far, "obj_file")
    near = lambda c, x: F.abs(F.col(c) - x) <= 0.05
    form = F.when(near("diagonal", 1.0), "unit_diagonal").when(near("extent", 1.0), "unit_extent").when(near("extent", 2.0), "cube").when(near("radius", 1.0), "unit_sphere").otherwise("none")
    return j.select("obj_file", "n", *(F.round(c, 8).alias(c) for c in ("cx", "cy", "cz", "extent", "diagonal", "radius")), form.alias("normalised"))


def obj_mesh(spark: S_, d: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, fan triangles) of the valid lines, parsed once.

    A vertex has its 0-based position among all vertex lines of the file; negative indices count from the end. A triangle
    is known by its line and its place in the fan.
    """
    lines = bad_rows.parse_obj_lines(table(spark, d, "obj_line"))
    ok = spill(lines.filter(F.col("tag").isin("v", "f")).select("obj_file", "line_no", "tag", "face_tokens", "reason", "vertex"), "parsed")
    v = row_numbers(ok.filter(F.col("tag") == "v").select("obj_file", "line_no", "vertex"), ["obj_file"], ["line_no"], "place")
    n = ok.filter(F.col("tag") == "v").groupBy("obj_file").agg(F.count("*").alias("n_v"))
    f = salted_join(ok.filter(F.col("face_tokens").isNotNull() & F.col("reason").isNull()), n, "obj_file", F.col("line_no"), how="inner")
    i = F.transform("face_tokens", lambda t: F.split(t, "/")[0].cast("long"))
    f = f.withColumn("ix", F.transform(i, lambda x: F.when(x > 0, x - 1).otherwise(F.col("n_v") + x)))
    fan = F.transform(F.sequence(F.lit(1), F.size("ix") - 2), lambda k: F.struct(k.alias("k"), F.col("ix")[0].alias("v0"), F.get(F.col("ix"), k).alias("v1"), F.get(F.col("ix"), k + 1).alias("v2")))
    t = f.select("obj_file", "line_no", F.explode(fan).alias("t")).select("obj_file", F.struct("line_no", "t.k").alias("face_id"), "t.v0", "t.v1", "t.v2")
    v = v.filter(F.col("vertex").isNotNull()).select("obj_file", (F.col("place") - 1).cast("long").alias("vertex_id"), *(F.col("vertex")[i].alias(a) for i, a in enumerate(B.AXES)))
    return v, t


def obj_mesh_volume(spark: S_, d: str) -> DataFrame:
    """Divergence volume and area of each file's triangles."""
    v, t = obj_mesh(spark, d)
    return S.mesh_volumes(S.gather_corners(t, v, "obj_file"), "obj_file").select("obj_file", F.round("volume", 6).alias("volume"), F.round("area", 6).alias("area"), "faces")


def obj_point_inside(spark: S_, d: str) -> DataFrame:
    """Whether each file's mean vertex lies inside its surface, by ray parity."""
    v, t = obj_mesh(spark, d)
    v = spill(v, "vertices")
    t = S.gather_corners(t, v, "obj_file")
    c = v.groupBy("obj_file").agg(*(F.avg(a).alias(f"p{a}") for a in B.AXES))
    j = salted_join(t, c, "obj_file", F.xxhash64("face_id"), how="inner")
    hit = V.ray_hits([F.col(f"p{a}") for a in B.AXES], S.corner("a"), S.corner("b"), S.corner("c"))
    return j.groupBy("obj_file").agg(F.sum(hit.cast("long")).alias("crossings")).withColumn("inside", F.col("crossings") % 2 == 1)


def obj_line_counts(spark: S_, d: str) -> DataFrame:
    """Quick vertex, face and byte counts of each file."""
    l = table(spark, d, "obj_line")
    return l.groupBy("obj_file").agg(F.count_if(F.col("raw_line").startswith("v ")).alias("vertices"), F.count_if(F.col("raw_line").startswith("f ")).alias("faces"), F.sum(F.length("raw_line") + 1).alias("bytes"))


def segment_chamfer(spark: S_, d: str) -> DataFrame:
    """Symmetric chamfer distance between the returned and the accepted points of each mesh."""
    return S.chamfer(D.points(spark, d), "mesh", F.col("part") == "R", F.col("part") == "A").select("mesh", F.round("chamfer", 4).alias("chamfer"))


def nearest_embeddings(spark: S_, d: str) -> DataFrame:
    """The 5 nearest of all embeddings for every embedding whose id is divisible by 20."""
    e = table(spark, d, "embeddings")
    return S.nearest_rows(e, e.filter(F.col("vec_id") % 20 == 0), 5).select("query_id", "vec_id", "rank", F.round("d2", 5).alias("d2"))


def nearest_label_centre(spark: S_, d: str) -> DataFrame:
    """Each embedding's nearest label centre."""
    e = table(spark, d, "embeddings")
    c = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c"))
    centres = c.select(F.col("label").alias("seed"), F.transform("c", lambda x: x["m"]).alias("c")).agg(F.array_sort(F.collect_list(F.struct("seed", "c"))).alias("all")).first()["all"]  # one row per label
    arr = F.array(*(F.struct(F.lit(s.seed).alias("seed"), F.array(*(F.lit(x) for x in s.c)).alias("c")) for s in centres)) if centres else F.lit(None).cast("array<struct<seed:int,c:array<double>>>")
    d2 = lambda s: F.round(F.aggregate(F.zip_with("embedding", s["c"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda x, y: x + y), 6)
    best = F.array_min(F.transform(arr, lambda s: F.struct(d2(s).alias("d2"), s["seed"].alias("seed"))))
    return e.select("vec_id", "label", best.alias("b")).groupBy("label", F.col("b.seed").alias("seed")).agg(F.count("*").alias("n"), F.round(F.avg("b.d2"), 4).alias("mean_d2"))


QUERIES = {f.__name__: f for f in (box_fit_score, box_grid_coverage, box_union_volume, box_pair_iou, box_corners, box_occupancy, edit_upper_bounds, edit_proxy_rewards, mesh_adjacency, mesh_surface, obj_vertex_stats, obj_mesh_volume, obj_point_inside, obj_line_counts, segment_chamfer, nearest_embeddings, nearest_label_centre)}

_UNION = "(max(max_x) - min(min_x)) * (max(max_y) - min(min_y)) * (max(max_z) - min(min_z))"
_CUT = lambda a, b: f"greatest(0, least({a}.max_x, {b}.max_x) - greatest({a}.min_x, {b}.min_x)) * greatest(0, least({a}.max_y, {b}.max_y) - greatest({a}.min_y, {b}.min_y)) * greatest(0, least({a}.max_z, {b}.max_z) - greatest({a}.min_z, {b}.min_z))"
_CUT3 = " * ".join(f"greatest(0, least(a.max_{c}, b.max_{c}, c.max_{c}) - greatest(a.min_{c}, b.min_{c}, c.min_{c}))" for c in "xyz")
_VOL = lambda a: f"(({a}.max_x - {a}.min_x) * ({a}.max_y - {a}.min_y) * ({a}.max_z - {a}.min_z))"
_FACES = f"WITH {D.TETS}, f AS (SELECT mesh, tet_id, unnest([[v0,v1,v2],[v0,v1,v3],[v0,v2,v3],[v1,v2,v3]]) AS face FROM t), k AS (SELECT *, list_sort(face) AS key FROM f)"
_EDITS = f"""WITH {D.BOXES}, v AS (SELECT *, {D.VOLUME} AS v, sum({D.VOLUME}) OVER (PARTITION BY mesh) AS al FROM b),
g AS (SELECT v.*, k, CASE WHEN k = 12 THEN 6 ELSE k // 2 END AS coord_idx, CASE WHEN k = 12 THEN 0 ELSE k % 2 END AS scale_idx, bbox_idx * 13 + k AS action, CASE WHEN k = 12 THEN 0 WHEN k % 2 = 0 THEN -UNIT ELSE UNIT END AS delta FROM v, range(13) AS r(k)),
e AS (SELECT *, min_x + CASE coord_idx WHEN 0 THEN delta ELSE 0 END AS a0, min_y + CASE coord_idx WHEN 1 THEN delta ELSE 0 END AS a1, min_z + CASE coord_idx WHEN 2 THEN delta ELSE 0 END AS a2,
  max_x + CASE coord_idx WHEN 3 THEN delta ELSE 0 END AS b0, max_y + CASE coord_idx WHEN 4 THEN delta ELSE 0 END AS b1, max_z + CASE coord_idx WHEN 5 THEN delta ELSE 0 END AS b2 FROM g)"""

_XYZ = ", ".join(f"CAST(bare[{i}] AS DOUBLE) AS {c}" for i, c in enumerate("xyz", 1))
_OBJ = LINE + f""", v AS (SELECT obj_file, i, {_XYZ} FROM (SELECT *, row_number() OVER (PARTITION BY obj_file ORDER BY line_no) - 1 AS i FROM r WHERE tag = 'v') WHERE reason IS NULL),
g AS (SELECT obj_file, line_no, list_transform(ix, lambda x: CASE WHEN x > 0 THEN x - 1 ELSE n_v + x END) AS ix FROM r WHERE tag = 'f' AND reason IS NULL),
f AS (SELECT obj_file, line_no, k, ix[1] AS i0, ix[k + 1] AS i1, ix[k + 2] AS i2 FROM g, range(1, 60) AS q(k) WHERE k <= len(ix) - 2),
tri AS (SELECT f.*, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS "by", b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM f JOIN v a ON f.obj_file = a.obj_file AND i0 = a.i JOIN v b ON f.obj_file = b.obj_file AND i1 = b.i JOIN v c ON f.obj_file = c.obj_file AND i2 = c.i)"""
_E = {c: (f"(b{c} - a{c})" if c != "y" else '("by" - ay)', f"(c{c} - a{c})") for c in "xyz"}
_CROSS = [f"({_E[p][0]} * {_E[q][1]} - {_E[q][0]} * {_E[p][1]})" for p, q in ("yz", "zx", "xy")]

ORACLE = {
    "obj_vertex_stats": _OBJ
    + f""", st AS (SELECT obj_file, count(*) AS n, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, (min(z) + max(z)) / 2 AS cz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS extent, sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2 + (max(z) - min(z)) ** 2) AS diagonal FROM v GROUP BY 1),
m AS (SELECT obj_file, sqrt(max((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2)) AS radius FROM v JOIN st USING (obj_file) GROUP BY 1)
SELECT obj_file, n, {", ".join(f"round({c}, 8) AS {c}" for c in ("cx", "cy", "cz", "extent", "diagonal", "radius"))}, CASE WHEN abs(diagonal - 1) <= 0.05 THEN 'unit_diagonal' WHEN abs(extent - 1) <= 0.05 THEN 'unit_extent' WHEN abs(extent - 2) <= 0.05 THEN 'cube' WHEN abs(radius - 1) <= 0.05 THEN 'unit_sphere' ELSE 'none' END AS normalised FROM st JOIN m USING (obj_file)""",
    "obj_mesh_volume": _OBJ
    + f""" SELECT obj_file, round(abs(sum((ax * ("by" * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - "by" * cx)) / 6)), 6) AS volume, round(sum(sqrt({" + ".join(c + " ** 2" for c in _CROSS)}) / 2), 6) AS area, count(*) AS faces FROM tri GROUP BY 1""",
    "obj_point_inside": _OBJ
    + f""", cm AS (SELECT obj_file, avg(x) AS px, avg(y) AS py, avg(z) AS pz FROM v GROUP BY 1),
h AS (SELECT tri.*, px - ax AS sx, py - ay AS sy, pz - az AS sz, 0.372137 * {_E["z"][1]} - 0.157913 * {_E["y"][1]} AS hx, 0.157913 * {_E["x"][1]} - 1.0 * {_E["z"][1]} AS hy, 1.0 * {_E["y"][1]} - 0.372137 * {_E["x"][1]} AS hz FROM tri JOIN cm USING (obj_file)),
d AS (SELECT *, {" + ".join(f"{_E[c][0]} * h{c}" for c in "xyz")} AS det, {" + ".join(f"s{c} * h{c}" for c in "xyz")} AS u, {", ".join(f"s{p} * {_E[q][0]} - s{q} * {_E[p][0]} AS q{c}" for c, (p, q) in zip("xyz", ("yz", "zx", "xy")))} FROM h),
hits AS (SELECT obj_file, CASE WHEN abs(det) > 1e-10 AND u / det >= 0 AND (qx + 0.372137 * qy + 0.157913 * qz) / det >= 0 AND (u + qx + 0.372137 * qy + 0.157913 * qz) / det <= 1 AND ({" + ".join(f"{_E[c][1]} * q{c}" for c in "xyz")}) / det > 1e-10 THEN 1 ELSE 0 END AS hit FROM d)
SELECT obj_file, sum(hit) AS crossings, sum(hit) % 2 = 1 AS inside FROM hits GROUP BY 1""",
    "box_fit_score": f"""WITH {D.BOXES}, s AS (SELECT mesh, {_UNION.replace("min_", "").replace("max_", "")} AS shape, count(*) AS n_points FROM p GROUP BY 1),
v AS (SELECT mesh, sum({D.VOLUME}) AS total, count(*) AS boxes, count(*) FILTER (WHERE min_x < max_x AND min_y < max_y AND min_z < max_z) AS valid, {_UNION} AS u FROM b GROUP BY 1),
i AS (SELECT mesh, weight, EXISTS (SELECT 1 FROM b WHERE b.mesh = p.mesh AND {CONTAINS.format("b.").replace("x BET", "p.x BET").replace("y BET", "p.y BET").replace("z BET", "p.z BET")}) AS hit FROM p),
c AS (SELECT mesh, sum(CASE WHEN hit THEN weight ELSE 0 END) / sum(weight) AS covered FROM i GROUP BY 1)
SELECT mesh, n_points, boxes, valid, round(total, 6) AS total_volume, round(u, 6) AS union_bounds_volume, round(covered, 6) AS covered, round(total / shape, 6) AS bvs, round(-abs(total / shape - 1) - (1 - covered) * 100, 6) AS score
FROM c JOIN s USING (mesh) JOIN v USING (mesh) WHERE shape > 0""",
    "box_grid_coverage": f"""WITH {D.POINTS}, q AS (SELECT p_partkey, p_size - 1.5 AS min_x, p_size + 1.5 AS max_x, p_retailprice / 25 - 1 AS min_y, p_retailprice / 25 + 1 AS max_y, p_partkey % 9 AS min_z, p_partkey % 9 + 2.0 AS max_z FROM part)
SELECT p_partkey, count(*) AS n_points, round(sum(weight), 4) AS weight FROM p JOIN q ON {CONTAINS.format("q.")} GROUP BY 1""",
    "box_union_volume": f"""WITH {D.BOXES}, w AS (SELECT * FROM b WHERE min_x < max_x AND min_y < max_y AND min_z < max_z),
one AS (SELECT mesh, count(*) AS boxes, sum({D.VOLUME}) AS v FROM w GROUP BY 1),
two AS (SELECT a.mesh, sum({_CUT("a", "b")}) AS v FROM w a JOIN w b ON a.mesh = b.mesh AND a.bbox_idx < b.bbox_idx GROUP BY 1),
three AS (SELECT a.mesh, {_CUT3} AS v FROM w a JOIN w b ON a.mesh = b.mesh AND a.bbox_idx = 0 AND b.bbox_idx = 1 JOIN w c ON a.mesh = c.mesh AND c.bbox_idx = 2)
SELECT mesh, boxes, round(one.v - coalesce(two.v, 0) + coalesce(three.v, 0), 6) AS union_volume FROM one LEFT JOIN two USING (mesh) LEFT JOIN three USING (mesh)""",
    "box_pair_iou": f"""WITH {D.BOXES}, c AS (SELECT a.mesh, a.bbox_idx AS idx_a, b.bbox_idx AS idx_b, {_CUT("a", "b")} AS i, {_VOL("a")} + {_VOL("b")} AS s FROM b a JOIN b ON a.mesh = b.mesh AND a.bbox_idx < b.bbox_idx)
SELECT mesh, idx_a, idx_b, round(CASE WHEN s - i > 1e-12 THEN i / (s - i) ELSE 0 END, 6) AS iou, round(i, 6) AS shared_volume FROM c""",
    "box_corners": f"""WITH {D.BOXES} SELECT mesh, bbox_idx, k AS corner, round(CASE WHEN k % 2 = 1 THEN max_x ELSE min_x END, 6) AS x, round(CASE WHEN k // 2 % 2 = 1 THEN max_y ELSE min_y END, 6) AS y, round(CASE WHEN k // 4 = 1 THEN max_z ELSE min_z END, 6) AS z FROM b, range(8) AS r(k)""",
    "box_occupancy": f"""WITH {D.BOXES}, v AS (SELECT *, {D.VOLUME} AS v, greatest(max_x - min_x, max_y - min_y, max_z - min_z) / least(max_x - min_x, max_y - min_y, max_z - min_z) AS aspect FROM b WHERE {D.VOLUME} > 0),
s AS (SELECT *, weight / sum(weight) OVER (PARTITION BY mesh) AS share FROM v)
SELECT mesh, round(sum(share * weight / v), 6) AS occ, round(max(100 * weight / v), 4) AS best_bavf, round(avg(aspect), 10) AS mean_aspect, round(sum(v) / ({_UNION}), 6) AS fill_ratio, avg(aspect) >= 8 OR sum(v) / ({_UNION}) < 0.5 AS blocked FROM s GROUP BY 1""",
    "edit_upper_bounds": _EDITS.replace("UNIT", "0.5")
    + """, u AS (SELECT mesh, action, bbox_idx, coord_idx, scale_idx, round(-abs((al - v + (b0 - a0) * (b1 - a1) * (b2 - a2)) / (al * 0.9) - 1), 6) AS upper FROM e WHERE al > 0 AND a0 < b0 AND a1 < b1 AND a2 < b2),
r AS (SELECT *, row_number() OVER (PARTITION BY mesh ORDER BY upper DESC, action) AS rank FROM u)
SELECT mesh, rank, action, bbox_idx, coord_idx, scale_idx, CASE WHEN coord_idx = 6 THEN action ELSE bbox_idx * 13 + coord_idx * 2 + 1 - scale_idx END AS opposite, upper FROM r WHERE rank <= 3""",
    "edit_proxy_rewards": _EDITS.replace("UNIT", "1.0")
    + """, h AS (SELECT p.mesh, e.action, e.al, e.v, a0, a1, a2, b0, b1, b2, p.weight, (x BETWEEN a0 AND b0 AND y BETWEEN a1 AND b1 AND z BETWEEN a2 AND b2) OR EXISTS (SELECT 1 FROM b o WHERE o.mesh = p.mesh AND o.bbox_idx <> e.bbox_idx AND p.x BETWEEN o.min_x AND o.max_x AND p.y BETWEEN o.min_y AND o.max_y AND p.z BETWEEN o.min_z AND o.max_z) AS hit FROM p JOIN e ON p.mesh = e.mesh WHERE coord_idx < 6 AND al > 0),
c AS (SELECT mesh, action, any_value(al) AS al, any_value(v) AS v, any_value(a0) AS a0, any_value(a1) AS a1, any_value(a2) AS a2, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, sum(CASE WHEN hit THEN weight ELSE 0 END) / sum(weight) AS covered FROM h GROUP BY 1, 2),
r AS (SELECT mesh, action, covered, round(CASE WHEN a0 < b0 AND a1 < b1 AND a2 < b2 THEN -abs((al - v + (b0 - a0) * (b1 - a1) * (b2 - a2)) / (al * 0.9) - 1) - (1 - covered) * 100 ELSE '-inf'::DOUBLE END, 5) AS reward FROM c)
SELECT mesh, action, reward, round(covered, 6) AS covered FROM r QUALIFY row_number() OVER (PARTITION BY mesh ORDER BY reward DESC, action) = 1""",
    "mesh_adjacency": _FACES + " SELECT DISTINCT a.mesh, a.tet_id AS src, b.tet_id AS dst FROM k a JOIN k b ON a.mesh = b.mesh AND a.key = b.key AND a.tet_id <> b.tet_id",
    "mesh_surface": _FACES
    + """, s AS (SELECT mesh, key, any_value(tet_id) AS tet_id FROM k GROUP BY 1, 2 HAVING count(*) = 1),
e AS (SELECT mesh, edge, count(*) AS c FROM (SELECT mesh, unnest([[key[1], key[2]], [key[2], key[3]], [key[1], key[3]]]) AS edge FROM s) GROUP BY 1, 2),
g AS (SELECT mesh, count(*) AS edges, bool_and(c = 2) AS watertight FROM e GROUP BY 1)
SELECT mesh, faces, first_tet, edges, watertight FROM (SELECT mesh, count(*) AS faces, min(tet_id) AS first_tet FROM s GROUP BY 1) JOIN g USING (mesh)""",
    "obj_line_counts": "SELECT obj_file, count(*) FILTER (WHERE starts_with(raw_line, 'v ')) AS vertices, count(*) FILTER (WHERE starts_with(raw_line, 'f ')) AS faces, sum(length(raw_line) + 1) AS bytes FROM obj_line GROUP BY 1",
    "segment_chamfer": f"""WITH {D.POINTS}, q AS (SELECT row_number() OVER () AS i, * FROM p),
d AS (SELECT a.mesh, a.i AS ia, b.i AS ib, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 AS d2 FROM q a JOIN q b ON a.mesh = b.mesh AND a.part = 'R' AND b.part = 'A'),
l AS (SELECT mesh, avg(m) AS v FROM (SELECT mesh, ia, min(d2) AS m FROM d GROUP BY 1, 2) GROUP BY 1), r AS (SELECT mesh, avg(m) AS v FROM (SELECT mesh, ib, min(d2) AS m FROM d GROUP BY 1, 2) GROUP BY 1)
SELECT mesh, round(l.v + r.v, 4) AS chamfer FROM l JOIN r USING (mesh)""",
    "nearest_embeddings": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT q.vec_id AS query_id, e.vec_id, list_sum(list_transform(list_zip(q.v, e.v), lambda t: (t[1] - t[2]) ** 2)) AS d2 FROM e q JOIN e ON q.vec_id % 20 = 0)
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY d2, vec_id) AS rank, round(d2, 5) AS d2 FROM d QUALIFY rank <= 5""",
    "nearest_label_centre": """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
x AS (SELECT label AS seed, i, avg(v[i]) AS m FROM e, range(1, 65) AS r(i) GROUP BY 1, 2), c AS (SELECT seed, list(m ORDER BY i) AS c FROM x GROUP BY 1),
d AS (SELECT vec_id, label, seed, round(list_sum(list_transform(list_zip(v, c), lambda t: (t[1] - t[2]) ** 2)), 6) AS d2 FROM e, c),
n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, seed) = 1)
SELECT label, seed, count(*) AS n, round(avg(d2), 4) AS mean_d2 FROM n GROUP BY 1, 2""",
}
