"""Queries on proposed boxes, parts and tetrahedra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquarry.functions import boxes as B
from meshquarry.functions import vectors as V
from meshquarry.operators import proposals as P
from meshquarry.operators import spatial as S
from meshquarry.plans import frames as D
from meshquarry.plans.geometry import _CUT, _VOL
from meshquarry.plans.procedures import segment_merge
from meshquarry.session import salted_join, spill, table

S_ = SparkSession
_IDX = "CASE part WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"


def _open_boxes(spark: S_, d: str) -> DataFrame:
    o = S.fit_boxes(D.points(spark, d).filter(F.col("status") == "O"), ["mesh", "part"])
    return o.withColumn("bbox_idx", F.when(F.col("part") == "A", 0).when(F.col("part") == "N", 1).otherwise(2))


def box_matching(spark: S_, d: str) -> DataFrame:
    """Least total corner cost of matching each mesh's closed boxes to its open ones."""
    a = D.indexed_boxes(spark, d).select("mesh", F.col("bbox_idx").alias("l"), B.corners(B.box()).alias("a"))
    o = _open_boxes(spark, d).select("mesh", F.col("bbox_idx").alias("r"), B.corners(B.box()).alias("b"))
    cost = F.round(P.corner_cost(F.col("a"), F.col("b")), 9)
    m = P.optimal_assignment(a.join(o, "mesh").select("mesh", "l", "r", cost.alias("cost")), "mesh", "l", "r", "cost")
    return m.groupBy("mesh").agg(F.count("*").alias("pairs"), F.round(F.sum("cost"), 8).alias("cost"))


def part_excess(spark: S_, d: str) -> DataFrame:
    """Excess of the boxes around each two open parts of a mesh over its closed solid."""
    p = _open_boxes(spark, d).withColumn("volume", B.volume(B.box()))
    return P.excess_matrix(p, D.part_boxes(spark, d), "mesh", "bbox_idx").select("mesh", "i", "j", F.round("value", 6).alias("value"))


def edge_features(spark: S_, d: str) -> DataFrame:
    """Edges from each embedding of id divisible by 20 to its four nearest: neighbour minus self, then self."""
    e = table(spark, d, "embeddings")
    q = e.filter(F.col("vec_id") % 20 == 0)
    k = S.nearest_rows(e, q, 4)
    own, near = (e.select(F.col("vec_id").alias(i), F.col("embedding").cast("array<double>").alias(n)) for i, n in (("query_id", "own"), ("vec_id", "near")))
    j = k.join(own, "query_id").join(near, "vec_id")
    f = F.concat(F.zip_with("near", "own", lambda x, y: x - y), F.col("own"))
    n = F.size("own")
    return j.withColumn("f", f).select("query_id", "vec_id", F.size("f").alias("width"), *(F.round(F.aggregate(F.transform(F.slice("f", a, n), lambda x: x * x), F.lit(0.0), lambda s, x: s + x), 5).alias(c) for a, c in ((F.lit(1), "step"), (n + 1, "self"))))


def part_by_distance(spark: S_, d: str) -> DataFrame:
    """Points by the box of their mesh that they lie deepest in or nearest to, the first at ties."""
    b = D.indexed_boxes(spark, d).groupBy("mesh").agg(F.array_sort(F.collect_list(F.struct("bbox_idx", *B.BOUNDS))).alias("bs"))
    j = salted_join(D.points(spark, d), b, "mesh", F.xxhash64(*B.AXES), how="inner")
    far = lambda s: V.cuboid_distance([F.col(a) - (s[f"min_{a}"] + s[f"max_{a}"]) / 2 for a in B.AXES], [(s[f"max_{a}"] - s[f"min_{a}"]) / 2 for a in B.AXES])
    best = F.array_max(F.transform("bs", lambda s: F.struct((-F.round(far(s), 6)).alias("d"), (-s["bbox_idx"]).alias("k"))))
    return j.select("mesh", best.alias("b")).groupBy("mesh", (-F.col("b.k")).alias("bbox_idx")).agg(F.count("*").alias("n"), F.round(F.sum("b.d"), 6).alias("depth"))


#: A turn about z (fixed value).
TURN = (0.8, 0.6, 0.0, -0.6, 0.8, 0.0, 0.0, 0.0, 1.0)


def oriented_coverage(spark: S_, d: str) -> DataFrame:
    """Open items within boxes of a turned frame fitted to the closed ones."""
    r = [F.lit(x) for x in TURN]
    turned = B.rotate(r, [F.col(a) for a in B.AXES])
    p = D.points(spark, d)
    t = p.filter(F.col("status") == "F").select("mesh", "weight", *(c.alias(a) for c, a in zip(turned, B.AXES)))
    b = S.fit_boxes(t, ["mesh"]).select("mesh", *B.BOUNDS)
    j = salted_join(p.filter(F.col("status") == "O"), b, "mesh", F.xxhash64(*B.AXES), how="inner")
    inside = B.contains_oriented(B.box(), r, [F.col(a) for a in B.AXES])
    return j.groupBy("mesh").agg(F.count("*").alias("n"), F.count_if(inside).alias("inside"), F.sum(F.when(inside, F.col("weight")).otherwise(0.0)).alias("weight"))


def proposal_forms(spark: S_, d: str) -> DataFrame:
    """Points inside, volume and volume scaled by 2 of each box in its three forms."""
    b = D.indexed_boxes(spark, d).filter(B.is_valid(B.box()))
    forms = F.explode(F.array(*(F.struct(F.lit(n).alias("form"), B.as_proposal(B.box(), n).alias("v")) for n in (6, 12, 24)))).alias("f")
    v = spill(b.select("mesh", "bbox_idx", forms).select("mesh", "bbox_idx", "f.*"), "forms")
    j = salted_join(D.points(spark, d).select("mesh", *B.AXES), v, "mesh", F.xxhash64(*B.AXES), how="inner")
    n = j.filter(B.contains_proposal(F.col("v"), [F.col(a) for a in B.AXES])).groupBy("mesh", "bbox_idx", "form").agg(F.count("*").alias("inside"))
    g = v.join(n, ["mesh", "bbox_idx", "form"], "left").withColumn("twice", B.scaled_proposal(F.col("v"), 2.0))
    return g.select("mesh", "bbox_idx", "form", F.coalesce("inside", F.lit(0)).alias("inside"), F.round(B.proposal_volume(F.col("v")), 9).alias("volume"), F.round(B.proposal_volume(F.col("twice")), 9).alias("scaled"))


def observations(spark: S_, d: str) -> DataFrame:
    """Fixed-width input rows per mesh: four points, three boxes, the step one-hot and the mask of 39 actions."""
    b = D.indexed_boxes(spark, d).groupBy("mesh").agg(F.array_sort(F.collect_list(F.struct("bbox_idx", *B.BOUNDS))).alias("bs"))
    p = D.points(spark, d).groupBy("mesh").agg(F.slice(F.array_sort(F.collect_set(F.struct(*B.AXES, "weight"))), 1, 4).alias("ps"))
    rows = P.padded(F.transform("ps", lambda x: F.array(*(x[c] for c in (*B.AXES, "weight")))), 4, 4)
    boxes = P.padded(F.transform("bs", lambda x: F.array(*(x[c] for c in B.BOUNDS))), 6, 3)
    have = F.transform("bs", lambda x: x["bbox_idx"])
    mask = F.transform(F.sequence(F.lit(0), F.lit(38)), lambda a: F.when(F.array_contains(have, F.floor(a / 13).cast("int")), 1.0).otherwise(0.0))
    x = F.concat(rows, boxes, P.one_hot((F.col("mesh") % 4).cast("int"), 4), mask)
    o = p.join(b, "mesh").select("mesh", x.alias("x"))
    weigh = F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return o.select("mesh", F.size("x").alias("width"), F.round(weigh, 5).alias("weighed"))


def merged_points(spark: S_, d: str) -> DataFrame:
    """Different points of the segments A and N of each mesh together."""
    p = D.points(spark, d)
    side = lambda s: p.filter(F.col("part") == s).select("mesh", *B.AXES)
    return side("A").union(side("N")).distinct().groupBy("mesh").agg(F.count("*").alias("points"))


def joined_inputs(spark: S_, d: str) -> DataFrame:
    """Stage and evaluation records as one input, columns that one lacks being null."""
    u = table(spark, d, "stage_record").unionByName(table(spark, d, "evaluation_record"), allowMissingColumns=True)
    return u.groupBy(F.col("record_id").isNull().alias("evaluation"), "status").agg(F.count("*").alias("n"), F.count("bvs").alias("with_bvs"), F.count("started_at").alias("with_start"), F.countDistinct("mesh_id").alias("meshes"))


def part_adjacency(spark: S_, d: str) -> DataFrame:
    """Parts (the last digit of four of the tetrahedra's numbers) that share a face."""
    t = D.tets(spark, d)
    return P.part_adjacency(t.select("mesh", "tet_id", F.pmod("tet_id", F.lit(4)).alias("part_id")), S.tet_faces(t, "mesh"), "mesh")


#: Where the ten vertices of a stand-in mesh lie.
_AT = {"x": lambda v: v % 3, "y": lambda v: F.floor(v / 3) % 3, "z": lambda v: (v * v) % 5 * 0.5}


def presegments(spark: S_, d: str) -> DataFrame:
    """First segmentation of each mesh's tetrahedra by the two boxes that hold their centres."""
    t = D.tets(spark, d)
    at = {a: [f(F.col(f"v{i}")).cast("double") for i in range(4)] for a, f in _AT.items()}
    mid = V.tet_centroid(*([at[a][i] for a in B.AXES] for i in range(4)))
    label = F.concat(F.when(mid[0] <= 1.0, "a").otherwise(""), F.when(mid[1] <= 1.0, "b").otherwise(""))
    x = t.select("mesh", "tet_id", label.alias("label"), V.tet_volume(*([at[a][i] for a in B.AXES] for i in range(4))).alias("volume"), *(F.least(*at[a]).alias(f"min_{a}") for a in B.AXES), *(F.greatest(*at[a]).alias(f"max_{a}") for a in B.AXES))
    s = P.presegment(x, S.tet_adjacency(t, "mesh"), "mesh")
    return s.groupBy("mesh", "piece").agg(F.count("*").alias("tets"))


def merged_part_boxes(spark: S_, d: str) -> DataFrame:
    """Initial boxes from greedily merged segments."""
    from meshquarry.plans.procedures import _segments

    into = spill(segment_merge(spark, d), "into").select("mesh", "pid", "into")
    b = S.fit_boxes(_segments(spark, d), ["mesh", "pid"]).join(into, ["mesh", "pid"])
    return b.groupBy("mesh", F.col("into").alias("part")).agg(*(F.min(c).alias(c) for c in B.LOWS), *(F.max(c).alias(c) for c in B.HIGHS), F.count("*").alias("segments"))


def random_initial_boxes(spark: S_, d: str) -> DataFrame:
    """Three boxes per mesh between normal points, drawn by hash."""
    b = P.random_boxes(table(spark, d, "part").select(F.col("p_partkey").alias("mesh")), "mesh", 3)
    return b.select("mesh", "bbox_idx", *(F.round(c, 9).alias(c) for c in B.BOUNDS))


def surface_samples(spark: S_, d: str) -> DataFrame:
    """Sixteen points on the surface of every box, by area."""
    return P.surface_points(D.indexed_boxes(spark, d).select("mesh", "bbox_idx", *B.BOUNDS), ["mesh", "bbox_idx"], 16)


QUERIES = {f.__name__: f for f in (box_matching, part_excess, edge_features, part_by_distance, oriented_coverage, proposal_forms, observations, merged_points, joined_inputs, part_adjacency, presegments, merged_part_boxes, random_initial_boxes, surface_samples)}

_OPEN = f"o AS (SELECT mesh, {_IDX} AS bbox_idx, {D.FIT} FROM p WHERE status = 'O' GROUP BY 1, 2)"
_NEAR = " + ".join(f"(least(abs(b.min_{a} - o.min_{a}), abs(b.min_{a} - o.max_{a})) + least(abs(b.max_{a} - o.min_{a}), abs(b.max_{a} - o.max_{a}))) / 2" for a in "xyz")
_BACK = " + ".join(f"(least(abs(o.min_{a} - b.min_{a}), abs(o.min_{a} - b.max_{a})) + least(abs(o.max_{a} - b.min_{a}), abs(o.max_{a} - b.max_{a}))) / 2" for a in "xyz")
_HALF = {a: (f"abs(x.{a} - (b.min_{a} + b.max_{a}) / 2) - (b.max_{a} - b.min_{a}) / 2") for a in "xyz"}
_DIST = f"sqrt({' + '.join(f'greatest({h}, 0) ** 2' for h in _HALF.values())}) + least(greatest({', '.join(_HALF.values())}), 0)"


def _shared(*names: str) -> str:
    """Volume that boxes share, as SQL."""
    return " * ".join(f"greatest(0, {'least(' + ', '.join(f'{n}.max_{a}' for n in names) + ')'} - {'greatest(' + ', '.join(f'{n}.min_{a}' for n in names) + ')'})" for a in "xyz")


_EXCESS = f"""SELECT u.mesh, u.i, u.j, {_VOL("u")} - coalesce(sum(t.s), 0) AS e FROM u LEFT JOIN (
  SELECT u.mesh, u.i, u.j, {_shared("u", "c")} AS s FROM u JOIN b c USING (mesh)
  UNION ALL SELECT u.mesh, u.i, u.j, -({_shared("u", "c", "d")}) FROM u JOIN b c USING (mesh) JOIN b d USING (mesh) WHERE c.bbox_idx < d.bbox_idx
  UNION ALL SELECT u.mesh, u.i, u.j, {_shared("u", "c", "d", "f")} FROM u JOIN b c USING (mesh) JOIN b d USING (mesh) JOIN b f USING (mesh) WHERE c.bbox_idx < d.bbox_idx AND d.bbox_idx < f.bbox_idx) t USING (mesh, i, j)
GROUP BY u.mesh, u.i, u.j, {", ".join(f"u.{m}_{a}" for m in ("min", "max") for a in "xyz")}"""

ORACLE = {
    "box_matching": f"""WITH {D.BOXES}, {_OPEN}, k AS (SELECT mesh, b.bbox_idx AS l, o.bbox_idx AS r, round(({_NEAR} + {_BACK}) / 2, 9) AS c FROM b JOIN o USING (mesh)),
s AS (SELECT mesh, least(count(DISTINCT l), count(DISTINCT r)) AS m FROM k GROUP BY 1),
x AS (SELECT mesh, 1 AS pairs, c AS cost FROM k UNION ALL SELECT mesh, 2, a.c + b.c FROM k a JOIN k b USING (mesh) WHERE a.l < b.l AND a.r <> b.r
  UNION ALL SELECT mesh, 3, a.c + b.c + d.c FROM k a JOIN k b USING (mesh) JOIN k d USING (mesh) WHERE a.l < b.l AND b.l < d.l AND a.r <> b.r AND a.r <> d.r AND b.r <> d.r)
SELECT mesh, pairs, round(min(cost), 8) AS cost FROM x JOIN s USING (mesh) WHERE pairs = m GROUP BY 1, 2""",
    "part_excess": f"""WITH {D.BOXES}, {_OPEN}, v AS (SELECT *, {D.VOLUME} AS v FROM o WHERE {D.VOLUME} > 0),
u AS (SELECT x.mesh, x.bbox_idx AS i, y.bbox_idx AS j, {", ".join(f"least(x.min_{a}, y.min_{a}) AS min_{a}, greatest(x.max_{a}, y.max_{a}) AS max_{a}" for a in "xyz")} FROM v x JOIN v y USING (mesh)), e AS ({_EXCESS}),
w AS (SELECT e.mesh, i, e.e / v AS own, v FROM e JOIN v ON e.mesh = v.mesh AND e.i = v.bbox_idx WHERE i = j)
SELECT e.mesh, e.i, e.j, round(e.e / (CASE WHEN e.i = e.j THEN a.v ELSE a.v + b.v END) - a.own - b.own, 6) + 0.0 AS value FROM e JOIN w a ON e.mesh = a.mesh AND e.i = a.i JOIN w b ON e.mesh = b.mesh AND e.j = b.i""",
    "edge_features": """WITH q AS (SELECT vec_id AS query_id, embedding AS own FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT query_id, vec_id, own, list_sum(list_transform(list_zip(embedding, own), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)) AS d FROM q, embeddings),
k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) <= 4)
SELECT query_id, vec_id, 2 * len(own) AS width, round(d, 5) AS step, round(list_sum(list_transform(own, lambda z: z::DOUBLE ** 2)), 5) AS self FROM k""",
    "part_by_distance": f"""WITH {D.BOXES}, n AS (SELECT row_number() OVER () AS id, * FROM p), k AS (SELECT x.id, x.mesh, b.bbox_idx, -round({_DIST}, 6) AS d FROM n x JOIN b USING (mesh) QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY round({_DIST}, 6), b.bbox_idx) = 1)
SELECT mesh, bbox_idx, count(*) AS n, round(sum(d), 6) AS depth FROM k GROUP BY 1, 2""",
    "oriented_coverage": f"""WITH {D.POINTS}, t AS (SELECT mesh, status, weight, 0.8::DOUBLE * x + 0.6::DOUBLE * y + 0::DOUBLE * z AS x, -0.6::DOUBLE * x + 0.8::DOUBLE * y + 0::DOUBLE * z AS y, 0::DOUBLE * x + 0::DOUBLE * y + 1::DOUBLE * z AS z FROM p),
b AS (SELECT mesh, {D.FIT} FROM t WHERE status = 'F' GROUP BY 1), j AS (SELECT t.mesh, t.weight, x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y AND z BETWEEN min_z AND max_z AS i FROM t JOIN b USING (mesh) WHERE status = 'O')
SELECT mesh, count(*) AS n, count(*) FILTER (WHERE i) AS inside, coalesce(sum(weight) FILTER (WHERE i), 0) AS weight FROM j GROUP BY 1""",
    "proposal_forms": f"""WITH {D.BOXES}, n AS (SELECT b.mesh, b.bbox_idx, count(p.mesh) AS inside FROM b LEFT JOIN p ON p.mesh = b.mesh AND x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y AND z BETWEEN min_z AND max_z WHERE min_x < max_x AND min_y < max_y AND min_z < max_z GROUP BY 1, 2)
SELECT mesh, bbox_idx, unnest([6, 12, 24]) AS form, inside, round({D.VOLUME}, 9) AS volume, round({D.VOLUME} * 8, 9) AS scaled FROM b JOIN n USING (mesh, bbox_idx)""",
    "observations": f"""WITH {D.BOXES}, q AS (SELECT mesh, x, y, z, weight, row_number() OVER (PARTITION BY mesh ORDER BY x, y, z, weight) AS k FROM (SELECT DISTINCT mesh, x, y, z, weight FROM p)),
c AS (SELECT mesh, {" + ".join(f"{c} * ((k - 1) * 4 + {i + 1})" for i, c in enumerate(("x", "y", "z", "weight")))} AS s FROM q WHERE k <= 4
  UNION ALL SELECT mesh, {" + ".join(f"{c} * (16 + (row_number() OVER (PARTITION BY mesh ORDER BY bbox_idx) - 1) * 6 + {i + 1})" for i, c in enumerate(B.BOUNDS))} FROM b
  UNION ALL SELECT DISTINCT mesh, 34 + mesh % 4 + 1 FROM b UNION ALL SELECT mesh, 38 * 13 + bbox_idx * 169 + 91 FROM b)
SELECT mesh, 77 AS width, round(sum(s), 5) AS weighed FROM c WHERE mesh IN (SELECT mesh FROM b) GROUP BY 1""",
    "merged_points": f"WITH {D.POINTS} SELECT mesh, count(DISTINCT (x, y, z)) AS points FROM p WHERE part IN ('A', 'N') GROUP BY 1",
    "joined_inputs": "SELECT record_id IS NULL AS evaluation, status, count(*) AS n, count(bvs) AS with_bvs, count(started_at) AS with_start, count(DISTINCT mesh_id) AS meshes FROM (SELECT * FROM stage_record UNION ALL BY NAME SELECT * FROM evaluation_record) GROUP BY 1, 2",
    "part_adjacency": f"""WITH {D.TETS}, f AS (SELECT mesh, tet_id % 4 AS part, list_sort(unnest([[v0,v1,v2],[v0,v1,v3],[v0,v2,v3],[v1,v2,v3]])) AS key FROM t), g AS (SELECT DISTINCT * FROM f)
SELECT DISTINCT a.mesh, a.part AS l, b.part AS r FROM g a JOIN g b ON a.mesh = b.mesh AND a.key = b.key AND a.part < b.part""",
}
