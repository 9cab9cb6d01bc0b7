"""Queries that write the given tables in the file formats, to the shared folder, and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquarry.functions import boxes as B
from meshquarry.functions.text import name_key
from meshquarry.operators import bad_rows
from meshquarry.operators import spatial as S
from meshquarry.plans import frames as D
from meshquarry.plans.manifests import K
from meshquarry.plans.proposals import _AT
from meshquarry.operators.proposals import top_boxes
from meshquarry.session import shared_dir, spill, table
from meshquarry.sources import files as R

S_ = SparkSession
#: Meshes that the orders' customers are gathered into, one file each.
MESHES = 25


def _folder(spark: S_, name: str) -> str:
    """A new folder in the shared one; its files go when the process ends."""
    from meshquarry import session

    path = f"{shared_dir(spark)}/meshquarry/{name}-{uuid.uuid4().hex}"
    session._written.append((spark, path))
    return path


def _meshes(spark: S_, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, surface faces, tets) of the meshes, by mesh as text."""
    t = D.tets(spark, d).withColumn("mesh", F.concat(F.lit("m"), F.pmod("mesh", F.lit(MESHES)).cast("string")))
    v = t.select("mesh").distinct().select("mesh", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("vertex_id"))
    v = v.select("mesh", "vertex_id", *(f(F.col("vertex_id")).cast("double").alias(a) for a, f in _AT.items()))
    f = S.surface_faces(t, "mesh").select("mesh", F.col("tet_id").alias("face_id"), *(F.col("face")[i].alias(f"v{i}") for i in range(3)))
    return v, f, t


def gmsh_files(spark: S_, d: str) -> DataFrame:
    """Tetrahedra as Gmsh 2.2 files, read back: counts in the headers and checksums of the tetrahedra."""
    v, f, t = _meshes(spark, d)
    at = _folder(spark, "gmsh")
    R.write_texts(R.gmsh_text(v, f, t, "mesh"), at, ["mesh"])
    mesh = R.folder_key(F.col("file"), "mesh").alias("mesh")
    c = R.gmsh_counts(spark, f"{at}/*").select(mesh, "nodes", "elements")
    back = R.read_gmsh(spark, f"{at}/*")[2].select(mesh, *(f"v{i}" for i in range(4)))
    return back.groupBy("mesh").agg(F.count("*").alias("tets"), F.sum(F.col("v0") + 10 * F.col("v1") + 100 * F.col("v2") + 1000 * F.col("v3")).alias("corners")).join(c, "mesh")


def obj_files(spark: S_, d: str) -> DataFrame:
    """Surfaces as OBJ files, read back by the strict parser."""
    v, f, _ = _meshes(spark, d)
    at = _folder(spark, "obj")
    R.write_obj(v, f, at)
    l = R.obj_lines(spark, f"{at}/*")
    l = spill(l, "lines")
    mesh = R.folder_key(F.col("obj_file"), "mesh").alias("mesh")
    n = bad_rows.valid_faces(l).select(mesh, F.transform("face_tokens", lambda x: x.cast("long")).alias("c")).groupBy("mesh").agg(F.count("*").alias("faces"), F.sum(F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x)).alias("corners"))
    return n.join(bad_rows.valid_vertices(l).select(mesh, *B.AXES).groupBy("mesh").agg(F.count("*").alias("vertices"), F.sum(F.col("x") + F.col("y") + F.col("z")).alias("coordinates")), "mesh")


def segment_files(spark: S_, d: str) -> DataFrame:
    """Parts of tetrahedra as segment files and as JSON partitions, both read back."""
    t = _meshes(spark, d)[2].select("mesh", F.pmod("tet_id", F.lit(4)).alias("part_id"), "tet_id")
    out = None
    for form, text, read in (("segment", R.segment_text, R.read_segments), ("json", R.partition_json_text, R.read_partition_json)):
        at = _folder(spark, form)
        R.write_texts(text(t, "mesh"), at, ["mesh"])
        back = read(spark, f"{at}/*").select(F.lit(form).alias("form"), R.folder_key(F.col("file"), "mesh").alias("mesh"), "part_id", "tet_id")
        out = back if out is None else out.union(back)
    p = out.groupBy("form", "mesh", "part_id").agg(F.count("*").alias("tets"), F.min("tet_id").alias("first"), F.sum("tet_id").alias("ids"))
    return p


def box_files(spark: S_, d: str) -> DataFrame:
    """Boxes as parameter files with rotation, read back (S13), and as box meshes."""
    b = D.indexed_boxes(spark, d).withColumn("set", F.concat(F.lit("s"), F.pmod("mesh", F.lit(MESHES)).cast("string")))
    b = b.select("set", (F.col("mesh") * 3 + F.col("bbox_idx")).alias("bbox_idx"), *B.BOUNDS, F.array(*(F.lit(float(i % 4 == 0)) for i in range(9))).alias("rot"))
    at, obj = _folder(spark, "boxes"), _folder(spark, "boxmesh")
    R.write_texts(R.box_params_text(b, "set"), at, ["set"])
    R.write_texts(R.box_obj_text(b, "set"), obj, ["set"])
    back = R.read_box_params(spark, f"{at}/*").select(R.folder_key(F.col("file"), "set").alias("set"), *B.BOUNDS, "rot")
    n = back.groupBy("set").agg(F.count("*").alias("boxes"), F.round(F.sum(B.total(B.box())), 6).alias("bounds"), F.sum(F.aggregate("rot", F.lit(0.0), lambda a, x: a + x)).alias("rotation"))
    lines = R.read_lines(spark, f"{obj}/*").groupBy(R.folder_key(F.col("file"), "set").alias("set")).agg(F.count_if(F.col("line").startswith("v ")).alias("vertices"), F.count_if(F.col("line").startswith("f ")).alias("faces"))
    return n.join(lines, "set")


def manifest_files(spark: S_, d: str) -> DataFrame:
    """Stage records appended as JSON lines, then replaced by stage, read back."""
    r = table(spark, d, "stage_record").withColumn("stage", name_key(F.col("stage"))).filter(F.col("stage") != "")
    at = _folder(spark, "manifest")
    R.append_manifest(r.drop("record_id"), at, by_stage=True)
    again = _folder(spark, "log")
    R.append_manifest(r.filter(F.col("status") == "failed").drop("record_id"), again)
    R.append_manifest(r.filter(F.col("status") == "success").drop("record_id"), again)
    m = spark.read.schema(R.MANIFEST).json(at).groupBy("stage").agg(F.count("*").alias("n"), F.count("error").alias("errors"), F.sum(F.coalesce(F.size("command"), F.lit(0))).alias("words"))
    l = R.read_manifest(spark, f"{again}/*.json").groupBy("stage").agg(F.count("*").alias("logged"), F.count_if(F.col("status") == "failed").alias("failed"))
    return m.join(l, "stage", "left")


def table_files(spark: S_, d: str) -> DataFrame:
    """Customers as CSV, TSV and JSON lines, read by the ending of the name."""
    c, out = table(spark, d, "customer"), None
    for ending in ("csv", "tsv", "jsonl"):
        at = f"{_folder(spark, 'table')}.{ending}"
        c.write.json(at) if ending == "jsonl" else c.write.csv(at, header=True, sep="\t" if ending == "tsv" else ",")
        r = R.read_table(spark, at, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
        r = r.groupBy(F.lit(ending).alias("form"), "c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
        out = r if out is None else out.union(r)
    return out


def mesh_list_files(spark: S_, d: str) -> DataFrame:
    """Mesh models as a tab-separated list, read back, and expanded from a list of paths."""
    m = table(spark, d, "mesh_model").select(F.when(F.col("mesh_no") % 2 == 0, F.col("category")).alias("category"), "mesh_id", F.concat(F.lit("root/"), F.coalesce("category", F.lit("none")), F.lit("/"), "mesh_id", F.lit("/model.obj")).alias("path"))
    at, paths = _folder(spark, "list"), _folder(spark, "paths")
    R.write_mesh_list(m, at)
    m.select(F.concat("path", F.lit("  # note"))).union(m.limit(0).select("path")).write.text(paths)
    n = R.expand_list(spark, paths).groupBy(F.split_part("path", F.lit("/"), F.lit(2)).alias("category")).agg(F.count("*").alias("listed"))
    return R.read_mesh_list(spark, at).groupBy("category").agg(F.count("*").alias("meshes"), F.countDistinct("mesh_id").alias("ids")).join(n, "category", "left")


def found_files(spark: S_, d: str) -> DataFrame:
    """One file per supplier in folders of its nation, discovered, and which folders lack the second file."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("category"), F.col("s_suppkey").alias("mesh"), F.col("s_name").alias("text"))
    at = _folder(spark, "found")
    R.write_texts(s, at, ["category", "mesh"])
    f = R.discover(spark, at, "*.txt", limit=3)
    return f.select(F.split_part("category", F.lit("="), F.lit(2)).cast("int").alias("category"), F.split_part("mesh_id", F.lit("="), F.lit(2)).cast("long").alias("mesh"), "bytes")


def obj_part_meshes(spark: S_, d: str) -> DataFrame:
    """Parts of each OBJ file at material lines, with vertices of their own."""
    l = table(spark, d, "obj_line").select(F.col("obj_file").alias("file"), "line_no", F.col("raw_line").alias("line"))
    v, f = R.part_meshes(spill(l, "lines"))
    n = f.groupBy("file", "part").agg(F.count("*").alias("faces"), F.sum(F.size("corners")).alias("corners"))
    return n.join(v.groupBy("file", "part").agg(F.count("*").alias("vertices")), ["file", "part"])


def proposal_labels(spark: S_, d: str) -> DataFrame:
    """The two largest boxes of each mesh as nested labels, written as JSON lines and read back."""
    b = top_boxes(D.part_boxes(spark, d), F.col("mesh"), 2)
    at = _folder(spark, "labels")
    b.withColumnRenamed("key", "mesh").write.json(at)
    r = spark.read.schema("mesh long, boxes array<struct<volume: double, corners: array<double>>>").json(at)
    every = lambda x: F.aggregate(x["corners"], F.lit(0.0), lambda a, y: a + y)
    return r.select("mesh", F.size("boxes").alias("boxes"), F.round(F.col("boxes")[0]["volume"], 9).alias("largest"), F.round(F.aggregate(F.transform("boxes", every), F.lit(0.0), lambda a, x: a + x), 5).alias("corners"))


def cache_keys(spark: S_, d: str) -> DataFrame:
    """Which models a cache of the first half of the numbers already holds, by content key."""
    m = table(spark, d, "mesh_model").select("mesh_no", "category", "vertex_count")
    k = spill(m.withColumn("key", R.cache_key(m, ["category", "vertex_count"])), "keys")
    hit, miss = R.split_cached(k, k.filter(F.col("mesh_no") % 2 == 0), "key")
    return hit.withColumn("cached", F.lit(True)).union(miss.withColumn("cached", F.lit(False))).select("mesh_no", "key", "cached")


QUERIES = {f.__name__: f for f in (gmsh_files, obj_files, segment_files, box_files, manifest_files, table_files, mesh_list_files, found_files, obj_part_meshes, proposal_labels, cache_keys)}

_M = D.TETS.replace("o_custkey AS mesh", f"'m' || (o_custkey % {MESHES}) AS mesh")
_SURFACE = "f AS (SELECT mesh, tet_id, unnest([[v0,v1,v2],[v0,v1,v3],[v0,v2,v3],[v1,v2,v3]]) AS face FROM t), s AS (SELECT mesh, any_value(face) AS face FROM f GROUP BY mesh, list_sort(face) HAVING count(*) = 1)"
_SETS = f"{D.BOXES}, x AS (SELECT 's' || (mesh % {MESHES}) AS set, * FROM b)"
_STAGE = f"SELECT {K('stage')} AS stage, * EXCLUDE (stage) FROM stage_record"
ORACLE = {
    "gmsh_files": f"""WITH {_M}, {_SURFACE}, n AS (SELECT mesh, count(*) AS n FROM s GROUP BY 1)
SELECT t.mesh, count(*) AS tets, sum(v0 + 10 * v1 + 100 * v2 + 1000 * v3) AS corners, 10 AS nodes, count(*) + coalesce(any_value(n), 0) AS elements FROM t LEFT JOIN n USING (mesh) GROUP BY 1""",
    "obj_files": f"""WITH {_M}, {_SURFACE} SELECT mesh, count(*) AS faces, sum(list_sum(face) + 3) AS corners, 10 AS vertices, (SELECT sum(v % 3 + v // 3 % 3 + v * v % 5 * 0.5::DOUBLE) FROM range(10) r(v)) AS coordinates FROM s GROUP BY 1""",
    "segment_files": f"""WITH {_M}, p AS (SELECT mesh, tet_id % 4 AS part, count(*) AS tets, min(tet_id) AS first, sum(tet_id) AS ids FROM t GROUP BY 1, 2)
SELECT unnest(['segment', 'json']) AS form, mesh, row_number() OVER (PARTITION BY mesh ORDER BY first) - 1 AS part_id, tets, first, ids FROM p""",
    "box_files": f"WITH {_SETS} SELECT set, count(*) AS boxes, round(sum(min_x + min_y + min_z + max_x + max_y + max_z), 6) AS bounds, 3.0::DOUBLE * count(*) AS rotation, 8 * count(*) AS vertices, 12 * count(*) AS faces FROM x GROUP BY 1",
    "manifest_files": f"WITH r AS ({_STAGE}) SELECT stage, count(*) AS n, count(error) AS errors, sum(coalesce(len(command), 0)) AS words, nullif(count(*) FILTER (WHERE status IN ('failed', 'success')), 0) AS logged, CASE WHEN count(*) FILTER (WHERE status IN ('failed', 'success')) > 0 THEN count(*) FILTER (WHERE status = 'failed') END AS failed FROM r WHERE stage <> '' GROUP BY 1",
    "table_files": "SELECT unnest(['csv', 'tsv', 'jsonl']) AS form, c_mktsegment, n, keys, balance FROM (SELECT c_mktsegment, count(*) AS n, sum(c_custkey) AS keys, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1)",
    "mesh_list_files": "SELECT coalesce(category, 'none') AS category, count(*) AS meshes, count(DISTINCT mesh_id) AS ids, count(*) AS listed FROM mesh_model GROUP BY 1",
    "found_files": "SELECT s_nationkey AS category, s_suppkey AS mesh, octet_length(encode(s_name)) + 1 AS bytes FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY 'mesh=' || s_suppkey) <= 3",
    "obj_part_meshes": r"""WITH l AS (SELECT obj_file AS file, line_no, string_split_regex(trim(raw_line), '[ \t]+') AS p, sum(regexp_matches(raw_line, '^\s*usemtl(\s|$)')::INT) OVER (PARTITION BY obj_file ORDER BY line_no) AS part FROM obj_line),
n AS (SELECT file, count(*) AS n FROM l WHERE p[1] = 'v' GROUP BY 1), t AS (SELECT file, part, line_no, unnest(p[2:]) AS t FROM l WHERE p[1] = 'f' AND len(p) >= 4),
i AS (SELECT file, part, line_no, CASE WHEN regexp_full_match(split_part(t, '/', 1), '[+-]?[0-9]+\s*') THEN TRY_CAST(split_part(t, '/', 1) AS BIGINT) END AS i FROM t),
g AS (SELECT i.*, n, CASE WHEN i < 0 THEN n + i + 1 ELSE i END AS g FROM i JOIN n USING (file)), ok AS (SELECT * FROM g QUALIFY bool_and(coalesce(g BETWEEN 1 AND n, false)) OVER (PARTITION BY file, line_no))
SELECT file, part, count(DISTINCT line_no) AS faces, count(*) AS corners, count(DISTINCT g) AS vertices FROM ok GROUP BY 1, 2""",
    "proposal_labels": f"""WITH {D.BOXES}, r AS (SELECT mesh, {D.VOLUME} AS v, 4 * (min_x + min_y + min_z + max_x + max_y + max_z) AS c, row_number() OVER (PARTITION BY mesh ORDER BY {D.VOLUME} DESC, {", ".join(B.BOUNDS)}) AS k FROM b)
SELECT mesh, count(*) AS boxes, round(max(v), 9) AS largest, round(sum(c), 5) AS corners FROM r WHERE k <= 2 GROUP BY 1""",
    "cache_keys": """WITH k AS (SELECT mesh_no, sha256('{"category":' || coalesce('"' || category || '"', 'null') || ',"vertex_count":' || coalesce(vertex_count::VARCHAR, 'null') || '}')[:24] AS key FROM mesh_model)
SELECT mesh_no, key, key IN (SELECT key FROM k WHERE mesh_no % 2 = 0) AS cached FROM k""",
}
