"""Readers and writers of the text formats: OBJ, Gmsh 2.2, segments, box parameters, manifests, mesh lists, traces, archives, cache keys.

Readers are text or binary scans; everything after the scan is column expressions, so files
are read in parallel and in pieces. Only formats whose sections need the line order number
their lines with the file.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshquarry.functions import boxes as B
from meshquarry.operators.ranking import row_numbers, running_sum
from meshquarry.session import salted_join, spill


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, line_no (from 1), line of text files of any size.

    A large file is read in blocks by several tasks. Numbers run on within a task, so a line's place is its distance to its
    block's first line, plus the lines of the blocks before it. The lines are written once, as numbers of a second
    reading needn't be the same.
    """
    m = F.col("_metadata")
    t = spark.read.text(path).select(m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("i"), F.col("value").alias("line"))
    t = spill(t, "lines")
    blocks = t.groupBy("file", "block").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    w = W.partitionBy("file").orderBy("block")  # one row per block
    blocks = blocks.select("file", "block", "first", (F.sum("n").over(w) - F.col("n")).alias("before"))
    j = salted_join(t.withColumn("_k", F.struct("file", "block")), blocks.select(F.struct("file", "block").alias("_k"), "first", "before"), "_k", F.col("i"), how="inner")
    return j.select("file", (F.col("before") + F.col("i") - F.col("first") + 1).alias("line_no"), "line")


def write_texts(texts: DataFrame, path: str, keys: Sequence[str] = ("file",)) -> None:
    """One text file per row of ``texts`` (keys, text), in folders ``key=value`` under ``path``."""
    texts.select(*keys, F.rtrim("text", F.lit("\n")).alias("value")).repartition(*keys).write.partitionBy(*keys).mode("overwrite").text(path)


def folder_key(file: Column, key: str) -> Column:
    """The value of ``key=value`` in a path."""
    return F.nullif(F.url_decode(F.regexp_extract(file, rf"(?:^|/){key}=([^/]*)/", 1)), F.lit(""))


def obj_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """OBJ files as the line table that :mod:`meshquarry.operators.bad_rows` parses."""
    l = read_lines(spark, path)
    return l.select(F.xxhash64("file", "line_no").alias("line_id"), F.col("file").alias("obj_file"), "line_no", F.col("line").alias("raw_line"))


def general(x: Column, digits: int) -> Column:
    """A number with ``digits`` significant digits and no trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}g", x), r"(\.\d*?)0+(?=e|$)", "$1"), r"\.(?=e|$)", "")


def write_obj(vertices: DataFrame, faces: DataFrame, path: str, digits: int = 9) -> None:
    """One text file per mesh folder (mesh=...): v lines in order of vertex_id, then f lines, 1-based.

    ``vertices`` has mesh, vertex_id, x, y, z; ``faces`` mesh, face_id, v0, v1, v2. Each mesh is sorted within its task only.
    """
    v = vertices.select("mesh", F.lit(0).alias("kind"), F.col("vertex_id").cast("long").alias("i"), F.concat_ws(" ", F.lit("v"), *(general(F.col(a), digits) for a in B.AXES)).alias("value"))
    f = faces.select("mesh", F.lit(1).alias("kind"), F.col("face_id").cast("long").alias("i"), F.format_string("f %d %d %d", F.col("v0") + 1, F.col("v1") + 1, F.col("v2") + 1).alias("value"))
    v.union(f).repartition("mesh").sortWithinPartitions("mesh", "kind", "i").select("mesh", "value").write.partitionBy("mesh").mode("overwrite").text(path)


#: The twelve triangles of a box by its corners (bit k of a corner picks max on axis k), outward (fixed values).
BOX_FACES = ((0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5))


def box_obj_text(boxes: DataFrame, key: str = "file", digits: int = 9) -> DataFrame:
    """key, text: the boxes of each set (bbox_idx and bounds) as one OBJ mesh, eight vertices and twelve triangles each."""
    v = F.transform(B.corners(B.box()), lambda c: F.concat_ws(" ", F.lit("v"), *(general(c[a], digits) for a in B.AXES)))
    g = boxes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("bbox_idx", v.alias("v")))).alias("b"))
    faces = F.array(*(F.array(*(F.lit(i) for i in f)) for f in BOX_FACES))
    each = lambda k: F.transform(faces, lambda f: F.format_string("f %d %d %d", *(f[i] + 8 * k + 1 for i in range(3))))
    lines = F.concat(F.flatten(F.transform("b", lambda x: x["v"])), F.flatten(F.transform("b", lambda _, k: each(k))))
    return g.select(key, F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("text"))


def normalised_obj(lines: DataFrame, stats: DataFrame, digits: int = 9) -> DataFrame:
    """``lines`` (obj_file, line_no, raw_line) with v lines moved and scaled, all else kept, as are further fields of v lines.

    ``stats`` has obj_file, cx, cy, cz and scale.
    """
    j = lines.join(stats, "obj_file", "left")
    p = F.split(F.trim("raw_line"), r"[ \t]+")
    xyz = [F.expr(f"try_cast(split(trim(raw_line), '[ \\t]+')[{i + 1}] AS DOUBLE)") for i in range(3)]
    moved = [general((x - F.col(c)) / F.col("scale"), digits) for x, c in zip(xyz, ("cx", "cy", "cz"))]
    new = F.concat_ws(" ", F.lit("v"), *moved, F.array_join(F.slice(p, F.lit(5), F.greatest(F.lit(0), F.size(p) - 4)), " "))
    ok = F.col("raw_line").rlike(r"^\s*v\s") & (F.size(p) >= 4) & F.col("cx").isNotNull()
    for x in xyz:
        ok = ok & x.isNotNull()
    return j.withColumn("raw_line", F.when(ok, F.rtrim(new)).otherwise(F.col("raw_line"))).select(*lines.columns)


def obj_parts(lines: DataFrame, boundary: str = "usemtl") -> DataFrame:
    """file, line_no, line and part: 0 before the first boundary line, then one more at each (``o``, ``g`` or ``usemtl``)."""
    at = F.col("line").rlike(rf"^\s*(?:{boundary})(?:\s|$)").cast("int")
    return running_sum(lines.withColumn("_at", at), ["file"], ["line_no"], "_at", "part").drop("_at")


def part_meshes(lines: DataFrame, boundary: str = "usemtl") -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of the parts of OBJ files: file, part, vertex_id (from 0 in each part), x, y, z, and file, part, line_no, corners.

    ``lines`` as for :func:`obj_parts`. A face keeps its corner order; a part has the vertices that its faces use, in the
    order of the file. Negative indices count from the end of the file; faces that name no vertex of the file are dropped.
    """
    l = obj_parts(lines, boundary)
    l = spill(l, "parts")
    p = F.split(F.trim("line"), r"[ \t]+")
    v = row_numbers(l.filter(p[0] == "v").select("file", "line_no", *(F.get(p, F.lit(i + 1)).try_cast("double").alias(a) for i, a in enumerate(B.AXES))), ["file"], ["line_no"], "g")
    v = spill(v, "vertices")
    f = l.filter((p[0] == "f") & (F.size(p) >= 4)).select("file", "part", "line_no", F.posexplode(F.slice(p, F.lit(2), F.size(p))).alias("k", "t"))
    n = v.groupBy("file").agg(F.count("*").alias("n"))
    f = f.join(n, "file").withColumn("i", F.split_part("t", F.lit("/"), F.lit(1)).try_cast("long"))
    f = f.withColumn("g", F.when(F.col("i") < 0, F.col("n") + F.col("i") + 1).otherwise(F.col("i")))
    bad = f.filter(F.col("g").isNull() | (F.col("g") < 1) | (F.col("g") > F.col("n"))).select("file", "line_no").distinct()
    f = f.join(bad, ["file", "line_no"], "left_anti")
    f = spill(f, "corners")
    local = row_numbers(f.select("file", "part", "g").distinct(), ["file", "part"], ["g"], "vertex_id").withColumn("vertex_id", F.col("vertex_id") - 1)
    local = spill(local, "local")
    vertices = local.join(v, ["file", "g"]).select("file", "part", "vertex_id", *B.AXES)
    faces = f.join(local, ["file", "part", "g"]).groupBy("file", "part", "line_no").agg(F.array_sort(F.collect_list(F.struct("k", "vertex_id"))).alias("c"))
    return vertices, faces.select("file", "part", "line_no", F.transform("c", lambda x: x["vertex_id"]).alias("corners"))


def read_gmsh(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, faces, tets) of Gmsh 2.2 text files; node ids become 0-based positions, other element types are dropped."""
    l = read_lines(spark, path)
    tag = F.when(F.col("line").startswith("$"), F.trim("line"))
    s = spill(running_sum(l.withColumn("_at", tag.isNotNull().cast("int")), ["file"], ["line_no"], "_at", "_section"), "sections")
    starts = s.filter(F.col("_at") == 1).select(F.struct("file", "_section").alias("_k"), F.trim("line").alias("section"), F.col("line_no").alias("at"))
    s = salted_join(s.withColumn("_k", F.struct("file", "_section")), starts, "_k", F.col("line_no"), how="inner")
    body = s.filter((F.col("_at") == 0) & (F.col("line_no") > F.col("at") + 1)).withColumn("p", F.split(F.trim("line"), r"\s+"))  # the first line is the count
    at = lambda i, t: F.get("p", F.lit(i)).try_cast(t)
    nodes = body.filter(F.col("section") == "$Nodes").select("file", "line_no", at(0, "long").alias("node"), *(at(i + 1, "double").alias(a) for i, a in enumerate(B.AXES)))
    nodes = row_numbers(nodes, ["file"], ["line_no"], "vertex_id").select("file", "node", (F.col("vertex_id") - 1).cast("long").alias("vertex_id"), *B.AXES)
    nodes = spill(nodes, "nodes")
    e = body.filter(F.col("section") == "$Elements").select("file", "line_no", "p", at(1, "int").alias("kind"), F.coalesce(at(2, "int"), F.lit(0)).alias("tags"))
    e = e.select("file", "line_no", "kind", F.transform(F.slice("p", F.col("tags") + 4, F.size("p")), lambda x: x.try_cast("long")).alias("ids"))

    def elements(kind: int, n: int, name: str) -> DataFrame:
        x = e.filter((F.col("kind") == kind) & (F.size("ids") == n)).select("file", "line_no", F.posexplode("ids").alias("k", "node")).join(nodes.select("file", "node", "vertex_id"), ["file", "node"])
        g = x.groupBy("file", "line_no").agg(*(F.max(F.when(F.col("k") == i, F.col("vertex_id"))).alias(f"v{i}") for i in range(n)))
        return row_numbers(g, ["file"], ["line_no"], name).select("file", (F.col(name) - 1).cast("long").alias(name), *(f"v{i}" for i in range(n)))

    return nodes.drop("node"), elements(2, 3, "face_id"), elements(4, 4, "tet_id")


def gmsh_text(vertices: DataFrame, faces: DataFrame, tets: DataFrame, key: str = "file") -> DataFrame:
    """key, text: each mesh as Gmsh 2.2, 1-based, faces before tets. The text of one mesh is one row, as it is one file."""
    node = vertices.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("vertex_id", *B.AXES))).alias("v"))
    f = faces.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("face_id", "v0", "v1", "v2"))).alias("f"))
    t = tets.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("tet_id", "v0", "v1", "v2", "v3"))).alias("t"))
    j = node.join(f, key, "left").join(t, key, "left")
    nf, nt = F.coalesce(F.size("f"), F.lit(0)), F.coalesce(F.size("t"), F.lit(0))
    nf, nt = F.greatest(nf, F.lit(0)), F.greatest(nt, F.lit(0))
    vs = F.transform("v", lambda x: F.format_string("%d %.17g %.17g %.17g", x["vertex_id"] + 1, x["x"], x["y"], x["z"]))
    fs = F.transform("f", lambda x, i: F.format_string("%d 2 2 0 0 %d %d %d", i + 1, x["v0"] + 1, x["v1"] + 1, x["v2"] + 1))
    ts = F.transform("t", lambda x, i: F.format_string("%d 4 2 0 0 %d %d %d %d", i + 1 + nf, x["v0"] + 1, x["v1"] + 1, x["v2"] + 1, x["v3"] + 1))
    none = F.array().cast("array<string>")
    head = F.array(F.lit("$MeshFormat"), F.lit("2.2 0 8"), F.lit("$EndMeshFormat"), F.lit("$Nodes"), F.size("v").cast("string"))
    mid = F.array(F.lit("$EndNodes"), F.lit("$Elements"), (nf + nt).cast("string"))
    return j.select(key, F.concat(F.array_join(F.concat(head, vs, mid, F.coalesce(fs, none), F.coalesce(ts, none), F.array(F.lit("$EndElements"))), "\n"), F.lit("\n")).alias("text"))


def gmsh_counts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, nodes, elements: the counts that head the sections."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    count = lambda s: F.regexp_extract("value", rf"\${s}\s+(\d+)", 1).try_cast("long")
    return t.select("file", count("Nodes").alias("nodes"), count("Elements").alias("elements"))


def read_segments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, part_id, tet_id of segment files: a count, then one line of ids per part; empty parts are passed over."""
    l = read_lines(spark, path).filter(F.col("line_no") > 1)
    ids = F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "")
    return l.select("file", (F.col("line_no") - 2).alias("part_id"), F.explode(F.array_sort(F.array_distinct(F.transform(ids, lambda x: x.cast("long"))))).alias("tet_id"))


def segment_text(members: DataFrame, key: str = "file") -> DataFrame:
    """key, text of the segment format from key, part_id, tet_id; parts in order of their first member."""
    p = members.groupBy(key, "part_id").agg(F.array_sort(F.collect_set("tet_id")).alias("ids"))
    g = p.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("ids")[0].alias("first"), F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("line")))).alias("s"))
    return g.select(key, F.concat(F.size("s").cast("string"), F.lit("\n"), F.array_join(F.transform("s", lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))


def partition_json_text(members: DataFrame, key: str = "file") -> DataFrame:
    """key, text: the parts of each mesh as ``{"partitions": [[...], ...]}``, sorted and unique, parts in order of their first member."""
    p = members.groupBy(key, "part_id").agg(F.array_sort(F.collect_set(F.col("tet_id").cast("long"))).alias("ids")).filter(F.size("ids") > 0)
    g = p.groupBy(key).agg(F.array_sort(F.collect_list("ids")).alias("partitions"))
    return g.select(key, F.to_json(F.struct("partitions")).alias("text"))


def read_partition_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, part_id, tet_id of partition files, a list of lists or an object that holds one; empty parts are passed over."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("v"))
    lists = F.coalesce(F.when(F.col("v").startswith("["), F.from_json("v", "array<array<bigint>>")), F.from_json("v", "partitions array<array<bigint>>")["partitions"])
    full = F.filter(lists, lambda x: F.size(x) > 0)
    return t.select("file", F.posexplode(full).alias("part_id", "ids")).select("file", "part_id", F.explode(F.array_sort(F.array_distinct("ids"))).alias("tet_id"))


BOX_JSON = "array<struct<bounds: array<double>, rotation: array<double>, partition: array<bigint>>>"


def read_box_params(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, bbox_idx, bounds, rot (identity where missing) and partition of box parameter files (a JSON list)."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", BOX_JSON).alias("b"))
    one = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    x = t.select("file", F.posexplode("b").alias("bbox_idx", "x")).filter(F.size("x.bounds") == 6)
    return x.select("file", "bbox_idx", *(F.col("x.bounds")[i].alias(c) for i, c in enumerate(B.BOUNDS)), F.coalesce("x.rotation", F.array(*(F.lit(v) for v in one))).alias("rot"), "x.partition")


def box_params_text(boxes: DataFrame, key: str = "file") -> DataFrame:
    """key, text: the boxes of each set as such a JSON list, in order of bbox_idx."""
    s = F.struct("bbox_idx", F.struct(F.array(*B.BOUNDS).alias("bounds"), F.col("rot").alias("rotation")).alias("x"))
    return boxes.groupBy(key).agg(F.array_sort(F.collect_list(s)).alias("b")).select(key, F.to_json(F.transform("b", lambda y: y["x"])).alias("text"))


MANIFEST = "stage string, category string, mesh_id string, status string, started_at double, finished_at double, output_path string, log_path string, command array<string>, error string, metadata string, _bad string"


def read_manifest(spark: SparkSession, path: str | list[str], keep_bad: bool = False) -> DataFrame:
    """Stage records of JSON line files; the stage defaults to the file's name. Lines that don't parse are dropped, or kept in ``_bad``."""
    m = spark.read.schema(MANIFEST).option("columnNameOfCorruptRecord", "_bad").json(path)
    name = F.regexp_extract("_metadata.file_name", r"^(.*?)(?:_manifest)?\.jsonl?$", 1)
    m = m.select("*", name.alias("_stage")).withColumn("stage", F.coalesce("stage", "_stage")).drop("_stage")
    return m if keep_bad else m.filter(F.col("_bad").isNull()).drop("_bad")


def append_manifest(records: DataFrame, path: str, by_stage: bool = False) -> None:
    """Append records as JSON lines, or with ``by_stage`` replace the folders of their stages."""
    if by_stage:
        records.write.partitionBy("stage").option("partitionOverwriteMode", "dynamic").mode("overwrite").json(path)
    else:
        records.write.mode("append").json(path)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV or TSV (with header) or JSON-lines data set by the ending of its name."""
    r = spark.read if schema is None else spark.read.schema(schema)
    ending = path.lower().rstrip("/").rsplit(".", 1)[-1]
    return r.csv(path, header=True, sep="\t" if ending == "tsv" else ",") if ending in ("csv", "tsv") else r.json(path)


def read_traces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """trace_file, written_at, line_no, payload of JSON-lines trace files, blank lines passed over: what :mod:`meshquarry.operators.drift` reads."""
    l = read_lines(spark, path)
    at = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("written_at")).groupBy("file").agg(F.max("written_at").alias("written_at"))
    t = salted_join(l.filter(F.trim("line") != ""), at, "file", F.col("line_no"))
    return t.select(F.element_at(F.split("file", "/"), -1).alias("trace_file"), "written_at", "line_no", F.col("line").alias("payload"))


def expand_list(spark: SparkSession, path: str) -> DataFrame:
    """path: the entries of a list file, without comments (#) and blank lines."""
    t = spark.read.text(path).select(F.trim(F.split_part("value", F.lit("#"), F.lit(1))).alias("path"))
    return t.filter(F.col("path") != "")


def read_mesh_list(spark: SparkSession, path: str) -> DataFrame:
    """category, mesh_id, path of a tab-separated mesh list; a missing category is the mesh's name before ``__``, else the folder's."""
    t = spark.read.csv(path, sep="\t", schema="category string, mesh_id string, path string").filter(F.col("mesh_id").isNotNull())
    return t.withColumn("category", F.coalesce(F.nullif(F.col("category"), F.lit("")), category_of("mesh_id", "path")))


def write_mesh_list(meshes: DataFrame, path: str) -> None:
    """A tab-separated mesh list of category, mesh_id and path."""
    meshes.select("category", "mesh_id", "path").write.mode("overwrite").csv(path, sep="\t")


def category_of(mesh: str, path: str) -> Column:
    prefix = F.when(F.col(mesh).contains("__"), F.split_part(mesh, F.lit("__"), F.lit(1)))
    folder = F.regexp_extract(path, r"([^/\\]+)[/\\][^/\\]+[/\\][^/\\]+$", 1)
    return F.coalesce(prefix, F.nullif(folder, F.lit("")))


def complete_folders(spark: SparkSession, root: str, required: Sequence[str]) -> DataFrame:
    """category, mesh_id, missing: the folders ``root/category/mesh`` and which of the required files they lack (empty: complete)."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.split("path", "/").alias("p"))
    g = f.groupBy(F.element_at("p", -3).alias("category"), F.element_at("p", -2).alias("mesh_id")).agg(F.collect_set(F.element_at("p", -1)).alias("have"))
    return g.select("category", "mesh_id", F.array_sort(F.array_except(F.array(*(F.lit(n) for n in required)), "have")).alias("missing"))


def discover(spark: SparkSession, root: str, name: str = "model.obj", categories: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """category, mesh_id, path, bytes of ``root/category/mesh/name``, without reading contents; the first ``limit`` per category by name."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root).select("path", F.col("length").alias("bytes"))
    p = F.split("path", "/")
    f = f.select(F.element_at(p, -3).alias("category"), F.element_at(p, -2).alias("mesh_id"), "path", "bytes")
    if categories:
        f = f.filter(F.col("category").isin(*categories))
    if limit is not None:
        f = f.withColumn("_r", F.row_number().over(W.partitionBy("category").orderBy("mesh_id"))).filter(F.col("_r") <= limit).drop("_r")
    return f


def zip_members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """archive, member, bytes, packed of the members of zip files whose name ends in ``suffix``, in order of archive and member.

    Of an archive on a mounted disk only the directory is read, whatever its size; elsewhere its bytes go through one row.
    """

    def members(archive: str, source: str | io.BytesIO) -> list[tuple]:
        with zipfile.ZipFile(source) as z:
            return [(archive, i.filename, i.file_size, i.compress_size) for i in z.infolist() if not i.is_dir() and i.filename.endswith(suffix)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            rows = [r for p, *c in zip(*columns) for r in members(p, io.BytesIO(c[0]) if c else unquote(urlparse(p).path))]
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["archive", "member", "bytes", "packed"])

    f = spark.read.format("binaryFile").load(path)
    kind = "archive string, member string, bytes long, packed long"
    mounted, other = f.filter(F.col("path").startswith("file:")).select("path"), f.filter(~F.col("path").startswith("file:")).select("path", "content")
    return mounted.mapInArrow(run, kind).union(other.mapInArrow(run, kind)).orderBy("archive", "member")


def cache_key(df: DataFrame, columns: Sequence[str]) -> Column:
    """24 hex digits over the canonical JSON of the columns in order of their names; equal inputs have equal keys."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256), 1, 24)


def split_cached(df: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): rows of ``df`` whose key is in ``cache``, and the rest."""
    return df.join(cache.select(key).distinct(), key, "left_semi"), df.join(cache.select(key).distinct(), key, "left_anti")


def one_json(df: DataFrame) -> str:
    """The first row as JSON text, for summary files of one row."""
    r = df.limit(1).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).first()
    return r.j if r else "{}"
