"""Round trips of the file formats."""

import json
import zipfile

from pyspark.sql import functions as F

from meshquarry.operators import bad_rows
from meshquarry.sources import files as S
from meshquarry.streaming import manifests as M


def test_obj(spark, tmp_path):
    v = spark.createDataFrame([("m", i, float(i), 0.5, -1.0) for i in range(4)], "mesh string, vertex_id long, x double, y double, z double")
    f = spark.createDataFrame([("m", 0, 0, 1, 2), ("m", 1, 1, 2, 3)], "mesh string, face_id long, v0 long, v1 long, v2 long")
    S.write_obj(v, f, str(tmp_path / "o"))
    lines = S.obj_lines(spark, str(tmp_path / "o" / "mesh=m" / "*.txt"))
    got = bad_rows.valid_vertices(lines).orderBy("line_no").collect()
    assert [(r.x, r.y, r.z) for r in got] == [(float(i), 0.5, -1.0) for i in range(4)]
    assert [r.face_tokens for r in bad_rows.valid_faces(lines).orderBy("line_no").collect()] == [["1", "2", "3"], ["2", "3", "4"]]
    n = S.normalised_obj(lines.select("obj_file", "line_no", "raw_line"), lines.select("obj_file").distinct().select("obj_file", *(F.lit(x).alias(c) for c, x in (("cx", 1.0), ("cy", 0.0), ("cz", 0.0), ("scale", 2.0)))))
    assert sorted(r.raw_line for r in n.collect())[-1] == "v 1 0.25 -0.5"


GMSH = "$MeshFormat\n2.2 0 8\n$EndMeshFormat\n$Nodes\n5\n10 0 0 0\n20 1 0 0\n30 0 1 0\n40 0 0 1\n50 0 0 -1\n$EndNodes\n$Elements\n3\n1 15 2 0 0 10\n2 4 2 0 0 10 20 30 40\n3 4 2 0 0 10 20 30 50\n$EndElements\n"


def test_gmsh(spark, tmp_path):
    (tmp_path / "a.msh").write_text(GMSH)
    v, f, t = S.read_gmsh(spark, str(tmp_path / "a.msh"))
    assert v.count() == 5 and f.count() == 0
    assert [(r.v0, r.v1, r.v2, r.v3) for r in t.orderBy("tet_id").collect()] == [(0, 1, 2, 3), (0, 1, 2, 4)]
    (tmp_path / "b.msh").write_text(S.gmsh_text(v, f, t).first().text)
    v2, _, t2 = S.read_gmsh(spark, str(tmp_path / "b.msh"))
    assert sorted(v2.drop("file").collect()) == sorted(v.drop("file").collect()) and sorted(t2.drop("file").collect()) == sorted(t.drop("file").collect())
    c = S.gmsh_counts(spark, str(tmp_path / "b.msh")).first()
    assert (c.nodes, c.elements) == (5, 2)


def test_segments_and_boxes(spark, tmp_path):
    m = spark.createDataFrame([("f", 0, 5), ("f", 0, 3), ("f", 1, 1)], "file string, part_id long, tet_id long")
    text = S.segment_text(m).first().text
    assert text == "2\n1\n3 5\n"
    (tmp_path / "s.txt").write_text(text)
    assert [(r.part_id, r.tet_id) for r in S.read_segments(spark, str(tmp_path / "s.txt")).orderBy("part_id", "tet_id").collect()] == [(0, 1), (1, 3), (1, 5)]
    (tmp_path / "b.json").write_text(json.dumps([{"bounds": [0, 0, 0, 1, 1, 1]}, {"bounds": [0, 0, 0, 2, 2, 2], "rotation": [0, 1, 0, 1, 0, 0, 0, 0, 1]}]))
    b = S.read_box_params(spark, str(tmp_path / "b.json"))
    assert [r.max_x for r in b.orderBy("bbox_idx").collect()] == [1, 2]
    again = json.loads(S.box_params_text(b).first().text)
    assert again[0]["rotation"] == [1, 0, 0, 0, 1, 0, 0, 0, 1] and again[1]["bounds"] == [0, 0, 0, 2, 2, 2]


def test_manifest_and_lists(spark, tmp_path):
    (tmp_path / "merge_manifest.jsonl").write_text('{"mesh_id": "a", "status": "success"}\n\n{bad\n{"stage": "x", "mesh_id": "b"}\n')
    got = sorted((r.stage, r.mesh_id) for r in S.read_manifest(spark, str(tmp_path / "merge_manifest.jsonl")).collect())
    assert got == [("merge", "a"), ("x", "b")]
    S.append_manifest(S.read_manifest(spark, str(tmp_path / "merge_manifest.jsonl")), str(tmp_path / "out"), by_stage=True)
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    (tmp_path / "l.txt").write_text("a # note\n# all\n\n b\n")
    assert [r.path for r in S.expand_list(spark, str(tmp_path / "l.txt")).collect()] == ["a", "b"]
    (tmp_path / "m.tsv").write_text("\tchair__1\tx/y/z\n\tm2\troot/sofa/m2/model.obj\n")
    assert [r.category for r in S.read_mesh_list(spark, str(tmp_path / "m.tsv")).collect()] == ["chair", "sofa"]


def test_discovery_zip_cache(spark, tmp_path):
    for c, m in (("a", "1"), ("a", "2"), ("b", "3")):
        (tmp_path / "r" / c / m).mkdir(parents=True)
        (tmp_path / "r" / c / m / "model.obj").write_text("v 0 0 0\n")
    got = S.discover(spark, str(tmp_path / "r"), limit=1)
    assert sorted((r.category, r.mesh_id) for r in got.collect()) == [("a", "1"), ("b", "3")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/model.obj", "v 1 1 1\n")
        z.writestr("d/readme.txt", "x")
    assert [r.member for r in S.zip_members(spark, str(tmp_path / "z.zip"), ".obj").collect()] == ["d/model.obj"]
    d = spark.createDataFrame([("x", 1), ("x", 1), (None, 2)], "a string, b int")
    k = [r.k for r in d.withColumn("k", S.cache_key(d, ["b", "a"])).collect()]
    assert k[0] == k[1] != k[2] and len(k[2]) == 24
    hit, miss = S.split_cached(d.withColumn("k", S.cache_key(d, ["a", "b"])), spark.createDataFrame([(k[0],)], "k string"), "k")
    assert (hit.count(), miss.count()) == (2, 1)


def test_streams(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.json").write_text('{"stage": "x", "mesh_id": "1", "status": "failed", "finished_at": 10.0}\n{"stage": "x", "mesh_id": "1", "status": "failed", "finished_at": 10.0}\n')
    schema = "stage string, mesh_id string, status string, finished_at double"
    s = M.manifest_stream(spark, str(d), schema, "finished_at")
    assert M.run_to_table(s).count() == 1
    out = str(tmp_path / "state")
    raw = spark.readStream.schema(schema).json(str(d))
    M.keep_latest(raw, out, ["stage", "mesh_id"], ["finished_at"]).awaitTermination()
    (d / "b.json").write_text('{"stage": "x", "mesh_id": "1", "status": "success", "finished_at": 20.0}\n')
    M.keep_latest(raw, out, ["stage", "mesh_id"], ["finished_at"]).awaitTermination()
    assert [r.status for r in spark.read.schema(schema).parquet(f"{out}/v=1").collect()] == ["success"]


def test_lines_of_split_files(spark, tmp_path):
    want = {}
    for k in range(3):
        lines = [f"file {k} line {i}" if i % 7 else "" for i in range(4000 * k + 5)]
        (tmp_path / f"{k}.txt").write_text("\n".join(lines) + "\n")
        want |= {(k, i + 1): x for i, x in enumerate(lines)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        d = S.read_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
        assert {(int(r.file[-5]), r.line_no): r.line for r in d.collect()} == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tables_traces_lists(spark, tmp_path):
    d = spark.createDataFrame([("a,b", "x\ty"), (None, "z")], "p string, q string")
    for ending in ("csv", "tsv", "jsonl"):
        path = str(tmp_path / f"t.{ending}")
        d.write.json(path) if ending == "jsonl" else d.write.csv(path, header=True, sep="\t" if ending == "tsv" else ",")
        assert sorted(S.read_table(spark, path, "p string, q string").collect(), key=str) == sorted(d.collect(), key=str), ending
    (tmp_path / "trace_w_1.jsonl").write_text('{"a": 1}\n\n  \n{"a": 2}\n')
    t = S.read_traces(spark, str(tmp_path / "trace_w_1.jsonl")).orderBy("line_no").collect()
    assert [(r.trace_file, r.line_no, r.payload) for r in t] == [("trace_w_1.jsonl", 1, '{"a": 1}'), ("trace_w_1.jsonl", 4, '{"a": 2}')] and t[0].written_at
    S.write_mesh_list(spark.createDataFrame([("c", "m", "r/c/m/x.obj"), (None, "k__1", "p")], "category string, mesh_id string, path string"), str(tmp_path / "list"))
    assert sorted((r.category, r.mesh_id) for r in S.read_mesh_list(spark, str(tmp_path / "list")).collect()) == [("c", "m"), ("k", "k__1")]


def test_partitions_parts_and_box_meshes(spark, tmp_path):
    m = spark.createDataFrame([("f", 0, 5), ("f", 0, 3), ("f", 0, 3), ("f", 1, 1)], "file string, part_id long, tet_id long")
    text = S.partition_json_text(m).first().text
    assert text == '{"partitions":[[1],[3,5]]}'
    (tmp_path / "a.json").write_text(text)
    (tmp_path / "b.json").write_text("[[4, 2, 4], [], [9]]")
    got = sorted((r.file[-6:], r.part_id, r.tet_id) for r in S.read_partition_json(spark, str(tmp_path / "*.json")).collect())
    assert got == [("a.json", 0, 1), ("a.json", 1, 3), ("a.json", 1, 5), ("b.json", 0, 2), ("b.json", 0, 4), ("b.json", 1, 9)]
    rows = ["v 0 0 0", "v 1 0 0", "usemtl a", "v 0 1 0", "f 1 2 3", "usemtl b", "v 5 5 5", "f 4/1 -2/2 2//1", "f 9 1 2"]
    l = spark.createDataFrame([("o", i + 1, x) for i, x in enumerate(rows)], "file string, line_no long, line string")
    v, f = S.part_meshes(l)
    assert sorted((r.part, r.corners) for r in f.collect()) == [(1, [0, 1, 2]), (2, [2, 1, 0])]
    assert sorted((r.part, r.vertex_id, r.x) for r in v.collect()) == [(1, 0, 0.0), (1, 1, 1.0), (1, 2, 0.0), (2, 0, 1.0), (2, 1, 0.0), (2, 2, 5.0)]
    b = spark.createDataFrame([("x", 0, 0.0, 0.0, 0.0, 1.0, 2.0, 3.0), ("x", 1, 1.0, 1.0, 1.0, 2.0, 2.0, 2.0)], "file string, bbox_idx int, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")
    S.write_texts(S.box_obj_text(b), str(tmp_path / "boxes"))
    v, f = S.part_meshes(S.read_lines(spark, str(tmp_path / "boxes" / "file=x")).select("file", "line_no", "line"))
    p = {r.vertex_id: (r.x, r.y, r.z) for r in v.collect()}
    volume = sum((lambda a, b, c: a[0] * (b[1] * c[2] - b[2] * c[1]) + a[1] * (b[2] * c[0] - b[0] * c[2]) + a[2] * (b[0] * c[1] - b[1] * c[0]))(*(p[i] for i in r.corners)) / 6 for r in f.collect())
    assert len(p) == 16 and abs(volume - 7.0) < 1e-9


def test_complete_folders(spark, tmp_path):
    for m, names in (("1", ("a.obj", "b.json")), ("2", ("a.obj",))):
        (tmp_path / "r" / "c" / m).mkdir(parents=True)
        for n in names:
            (tmp_path / "r" / "c" / m / n).write_text("x")
    assert sorted((r.mesh_id, r.missing) for r in S.complete_folders(spark, str(tmp_path / "r"), ["b.json", "a.obj"]).collect()) == [("1", []), ("2", ["b.json"])]
