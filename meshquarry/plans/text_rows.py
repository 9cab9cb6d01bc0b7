"""Queries of the general data problems: drifting schemas and rows that fail to parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquarry.operators import bad_rows, drift
from meshquarry.session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.schema_changes(table(spark, sf_dir, "trace_line")).select("trace_file", "field_name", "change_kind")


def p5_trace_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.consistent_table(table(spark, sf_dir, "trace_line"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bad_rows.faulty_lines(table(spark, sf_dir, "obj_line"))


def p6_valid_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = bad_rows.valid_vertices(table(spark, sf_dir, "obj_line"))
    return v.groupBy("obj_file").agg(F.count("*").alias("n_vertices"), *(F.round(f(c), 6).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))))


def p6_valid_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = bad_rows.valid_faces(table(spark, sf_dir, "obj_line"))
    return f.groupBy("obj_file").agg(F.count("*").alias("n_faces"), F.sum(F.col("n_tokens") - 2).alias("n_triangles"))


QUERIES = {f.__name__: f for f in (p5_found, p5_trace_table, p6_found, p6_valid_vertices, p6_valid_faces)}

LINE = r"""
WITH l AS (SELECT line_id, obj_file, line_no, trim(raw_line, e' \t\r\n') AS s FROM obj_line),
w AS (SELECT *, string_split_regex(s, '[ \t]+') AS ws FROM l),
t AS (SELECT *, ws[1] AS tag, ws[2:] AS args FROM w),
n AS (SELECT obj_file, count(*) FILTER (WHERE tag = 'v') AS n_v FROM t GROUP BY 1),
p AS (SELECT t.*, n_v, list_transform(args, lambda a: CASE WHEN length(a) > 2 AND a[1] = '"' AND a[-1] = '"' THEN a[2:-2] ELSE a END) AS bare,
  list_transform(args, lambda a: try_cast(regexp_extract(a, '^[+-]?[0-9]+') AS BIGINT)) AS ix FROM t JOIN n USING (obj_file)),
r AS (SELECT *, CASE WHEN s = '' OR s[1] = '#' THEN NULL
  WHEN tag NOT IN ('v','vt','vn','f','o','g','s','usemtl','mtllib','l','p') THEN 'tag'
  WHEN (length(s) - length(replace(s, '"', ''))) % 2 = 1 THEN 'quote'
  WHEN tag = 'v' AND len(args) NOT IN (3, 4, 6) THEN 'columns'
  WHEN tag = 'f' AND len(args) < 3 THEN 'columns'
  WHEN tag = 'v' AND len(list_filter(bare, lambda a: NOT (regexp_full_match(a, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') AND coalesce(isfinite(try_cast(a AS DOUBLE)), false)))) > 0 THEN 'value'
  WHEN tag = 'f' AND len(list_filter(args, lambda a: NOT regexp_full_match(a, '[+-]?[0-9]+(/[+-]?[0-9]+|//[+-]?[0-9]+|/[+-]?[0-9]+/[+-]?[0-9]+)?'))) > 0 THEN 'value'
  WHEN tag = 'f' AND len(list_filter(ix, lambda i: i = 0 OR abs(i) > n_v)) > 0 THEN 'range' END AS reason FROM p)
"""  # fmt: skip

ORACLE = {
    "p6_found": LINE + "SELECT line_id, reason FROM r WHERE reason IS NOT NULL",
    "p6_valid_vertices": LINE
    + "SELECT obj_file, count(*) AS n_vertices, "
    + ", ".join(f"round({n}(CAST(bare[{i}] AS DOUBLE)), 6) AS {n}_{c}" for i, c in enumerate("xyz", 1) for n in ("min", "max"))
    + " FROM r WHERE reason IS NULL AND tag = 'v' GROUP BY 1",
    "p6_valid_faces": LINE + "SELECT obj_file, count(*) AS n_faces, sum(len(args) - 2) AS n_triangles FROM r WHERE reason IS NULL AND tag = 'f' GROUP BY 1",
}
