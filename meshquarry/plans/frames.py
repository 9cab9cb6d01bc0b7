"""How the driver's tables stand in for points, boxes, tetrahedra and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshquarry.operators.spatial import fit_boxes
from meshquarry.session import table


def points(spark: SparkSession, d: str) -> DataFrame:
    """Every line item is a point; its part is the mesh, its return flag the segment, its quantity the weight."""
    l = table(spark, d, "lineitem")
    return l.select(F.col("l_partkey").alias("mesh"), F.col("l_returnflag").alias("part"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"), F.col("l_quantity").alias("weight"), F.col("l_linestatus").alias("status"))


def part_boxes(spark: SparkSession, d: str) -> DataFrame:
    """One box per mesh and segment, fitted to its closed line items (status F)."""
    return fit_boxes(points(spark, d).filter(F.col("status") == "F"), ["mesh", "part"])


def indexed_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The same with bbox_idx: A, N, R are 0, 1, 2."""
    return part_boxes(spark, d).withColumn("bbox_idx", F.when(F.col("part") == "A", 0).when(F.col("part") == "N", 1).otherwise(2))


def tets(spark: SparkSession, d: str) -> DataFrame:
    """Every order is a tetrahedron of its customer's mesh over ten vertices; those with equal vertices are dropped."""
    k = F.col("o_orderkey")
    t = table(spark, d, "orders").select(F.col("o_custkey").alias("mesh"), k.alias("tet_id"), *(F.pmod(k * m + F.floor(k / (7 * (i + 1))), F.lit(10)).alias(f"v{i}") for i, m in enumerate((1, 7, 13, 29))))
    return t.filter(F.size(F.array_distinct(F.array(*(f"v{i}" for i in range(4))))) == 4)


#: The same in SQL.
POINTS = "p AS (SELECT l_partkey AS mesh, l_returnflag AS part, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z, l_quantity AS weight, l_linestatus AS status FROM lineitem)"
FIT = "min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z, count(*) AS n, sum(weight) AS weight"
BOXES = f"{POINTS}, b AS (SELECT mesh, part, CASE part WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS bbox_idx, {FIT} FROM p WHERE status = 'F' GROUP BY 1, 2)"
VOLUME = "(max_x - min_x) * (max_y - min_y) * (max_z - min_z)"
TETS = "t AS (SELECT * FROM (SELECT o_custkey AS mesh, o_orderkey AS tet_id, " + ", ".join(f"(o_orderkey * {m} + o_orderkey // {7 * (i + 1)}) % 10 AS v{i}" for i, m in enumerate((1, 7, 13, 29))) + " FROM orders) WHERE v0 <> v1 AND v0 <> v2 AND v0 <> v3 AND v1 <> v2 AND v1 <> v3 AND v2 <> v3)"
