"""Scenes derived from the driver's tables: boxes from `part`, points from `lineitem`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELL_SIZE = (128, 128, 64)
LEVELS = 3
# Corners by bits (x, y, z) of their number; triangles turn outward.
BOX_FACES = ((0, 4, 6), (0, 6, 2), (1, 3, 7), (1, 7, 5), (0, 1, 5), (0, 5, 4), (2, 6, 7), (2, 7, 3), (0, 2, 3), (0, 3, 1), (4, 5, 7), (4, 7, 6))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object_id, cx, cy, cz, ex, ey, ez: one box a part."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS object_id",
        "CAST(300 + p_partkey % 40 * 90 AS DOUBLE) AS cx",
        "CAST(300 + p_partkey DIV 40 % 50 * 70 AS DOUBLE) AS cy",
        "CAST(150 + p_partkey % 7 * 40 AS DOUBLE) AS cz",
        "CAST(4 + p_size * 5 AS DOUBLE) AS ex",
        "CAST(4 + p_size * 3 % 97 AS DOUBLE) AS ey",
        "CAST(4 + p_size * 7 % 61 AS DOUBLE) AS ez",
    )


def corner(bit: int, axis: str) -> F.Column:
    return F.col(f"c{axis}") + F.when(F.col("vid").bitwiseAND(F.lit(bit)) > 0, 0.5).otherwise(-0.5) * F.col(f"e{axis}")


def box_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object_id, vid, x, y, z."""
    rows = boxes(spark, sf_dir).withColumn("vid", F.explode(F.array(*map(F.lit, range(8)))))
    return rows.select("object_id", "vid", corner(1, "x").alias("x"), corner(2, "y").alias("y"), corner(4, "z").alias("z"))


def box_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object_id, fid, a, b, c."""
    faces = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(f, "abc")]) for f in BOX_FACES])
    return boxes(spark, sf_dir).select("object_id", F.posexplode(faces).alias("fid", "f")).select("object_id", "fid", "f.a", "f.b", "f.c")


def box_triangles(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """object_id, fid, ax .. cz: corners computed in place, without a join of faces and vertices.

    A small file is read by one task, however many triangles come of it; with `spread` boxes are dealt to
    several by id first, while they are slim.
    """
    rows = boxes(spark, sf_dir)
    if spread:
        rows = rows.repartition(4 * spark.sparkContext.defaultParallelism, "object_id")
    corners = []
    for f in BOX_FACES:
        one = [F.col(f"c{axis}") + F.lit(0.5 if v & bit else -0.5) * F.col(f"e{axis}") for v in f for bit, axis in ((1, "x"), (2, "y"), (4, "z"))]
        corners.append(F.struct(*[c.alias(f"{p}{axis}") for c, (p, axis) in zip(one, [(p, axis) for p in "abc" for axis in "xyz"])]))
    return rows.select("object_id", F.posexplode(F.array(*corners)).alias("fid", "t")).select("object_id", "fid", "t.*")


def numbered_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """box_triangles with the corners' vids a, b, c: faces and vertices in one row, without a join.

    Spark takes an exploded table for as small as its source, and would broadcast millions of vertices.
    """
    faces = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(f, "abc")]) for f in BOX_FACES])
    return box_triangles(spark, sf_dir).withColumn("f", faces[F.col("fid")]).select("*", "f.*").drop("f")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object_id, x, y, z: one point a line item."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS object_id", "CAST(l_partkey % 1024 AS DOUBLE) AS x", "l_quantity * 20 AS y", "datediff(l_shipdate, DATE'1995-01-01') / 2 AS z")
