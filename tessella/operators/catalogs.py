"""Cell and object catalogs as aggregations."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import geometry, morton

BOUNDS = [f"bbox_{m}_{a}" for m in ("min", "max") for a in "xyz"]


def low() -> list[Column]:
    return [F.col(f"bbox_min_{a}") for a in "xyz"]


def high() -> list[Column]:
    return [F.col(f"bbox_max_{a}") for a in "xyz"]


def with_cells(points: DataFrame, cell_size: tuple) -> DataFrame:
    """points (x, y, z, ...) and the level-0 cell of each."""
    return points.withColumn("cell", morton.encode(*[morton.of_point(a, s) for a, s in zip("xyz", cell_size)]))


def bounds() -> list[Column]:
    return [f(a).alias(f"bbox_{m}_{a}") for m, f in (("min", F.min), ("max", F.max)) for a in "xyz"]


def at_levels(rows: DataFrame, levels: int) -> DataFrame:
    """Each row once a level, with that level's cell."""
    up = F.array(*[F.struct(F.lit(n).alias("level"), morton.ancestor("cell", n).alias("cell")) for n in range(levels)])
    return rows.withColumn("_at", F.explode(up)).drop("cell").select("*", "_at.level", "_at.cell").drop("_at")


def cell_catalog(points: DataFrame, cell_size: tuple, levels: int) -> DataFrame:
    """level, cell, bounds, vertex_count, object_count of points (object_id, x, y, z).

    Level 0 is aggregated from the points; coarser levels from the level-0 cells, which are far fewer.
    """
    fine = with_cells(points, cell_size).groupBy("cell", "object_id").agg(*bounds(), F.count("*").alias("n"))
    merged = [f(c).alias(c) for c in BOUNDS for f in [F.min if "_min_" in c else F.max]]
    return at_levels(fine, levels).groupBy("level", "cell").agg(*merged, F.sum("n").alias("vertex_count"), F.countDistinct("object_id").alias("object_count"))


def child_masks(cells: DataFrame) -> DataFrame:
    """level, cell, child_mask of every cell that has children. cells: level, cell."""
    bit = morton.bit(morton.octant("cell"))
    return cells.groupBy((F.col("level") + 1).alias("level"), morton.ancestor("cell", 1).alias("cell")).agg(F.bit_or(bit).cast("long").alias("child_mask"))


def lod_errors(cells: DataFrame, cell_size: tuple, levels: int) -> DataFrame:
    """level, cell, lod_error of cells (level, cell, displacement): a parent's is at least its children's.

    own = longest side / 65535 + displacement; the maximum over a cell and all its descendants, in
    one aggregation by ancestor instead of one pass a level.
    """
    side = F.lit(float(max(cell_size))) * morton.bit(F.col("level"))
    own = side / geometry.STEPS + F.when(F.col("level") > 0, F.col("displacement")).otherwise(0.0)
    up = F.sequence(F.lit(0), F.lit(levels - 1) - F.col("level"))
    rows = cells.select("level", "cell", own.alias("own"), F.explode(up).alias("d"))
    rows = rows.select((F.col("level") + F.col("d")).alias("level"), F.expr("shiftright(cell, 3 * d)").alias("cell"), "own")
    present = cells.select("level", "cell")
    return rows.groupBy("level", "cell").agg(F.max("own").alias("lod_error")).join(present, ["level", "cell"], "left_semi")


def full_catalog(cells: DataFrame, cell_size: tuple, levels: int) -> DataFrame:
    """cells (with displacement) and child_mask (0 without children), lod_error."""
    out = cells.join(child_masks(cells), ["level", "cell"], "left").join(lod_errors(cells, cell_size, levels), ["level", "cell"])
    return out.withColumn("child_mask", F.coalesce("child_mask", F.lit(0)))


def ordinals(ids: DataFrame, ranges: int = 1024) -> DataFrame:
    """object_id, ordinal: 0 .. n - 1 in ascending order of id, without a global sort in one task.

    Ids are dealt by ranges that hold about equally many of them, however they are spread; the
    ranges' sizes (a bounded table) give the offsets.
    """
    ids = ids.select("object_id").distinct()
    shares = [i / ranges for i in range(1, ranges)]
    limits = ids.agg(F.percentile_approx("object_id", shares, 10 * ranges)).first()[0]
    if limits is None:
        return ids.withColumn("ordinal", F.lit(0))
    rows = ids.withColumn("_range", morton.count_upto(sorted(set(limits)), F.col("object_id")))
    sizes = {r["_range"]: r["count"] for r in rows.groupBy("_range").count().collect()}  # a row a range
    starts, at = [], 0
    for b in range(max(sizes) + 1):
        starts.append(at)
        at += sizes.get(b, 0)
    start = F.lit(np.array(starts, np.int64))
    own = F.row_number().over(Window.partitionBy("_range").orderBy("object_id")) - 1
    return rows.select("object_id", (F.element_at(start, F.col("_range") + 1) + own).cast("int").alias("ordinal"))


def object_catalog(points: DataFrame, cell_size: tuple, levels: int) -> DataFrame:
    """object_id, ordinal, level-0 bounds, vertex_count, cells (all levels, by level and Morton order)."""
    fine = with_cells(points, cell_size).groupBy("object_id", "cell").agg(*bounds(), F.count("*").alias("n"))
    merged = [f(c).alias(c) for c in BOUNDS for f in [F.min if "_min_" in c else F.max]]
    whole = fine.groupBy("object_id").agg(*merged, F.sum("n").alias("vertex_count"))
    cells = at_levels(fine.select("object_id", "cell"), levels).distinct()
    lists = cells.groupBy("object_id").agg(F.sort_array(F.collect_list(F.struct("level", "cell"))).alias("cells"))
    return whole.join(lists, "object_id").join(ordinals(points), "object_id")


def cells_of(owned: DataFrame, cells: DataFrame) -> DataFrame:
    """object_id and the catalog's rows of owned cells (object_id, level, cell); keys the catalog lacks are left out."""
    return owned.select("object_id", "level", "cell").join(cells, ["level", "cell"])


def choose_cell_size(spans: DataFrame, least: int = 8) -> tuple[int, int, int]:
    """A cell size for objects (object_id, lo and hi bounds): the power of two at or over twice the
    90th percentile of their extents, at least `least`, at most the scene's own power of two.

    The halving that would follow for scenes of few cells never applies: a side is under twice what
    is wanted, or already the least.
    """
    sides = [F.percentile(F.col(f"bbox_max_{a}") - F.col(f"bbox_min_{a}"), 0.9).alias(f"p{a}") for a in "xyz"]
    r = spans.agg(*sides, *[F.max(f"bbox_max_{a}").alias(f"u{a}") for a in "xyz"]).first()

    def side(a: str) -> int:
        up = lambda x: 1 << max(0, math.ceil(math.log2(x)))
        return min(up(max(2 * (r[f"p{a}"] or 0), least)), up(max(r[f"u{a}"] or 0, 1)))

    return side("x"), side("y"), side("z")
