"""Which cells to draw: a level-of-detail descent over the cell catalog alone.

A catalog row needs level, cell, child_mask, lod_error and the six bounds. The descent goes level by
level, coarsest first: a cell is taken if it is good enough, at the lowest level wanted, or has no
wanted child; else its wanted children are looked at. Each level is a filter of the catalog and a
semi join with the cells above that were opened, so nothing is iterated over rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import geometry, morton
from tessella.operators.catalogs import high, low
from tessella.sources.scratch import cut


def with_flags(cells: DataFrame, camera: geometry.Camera | None, pixel_budget: float, error_budget: float | None, box: tuple | None, frustum: list | None, allowed: DataFrame | None, min_level: int) -> DataFrame:
    """The wanted cells, with `good` (needs no opening). A camera goes before an error budget."""
    wanted = F.lit(True)
    if box is not None:
        wanted = wanted & geometry.overlaps(low(), high(), box)
    if frustum is not None:
        wanted = wanted & geometry.inside_planes(low(), high(), frustum)
    cells = cells.where(wanted)
    if allowed is not None:
        cells = cells.join(allowed.select("level", "cell").distinct(), ["level", "cell"], "left_semi")
    good: Column = F.lit(False)
    if camera is not None:
        good = camera.pixels(F.col("lod_error"), low(), high()) <= pixel_budget
    elif error_budget is not None:
        good = F.col("lod_error") <= error_budget
    return cells.withColumn("good", (F.col("level") <= min_level) | good)


def named_children(cells: DataFrame) -> DataFrame:
    """level, cell, children: wanted cells that have wanted children which their mask names."""
    bit = morton.bit(morton.octant("cell"))
    below = cells.select((F.col("level") + 1).alias("level"), morton.ancestor("cell", 1).alias("cell"), bit.alias("_bit"))
    named = below.join(cells.select("level", "cell", "child_mask"), ["level", "cell"]).where(F.col("child_mask").cast("long").bitwiseAND(F.col("_bit")) != 0)
    return named.groupBy("level", "cell").agg(F.count("*").alias("children"))


def plan(cells: DataFrame, levels: int, *, camera: geometry.Camera | None = None, pixel_budget: float = 1.0, error_budget: float | None = None, box: tuple | None = None, frustum: list | None = None, objects: list | DataFrame | None = None, object_cells: DataFrame | None = None, max_cells: int | None = None, min_level: int = 0) -> DataFrame:
    """The cells to draw, coarsest level first, then in Morton order; columns of the catalog.

    objects: ids, or a frame with the column object_id where they are many; object_cells (object_id, level, cell) then names their cells, and an unknown id is
    a KeyError. max_cells bounds how far cells are opened: never below the number of wanted roots.
    """
    if max_cells is not None and max_cells < 1:
        raise ValueError(f"max_cells is {max_cells}, not 1 at least")
    allowed = None
    if objects is not None:
        ids = objects.select("object_id") if isinstance(objects, DataFrame) else cells.sparkSession.createDataFrame([(int(i),) for i in objects], "object_id long")
        unknown = ids.join(object_cells.select("object_id").distinct(), "object_id", "left_anti").first()
        if unknown is not None:
            raise KeyError(f"no object {unknown[0]}")
        allowed = object_cells.join(ids.distinct(), "object_id", "left_semi")
    columns = cells.columns
    flagged = with_flags(cells, camera, pixel_budget, error_budget, box, frustum, allowed, min_level)
    flagged = flagged.join(named_children(flagged), ["level", "cell"], "left").withColumn("children", F.coalesce("children", F.lit(0)))
    flagged = flagged.withColumn("opens", ~F.col("good") & (F.col("children") > 0))
    reached = flagged.where(F.col("level") == levels - 1)
    if max_cells is not None:
        # Several jobs read the wanted cells: they are found once.
        flagged = cut(flagged, "wanted")
        return capped(flagged, flagged.where(F.col("level") == levels - 1), levels, max_cells).select(columns).orderBy(F.desc("level"), "cell")
    taken = []
    for level in range(levels - 1, -1, -1):
        taken.append(reached.where(~F.col("opens")))
        if level:
            reached = below(flagged, reached.where("opens"), level - 1)
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    return out.select(columns).orderBy(F.desc("level"), "cell")


def below(flagged: DataFrame, opened: DataFrame, level: int) -> DataFrame:
    """Wanted cells of a level whose parents were opened and name them."""
    parents = opened.select(F.col("cell").alias("_parent"), F.col("child_mask").cast("long").alias("_mask"))
    bit = morton.bit(morton.octant("cell"))
    own = flagged.where(F.col("level") == level).withColumns({"_parent": morton.ancestor("cell", 1), "_bit": bit})
    hit = own.alias("c").join(parents.alias("p"), (F.col("c._parent") == F.col("p._parent")) & (F.col("p._mask").bitwiseAND(F.col("c._bit")) != 0), "left_semi")
    return hit.drop("_parent", "_bit")


def capped(flagged: DataFrame, roots: DataFrame, levels: int, most: int) -> DataFrame:
    """The same with a bound on cells: one ordered fold a level, carrying the cells taken or waiting.

    In Morton order a cell is opened if the total, with itself replaced by its children, stays within
    the bound. The fold streams over (cell, children) of the frontier, which the bound itself keeps
    small; only the running total goes to the driver.
    """
    total, reached, out = roots.count(), roots, None
    for level in range(levels - 1, -1, -1):
        rows = reached.select("cell", F.when(F.col("opens"), F.col("children")).otherwise(0).cast("long").alias("n")).coalesce(1).sortWithinPartitions("cell")

        def fold(batches: Iterator[pa.RecordBatch], total: int = total) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep, totals = [], []
                for n in batch.column(1).to_pylist():
                    opens = n > 0 and total - 1 + n <= most
                    total += n - 1 if opens else 0
                    keep.append(opens), totals.append(total)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keep, pa.bool_()), pa.array(totals, pa.int64())], names=["cell", "goes", "total"])

        folded = cut(rows.mapInArrow(fold, "cell long, goes boolean, total long"), "folded")  # as many as the bound, about
        total = folded.agg(F.max("total")).first()[0] or total
        marked = cut(reached.join(folded.select("cell", "goes"), "cell"), "marked")
        taken = marked.where("not goes").drop("goes")
        out = taken if out is None else out.unionByName(taken)
        if level:
            reached = below(flagged, marked.where("goes").drop("goes"), level - 1)
    return out


def cost(planned: DataFrame) -> DataFrame:
    """level, cells, faces, bytes of a plan."""
    return planned.groupBy("level").agg(F.count("*").alias("cells"), F.sum(F.expr("index_count div 3")).alias("faces"), F.sum("blob_bytes").alias("bytes"))
