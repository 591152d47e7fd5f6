"""Queries of the mesh pipeline: clip, build, simplify, write, read, audit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import blobs, geometry
from tessella.functions import oracles as O  # noqa: N812
from tessella.operators import audit, catalogs, mesh, pyramid
from tessella.queries_core import BOX_POINTS, XYZ, as_bytes, object_cells, per_object, point_catalog, triangles_of
from tessella.sources import obj, scenes, store
from tessella.sources.scenes import CELL_SIZE, LEVELS
from tessella.sources.scratch import scratch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def corners() -> list[list]:
    return [[F.col(f"{p}{a}") for a in XYZ] for p in "abc"]


def area_of_box() -> str:
    return "2 * (ex * ey + ey * ez + ez * ex)"


@query(f"WITH {O.BOXES} SELECT object_id, round({area_of_box()}, 3) AS area FROM b")
def clip_box_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut at all cell planes, the surface keeps its area: no face is lost or doubled."""
    rows = pyramid.clip_to_cells(scenes.box_triangles(spark, sf_dir), CELL_SIZE)
    area = F.sqrt(geometry.area_squared(*corners())) / 2
    return rows.groupBy("object_id").agg(F.round(F.sum(area), 3).alias("area"))


def span(a: str, size: int) -> str:
    """Cells that a box's sides reach along an axis: a side in a plane belongs to the cell inside."""
    return f"CAST(floor(min({a}) / {size}) AS BIGINT) AS l{a}, CAST(greatest(floor(min({a}) / {size}), ceil(max({a}) / {size}) - 1) AS BIGINT) AS h{a}"


@query(f"""WITH {O.BOXES}, s AS (SELECT object_id, {', '.join(span(a, s) for a, s in zip(XYZ, CELL_SIZE))} FROM v GROUP BY object_id)
SELECT object_id, (hx - lx + 1) * (hy - ly + 1) * (hz - lz + 1) - greatest(hx - lx - 1, 0) * greatest(hy - ly - 1, 0) * greatest(hz - lz - 1, 0) AS cells FROM s""")
def clip_box_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that hold a part of each box's surface: all it reaches but those wholly inside."""
    rows = pyramid.clip_to_cells(scenes.box_triangles(spark, sf_dir), CELL_SIZE)
    return rows.groupBy("object_id").agg(F.countDistinct("cell").alias("cells"))


SURFACE = f"""{O.BOXES}, reach AS (SELECT object_id, {', '.join(span(a, s) for a, s in zip(XYZ, CELL_SIZE))} FROM v GROUP BY object_id),
ri AS (SELECT *, unnest(range(lx, hx + 1)) AS i FROM reach), rj AS (SELECT *, unnest(range(ly, hy + 1)) AS j FROM ri), rk AS (SELECT *, unnest(range(lz, hz + 1)) AS k FROM rj),
surface AS (SELECT object_id, {O.morton('i', 'j', 'k')} AS cell FROM rk WHERE i IN (lx, hx) OR j IN (ly, hy) OR k IN (lz, hz)),
held AS (SELECT DISTINCT object_id, CAST(level AS INTEGER) AS level, cell >> (3 * level) AS cell FROM surface, (SELECT unnest([0, 1, 2]) AS level))"""


def built(spark: SparkSession, sf_dir: str, **how) -> pyramid.Built:
    return pyramid.build(scenes.box_triangles(spark, sf_dir, spread=True), CELL_SIZE, LEVELS, warn=False, **how)


@query(f"WITH {SURFACE} SELECT level, count(DISTINCT cell) AS cells, count(*) AS pieces, level > 0 AS fewer_faces FROM held GROUP BY level")
def pyramid_faces_per_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and pieces of each level, and whether it holds fewer faces than the level below."""
    b = built(spark, sf_dir)
    pieces = b.heads.where("ni > 0").groupBy("level").agg(F.count("*").alias("pieces"))
    return b.faces_per_level().join(pieces, "level").select("level", "cells", "pieces", F.coalesce(F.col("ratio") < 1, F.lit(False)).alias("fewer_faces"))


@query()
def decimation_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, simplifier="GREEDY").faces_per_level().select("level", "ratio")


@query(f"WITH {SURFACE} SELECT CAST(level AS BIGINT) AS level, count(DISTINCT cell) AS cells, CAST(0 AS BIGINT) AS moved FROM held WHERE level > 0 GROUP BY level")
def locked_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each coarse level, and in how many a vertex on their planes was lost or made by simplification."""
    bundles = built(spark, sf_dir).bundles.where(F.octet_length("v") > 0)
    return audit.moved_on_planes(bundles, CELL_SIZE).groupBy("level").agg(F.count("*").alias("cells"), F.count_if((F.col("lost") > 0) | (F.col("new") > 0)).alias("moved"))


LONE = "ex <> ey AND ey <> ez AND ex <> ez"  # boxes with one shortest side


def simplified(spark: SparkSession, sf_dir: str, how: object, target: int) -> DataFrame:
    """Each box alone, without cell planes: faces left and how far a vertex went."""

    def give(own: pa.Table) -> dict:
        v, f = mesh.weld(triangles_of(own))
        nv, nf, error, relaxed = mesh.relax(v, f, np.zeros(len(v), bool), target, how)
        return {"vertices": [len(nv)], "faces": [len(nf)], "moved": [error], "relaxed": [relaxed]}

    boxes = scenes.boxes(spark, sf_dir).where(LONE).select("object_id")
    rows = scenes.box_triangles(spark, sf_dir).join(boxes, "object_id", "left_semi")
    return per_object(rows, "fid", give, "object_id long, vertices int, faces int, moved double, relaxed boolean")


@query(f"WITH {O.BOXES} SELECT object_id, 6 AS vertices, 8 AS faces, least(ex, ey, ez) / 2 AS moved, FALSE AS relaxed FROM b WHERE {LONE}")
def greedy_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of twelve faces eight: two of the four shortest edges are drawn together at their middles."""
    return simplified(spark, sf_dir, mesh.Greedy(), 8)


@query()
def quadric_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simplified(spark, sf_dir, mesh.Quadric(), 8)


@query()
def relax_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target of one face cannot be met by a closed surface: it is doubled until something is left."""
    return simplified(spark, sf_dir, mesh.Greedy(), 1)


CHUNKS = f"""WITH RECURSIVE {O.POINTS}, {O.CELLS}, n AS (SELECT level, cell, 6 * vertex_count AS size, row_number() OVER (PARTITION BY level ORDER BY cell) AS r FROM cat),
c(level, cell, r, chunk, running) AS (SELECT level, cell, r, 0, size FROM n WHERE r = 1
UNION ALL SELECT n.level, n.cell, n.r, CASE WHEN c.running > 0 AND c.running + n.size > 900 THEN c.chunk + 1 ELSE c.chunk END,
CASE WHEN c.running > 0 AND c.running + n.size > 900 THEN n.size ELSE c.running + n.size END FROM c JOIN n ON n.level = c.level AND n.r = c.r + 1)
SELECT level, cell, CAST(chunk AS INTEGER) AS chunk FROM c"""


@query(CHUNKS)
def byte_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = point_catalog(spark, sf_dir).select("level", "cell", (6 * F.col("vertex_count")).alias("size"))
    return store.byte_chunks(sizes, 900).select("level", "cell", "chunk")


def put(spark: SparkSession, made: pyramid.Built) -> store.Collection:
    """A collection in the shared folder."""
    prefix = scratch(spark, "collection")
    store.write_collection(made, prefix, row_group_bytes=64 << 10, part_bytes=1 << 20)
    return store.open_collection(spark, prefix)


def written(spark: SparkSession, sf_dir: str, **how) -> store.Collection:
    """A collection of the box scene."""
    made = built(spark, sf_dir, **how)
    c = put(spark, made)
    made.release()
    return c


@query(f"WITH {BOX_POINTS} SELECT object_id FROM p GROUP BY object_id")
def write_read_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects whose level-0 surface, read back, has its area to within quantisation."""
    c = written(spark, sf_dir)

    def area(batches):
        for b in batches:
            out = []
            for v, f in zip(b.column(1), b.column(2)):
                t = np.frombuffer(v.as_buffer(), "<f8").reshape(-1, 3)[np.frombuffer(f.as_buffer(), "<i4").reshape(-1, 3)]
                out.append(float(np.sqrt((np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]) ** 2).sum(axis=1)).sum() / 2))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["object_id", "area"])

    got = c.decode(c.geometry(0)).select("object_id", "v", "f").mapInArrow(area, "object_id long, area double").groupBy("object_id").agg(F.sum("area").alias("area"))
    want = scenes.boxes(spark, sf_dir).selectExpr("object_id", f"{area_of_box()} AS want")
    return got.join(want, "object_id").where("abs(area - want) <= 0.002 * want").select("object_id")


@query(f"WITH {SURFACE} SELECT level, cell, CAST(count(*) AS INTEGER) AS objects FROM held WHERE level = 1 GROUP BY level, cell")
def level_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a whole level, and how many objects each cell holds."""
    return written(spark, sf_dir).geometry(1).select("level", "cell", F.size("object_ids").alias("objects"))


OWNERS = "object_id % 3 = 1"


@query(f"WITH {SURFACE} SELECT level, cell, object_id FROM held WHERE level = 1 AND cell IN (SELECT cell FROM held WHERE level = 1 AND {OWNERS})")
def read_located_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces in the cells of a plan, read from the row groups that hold these."""
    c = written(spark, sf_dir)
    keys = c.plan(objects=scenes.boxes(spark, sf_dir).where(OWNERS).select("object_id"), min_level=1).select("level", "cell")
    keys = keys.withColumn("pos", (F.col("level") * -(1 << 55) + F.col("cell")).cast("long"))
    return c.read_cells(keys).select("level", "cell", "object_id")


@query("SELECT * FROM (VALUES (CAST(3 AS BIGINT), 0, 2, TRUE), (5, 0, 2, TRUE), (7, 0, 2, TRUE)) AS t(object_id, open_edges, euler, same_area)")
def object_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects put together from their cells: closed, of a ball's Euler number, with the box's area to within quantisation."""
    c, want, rows = written(spark, sf_dir), {r["object_id"]: r["want"] for r in scenes.boxes(spark, sf_dir).where("object_id IN (3, 5, 7)").selectExpr("object_id", f"{area_of_box()} AS want").collect()}, []
    for i in sorted(want):
        v, f = c.object_mesh(i)
        edges, count = mesh.edges_of(f)
        t = v[f]
        area = float(np.sqrt((np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]) ** 2).sum(axis=1)).sum() / 2)
        rows.append((i, int((count == 1).sum()), len(v) - len(edges) + len(f), abs(area - want[i]) <= 0.002 * want[i]))
    return spark.createDataFrame(rows, "object_id long, open_edges int, euler int, same_area boolean")


@query(f"WITH {SURFACE} SELECT cell, object_id FROM held WHERE level = 0")
def blob_zstd_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed blobs give the pieces that plain ones give."""
    plain = built(spark, sf_dir)
    packed = plain.encoded(compression="ZSTD")  # of the same pieces: these are built once
    a, b = (c.decode(c.geometry(0)) for c in (put(spark, plain), put(spark, packed)))
    plain.release(), packed.release()
    return a.join(b.select("cell", "object_id", F.col("v").alias("w"), F.col("f").alias("g")), ["cell", "object_id"]).where("v = w and f = g").select("cell", "object_id")


# A box inside one cell and away from its planes is written as it is: 8 vertices and 12 faces.
INSIDE = " AND ".join(f"floor((c{a} - e{a} / 2 - 1) / {s}) = floor((c{a} + e{a} / 2 + 1) / {s})" for a, s in zip(XYZ, CELL_SIZE))
ROUNDED = ", ".join(f"floor({a} / {s}) * {s} + round_even(({a} - floor({a} / {s}) * {s}) / {s} * 65535, 0) / 65535 * {s} AS {a}" for a, s in zip(XYZ, CELL_SIZE))


@query(f"""WITH {O.BOXES}, {O.FACES}, one AS (SELECT min(object_id) AS object_id FROM b WHERE {INSIDE}),
t AS (SELECT *, row_number() OVER (ORDER BY ax, ay, az, bx, by_, bz, cx, cy, cz) - 1 AS r FROM tri WHERE object_id = (SELECT object_id FROM one)),
s AS (SELECT unnest([3 * r, 3 * r + 1, 3 * r + 2]) AS pos, unnest([ax, bx, cx]) AS x, unnest([ay, by_, cy]) AS y, unnest([az, bz, cz]) AS z FROM t),
u AS (SELECT x, y, z, row_number() OVER (ORDER BY min(pos)) AS n FROM s GROUP BY x, y, z),
f3 AS (SELECT pos // 3 AS r, list(n ORDER BY pos) AS n FROM s JOIN u USING (x, y, z) GROUP BY 1)
SELECT CAST(n - 1 AS INTEGER) AS line, 'v' AS kind, x, y, z FROM (SELECT n, {ROUNDED} FROM u)
UNION ALL SELECT CAST(8 + r AS INTEGER), 'f', CAST(n[1] AS DOUBLE), CAST(n[2] AS DOUBLE), CAST(n[3] AS DOUBLE) FROM f3""")
def export_obj(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an OBJ file of one object, taken apart: vertices, then faces from 1."""
    one = scenes.boxes(spark, sf_dir).where(INSIDE).agg(F.min("object_id")).first()[0]
    lines = [line.split() for line in obj.obj_lines(*written(spark, sf_dir).object_mesh(one))]
    return spark.createDataFrame([(i, kind, *map(float, xs)) for i, (kind, *xs) in enumerate(lines)], "line int, kind string, x double, y double, z double")


def broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point catalog with planted faults: lost mask bits, errors too small, wrong and missing locators."""
    cells = point_catalog(spark, sf_dir)
    return cells.withColumns(
        {
            "child_mask": F.when((F.col("cell") % 5 == 0) & (F.col("level") > 0), F.lit(0).cast("long")).otherwise(F.col("child_mask")),
            "lod_error": F.when((F.col("cell") % 3 == 0) & (F.col("level") > 0), F.lit(0.0)).otherwise(F.col("lod_error")),
            "part": F.when(F.col("cell") % 7 > 0, (F.col("cell") % 4).cast("int")),
            "row_group": (F.col("cell") % 9).cast("int"),
            "blob_bytes": 6 * F.col("vertex_count"),
        }
    )


BROKEN = f"""{O.POINTS}, {O.CELLS}, x AS (SELECT level, cell, CASE WHEN cell % 5 = 0 AND level > 0 THEN 0 ELSE child_mask END AS child_mask,
CASE WHEN cell % 3 = 0 AND level > 0 THEN 0.0 ELSE lod_error END AS lod_error, CASE WHEN cell % 7 > 0 THEN cell % 4 END AS part, cell % 9 AS row_group, vertex_count FROM full_)"""


@query(f"""WITH {BROKEN}, r AS (SELECT level + 1 AS level, cell >> 3 AS cell, bit_or(CAST(1 AS BIGINT) << (cell & 7)) AS real FROM x GROUP BY 1, 2)
SELECT x.level, x.cell, x.child_mask AS claimed, coalesce(r.real, 0) AS real FROM x LEFT JOIN r USING (level, cell) WHERE x.child_mask <> coalesce(r.real, 0)""")
def audit_child_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.wrong_masks(broken(spark, sf_dir))


@query(f"""WITH {BROKEN}, c AS (SELECT level + 1 AS level, cell >> 3 AS cell, max(lod_error) AS below FROM x GROUP BY 1, 2)
SELECT x.level, x.cell, x.lod_error, c.below FROM x JOIN c USING (level, cell) WHERE x.lod_error + 1e-9 < c.below""")
def audit_error_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.undominated(broken(spark, sf_dir))


@query(f"WITH {BROKEN} SELECT level, cell FROM x WHERE part IS NULL")
def audit_locators_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.unlocated(broken(spark, sf_dir))


@query(f"WITH {BROKEN} SELECT level, cell, CAST(part AS INTEGER) AS part, CAST(row_group AS INTEGER) AS row_group FROM x WHERE part IS NOT NULL AND (part > 2 OR row_group >= 6)")
def audit_locators_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = spark.createDataFrame([(n, p, 100, 6, "") for n in range(LEVELS) for p in range(3)], "level int, part int, bytes long, row_groups int, path string")
    return audit.misplaced(broken(spark, sf_dir), layout)


HELD, NAMED = "cell % 5 <> 0", "cell % 7 <> 0"


@query(f"WITH {O.POINTS}, {O.CELLS} SELECT CAST(n AS INTEGER) AS level FROM (SELECT unnest(range(4)) AS n) WHERE n NOT IN (SELECT level FROM cat WHERE level <> 1)")
def audit_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels that a catalog lacks which claims four and has lost one."""
    return audit.missing_levels(point_catalog(spark, sf_dir).where("level <> 1"), 4)


@query(f"""WITH {O.POINTS}, {O.CELLS}, o AS (SELECT object_id, row_number() OVER (ORDER BY object_id) - 1 + CASE WHEN object_id % 4 = 0 THEN 1 ELSE 0 END AS ordinal FROM (SELECT DISTINCT object_id FROM p))
SELECT count(*) AS objects, count(DISTINCT ordinal) AS ordinals, CAST(min(ordinal) AS INTEGER) AS first, CAST(max(ordinal) AS INTEGER) AS last FROM o""")
def audit_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinals of which some stand twice and some are left out."""
    rows = catalogs.ordinals(scenes.points(spark, sf_dir))
    return audit.ordinal_range(rows.withColumn("ordinal", F.col("ordinal") + F.when(F.col("object_id") % 4 == 0, 1).otherwise(0)))


@query(f"""WITH {O.POINTS}, {O.CELLS} SELECT level, cell, 'decode' AS kind FROM cat WHERE cell % 5 = 0
UNION ALL SELECT level, cell, 'index' FROM cat WHERE cell % 7 = 0 AND cell % 5 <> 0 UNION ALL SELECT level, cell, 'offsets' FROM cat WHERE cell % 3 = 0""")
def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometry rows with blobs that are too long, indices past their vertices, and offsets that do not begin at 0."""
    n = F.col("vertex_count")
    rows = catalogs.cell_catalog(scenes.points(spark, sf_dir), CELL_SIZE, LEVELS).select(
        "level", "cell",
        F.unhex(F.expr("repeat('000000000000', CAST(vertex_count + IF(cell % 5 = 0, 1, 0) AS INT))")).alias("positions"),
        blobs.pack(F.array(F.lit(0).cast("long"), F.lit(0).cast("long"), F.when(F.col("cell") % 7 == 0, n).otherwise(0)), 4).alias("indices"),
        n.cast("int").alias("vertex_count"), F.lit(3).alias("index_count"), F.array(F.lit(1).cast("long")).alias("object_ids"), F.array(F.lit(0)).alias("object_ordinals"),
        F.array(F.when(F.col("cell") % 3 == 0, 1).otherwise(0)).alias("object_vertex_offsets"), F.array(F.lit(0)).alias("object_index_offsets"))
    return audit.blob_problems(rows, CELL_SIZE).select("level", "cell", "kind")


@query(f"""WITH {O.POINTS}, {O.CELLS}, d AS (SELECT DISTINCT level, cell, object_id FROM pl)
SELECT level, cell, object_id, 'is not in the object catalog' AS said FROM d WHERE {HELD} AND NOT ({NAMED}) UNION ALL SELECT level, cell, object_id, 'is not in the cell' FROM d WHERE NOT ({HELD}) AND {NAMED}""")
def audit_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What only the cells have, and what only the object catalog has."""
    both = object_cells(spark, sf_dir).select("level", "cell", "object_id")
    return audit.disagreements(both.where(HELD), both.where(NAMED))


@query(f"""WITH {O.POINTS}, {O.CELLS}, said AS (SELECT level, cell, cell % 4 AS part, cell % 9 AS g FROM cat),
there AS (SELECT level, cell, part, CASE WHEN cell % 6 = 0 THEN (g + 1) % 9 ELSE g END AS g FROM said WHERE cell % 11 <> 0)
SELECT s.level, s.cell, t.cell IS NULL AS nowhere FROM said s LEFT JOIN there t ON t.level = s.level AND t.cell = s.cell
WHERE t.cell IS NULL OR (s.g <> t.g AND EXISTS (SELECT 1 FROM there q WHERE q.level = s.level AND q.part = s.part AND q.g = s.g))""")
def audit_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that were not written, or into another row group than their locator says."""
    cells = point_catalog(spark, sf_dir).select("level", "cell", F.expr("CAST(cell % 4 AS INT)").alias("part"), F.expr("CAST(cell % 9 AS INT)").alias("row_group"))
    placed = cells.where("cell % 11 <> 0").withColumn("row_group", F.expr("IF(cell % 6 = 0, (row_group + 1) % 9, row_group)"))
    return audit.lost_rows(cells, placed).select("level", "cell", (F.col("said") == "no row").alias("nowhere"))


@query(f"""WITH {O.POINTS}, {O.CELLS}, n AS (SELECT level, sum(CASE WHEN level = 1 THEN 2 ELSE 1 END * vertex_count)::BIGINT AS faces FROM cat GROUP BY level)
SELECT a.level, a.faces, b.faces AS below FROM n a JOIN n b ON b.level = a.level - 1 WHERE a.faces > b.faces""")
def audit_level_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A level that holds more faces than the one below."""
    return audit.larger_levels(point_catalog(spark, sf_dir).withColumn("index_count", F.expr("3 * IF(level = 1, 2, 1) * vertex_count")))


@query(f"WITH {O.POINTS}, {O.CELLS} SELECT CAST(level AS BIGINT) AS level, cell, count(*) AS lost, CAST(0 AS BIGINT) AS new FROM pl WHERE level = 1 AND x % 256 = 0 AND cell % 3 = 0 GROUP BY level, cell")
def audit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices on planes of coarse cells, which every third coarse cell has lost."""
    rows = catalogs.at_levels(catalogs.with_cells(scenes.points(spark, sf_dir).where("x % 256 = 0"), CELL_SIZE), 2)

    kept = (F.col("level") == 0) | (F.col("cell") % 3 != 0)
    spot = F.struct(*[F.when(kept, F.col(a)).otherwise(F.lit(100.5) if a != "z" else F.lit(50.25)).alias(a) for a in XYZ])
    pieces = as_bytes(rows.groupBy("level", "cell").agg(F.collect_list(spot).alias("v")), "level int, cell long, v binary")
    return audit.moved_on_planes(pieces, CELL_SIZE).where("lost > 0 or new > 0").drop("n")


@query(f"WITH {O.BOXES} SELECT object_id, CAST(1 AS INTEGER) AS level, CAST(3 AS DOUBLE) AS moved, CAST(2 AS DOUBLE) AS budget FROM b WHERE object_id % 3 = 2 AND ex >= 3")
def audit_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes whose coarse level is moved by one, two or three voxels along x, where two are claimed."""

    def give(own: pa.Table) -> dict:
        t, by = triangles_of(own), 1.0 + own["object_id"][0].as_py() % 3
        v, f = mesh.weld(t)
        w = v + np.array([by, 0.0, 0.0])
        return {"level": [0, 1], "v": [x.astype("<f8").tobytes() for x in (v, w)], "f": [f.astype("<i4").tobytes()] * 2, "lod_error": [0.0, 2.0]}

    rows = scenes.box_triangles(spark, sf_dir)
    pieces = per_object(rows, "fid", give, "object_id long, level int, v binary, f binary, lod_error double")
    return audit.displacements(pieces).withColumn("moved", F.round("moved", 9)).where("moved > budget")


def audited(spark: SparkSession, sf_dir: str, tier: str) -> DataFrame:
    return audit.verify(written(spark, sf_dir), tier).frame(spark).select("name", "tier", "ok")


def passed(*names: tuple[str, str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{n.replace(chr(39), chr(39) * 2)}', '{t}', TRUE)" for n, t in names) + ") AS t(name, tier, ok)"


STRUCTURE = [
    (n, "structure")
    for n in (
        "files exist", "recorded file lengths land on the end of the file", "levels are contiguous", "child masks name children that exist", "a parent's error dominates its children's",
        "every cell carries a locator", "locators point inside the files that exist", "object ordinals are dense", "the object catalog names cells that exist")
]
BLOBS = [(n, "blobs") for n in (*audit.BLOBS.values(), "the two catalogs agree about who is in which cell")]
GEOMETRY = [(n, "geometry") for n in ("a coarse level holds less than the level it summarises", "on-plane vertices are held fixed across levels", "lod_error bounds how far a vertex moved from level 0")]


@query(passed(*STRUCTURE))
def audit_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark, sf_dir, "structure")


@query(passed(*STRUCTURE, *BLOBS))
def audit_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark, sf_dir, "blobs")


@query(passed(*STRUCTURE, *BLOBS, *GEOMETRY))
def audit_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark, sf_dir, "geometry")
