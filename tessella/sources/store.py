"""Collections on disk: written with exact row-group locators, committed by the manifest, read by plan.

    <prefix>/level=L/part-NNNNN.parquet   geometry, Morton order, row groups of bounded size
    <prefix>/catalog/cells.parquet        one row a cell, with part and row group
    <prefix>/catalog/objects.parquet      one row an object, with its cells
    <prefix>/manifest.json                last

Located reads open only the row groups that the cell catalog names, and check that they hold the cells.
"""

from __future__ import annotations

import asyncio
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.errors import FormatError, UnfinishedCollectionError
from tessella.operators import catalogs, mesh, pyramid
from tessella.sources import files
from tessella.sources.manifest import CELLS, NAME, OBJECTS, File, Manifest, level_path, relative

ROW_GROUP_BYTES, PART_BYTES = 512 << 10, 512 << 20
REQUIRED = {
    "cells": ["level", "cell", "vertex_count", "index_count", *(f"bbox_{m}_{a}" for m in ("min", "max") for a in "xyz"), "lod_error", "object_count", "child_mask"],
    "objects": ["object_id", "ordinal", *(f"bbox_{m}_{a}" for m in ("min", "max") for a in "xyz"), "vertex_count", "index_count", "cells"],
    "geometry": pyramid.BLOB_COLUMNS,
}
GEOMETRY_SCHEMA = pa.schema(
    [("level", pa.int32()), ("cell", pa.int64()), ("positions", pa.binary()), ("indices", pa.binary()), ("vertex_count", pa.int32()), ("index_count", pa.int32()), ("object_ids", pa.list_(pa.int64()))]
    + [(n, pa.list_(pa.int32())) for n in ("object_ordinals", "object_vertex_offsets", "object_index_offsets")])


def validate(df: DataFrame, role: str) -> None:
    """Presence of the role's columns; more are welcome."""
    if role not in REQUIRED:
        raise FormatError(f"unknown role {role!r}; there are {sorted(REQUIRED)}")
    missing = [c for c in REQUIRED[role] if c not in df.columns]
    if missing:
        raise FormatError(f"the {role} table lacks {missing}")


def byte_chunks(sizes: DataFrame, budget: int, name: str = "chunk", by: str = "level") -> DataFrame:
    """sizes (by, cell, size) and the run each row is in: a run ends before the row that would pass the budget.

    The reset depends on the running sum, so each level is one ordered fold; it streams over slim rows.
    """
    kinds = dict(sizes.dtypes)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chunk, running = None, 0, 0
        for batch in batches:
            out = []
            for key, size in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if key != held:
                    held, chunk, running = key, 0, 0
                elif running and running + size > budget:
                    chunk, running = chunk + 1, 0
                running += size
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(out, pa.int32())], names=[by, "cell", "size", name])

    rows = sizes.select(by, "cell", F.col("size").cast("long").alias("size")).repartition(by).sortWithinPartitions(by, "cell")
    return rows.mapInArrow(over, f"{by} {kinds[by]}, cell long, size long, {name} int")


def write_parts(geometry: DataFrame, path: str, part_bytes: int, row_group_bytes: int, sizes: DataFrame) -> DataFrame:
    """Writes the parts of all levels; level, cell, part, row_group, blob_bytes, and each part's file.

    sizes: level, cell, blob_bytes of each row.
    """
    parts = byte_chunks(sizes.select("level", "cell", F.col("blob_bytes").alias("size")), part_bytes, "part")
    rows = geometry.select(REQUIRED["geometry"]).join(parts.drop("size"), ["level", "cell"])
    rows = rows.repartition("level", "part").sortWithinPartitions("level", "part", "cell")
    columns = REQUIRED["geometry"]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = files.place(path)
        held, writer, temp, group, held_bytes, groups, out, sink = None, None, "", [], 0, 0, [], None

        def flush() -> None:
            nonlocal group, held_bytes, groups
            if group:
                t = pa.Table.from_batches(group).select(columns)
                writer.write_table(t, row_group_size=t.num_rows)
                for cell, p, i in zip(t["cell"].to_pylist(), t["positions"], t["indices"]):
                    out.append((held[0], cell, held[1], groups, len(p.as_buffer()) + len(i.as_buffer())))
                groups += 1
                group, held_bytes = [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal out, groups
            if writer is None:
                return
            flush()
            writer.close()
            sink.close()
            name = level_path(*held)
            system.move(temp, f"{root}/{name}")
            n = system.get_file_info(f"{root}/{name}").size
            cols = list(zip(*[(*r, n, groups) for r in out]))
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["level", "cell", "part", "row_group", "blob_bytes", "file_bytes", "row_groups"])
            out, groups = [], 0

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                key = row.column("level")[0].as_py(), row.column("part")[0].as_py()
                if key != held:
                    yield from close()
                    held = key
                    system.create_dir(f"{root}/level={key[0]}", recursive=True)
                    temp = f"{root}/level={key[0]}/.tmp-{uuid.uuid4().hex}"
                    sink = system.open_output_stream(temp)
                    writer = pq.ParquetWriter(sink, row.select(columns).schema, compression="zstd")
                n = len(row.column("positions")[0].as_buffer()) + len(row.column("indices")[0].as_buffer())
                if held_bytes and held_bytes + n > row_group_bytes:
                    flush()
                group.append(row)
                held_bytes += n
        yield from close()

    return rows.mapInArrow(over, "level int, cell long, part int, row_group int, blob_bytes long, file_bytes long, row_groups int")


def put_catalog(df: DataFrame, path: str, keys: list[str], types: dict) -> int:
    """Writes df as one Parquet file with exact Arrow types, streamed by one task; returns its length."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, target = files.place(path)
        system.create_dir(target.rsplit("/", 1)[0], recursive=True)
        temp, writer = f"{target}.{uuid.uuid4().hex}", None
        with system.open_output_stream(temp) as sink:
            for batch in batches:
                t = pa.Table.from_batches([batch])
                for n, kind in types.items():
                    t = t.set_column(t.schema.get_field_index(n), n, t[n].cast(kind))
                writer = writer or pq.ParquetWriter(sink, t.schema, compression="zstd")
                writer.write_table(t)
            writer = writer or pq.ParquetWriter(sink, schema)  # an empty catalog has its columns' types all the same
            writer.close()
        system.move(temp, target)
        yield pa.RecordBatch.from_arrays([pa.array([system.get_file_info(target).size], pa.int64())], names=["bytes"])

    schema = pa.schema([pa.field(f.name, types.get(f.name, f.type)) for f in to_arrow_schema(df.schema)])
    found = df.repartition(1).sortWithinPartitions(*keys).mapInArrow(over, "bytes long").first()
    # Where Spark knows that there are no rows it runs no task.
    return found[0] if found else next(over(iter(())))["bytes"][0].as_py()


def with_locators(cells: DataFrame, located: DataFrame) -> DataFrame:
    """Catalog rows and where they were written; those that were not have nulls."""
    return cells.join(located.select("level", "cell", "part", "row_group", "blob_bytes"), ["level", "cell"], "left")


def write_collection(built: pyramid.Built, prefix: str, part_bytes: int = PART_BYTES, row_group_bytes: int = ROW_GROUP_BYTES, name: str = NAME) -> Manifest:
    """Parts, cell catalog with locators, object catalog, and the manifest last.

    What stood under the prefix goes first, manifest before all: no reader takes half of each.
    """
    spark = built.cells.sparkSession
    for role, df in (("geometry", built.geometry), ("cells", built.cells), ("objects", built.objects)):
        validate(df, role)
    if built.stats.where("level is null or cell is null").limit(1).count():
        raise FormatError("a geometry row has no level or no cell")
    files.remove(spark, f"{prefix}/{name}")
    for old in ("catalog", *(f"level={n}" for n in range(64) if files.exists(spark, f"{prefix}/level={n}"))):
        files.remove(spark, f"{prefix}/{old}")
    located = write_parts(built.geometry, prefix, part_bytes, row_group_bytes, built.stats).persist()
    parts = located.groupBy("level", "part").agg(F.first("file_bytes").alias("bytes"), F.first("row_groups").alias("groups")).orderBy("level", "part").collect()  # one row a file
    cells = with_locators(built.cells.drop("blob_bytes"), located)
    n_cells = put_catalog(cells.select(*REQUIRED["cells"], "part", "row_group", "blob_bytes"), f"{prefix}/{CELLS}", ["level", "cell"], {"level": pa.int32(), "object_count": pa.int32(), "child_mask": pa.uint8()})
    n_objects = put_catalog(built.objects.select(REQUIRED["objects"]), f"{prefix}/{OBJECTS}", ["object_id"], {})
    per_level = {r["level"]: r["count"] for r in built.cells.groupBy("level").count().collect()}
    counts = {"objects": built.ordinals.count(), "cellsPerLevel": [per_level.get(n, 0) for n in range(built.levels)]}
    named: dict[int, list[File]] = {}
    for r in parts:
        named.setdefault(r["level"], []).append(File(level_path(r["level"], r["part"]), r["bytes"], r["groups"]))
    out = Manifest(built.cell_size, built.levels, built.codec, built.compression, "LOCKED", built.decimation, counts, File(CELLS, n_cells), File(OBJECTS, n_objects), named)
    files.put(spark, f"{prefix}/{name}", out.to_json())
    located.unpersist()
    return out


async def awrite_collection(built: pyramid.Built, prefix: str, **how) -> Manifest:
    return await asyncio.to_thread(write_collection, built, prefix, **how)


def write_meshes(triangles: DataFrame, prefix: str, part_bytes: int = PART_BYTES, row_group_bytes: int = ROW_GROUP_BYTES, **how) -> Manifest:
    return write_collection(pyramid.build(triangles, **how), prefix, part_bytes, row_group_bytes)


@dataclass(frozen=True)
class Cell:
    """A decoded cell: all its vertices and faces, and which run of each belongs to which object."""

    level: int
    cell: int
    vertices: np.ndarray
    faces: np.ndarray
    object_ids: list[int]
    object_ordinals: list[int]
    object_vertex_offsets: list[int]
    object_index_offsets: list[int]

    def object_mesh(self, object_id: int) -> tuple[np.ndarray, np.ndarray]:
        for o, v, f in pyramid.slices(self.vertices, self.faces, self.object_ids, self.object_vertex_offsets, self.object_index_offsets):
            if o == object_id:
                return v, f
        raise KeyError(f"no object {object_id} in cell {self.cell} at level {self.level}")


def span_of(meta: pq.FileMetaData, group: int) -> tuple[int, int]:
    """First byte and end of a row group's column chunks."""
    chunks = [meta.row_group(group).column(i) for i in range(meta.num_columns)]
    starts = [min(x for x in (c.dictionary_page_offset, c.data_page_offset) if x) for c in chunks]
    return min(starts), max(a + c.total_compressed_size for a, c in zip(starts, chunks))


def located_rows(file: pq.ParquetFile, group: int, cells: list[int], where: str) -> pa.Table:
    """The rows of these cells, from the row group that a catalog names for them."""
    if not 0 <= group < file.metadata.num_row_groups:
        raise FormatError(f"{where} has {file.metadata.num_row_groups} row groups, not a row group {group}")
    table = file.read_row_group(group, columns=pyramid.BLOB_COLUMNS)
    pyramid.refuse_nulls(table, f"{where}, row group {group},")
    spots = {c: i for i, c in enumerate(table["cell"].to_pylist())}
    lost = sorted(set(cells) - spots.keys())
    if lost:
        raise FormatError(f"cell {lost[0]} is not in {where}, row group {group}, which the cell catalog names for it")
    return table.take(pa.array([spots[c] for c in cells], pa.int64())).cast(GEOMETRY_SCHEMA)


class Collection:
    """An open collection. Frames are lazy: planning reads the cell catalog and never the geometry."""

    def __init__(self, spark: SparkSession, prefix: str, name: str = NAME) -> None:
        if not files.exists(spark, f"{prefix}/{name}"):
            raise UnfinishedCollectionError(f"{prefix} has no {name}: it was not finished, or is not there")
        self.spark, self.prefix = spark, prefix
        self.manifest = Manifest.from_json(files.get(spark, f"{prefix}/{name}"))
        self.open_file: Callable[[str], object] = lambda path: files.place(path)[0].open_input_file(files.place(path)[1])
        self.kept: list[DataFrame] = []
        self.footers: dict[str, pq.FileMetaData] = {}
        self.sound: set[str] = set()

    def __repr__(self) -> str:
        return f"Collection({self.prefix!r}, cell_size={self.manifest.cell_size}, levels={self.manifest.levels})"

    def release(self) -> None:
        """Lets go of what reads have kept: persisted frames and file footers. The catalogs are read anew as ever."""
        for df in self.kept:
            df.unpersist()
        self.kept.clear()
        self.footers.clear()

    def catalog(self, path: str, role: str) -> DataFrame:
        """A catalog with its columns; a null where none may be is refused by the file's own statistics."""
        out = self.spark.read.parquet(f"{self.prefix}/{path}")
        validate(out, role)
        if path not in self.sound:
            plain = [c for c, kind in out.dtypes if c in REQUIRED[role] and not kind.startswith("array")]
            counts = out.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in plain]).first() if self.may_hold_nulls(path, plain) else {}
            for c in plain:
                if counts and counts[c]:
                    raise FormatError(f"{path} holds {counts[c]} nulls in column {c}, which may have none")
            self.sound.add(path)
        return out

    def may_hold_nulls(self, path: str, columns: list[str]) -> bool:
        """False where the footer's statistics rule nulls out in these columns."""
        try:
            meta = self.parquet(f"{self.prefix}/{path}").metadata
        except (OSError, ValueError, pa.ArrowException):  # a file system that Arrow does not know
            return True
        for g in range(meta.num_row_groups):
            for i in range(meta.num_columns):
                chunk = meta.row_group(g).column(i)
                stats = chunk.statistics
                if chunk.path_in_schema in columns and (stats is None or not stats.has_null_count or stats.null_count):
                    return True
        return False

    def cells(self) -> DataFrame:
        out = self.catalog(self.manifest.cells.path, "cells")
        for c in ("part", "row_group", "blob_bytes"):
            if c not in out.columns:
                out = out.withColumn(c, F.lit(None).cast("long"))
        return out

    def cells_at(self, level: int) -> DataFrame:
        """The catalog's rows of a level, in Morton order."""
        return self.cells().where(F.col("level") == level).orderBy("cell")

    def roots(self) -> DataFrame:
        """The coarsest cells."""
        return self.cells_at(self.manifest.levels - 1)

    def objects(self) -> DataFrame:
        return self.catalog(self.manifest.objects.path, "objects")

    def object_cells(self) -> DataFrame:
        return self.objects().select("object_id", "ordinal", F.explode("cells").alias("c")).select("object_id", "ordinal", "c.level", "c.cell")

    def object_cells_at(self, object_id: int, level: int) -> list[int]:
        """The cells of one object at a level, in Morton order."""
        own = self.objects().where(F.col("object_id") == object_id).select("cells").first()
        if own is None:
            raise KeyError(f"no object {object_id}")
        return sorted(c["cell"] for c in own["cells"] if c["level"] == level)

    def cells_for_objects(self, objects: list[int], level: int | None = None) -> DataFrame:
        """object_id and the catalog's rows of these objects' cells."""
        owned = self.object_cells().where(F.col("object_id").isin(objects))
        return catalogs.cells_of(owned if level is None else owned.where(F.col("level") == level), self.cells())

    def level_paths(self, level: int, parts: list[int] | None = None) -> list[str]:
        """Files of a level by the manifest, else by listing; only the parts named."""
        named = (self.manifest.level_files or {}).get(level)
        paths = [f.path for f in named] if named else [f"level={level}/{n}" for n in files.names(self.spark, f"{self.prefix}/level={level}", ".parquet")]
        if parts is not None:
            paths = [level_path(level, p) for p in parts if level_path(level, p) in set(paths)]
        return [f"{self.prefix}/{relative(p)}" for p in paths]

    def geometry(self, level: int, parts: list[int] | None = None) -> DataFrame:
        paths = self.level_paths(level, parts)
        if not paths:
            return self.spark.createDataFrame([], pyramid.GEOMETRY)
        return self.spark.read.schema(pyramid.GEOMETRY).parquet(*paths)

    def plan(self, **how) -> DataFrame:
        from tessella.plans import descent

        if how.get("objects") is not None:
            how["object_cells"] = self.object_cells()
        return descent.plan(self.cells(), self.manifest.levels, **how)

    def parquet(self, path: str) -> pq.ParquetFile:
        """An open file; its footer is read once."""
        out = pq.ParquetFile(self.open_file(path), metadata=self.footers.get(path))
        self.footers.setdefault(path, out.metadata)
        return out

    def row_group_spans(self, level: int, part: int) -> list[tuple[int, int]]:
        """First byte and end of each row group of a part."""
        meta = self.parquet(f"{self.prefix}/{level_path(level, part)}").metadata
        return [span_of(meta, g) for g in range(meta.num_row_groups)]

    def locators(self, keys: list[tuple[int, int]]) -> list[tuple]:
        """(level, cell, part, row_group) of a few keys, in their order."""
        asked = self.spark.createDataFrame([(int(a), int(b)) for a, b in dict.fromkeys(keys)], "level int, cell long")
        held = {(r["level"], r["cell"]): r for r in self.cells().join(F.broadcast(asked), ["level", "cell"], "left_semi").select("level", "cell", "part", "row_group").collect()}
        for level, cell in keys:
            if (level, cell) not in held:
                raise KeyError(f"no cell {cell} at level {level}")
        return [tuple(held[k]) for k in keys]

    def group_rows(self, level: int, part: int | None, group: int | None, cells: list[int]) -> pa.Table:
        """Rows of cells from their row group; of cells without a locator, from a scan of the level."""
        if part is None or group is None:
            rows = self.geometry(level).where(F.col("cell").isin(cells)).toArrow().cast(GEOMETRY_SCHEMA)
            spots = {c: i for i, c in enumerate(rows["cell"].to_pylist())}
            if set(cells) - spots.keys():
                raise KeyError(f"no cell {min(set(cells) - spots.keys())} at level {level} was written")
            return rows.take(pa.array([spots[c] for c in cells], pa.int64()))
        path = level_path(level, part)
        return located_rows(self.parquet(f"{self.prefix}/{path}"), int(group), cells, path)

    def decoded(self, rows: pa.Table) -> list[Cell]:
        m, out = self.manifest, []
        for r in rows.to_pylist():
            v, f = pyramid.decode_cell(r["positions"], r["indices"], r["cell"], r["level"], m.cell_size, r["vertex_count"], r["index_count"], m.codec, m.compression)
            out.append(Cell(r["level"], r["cell"], v, f, *(r[c] for c in pyramid.BLOB_COLUMNS[6:])))
        return out

    def read_cell(self, level: int, cell: int) -> Cell:
        """One cell: its catalog row, and the row group that this names, by the driver itself."""
        (found,) = self.locators([(level, cell)])
        return self.decoded(self.group_rows(level, found[2], found[3], [cell]))[0]

    async def aread_cell(self, level: int, cell: int) -> Cell:
        return (await self.aread_cells([(level, cell)]))[0]

    async def aread_cells(self, keys: list[tuple[int, int]], concurrency: int = 16) -> list[Cell]:
        """A few cells in the order asked for; each row group is read once, so many at a time at most."""
        groups: dict[tuple, list[int]] = {}
        for level, cell, part, group in await asyncio.to_thread(self.locators, keys):
            groups.setdefault((level, part, group), []).append(cell)
        gate = asyncio.Semaphore(max(1, concurrency))

        async def read(spot: tuple, cells: list[int]) -> list[Cell]:
            async with gate:  # a file handle of its own for each read: handles are not shared by threads
                return self.decoded(await asyncio.to_thread(self.group_rows, *spot, list(dict.fromkeys(cells))))

        found = await asyncio.gather(*(read(spot, cells) for spot, cells in groups.items()))
        by_key = {(c.level, c.cell): c for cells in found for c in cells}
        return [by_key[k] for k in keys]

    def read_rows(self, keys: DataFrame) -> DataFrame:
        """Geometry rows of keys (level, cell, ...) in no order, of the row groups that hold them and no others.

        Each row group is read once, by one task; one that lacks a cell which the catalog places there
        is an error, and so is a key without a row.
        """
        located = keys.select("level", "cell").distinct().join(self.cells().select("level", "cell", F.lit(True).alias("known"), "part", "row_group"), ["level", "cell"], "left").persist()
        self.kept.append(located)
        bad = located.where("known is null or part is null or row_group is null").first()
        if bad is not None:
            raise KeyError(f"no cell {bad['cell']} at level {bad['level']} was written")
        groups = located.groupBy("level", "part", "row_group").agg(F.sort_array(F.collect_list("cell")).alias("cells"))  # a row group's own cells at most
        prefix = self.prefix

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, file = None, None
            for batch in batches:
                for r in pa.Table.from_batches([batch]).to_pylist():
                    path = level_path(r["level"], r["part"])
                    if path != last:
                        system, target = files.place(f"{prefix}/{path}")
                        last, file = path, pq.ParquetFile(system.open_input_file(target))
                    yield from located_rows(file, r["row_group"], r["cells"], path).to_batches()

        ordered = groups.repartition("level", "part", "row_group").sortWithinPartitions("level", "part", "row_group")
        return ordered.mapInArrow(over, pyramid.GEOMETRY)

    def placed(self) -> DataFrame:
        """level, cell, part, row_group as the files have it: one column of each row group is read."""
        prefix = self.prefix

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for level, part, path in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    system, target = files.place(f"{prefix}/{path}")
                    file = pq.ParquetFile(system.open_input_file(target))
                    for g in range(file.metadata.num_row_groups):
                        cells = file.read_row_group(g, columns=["cell"])["cell"].combine_chunks()
                        n = len(cells)
                        yield pa.RecordBatch.from_arrays([pa.array([level] * n, pa.int32()), cells, pa.array([part] * n, pa.int32()), pa.array([g] * n, pa.int32())], names=["level", "cell", "part", "row_group"])

        named = self.layout().select("level", "part", "path")
        return named.repartition(max(1, min(256, sum(map(len, (self.manifest.level_files or {}).values()))))).mapInArrow(over, "level int, cell long, part int, row_group int")

    def decode(self, rows: DataFrame) -> DataFrame:
        """One row a (level, cell, object): its vertices (float64) and faces (int32, from 0)."""
        return pyramid.decode_rows(rows, self.manifest.cell_size, self.manifest.codec, self.manifest.compression)

    def read_cells(self, keys: DataFrame) -> DataFrame:
        """Decoded pieces of keys (level, cell, pos), in the order of pos and of object ids."""
        pieces = self.decode(self.read_rows(keys))
        return pieces.join(keys.select("level", "cell", "pos"), ["level", "cell"]).orderBy("pos", "object_id")

    def object_mesh(self, object_id: int, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Vertices and faces of one object at a level, its cells welded."""
        keys = self.object_cells().where((F.col("object_id") == object_id) & (F.col("level") == level)).select("level", "cell")
        if not self.objects().where(F.col("object_id") == object_id).limit(1).count():
            raise KeyError(f"no object {object_id}")
        if keys.isEmpty():
            return np.zeros((0, 3)), np.zeros((0, 3), np.int64)
        rows = self.decode(self.read_rows(keys)).where(F.col("object_id") == object_id).orderBy("cell").collect()  # one object
        soup = [np.frombuffer(r["v"], "<f8").reshape(-1, 3)[np.frombuffer(r["f"], "<i4").reshape(-1, 3)] for r in rows]
        return mesh.weld(np.concatenate(soup))

    def layout(self) -> DataFrame:
        """level, part, bytes, row_groups of the manifest's files."""
        rows = [(n, i, f.bytes, f.row_groups, f.path) for n, fs in (self.manifest.level_files or {}).items() for i, f in enumerate(fs)]
        return self.spark.createDataFrame(rows, "level int, part int, bytes long, row_groups int, path string")


def open_collection(spark: SparkSession, prefix: str, name: str = NAME) -> Collection:
    return Collection(spark, prefix, name)


async def aopen_collection(spark: SparkSession, prefix: str, name: str = NAME) -> Collection:
    return await asyncio.to_thread(Collection, spark, prefix, name)
