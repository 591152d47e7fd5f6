"""The build: triangles are cut once at level-0 planes, then welded and simplified for every level.

All levels come from one grouping by (level, cell, object): each coarser level is made from the
level-0 pieces, never from the level below, so the levels run side by side. A coarse cell gathers
what lies in it before it is simplified: that is what a level of detail is; its size is bounded by
the cell size, not by the object.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessella.errors import FormatError, PartitioningError
from tessella.functions import geometry, morton
from tessella.functions.blobs import check_encoding
from tessella.operators import catalogs, mesh
from tessella.operators.codecs import codec_for
from tessella.operators.runs import changes, whole_runs

MAX_OBJECTS = 1 << 24
CORNERS = [f"{p}{a}" for p in "abc" for a in "xyz"]
# The named schedules.
SCHEDULES = {"QUARTER": 0.25, "HALF": 0.5, "EIGHTH": 0.125}


@dataclass(frozen=True)
class Decimation:
    ratio: float = 0.25
    floor_faces: int = 4

    def __post_init__(self) -> None:
        if not 0 < self.ratio < 1:
            raise FormatError(f"ratio {self.ratio} is not between 0 and 1")
        if self.floor_faces < 1:
            raise FormatError(f"floor of {self.floor_faces} faces is under 1")

    @property
    def name(self) -> str:
        return next((n for n, r in SCHEDULES.items() if r == self.ratio), "CUSTOM")

    @classmethod
    def named(cls, name: str, ratio: float | None = None, floor_faces: int = 4) -> Decimation:
        if name != "CUSTOM" and name not in SCHEDULES:
            raise FormatError(f"unknown decimation {name!r}")
        if name in SCHEDULES and ratio is not None and ratio != SCHEDULES[name]:
            raise FormatError(f"decimation {name} has ratio {SCHEDULES[name]}, not {ratio}")
        if name == "CUSTOM" and ratio is None:
            raise FormatError("a CUSTOM decimation needs a ratio")
        return cls(SCHEDULES.get(name, ratio), floor_faces)

    def target(self, faces: int, level: int) -> int:
        return max(self.floor_faces, round(faces * self.ratio**level))


def soup(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """object_id, fid, ax .. cz from indexed meshes; an index without a vertex is an error naming the object."""
    long = faces.select("object_id", "fid", F.posexplode(F.array("a", "b", "c")).alias("n", "vid"))
    known = long.join(vertices, ["object_id", "vid"], "left")
    said = F.format_string("object %s: face %s names vertex %s, which it does not have", *[F.col(c).cast("string") for c in ("object_id", "fid", "vid")])
    known = known.withColumn("x", F.when(F.col("x").isNull(), F.raise_error(said).cast("double")).otherwise(F.col("x")))
    parts = [F.max(F.when(F.col("n") == n, F.col(a))).alias(f"{p}{a}") for n, p in enumerate("abc") for a in "xyz"]
    return known.groupBy("object_id", "fid").agg(*parts)


def clip_to_cells(triangles: DataFrame, cell_size: tuple) -> DataFrame:
    """object_id, cell, ax .. cz: triangle by triangle, so a giant object is no giant task."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                t = np.stack([part.column(c).to_numpy() for c in CORNERS], axis=1).reshape(-1, 3, 3)
                source, cells, out = mesh.clip(t, cell_size)
                if (cells < 0).any() or (cells >= morton.LIMIT).any():
                    raise PartitioningError("a triangle lies outside the octree's octant")
                flat = out.reshape(-1, 9)
                yield pa.RecordBatch.from_arrays([part.column("object_id").take(pa.array(source)), *(pa.array(cells[:, a]) for a in range(3)), *(pa.array(flat[:, c]) for c in range(9))], names=["object_id", "i", "j", "k", *CORNERS])

    rows = triangles.select(F.col("object_id").cast("long").alias("object_id"), *CORNERS).mapInArrow(over, "object_id long, i long, j long, k long, " + ", ".join(f"{c} double" for c in CORNERS))
    return rows.select("object_id", morton.encode("i", "j", "k").alias("cell"), *CORNERS)


def snapped(fragments: DataFrame, cell_size: tuple, levels: int) -> DataFrame:
    """Corners on planes and near them onto the shared lattice; faces that vanish go."""
    moved = {}
    for p in "abc":
        xs, _ = geometry.snap([F.col(f"{p}{a}") for a in "xyz"], cell_size, levels)
        moved |= {f"{p}{a}": x for a, x in zip("xyz", xs)}
    out = fragments.withColumns(moved)
    return out.where(geometry.area_squared(*[[F.col(f"{p}{a}") for a in "xyz"] for p in "abc"]) > 0)


PIECE = "level int, cell long, object_id long, ordinal int, v binary, f binary, displacement double, faces_before int, pinned int, at_floor boolean, nv int, ni int, " + ", ".join(f"{b} double" for b in catalogs.BOUNDS)
# A bundle: the pieces of one cell that one task made of one batch. A scene has far fewer of these than pieces.
HEAD = np.dtype([("object_id", "<i8"), ("ordinal", "<i4"), ("displacement", "<f8"), ("faces_before", "<i4"), ("pinned", "<i4"), ("at_floor", "?"), ("nv", "<i4"), ("ni", "<i4"), *((b, "<f8") for b in catalogs.BOUNDS)])
BUNDLE = "level int, cell long, heads binary, v binary, f binary"
SHARES = 32  # parts by object of each coarsest cell


def spread_to_tops(triangles: DataFrame, cell_size: tuple, levels: int) -> DataFrame:
    """object_id, ordinal, top, ax .. cz: each triangle, uncut, once for each coarsest cell it reaches."""
    size = tuple(s << (levels - 1) for s in cell_size)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4000):
                part = batch.slice(lo, 4000)
                t = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in CORNERS], axis=1).reshape(-1, 3, 3)
                part, t = (part, t) if (sound := mesh.squared(t) > 0).all() else (part.filter(pa.array(sound)), t[sound])
                if (t < 0).any() or (np.floor((t - 1e-9) / np.array(cell_size, float)) >= morton.LIMIT).any():
                    raise PartitioningError("a triangle lies outside the octree's octant")
                source, cells = mesh.reached(t, size)
                top = morton.interleave(cells)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(source)) for c in ("object_id", "ordinal")), pa.array(top), *(part.column(c).take(pa.array(source)) for c in CORNERS)], names=["object_id", "ordinal", "top", *CORNERS])

    rows = triangles.select(F.col("object_id").cast("long").alias("object_id"), "ordinal", *CORNERS)
    return rows.mapInArrow(over, "object_id long, ordinal int, top long, " + ", ".join(f"{c} double" for c in CORNERS))


def binaries(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Rows of an array as binary values, so many rows each."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * (data.itemsize * data.shape[1])
    if ends[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def bytes_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Binary values as one array of bytes, and how many each has."""
    whole = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks])
    ends = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    return np.frombuffer(whole.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8), np.diff(ends)


def runs_of(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Binary values as one array (n, 3) of this kind, and how many rows of it each has."""
    data, size = bytes_of(column)
    rows = data.view(kind).reshape(-1, 3)
    return rows, size // (3 * rows.itemsize)


def heads_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The heads of bundles as one array, and how many each bundle has."""
    data, size = bytes_of(column)
    return data.view(HEAD), size // HEAD.itemsize


def rows_of(counts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Places of the rows of runs of these lengths, the runs in this order."""
    n = counts[order]
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) + np.repeat((np.cumsum(counts) - counts)[order] - (ends - n), n)


def bundled(level: int, cell: np.ndarray, heads: np.ndarray, v: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
    """Bundles of pieces, told by their heads; vertices and faces of each after those of the piece before."""
    order = np.argsort(cell, kind="stable")
    v, f = v[rows_of(heads["nv"], order)], f[rows_of(heads["ni"] // 3, order)]
    heads, cell = heads[order], cell[order]
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sums = [np.add.reduceat(n.astype(np.int64), first) for n in (heads["nv"], heads["ni"] // 3)]
    each = binaries(heads.view(np.uint8).reshape(len(heads), -1), np.diff([*first, len(heads)]))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), level, np.int32)), pa.array(cell[first]), each, binaries(v.astype("<f8"), sums[0]), binaries(f.astype("<i4"), sums[1])], names=["level", "cell", "heads", "v", "f"])


def unbundled(bundles: DataFrame, blobs: bool) -> DataFrame:
    """One row a piece of bundles; without blobs all but its vertices and faces."""
    names = [n.split()[0] for n in PIECE.split(", ")]
    kinds = {f.name: f.type for f in to_arrow_schema(StructType.fromDDL(PIECE))}
    names = names if blobs else [n for n in names if n not in ("v", "f")]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                table = pa.Table.from_batches([batch.slice(lo, 256)])
                heads, n = heads_of(table["heads"])
                cols = {c: heads[c] for c in HEAD.names} | {c: np.repeat(table[c].to_numpy(), n) for c in ("level", "cell")}
                if blobs:
                    cols |= {"v": binaries(runs_of(table["v"], "<f8")[0], heads["nv"]), "f": binaries(runs_of(table["f"], "<i4")[0], heads["ni"] // 3)}
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(np.ascontiguousarray(x)).cast(kinds[c]) for c, x in ((c, cols[c]) for c in names)], names=names)

    fields = [n for n in PIECE.split(", ") if n.split()[0] in names]
    return bundles.select("level", "cell", "heads", *["v", "f"][: 2 * blobs]).mapInArrow(over, ", ".join(fields))


def collapsed(some: np.ndarray, v: np.ndarray, of_vertex: np.ndarray, f: np.ndarray, of_face: np.ndarray, held: np.ndarray, targets: np.ndarray, how: object) -> dict[int, tuple | None]:
    """What simplify_many makes of these pieces (ascending numbers), as mesh.relax gives it."""
    member = np.zeros(len(targets), bool)
    member[some] = True
    vs, fs, rank = member[of_vertex], member[of_face], np.cumsum(member) - 1
    own, faces = v[vs], (np.cumsum(vs) - 1)[f[fs]]
    got = how.simplify_many(own, rank[of_vertex[vs]], faces, rank[of_face[fs]], fixed=held[vs], target_faces=targets[some], known=how.knows(own, faces) if hasattr(how, "knows") else None)
    return {k: x and (*x, False) for k, x in zip(some.tolist(), got)}


def pieces(triangles: DataFrame, cell_size: tuple, levels: int, decimation: Decimation, how: object) -> DataFrame:
    """Bundles of one piece a (level, cell, object): welded and, above level 0, simplified.

    triangles: object_id, ordinal, ax .. cz. Uncut triangles meet by (object, coarsest cell), beside other
    objects of that cell, so that bundles hold many pieces; they are cut there, and the pieces of all levels are made of one sort of the fragments by their corners, so that
    the order of rows does not matter. All pieces of a batch are welded at once, those that have their
    target pass as they are, and a piece that is its only child's input over again takes its result.
    """

    def packed(keys: tuple, v: np.ndarray, nv: np.ndarray, f: np.ndarray, nf: np.ndarray, told: tuple) -> pa.RecordBatch:
        if (nf == 0).any():  # where no face is left, vertices are of no use
            v, nv = v[np.repeat(nf > 0, nv)], np.where(nf > 0, nv, 0)
        at = np.concatenate([[0], np.cumsum(nv)])[:-1]
        filled = nv > 0
        low, high = np.zeros((len(nv), 3)), np.zeros((len(nv), 3))
        if filled.any():
            low[filled], high[filled] = np.minimum.reduceat(v, at[filled]), np.maximum.reduceat(v, at[filled])
        heads = np.zeros(len(nv), HEAD)
        for name, column in zip(HEAD.names, (*keys[2:], *told, nv, 3 * nf, *low.T, *high.T)):
            heads[name] = column
        return bundled(int(keys[0][0]), keys[1], heads, v, f)

    def fragments(table: pa.Table) -> tuple[np.ndarray, ...]:
        """Rows, cells and corners of what is cut, by group and corners."""
        t = np.stack([table[c].to_numpy() for c in CORNERS], axis=1).reshape(-1, 3, 3)
        low = morton.deinterleave(table["top"].to_numpy()) << (levels - 1)
        source, cells, out = mesh.clip(t, cell_size, low, low + (1 << (levels - 1)) - 1)
        out = mesh.snap(out, cell_size, levels, geometry.STEPS)
        good = mesh.squared(out) > 0
        source, cells, out = source[good], cells[good], out[good]
        starts = np.concatenate([[0], changes(table, ["object_id", "top"])])
        group = np.searchsorted(starts, source, side="right") - 1
        order = np.lexsort((*out.reshape(-1, 9).T[::-1], group))
        return source[order], group[order], morton.interleave(cells[order]), out[order]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["object_id", "top"]):
            source, group, cells, triangles = fragments(table)
            if not len(source):
                continue
            ids, numbers = table["object_id"].to_numpy(), table["ordinal"].to_numpy()
            below: dict[tuple, tuple] = {}
            for n in range(levels):
                cell = cells >> (3 * n)
                order = np.lexsort((cell, group))
                g, c = group[order], cell[order]
                begins = np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])])
                first = np.flatnonzero(begins)
                v, of_vertex, f, of_face = mesh.weld_many(np.cumsum(begins) - 1, triangles[order])
                count = len(first)
                nv, before = (np.bincount(x, minlength=count) for x in (of_vertex, of_face))
                keys = np.full(count, n), c[first], ids[source[order[first]]], numbers[source[order[first]]]
                held = mesh.on_planes(v, np.array(cell_size, float) * (1 << n))
                start = np.concatenate([[0], np.cumsum(nv)])
                f = f - start[of_face][:, None]
                if not n:
                    zero = np.zeros(count)
                    yield packed(keys, v, nv, f, before, (zero, before, zero.astype(int), zero.astype(bool)))
                    continue
                targets = np.maximum(decimation.floor_faces, np.rint(before * decimation.ratio**n)).astype(np.int64)
                pinned = np.bincount(of_vertex[held], minlength=count) * (before > 0)
                floor = (before > 0) & ((before <= targets) | (np.rint(before * decimation.ratio**n) <= decimation.floor_faces))
                work = before > targets
                plain = ~work
                told = np.zeros(count), before, pinned, floor
                if plain.any():
                    yield packed(tuple(k[plain] for k in keys), v[plain[of_vertex]], nv[plain], f[plain[of_face]], before[plain], tuple(x[plain] for x in told))
                if not work.any():
                    below = {}
                    continue
                whole = f + start[of_face][:, None]
                around, out, moved, now, fresh = None, {}, np.zeros(count), {}, []
                spans = list(mesh.per_piece(of_vertex, of_face, count))
                for k in np.flatnonzero(work).tolist():
                    told_of, mask = (int(before[k]), int(targets[k])), held[spans[k][0]]
                    known = below.get((int(g[first[k]]), int(c[first[k]])))
                    if known is not None and known[0] == told_of and np.array_equal(known[1], mask):
                        out[k] = known[2]  # all its faces are of this one child: the same input over again
                    else:
                        fresh.append(k)
                if hasattr(how, "simplify_many"):
                    small = np.array([k for k in fresh if nv[k] <= mesh.MANY_VERTICES], int)
                    small = small[np.argsort(nv[small], kind="stable")]
                    for some in np.array_split(small, max(1, -(-len(small) // 512))):
                        if len(some):
                            out |= collapsed(np.sort(some), v, of_vertex, whole, of_face, held, targets, how)
                for k in fresh:
                    if out.get(k) is None:
                        vs, fs = spans[k]
                        if around is None and hasattr(how, "knows"):
                            around = how.knows(v, whole[work[of_face]])
                        more = {"known": around.of(vs)} if around is not None else {}
                        out[k] = mesh.relax(v[vs], f[fs], held[vs], int(targets[k]), how, **more)
                for k, got in out.items():
                    now[int(g[first[k]]), int(c[first[k]]) >> 3] = (int(before[k]), int(targets[k])), held[spans[k][0]], got
                    moved[k], floor[k] = got[2], got[3] or floor[k]
                below = now
                wv, wf = ([out[k][i] for k in np.flatnonzero(work).tolist()] for i in (0, 1))
                yield packed(tuple(k[work] for k in keys), np.concatenate(wv), np.array([len(x) for x in wv]), np.concatenate(wf), np.array([len(x) for x in wf]), (moved[work], before[work], pinned[work], floor[work]))

    rows = spread_to_tops(triangles, cell_size, levels)
    return rows.repartition("top", F.pmod(F.xxhash64("object_id"), F.lit(SHARES))).sortWithinPartitions("top", "object_id").mapInArrow(over, BUNDLE)


GEOMETRY = "level int, cell long, positions binary, indices binary, vertex_count int, index_count int, object_ids array<long>, object_ordinals array<int>, object_vertex_offsets array<int>, object_index_offsets array<int>"
STATS = ", ".join(f"{b} double" for b in catalogs.BOUNDS) + ", displacement double"


def encoded_cells(starts: np.ndarray, level: np.ndarray, cell: np.ndarray, heads: dict | np.ndarray, v: np.ndarray, nv: np.ndarray, f: np.ndarray, nf: np.ndarray, cell_size: tuple, packer: object, compression: str) -> Iterator[pa.RecordBatch]:
    """A geometry row, bounds and displacement of each run of pieces from these places on, ids ascending.

    level and cell: of each run; heads: object_id, ordinal and displacement of each piece.
    """
    names = [n.split()[0] for n in f"{GEOMETRY}, {STATS}".split(", ")]
    ints = pa.list_(pa.int32())
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int64()), ints, ints, ints, *[pa.float64()] * 7)
    v_at, f_at = (np.concatenate([[0], np.cumsum(n)]) for n in (nv, nf))
    for a, b, *at in zip(starts, [*starts[1:], len(nv)], cell.tolist(), level.tolist()):
        own, n = v[v_at[a] : v_at[b]], v_at[a:b] - v_at[a]
        faces = f[f_at[a] : f_at[b]].astype(np.int64) + np.repeat(n, nf[a:b])[:, None]
        positions, indices = packer.encode_positions(encode_positions(own, *at, cell_size), compression), packer.encode_indices(faces, len(own), compression)
        low, high = (own.min(axis=0), own.max(axis=0)) if len(own) else (np.zeros(3), np.zeros(3))
        out = (at[1], at[0], positions, indices, len(own), 3 * len(faces), heads["object_id"][a:b], heads["ordinal"][a:b], n, 3 * (f_at[a:b] - f_at[a]), *low, *high, heads["displacement"][a:b].max())
        yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(out, kinds)], names=names)


def assemble(built: DataFrame, cell_size: tuple, codec: str = "NONE", compression: str = "NONE") -> DataFrame:
    """Geometry rows with bounds and displacement: the pieces of a cell, object ids ascending.

    built: pieces and ordinal. Positions are quantised in the cell's box; indices count through the cell.
    """
    columns = ["level", "cell", "object_id", "ordinal", "v", "f", "displacement"]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = codec_for(codec)
        for table in whole_runs(batches, ["level", "cell"]):
            starts = np.array([0, *changes(table, ["level", "cell"])])
            (v, nv), (f, nf) = runs_of(table["v"], "<f8"), runs_of(table["f"], "<i4")
            own = {c: table[c].to_numpy() for c in columns if c not in ("v", "f")}
            yield from encoded_cells(starts, own["level"][starts], own["cell"][starts], own, v, nv, f, nf, cell_size, packer, compression)

    rows = built.where(F.octet_length("f") > 0).select(columns).repartition("level", "cell").sortWithinPartitions("level", "cell", "object_id")
    return rows.mapInArrow(over, f"{GEOMETRY}, {STATS}")


def assemble_bundles(bundles: DataFrame, cell_size: tuple, codec: str = "NONE", compression: str = "NONE") -> DataFrame:
    """assemble of bundled pieces: the bundles of a cell meet, and their pieces are sorted there."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = codec_for(codec)
        for table in whole_runs(batches, ["level", "cell"]):
            heads, n = heads_of(table["heads"])
            first = np.zeros(table.num_rows, bool)
            first[np.array([0, *changes(table, ["level", "cell"])])] = True
            run = np.repeat(np.cumsum(first) - 1, n)
            order = np.lexsort((heads["object_id"], run))
            order = order[heads["ni"][order] > 0]
            if not len(order):
                continue
            nv, nf = heads["nv"].astype(np.int64), heads["ni"].astype(np.int64) // 3
            v, f = runs_of(table["v"], "<f8")[0][rows_of(nv, order)], runs_of(table["f"], "<i4")[0][rows_of(nf, order)]
            run = run[order]
            starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            level, cell = (table[c].to_numpy()[first][run[starts]] for c in ("level", "cell"))
            yield from encoded_cells(starts, level, cell, heads[order], v, nv[order], f, nf[order], cell_size, packer, compression)

    return bundles.repartition("level", "cell").sortWithinPartitions("level", "cell").mapInArrow(over, f"{GEOMETRY}, {STATS}")


def gathered(code: int, axis: int) -> int:
    return sum((code >> (3 * n + axis) & 1) << n for n in range(morton.BITS))


def cell_origin(cell: int, level: int, cell_size: tuple) -> tuple[np.ndarray, np.ndarray]:
    extent = np.array([float(s << level) for s in cell_size])
    return np.array([gathered(cell, a) for a in range(3)]) * extent, extent


def encode_positions(v: np.ndarray, cell: int, level: int, cell_size: tuple) -> np.ndarray:
    origin, extent = cell_origin(cell, level, cell_size)
    t = (v - origin) / extent
    slack = 0.5 / geometry.STEPS
    if len(t) and (t.min() < -slack or t.max() > 1 + slack):
        raise PartitioningError(f"a vertex of cell {cell} at level {level} lies outside it")
    return np.rint(np.clip(t, 0, 1) * geometry.STEPS).astype("<u2")


def decode_cell(positions: bytes, indices: bytes, cell: int, level: int, cell_size: tuple, n: int, m: int, codec: str = "NONE", compression: str = "NONE") -> tuple[np.ndarray, np.ndarray]:
    """Vertices and faces of a cell; blobs that are not as long as their counts say are an error."""
    packer = codec_for(codec)
    try:
        q, f = packer.decode_positions(positions, n, compression), packer.decode_indices(indices, m, compression)
    except FormatError as e:
        raise FormatError(f"cell {cell} at level {level}: {e}") from e
    origin, extent = cell_origin(cell, level, cell_size)
    return origin + q / geometry.STEPS * extent, f.astype(np.int64)


DECODED = "level int, cell long, object_id long, vertex_count int, face_count int, v binary, f binary"
BLOB_COLUMNS = ["level", "cell", "positions", "indices", "vertex_count", "index_count", "object_ids", "object_ordinals", "object_vertex_offsets", "object_index_offsets"]


def refuse_nulls(table: pa.Table | pa.RecordBatch, what: str) -> None:
    for name in table.schema.names:
        if table.column(name).null_count:
            raise FormatError(f"{what} holds a null in column {name}, which may have none")


def decode_rows(rows: DataFrame, cell_size: tuple, codec: str = "NONE", compression: str = "NONE") -> DataFrame:
    """One row a (level, cell, object) of geometry rows: its vertices (float64) and faces (int32, from 0)."""
    names = [n.split()[0] for n in DECODED.split(", ")]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refuse_nulls(batch, "geometry")
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() if c not in BLOB_COLUMNS[6:] else batch.column(c)[i].values.to_numpy() for c in BLOB_COLUMNS}
                v, f = decode_cell(r["positions"], r["indices"], r["cell"], r["level"], cell_size, r["vertex_count"], r["index_count"], codec, compression)
                n = len(r["object_ids"])
                if not n:
                    continue
                starts, ends = np.append(r["object_vertex_offsets"], len(v)), np.append(r["object_index_offsets"] // 3, len(f))
                nv, nf = np.diff(starts), np.diff(ends)
                if len(starts) != n + 1 or len(ends) != n + 1 or starts[0] or ends[0] or (nv < 0).any() or (nf < 0).any():
                    raise FormatError(f"cell {r['cell']} at level {r['level']}: its objects' offsets do not ascend from 0 to its counts")
                f = f - np.repeat(starts[:-1], nf)[:, None]
                cols = [np.full(n, r["level"]), np.full(n, r["cell"]), r["object_ids"], nv, nf, binaries(v.astype("<f8"), nv), binaries(f.astype("<i4"), nf)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c).cast(k) for c, k in zip(cols, kinds)], names=names)

    return rows.select(BLOB_COLUMNS).mapInArrow(over, DECODED)


def slices(v: np.ndarray, f: np.ndarray, ids: list[int], vertex_offsets: list[int], index_offsets: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(object, vertices, faces from 0) of a cell: a slice ends where the next begins, or with the cell."""
    starts, ends = [*vertex_offsets, len(v)], [*(x // 3 for x in index_offsets), len(f)]
    for i, o in enumerate(ids):
        yield o, v[starts[i] : starts[i + 1]], f[ends[i] : ends[i + 1]] - starts[i]


@dataclass
class Built:
    """Frames of a collection; `geometry` still carries bounds and displacement."""

    geometry: DataFrame
    cells: DataFrame
    objects: DataFrame
    bundles: DataFrame
    stats: DataFrame
    ordinals: DataFrame
    cell_size: tuple
    levels: int
    decimation: Decimation
    codec: str
    compression: str

    def write(self, prefix: str, **how) -> object:
        """Writes the collection under a prefix; its manifest."""
        from tessella.sources import store

        return store.write_collection(self, prefix, **how)

    @property
    def pieces(self) -> DataFrame:
        """One row a (level, cell, object): the welded and, above level 0, simplified piece."""
        return unbundled(self.bundles, True)

    @property
    def heads(self) -> DataFrame:
        """The pieces without their vertices and faces."""
        return unbundled(self.bundles, False)

    def encoded(self, codec: str = "NONE", compression: str = "NONE") -> Built:
        """The same pieces in other blobs; both let go of them with one release."""
        check_encoding(codec, compression)
        return finished(self.bundles, self.ordinals, self.cell_size, self.levels, self.decimation, codec, compression)

    def release(self) -> None:
        """Lets go of the frames that the build keeps; they are made anew where they are used again."""
        self.geometry.unpersist()
        self.stats.unpersist()
        self.bundles.unpersist()
        self.ordinals.unpersist()

    def faces_per_level(self) -> DataFrame:
        """level, faces, cells, and the ratio to the level below."""
        rows = self.cells.groupBy("level").agg(F.sum(F.expr("index_count div 3")).alias("faces"), F.count("*").alias("cells"))
        below = rows.select((F.col("level") + 1).alias("level"), F.col("faces").alias("_below"))
        return rows.join(below, "level", "left").select("level", "faces", "cells", (F.col("faces") / F.col("_below")).alias("ratio"))


def build(triangles: DataFrame, cell_size: tuple | None = None, levels: int = 3, codec: str = "NONE", compression: str = "NONE", simplifier: object = None, decimation: Decimation | None = None, warn: bool = True) -> Built:
    """triangles: object_id, ax .. cz in the positive octant. Frames are persisted: all outputs share one build."""
    how, decimation = mesh.simplifier(simplifier), decimation or Decimation()
    check_encoding(codec, compression)
    if levels < 1:
        raise FormatError(f"{levels} levels")
    if cell_size is None:
        ends = [f(*[F.col(f"{p}{a}") for p in "abc"]) for f in (F.least, F.greatest) for a in "xyz"]
        spans = triangles.select("object_id", *[e.alias(b) for e, b in zip(ends, catalogs.BOUNDS)])
        spans = spans.groupBy("object_id").agg(*[(F.min if "_min_" in b else F.max)(b).alias(b) for b in catalogs.BOUNDS])
        cell_size = catalogs.choose_cell_size(spans)
    cell_size = tuple(int(s) for s in cell_size)
    if min(cell_size) < 1:
        raise FormatError(f"cell size {cell_size}")
    ids = triangles.select("object_id").distinct().persist()  # triangles are gone through once for them
    ordinals = catalogs.ordinals(ids).persist()
    if ordinals.count() > MAX_OBJECTS:
        raise FormatError(f"more than {MAX_OBJECTS} objects")
    ids.unpersist()
    # Joined while rows are slim: pieces are many times as large. Never by broadcast: ids grow with the scene.
    made = pieces(triangles.join(ordinals.hint("merge"), "object_id"), cell_size, levels, decimation, how).persist(StorageLevel.DISK_ONLY)
    out = finished(made, ordinals, cell_size, levels, decimation, codec, compression)
    if warn:
        warn_if_missed(out, how)
    return out


def finished(made: DataFrame, ordinals: DataFrame, cell_size: tuple, levels: int, decimation: Decimation, codec: str, compression: str) -> Built:
    """The frames of a collection of these pieces."""
    frame = assemble_bundles(made, cell_size, codec, compression).persist(StorageLevel.DISK_ONLY)  # blobs in memory leave a small heap no room
    stats = frame.select("level", "cell", "vertex_count", "index_count", *catalogs.BOUNDS, "displacement", F.size("object_ids").alias("object_count"), (F.octet_length("positions") + F.octet_length("indices")).cast("long").alias("blob_bytes")).persist()  # a row a cell, which all catalogs are made of
    cells = catalogs.full_catalog(stats, cell_size, levels).drop("displacement")
    return Built(frame, cells, objects(made, ordinals), made, stats, ordinals, cell_size, levels, decimation, codec, compression)


def objects(made: DataFrame, ordinals: DataFrame) -> DataFrame:
    """The object catalog; one that left no piece stays with zeros and no cells."""
    rows = unbundled(made, False).where("ni > 0").select("level", "cell", "object_id", "nv", "ni", *catalogs.BOUNDS)
    fine = F.col("level") == 0
    merged = [(F.min if "_min_" in b else F.max)(F.when(fine, F.col(b))).alias(b) for b in catalogs.BOUNDS]
    sums = [F.sum(F.when(fine, F.col(n))).cast("int").alias(m) for n, m in (("nv", "vertex_count"), ("ni", "index_count"))]
    lists = F.sort_array(F.collect_list(F.struct("level", "cell"))).alias("cells")
    out = ordinals.join(rows.groupBy("object_id").agg(*merged, *sums, lists), "object_id", "left")
    zero = {b: F.coalesce(b, F.lit(0.0)) for b in catalogs.BOUNDS} | {n: F.coalesce(n, F.lit(0)) for n in ("vertex_count", "index_count")}
    return out.withColumns(zero | {"cells": F.coalesce("cells", F.array().cast("array<struct<level:int,cell:bigint>>"))}).select("object_id", "ordinal", *catalogs.BOUNDS, "vertex_count", "index_count", "cells")


def warn_if_missed(built: Built, how: object) -> None:
    """Warns where a level holds more than the one below, or over twice what was asked for, and why."""
    rows = built.heads.groupBy("level").agg(F.sum(F.col("ni") / 3).alias("faces"), F.count("*").alias("n"), F.count_if("at_floor").alias("floor"), F.sum("pinned").alias("pinned"), F.sum("faces_before").alias("before")).orderBy("level").collect()
    for a, b in zip(rows, rows[1:]):
        if not a["faces"]:
            continue
        if b["faces"] > a["faces"]:
            warnings.warn(f"level {b['level']} holds {b['faces']:.0f} faces, more than the {a['faces']:.0f} of the level below", stacklevel=3)
        elif b["faces"] > 2 * built.decimation.ratio * a["faces"]:
            if b["floor"] * 2 > b["n"]:
                why = "most pieces are at the least number of faces: use larger cells"
            elif b["pinned"] * 4 > b["before"] and getattr(how, "uses_fixed_mask", True):
                why = "a large share of vertices lies on cell planes and is held"
            else:
                why = "borders of pieces are held where the surface was cut"
            warnings.warn(f"level {b['level']} holds {b['faces'] / a['faces']:.0%} of the level below, asked for {built.decimation.ratio:.0%}: {why}", stacklevel=3)
