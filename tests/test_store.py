import asyncio
import json
import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_mesh import areas, sphere

from tessella.errors import FormatError, UnfinishedCollectionError
from tessella.operators import audit, mesh, pyramid
from tessella.sources import files, store
from tessella.sources.manifest import Manifest

SIZE = (64, 64, 32)


def soup(spark, objects):
    rows = [(i, n, *map(float, t.ravel())) for i, s in objects.items() for n, t in enumerate(s)]
    return spark.createDataFrame(rows, "object_id long, fid int, " + ", ".join(f"{c} double" for c in pyramid.CORNERS))


@pytest.fixture(scope="module")
def scene(spark):
    return {7: sphere(3, 40, (90, 80, 70)), 3: sphere(1, 9, (20, 20, 12)), 11: sphere(2, 26, (150, 60, 40))}


@pytest.fixture(scope="module")
def collection(spark, scene, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('c')}/c"
    built = pyramid.build(soup(spark, scene), SIZE, 3, warn=False)
    store.write_collection(built, path, part_bytes=40_000, row_group_bytes=6_000)
    return store.open_collection(spark, path)


def test_round_trip(collection, scene):
    for i, t in scene.items():
        v, f = collection.object_mesh(i)
        assert abs(areas(v[f]).sum() / areas(t).sum() - 1) < 0.01
        assert not mesh.border(f, len(v)).any()  # closed again: both sides of each plane agree
        assert mesh.surface_distance(v, t) < 0.05
        for level in (1, 2):
            assert len(collection.object_mesh(i, level)[1]) > 0
    with pytest.raises(KeyError):
        collection.object_mesh(99)


def test_locators_are_exact_and_parts_bounded(collection):
    root = collection.prefix.removeprefix("file://")
    n = 0
    for r in collection.cells().collect():
        t = pq.ParquetFile(f"{root}/level={r['level']}/part-{r['part']:05d}.parquet").read_row_group(r["row_group"])
        row = [x for x in t.to_pylist() if x["cell"] == r["cell"]]
        assert len(row) == 1 and len(row[0]["positions"]) + len(row[0]["indices"]) == r["blob_bytes"]
        n += 1
    assert n and len(collection.manifest.level_files[0]) > 1
    assert str(pq.read_schema(f"{root}/catalog/cells.parquet").field("child_mask").type) == "uint8"
    for level, fs in collection.manifest.level_files.items():
        cells = [c for f in fs for c in pq.read_table(f"{root}/{f.path}", partitioning=None)["cell"].to_pylist()]
        assert cells == sorted(cells)


def test_planning_opens_no_geometry(spark, collection, tmp_path):
    root = collection.prefix.removeprefix("file://")
    os.makedirs(f"{tmp_path}/x/catalog")
    for f in ("manifest.json", "catalog/cells.parquet", "catalog/objects.parquet"):
        open(f"{tmp_path}/x/{f}", "wb").write(open(f"{root}/{f}", "rb").read())
    other = store.open_collection(spark, f"file://{tmp_path}/x")
    assert other.plan(error_budget=1.0).count() == collection.plan(error_budget=1.0).count()
    assert {r["cell"] for r in collection.plan(objects=[3]).collect()} == {r["cell"] for r in collection.object_cells().where("object_id = 3 and level = 0").collect()}


def test_located_reads_keep_order_and_refuse_unknown_keys(spark, collection):
    keys = collection.cells().where("level <= 1").orderBy(F.rand(1)).limit(20).select("level", "cell").collect()
    asked = spark.createDataFrame([(k["level"], k["cell"], n) for n, k in enumerate(keys)], "level int, cell long, pos int")
    got = [(r["level"], r["cell"]) for r in collection.read_cells(asked).collect()]
    assert list(dict.fromkeys(got)) == [(k["level"], k["cell"]) for k in keys]
    with pytest.raises(KeyError):
        collection.read_cells(spark.createDataFrame([(0, 1 << 40, 0)], "level int, cell long, pos int"))


def test_chunking_does_not_change_geometry_and_rewriting_leaves_nothing(spark, scene, tmp_path):
    path, built = f"file://{tmp_path}/c", pyramid.build(soup(spark, scene), SIZE, 2, compression="ZSTD", simplifier="GREEDY", warn=False)
    asyncio.run(store.awrite_collection(built, path, part_bytes=3_000, row_group_bytes=1_000))
    a = {r["cell"]: r["positions"] for r in store.open_collection(spark, path).geometry(0).collect()}
    many = sum(len(f) for _, _, f in os.walk(f"{tmp_path}/c"))
    store.write_collection(built, path)
    c = asyncio.run(store.aopen_collection(spark, path))
    assert {r["cell"]: r["positions"] for r in c.geometry(0).collect()} == a
    names = [f for _, _, fs in os.walk(f"{tmp_path}/c") for f in fs if not f.endswith(".crc")]
    assert len(names) == 5 < many and not any("tmp" in f for f in names)
    assert audit.verify(c).ok


def test_structure_does_not_depend_on_the_simplifier_or_row_order(spark, scene):
    t = soup(spark, scene)
    a, b = pyramid.build(t, SIZE, 3, warn=False), pyramid.build(t.orderBy(F.rand(3)), SIZE, 3, simplifier="GREEDY", warn=False)
    key = ["level", "cell", "object_count", "child_mask"]
    assert sorted(a.cells.select(key).collect()) == sorted(b.cells.select(key).collect())
    flat = [(r["level"], r["cell"], r["positions"]) for r in a.geometry.where("level = 0").collect()]
    assert sorted(flat) == sorted((r["level"], r["cell"], r["positions"]) for r in b.geometry.where("level = 0").collect())


def test_unfinished_and_wrong_manifests(spark, tmp_path):
    with pytest.raises(UnfinishedCollectionError):
        store.open_collection(spark, f"file://{tmp_path}/none")
    good = json.loads(Manifest((1, 2, 3), 2).to_json())
    assert Manifest.from_json(json.dumps(good | {"more": 1}).encode()).cell_size == (1, 2, 3)
    for change in ({"specVersion": "2"}, {"grid": None}, {"grid": good["grid"] | {"cellSize": [1, 2]}}, {"grid": good["grid"] | {"levels": 0}}, {"encoding": good["encoding"] | {"boundary": "X"}}, {"encoding": good["encoding"] | {"ratio": 0.5}}, {"files": {"cells": "/abs"}}, {"files": {"cells": "a/../../b"}}):
        with pytest.raises(FormatError):
            Manifest.from_json(json.dumps(good | change).encode())
    for body in (b"{", b"[]"):
        with pytest.raises(FormatError):
            Manifest.from_json(body)


def test_inputs_are_checked(spark):
    v = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 1.0, 0.0, 0.0), (1, 2, 0.0, 1.0, 0.0)], "object_id long, vid int, x double, y double, z double")
    ok = pyramid.soup(v, spark.createDataFrame([(1, 0, 0, 1, 2)], "object_id long, fid int, a int, b int, c int"))
    assert ok.first()["by"] == 0.0 and ok.first()["cy"] == 1.0
    with pytest.raises(Exception, match="object 1: face 0 names vertex 9"):
        pyramid.soup(v, spark.createDataFrame([(1, 0, 0, 1, 9)], "object_id long, fid int, a int, b int, c int")).collect()
    with pytest.raises(FormatError, match="lacks"):
        store.validate(v, "cells")
    with pytest.raises(FormatError, match="role"):
        store.validate(v, "x")


def test_missed_targets_are_told(spark):
    with pytest.warns(UserWarning, match="asked for 25%"):
        pyramid.build(soup(spark, {1: sphere(2, 20, (40, 40, 40))}), (4, 4, 4), 2)


FAULTS = {
    "level=0": "files exist",
    "child_mask": "child masks name children that exist",
    "lod_error": "a parent's error dominates its children's",
    "part": "locators point inside the files that exist",
    "row_group": "every blob decodes to the counts its row claims",
    "level": "levels are contiguous",
    "larger": "a coarse level holds less than the level it summarises",
    "box": "lod_error bounds how far a vertex moved from level 0",
    "planes": "on-plane vertices are held fixed across levels",
    "null part": "every cell carries a locator",
    "ordinal": "object ordinals are dense",
    "cells": "the object catalog names cells that exist",
    "bytes": "recorded file lengths land on the end of the file",
    "vertex_count": "every blob decodes to the counts its row claims",
    "indices": "indices stay inside their vertex array",
    "offsets": "object offset runs ascend and stay in bounds",
    "object_ids": "the two catalogs agree about who is in which cell",
}


@pytest.mark.parametrize("fault", FAULTS)
def test_each_fault_fails_its_own_check(spark, collection, tmp_path, fault):
    import shutil

    root = f"{tmp_path}/c"
    shutil.copytree(collection.prefix.removeprefix("file://"), root)
    for d, _, fs in os.walk(root):
        for f in fs:
            if f.endswith(".crc"):
                os.remove(f"{d}/{f}")

    def change(name, edit):
        t = pq.read_table(f"{root}/{name}", partitioning=None)
        rows = t.to_pylist()
        edit(rows)
        import pyarrow as pa

        pq.write_table(pa.Table.from_pylist(rows, t.schema), f"{root}/{name}")
        m = json.load(open(f"{root}/manifest.json"))
        for fs in [*m["files"]["levels"].values()]:
            for f in fs:
                if f["path"] == name:
                    f["bytes"] = os.path.getsize(f"{root}/{name}")
        json.dump(m, open(f"{root}/manifest.json", "w"))

    cells, part = "catalog/cells.parquet", "level=0/part-00000.parquet"
    if fault == "level=0":
        os.remove(f"{root}/{part}")
    elif fault == "child_mask":
        change(cells, lambda r: next(x for x in r if x["level"] == 1).update(child_mask=0))
    elif fault == "lod_error":
        change(cells, lambda r: next(x for x in r if x["level"] == 2).update(lod_error=0.0))
    elif fault == "part":
        change(cells, lambda r: r[0].update(part=99))
    elif fault == "row_group":
        change(cells, lambda r: next(x for x in r if x["level"] == 0 and x["part"] == 0).update(row_group=next(x for x in r if x["level"] == 0 and x["part"] == 0)["row_group"] + 1))
    elif fault == "level":
        change(cells, lambda r: [r.remove(x) for x in list(r) if x["level"] == 1])
    elif fault == "larger":
        change(cells, lambda r: next(x for x in r if x["level"] == 2).update(index_count=10**8))
    elif fault == "box":
        change(cells, lambda r: [x.update(lod_error=1e-9) for x in r])
    elif fault == "planes":
        change("level=1/part-00000.parquet", lambda r: [x.update(positions=bytes(6 * x["vertex_count"])) for x in r])
    elif fault == "null part":
        change(cells, lambda r: r[0].update(part=None))
    elif fault == "ordinal":
        change("catalog/objects.parquet", lambda r: r[0].update(ordinal=5))
    elif fault == "cells":
        change("catalog/objects.parquet", lambda r: r[0]["cells"].append({"level": 0, "cell": 1 << 40}))
    elif fault == "bytes":
        m = json.load(open(f"{root}/manifest.json"))
        m["files"]["levels"]["0"][0]["bytes"] -= 1
        json.dump(m, open(f"{root}/manifest.json", "w"))
    elif fault == "vertex_count":
        change(part, lambda r: r[0].update(vertex_count=r[0]["vertex_count"] + 1))
    elif fault == "indices":
        change(part, lambda r: r[0].update(indices=np.array([99999] * r[0]["index_count"], "<u4").tobytes()))
    elif fault == "offsets":
        change(part, lambda r: r[0].update(object_index_offsets=[1] * len(r[0]["object_ids"])))
    elif fault == "object_ids":
        change(part, lambda r: r[0].update(object_ids=[12345 + i for i in range(len(r[0]["object_ids"]))]))
    report = audit.verify(store.open_collection(spark, f"file://{root}"), "geometry" if fault in ("larger", "box", "planes") else "blobs")
    failed = {c.name for c in report.failures}
    assert FAULTS[fault] in failed and not report
    if fault not in ("level=0", "cells", "level", "planes"):  # these break more than one claim
        assert failed == {FAULTS[fault]}


class Counted:
    """A file that counts the bytes read from it."""

    def __init__(self, file, seen):
        self.file, self.seen = file, seen

    def read(self, n=-1):
        out = self.file.read(n) if n >= 0 else self.file.read()
        self.seen.append(len(out))
        return out

    def seek(self, at, whence=0):
        return self.file.seek(at, whence)

    def tell(self):
        return self.file.tell()

    def close(self):
        self.file.close()

    @property
    def closed(self):
        return self.file.closed

    def readable(self):
        return True

    seekable = readable


def test_reading_a_cell_costs_its_row_group(spark, collection):
    import pyarrow as pa

    c, seen = store.open_collection(spark, collection.prefix), []
    plain = c.open_file
    c.cells()
    c.open_file = lambda path: pa.PythonFile(Counted(plain(path), seen), "r")
    rows = [r for r in c.cells_at(0).collect() if r["part"] == 0]
    spans = c.row_group_spans(0, 0)
    assert len(spans) > 2 and all(a < b for a, b in spans) and spans == sorted(spans)
    level = c.manifest.level_files[0]
    for r in (rows[0], rows[-1]):
        seen.clear()
        cell = c.read_cell(0, r["cell"])
        a, b = spans[r["row_group"]]
        assert (len(cell.vertices), 3 * len(cell.faces), len(cell.object_ids)) == (r["vertex_count"], r["index_count"], r["object_count"])
        assert 0 < sum(seen) <= b - a + 64 and sum(seen) < sum(f.bytes for f in level) / 3  # the footer is known by now
    before = dict(c.footers)
    c.release()
    assert before and not c.footers
    seen.clear()
    c.read_cell(0, rows[0]["cell"])
    assert sum(seen) > spans[0][1] - spans[0][0]  # the footer again
    with pytest.raises(KeyError):
        c.read_cell(0, 1 << 40)


def test_cells_agree_with_the_frames_and_come_in_order(spark, collection):
    keys = [(r["level"], r["cell"]) for r in collection.cells().orderBy(F.rand(4)).limit(12).collect()]
    for concurrency in (1, 8):
        got = asyncio.run(collection.aread_cells(keys + keys[:2], concurrency=concurrency))
        assert [(c.level, c.cell) for c in got] == keys + keys[:2]
    frame = {(r["level"], r["cell"], r["object_id"]): (r["v"], r["f"]) for r in collection.decode(collection.read_rows(spark.createDataFrame(keys, "level int, cell long"))).collect()}
    assert {(c.level, c.cell, o) for c in got for o in c.object_ids} == frame.keys()
    for c in got:
        for o in c.object_ids:
            v, f = c.object_mesh(o)
            assert (v.astype("<f8").tobytes(), f.astype("<i4").tobytes()) == tuple(map(bytes, frame[c.level, c.cell, o]))
        with pytest.raises(KeyError):
            c.object_mesh(999)
    one = asyncio.run(collection.aread_cell(*keys[0]))
    assert (one.vertices == got[0].vertices).all()
    assert collection.kept
    collection.release()
    assert not collection.kept


def test_everyday_look_ups(collection):
    assert {r["level"] for r in collection.roots().collect()} == {2}
    ones = [r["cell"] for r in collection.cells_at(1).collect()]
    assert ones == sorted(ones) and len(ones) == collection.manifest.counts["cellsPerLevel"][1]
    own = collection.object_cells_at(3, 0)
    assert own == sorted(r["cell"] for r in collection.object_cells().where("object_id = 3 and level = 0").collect())
    assert sorted(r["cell"] for r in collection.cells_for_objects([3], 0).collect()) == own
    with pytest.raises(KeyError):
        collection.object_cells_at(99, 0)


def copied(collection, tmp_path):
    import shutil

    root = f"{tmp_path}/c"
    shutil.copytree(collection.prefix.removeprefix("file://"), root, ignore=shutil.ignore_patterns("*.crc"))
    return root


def rewritten(path, edit):
    import pyarrow as pa

    t = pq.read_table(path, partitioning=None)
    rows = t.to_pylist()
    edit(rows)
    pq.write_table(pa.Table.from_pylist(rows, t.schema), path)


def test_a_locator_of_the_wrong_row_group_is_refused(spark, collection, tmp_path):
    root = copied(collection, tmp_path)
    groups = max(r["row_group"] for r in collection.cells_at(0).collect() if r["part"] == 0)
    moved = []

    def edit(rows):
        row = next(x for x in rows if x["level"] == 0 and x["part"] == 0 and x["row_group"] == 0)
        row["row_group"] = groups
        moved.append(row["cell"])

    rewritten(f"{root}/catalog/cells.parquet", edit)
    c = store.open_collection(spark, f"file://{root}")
    with pytest.raises(FormatError, match="which the cell catalog names"):
        c.read_cell(0, moved[0])
    with pytest.raises(Exception, match="which the cell catalog names"):
        c.read_rows(spark.createDataFrame([(0, moved[0])], "level int, cell long")).collect()


def test_nulls_where_none_may_be_are_refused_by_name(spark, collection, tmp_path):
    root = copied(collection, tmp_path)
    rewritten(f"{root}/catalog/cells.parquet", lambda rows: rows[0].update(lod_error=None))
    c = store.open_collection(spark, f"file://{root}")
    with pytest.raises(FormatError, match="column lod_error"):
        c.cells()
    assert c.objects().count() == 3
    first = next(r for r in collection.cells_at(0).collect() if r["part"] == 0)
    rewritten(f"{root}/level=0/part-00000.parquet", lambda rows: next(x for x in rows if x["cell"] == first["cell"]).update(vertex_count=None))
    whole = store.open_collection(spark, f"file://{root}")
    with pytest.raises(Exception, match="column vertex_count"):
        whole.decode(whole.geometry(0)).collect()


def test_empty_catalogs_keep_their_types(spark, tmp_path):
    t = soup(spark, {1: sphere(0, 5, (20, 20, 12))}).limit(0)
    m = pyramid.build(t, SIZE, 2, warn=False).write(f"file://{tmp_path}/e")
    schema = pq.read_schema(f"{tmp_path}/e/catalog/cells.parquet")
    assert m.counts["objects"] == 0 and str(schema.field("lod_error").type) == "double" and str(schema.field("child_mask").type) == "uint8"
    assert store.open_collection(spark, f"file://{tmp_path}/e").cells().count() == 0


def test_stores_hold_whole_collections(spark, collection, tmp_path):
    from tessella.sources import stores

    class Own:
        """Any object with these four methods will do."""

        def __init__(self):
            self.held = {}

        def put(self, key, body):
            self.held[key] = body

        def get(self, key, start=0, size=None):
            return self.held[key][start:] if size is None else self.held[key][start : start + size]

        def names(self, prefix=""):
            return [k for k in self.held if k.startswith(prefix)]

        def delete(self, key):
            self.held.pop(key, None)

    for n, kept in enumerate((stores.MemoryStore(), stores.DirectoryStore(f"{tmp_path}/d"), Own())):
        named = stores.save(collection, kept, "a/b")
        assert named[-1] == "a/b/manifest.json" and sorted(kept.names("a/")) == sorted(named)
        assert kept.get(named[0], 0, 4) == b"PAR1" or named[0].endswith(".json")
        other = stores.load(spark, kept, "a/b", f"file://{tmp_path}/load{n}")
        assert sorted(map(str, other.cells().collect())) == sorted(map(str, collection.cells().collect()))
        v, f = other.object_mesh(3)
        w, g = collection.object_mesh(3)
        assert (v == w).all() and (f == g).all()
    with pytest.raises(UnfinishedCollectionError):
        stores.load(spark, stores.MemoryStore(), "nothing", f"file://{tmp_path}/none")
    with pytest.raises(KeyError):
        stores.MemoryStore().get("x")


def test_codecs_are_found_by_name_and_packages_asked_for(monkeypatch):
    import sys
    import types

    from tessella.errors import MissingExtraError
    from tessella.functions import blobs
    from tessella.operators import codecs

    q, f = np.arange(12, dtype="<u2").reshape(-1, 3), np.array([[0, 1, 2], [2, 1, 3]])
    raw = codecs.codec_for("NONE")
    for compression in ("NONE", "ZSTD"):
        assert (raw.decode_positions(raw.encode_positions(q, compression), 4, compression) == q).all()
        assert (raw.decode_indices(raw.encode_indices(f, 4, compression), 6, compression) == f).all()
        with pytest.raises(FormatError):
            raw.decode_positions(raw.encode_positions(q, compression)[:-1], 4, compression)
    with pytest.raises(FormatError, match="unknown codec"):
        codecs.codec_for("X")
    for ask in (lambda: blobs.check_encoding("MESHOPT", "NONE"), lambda: codecs.codec_for("MESHOPT").encode_positions(q)):
        with pytest.raises(MissingExtraError):
            ask()
    fake = types.ModuleType("meshoptimizer")
    fake.encode_vertex_buffer = lambda a, n, size: bytes([1]) + a.tobytes()
    fake.decode_vertex_buffer = lambda n, size, b: np.frombuffer(b[1:], np.float32)
    fake.encode_index_buffer = lambda a, n, m: bytes([2]) + a.tobytes()
    fake.decode_index_buffer = lambda n, size, b: np.frombuffer(b[1:], "<u4")
    monkeypatch.setitem(sys.modules, "meshoptimizer", fake)
    packed = codecs.codec_for("MESHOPT")
    assert (packed.decode_positions(packed.encode_positions(q), 4) == q).all() and (packed.decode_indices(packed.encode_indices(f, 4), 6) == f).all()
    v, g = pyramid.decode_cell(packed.encode_positions(q), packed.encode_indices(f, 4), 0, 0, (1, 1, 1), 4, 6, "MESHOPT")
    assert np.allclose(v, q / 65535) and (g == f).all()
    with pytest.raises(FormatError):
        packed.decode_positions(packed.encode_positions(q), 5)


def test_small_file_helpers(spark, tmp_path):
    path = f"file://{tmp_path}/a/b"
    files.put(spark, path, b"hello")
    files.put(spark, path, b"hello world")
    assert files.get(spark, path) == b"hello world" and files.get(spark, path, 6, 5) == b"world" and files.length(spark, path) == 11
    for bad in ((-1, 2), (5, 7)):
        with pytest.raises(ValueError):
            files.get(spark, path, *bad)
    assert files.names(spark, f"file://{tmp_path}/a", "b") == ["b"] and files.names(spark, f"file://{tmp_path}/zz", "") == []
