"""What is done for many pieces at once gives what one by one gives, to the bit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import geometry, morton
from tessella.operators import audit, mesh, pyramid
from tessella.plans import descent
from tessella.sources import scenes

SIZE = (128, 128, 64)


def bumpy(n, seed):
    """A sheet of n x n points, uneven, with a hole where the seed is odd."""
    rng = np.random.default_rng(seed)
    x, y = np.meshgrid(np.arange(n, dtype=float), np.arange(n, dtype=float), indexing="ij")
    v = np.stack([x, y, rng.normal(0, 0.3, (n, n)) if seed % 3 else np.zeros((n, n))], axis=2).reshape(-1, 3)
    at = np.arange(n * n).reshape(n, n)
    a, b, c, d = at[:-1, :-1].ravel(), at[1:, :-1].ravel(), at[1:, 1:].ravel(), at[:-1, 1:].ravel()
    f = np.concatenate([np.stack([a, b, c], axis=1), np.stack([a, c, d], axis=1)])
    return v, f[n:] if seed % 2 else f


def test_quadric_collapses_many_as_one_by_one():
    pieces, how = [bumpy(3 + k % 5, k) for k in range(40)], mesh.Quadric()
    targets = np.array([1 + k % 9 for k in range(40)])
    at = np.cumsum([0, *(len(v) for v, _ in pieces)])
    v, f = np.concatenate([v for v, _ in pieces]), np.concatenate([f + s for (_, f), s in zip(pieces, at)])
    of_v, of_f = (np.repeat(np.arange(40), [len(p[i]) for p in pieces]) for i in (0, 1))
    fixed = np.random.default_rng(1).random(len(v)) < 0.1
    many = how.simplify_many(v, of_v, f, of_f, fixed=fixed, target_faces=targets, known=mesh.Surroundings(v, f))
    assert sum(x is not None for x in many) > 20
    for k, got in enumerate(many):
        if got is not None:
            nv, nf, error, name = how.simplify(*pieces[k], fixed=fixed[at[k] : at[k + 1]], target_faces=int(targets[k]))
            assert name == "QUADRIC" and np.array_equal(nv, got[0]) and np.array_equal(nf, got[1]) and error == got[2]


@pytest.mark.parametrize("placement", mesh.PLACEMENTS)
def test_greedy_collapses_many_as_one_by_one(placement):
    pieces, how = [bumpy(3 + k % 5, k) for k in range(40)], mesh.Greedy(placement)
    targets = np.array([1 + k % 9 for k in range(40)])
    at = np.cumsum([0, *(len(v) for v, _ in pieces)])
    v, f = np.concatenate([v for v, _ in pieces]), np.concatenate([f + s for (_, f), s in zip(pieces, at)])
    of_v, of_f = (np.repeat(np.arange(40), [len(p[i]) for p in pieces]) for i in (0, 1))
    fixed = np.random.default_rng(1).random(len(v)) < 0.1
    many = how.simplify_many(v, of_v, f, of_f, fixed=fixed, target_faces=targets)
    assert sum(x is not None for x in many) > 20
    for k, got in enumerate(many):
        nv, nf, error, _ = how.simplify(*pieces[k], fixed=fixed[at[k] : at[k + 1]], target_faces=int(targets[k]))
        if got is None:
            assert not len(nf) or len(pieces[k][1]) <= targets[k]
        else:
            assert np.array_equal(nv, got[0]) and np.array_equal(nf, got[1]) and error == got[2]


def test_bundles_hold_many_pieces_and_give_the_same_rows(spark):
    """Boxes that share cells: fewer bundles than pieces, and geometry as of the pieces one a row."""
    rng = np.random.default_rng(9)
    rows = [(i, *map(float, t.ravel())) for i in range(200) for t in rng.uniform(0, 500, (1, 1, 3)) + rng.uniform(0, 90, (5, 3, 3))]
    built = pyramid.build(spark.createDataFrame(rows, "object_id long, " + ", ".join(f"{c} double" for c in pyramid.CORNERS)), SIZE, 3, warn=False)
    assert built.bundles.count() < built.heads.count() == built.pieces.count()
    order = ["level", "cell"]
    one_by_one = pyramid.assemble(built.pieces, SIZE).orderBy(order).collect()
    assert built.geometry.orderBy(order).collect() == one_by_one and len(one_by_one) == built.stats.count()
    assert not built.geometry.storageLevel.useMemory and not built.bundles.storageLevel.useMemory
    built.release()
    assert not built.bundles.is_cached


def test_boxes_are_dealt_to_several_tasks(spark, sf):
    one, many = scenes.box_triangles(spark, sf), scenes.box_triangles(spark, sf, spread=True)
    assert many.rdd.getNumPartitions() > one.rdd.getNumPartitions()
    assert sorted(many.collect()) == sorted(one.collect())


def test_parts_cut_in_their_own_cells_are_the_whole():
    rng = np.random.default_rng(3)
    t = np.concatenate([rng.uniform(0, 1500, (200, 1, 3)) + rng.uniform(0, 300, (200, 3, 3)), rng.integers(0, 12, (200, 3, 3)) * 64.0])
    t = t[mesh.squared(t) > 0]
    source, cells, out = mesh.clip(t, SIZE)
    row, top = mesh.reached(t, (512, 512, 256))
    assert len(np.unique(np.column_stack([row, top]), axis=0)) == len(row)
    s, c, o = mesh.clip(t[row], SIZE, top * 4, top * 4 + 3)
    rows = lambda s, c, o: sorted(map(tuple, np.column_stack([s, c, o.reshape(-1, 9)]).tolist()))
    assert rows(row[s], c, o) == rows(source, cells, out)


def test_arrays_give_what_columns_give(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.uniform(0, 999, (200, 3)), rng.integers(0, 9, (200, 3)) * np.array([128.0, 128.0, 64.0]) + rng.normal(0, 0.004, (200, 3)).clip(0)])
    xs, _ = geometry.snap([F.col(a) for a in "xyz"], SIZE, 3)
    rows = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(v)], "i int, x double, y double, z double")
    want = rows.select("i", *[x.alias(a) for x, a in zip(xs, "xyz")]).orderBy("i").drop("i").collect()
    assert np.array_equal(mesh.snap(v, SIZE, 3, geometry.STEPS), np.array(want))
    at = rng.integers(0, morton.LIMIT, (300, 3))
    codes = spark.createDataFrame([(i, *map(int, p)) for i, p in enumerate(at)], "n int, i long, j long, k long").select("n", morton.encode("i", "j", "k").alias("c")).orderBy("n").collect()
    assert morton.interleave(at).tolist() == [r["c"] for r in codes]
    assert np.array_equal(morton.deinterleave(morton.interleave(at)), at)


def test_unmatched_equals_all_distances():
    rng = np.random.default_rng(7)
    a, b = rng.uniform(-2, 2, (300, 3)), rng.uniform(-2, 2, (300, 3))
    a[:50], a[50:60] = b[:50] + 0.01, a[0]
    for near in (0.02, 0.3, 1.1):
        d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)).min(axis=1)
        assert audit.unmatched(a, b, near) == int((d > near).sum())


def test_objects_of_a_plan_may_be_a_frame(spark):
    cells = spark.createDataFrame([(0, n, 0.0, 0) for n in range(4)], "level int, cell long, lod_error double, child_mask long")
    owners = spark.createDataFrame([(1, 0, 0), (1, 0, 2), (2, 0, 3)], "object_id long, level int, cell long")
    got = descent.plan(cells, 1, objects=owners.select("object_id").where("object_id = 1"), object_cells=owners)
    assert [r["cell"] for r in got.collect()] == [0, 2]
    with pytest.raises(KeyError):
        descent.plan(cells, 1, objects=owners.selectExpr("object_id + 7 AS object_id"), object_cells=owners)
