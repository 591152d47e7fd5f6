import numpy as np
import pytest

from tessella.errors import FormatError
from tessella.operators import mesh
from tessella.operators.pyramid import Decimation


def sphere(n=2, r=20.0, at=(50.0, 50.0, 50.0)):
    t = (1 + 5**0.5) / 2
    v = [(-1, t, 0), (1, t, 0), (-1, -t, 0), (1, -t, 0), (0, -1, t), (0, 1, t), (0, -1, -t), (0, 1, -t), (t, 0, -1), (t, 0, 1), (-t, 0, -1), (-t, 0, 1)]
    f = [(0, 11, 5), (0, 5, 1), (0, 1, 7), (0, 7, 10), (0, 10, 11), (1, 5, 9), (5, 11, 4), (11, 10, 2), (10, 7, 6), (7, 1, 8), (3, 9, 4), (3, 4, 2), (3, 2, 6), (3, 6, 8), (3, 8, 9), (4, 9, 5), (2, 4, 11), (6, 2, 10), (8, 6, 7), (9, 8, 1)]
    p = np.array(v, float)[np.array(f)]
    for _ in range(n):
        a, b, c = p[:, 0], p[:, 1], p[:, 2]
        ab, bc, ca = (a + b) / 2, (b + c) / 2, (c + a) / 2
        p = np.concatenate([np.stack(x, axis=1) for x in ((a, ab, ca), (ab, b, bc), (ca, bc, c), (ab, bc, ca))])
    return p / np.linalg.norm(p, axis=2, keepdims=True) * r + np.array(at)


def areas(t):
    return np.sqrt((np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]) ** 2).sum(axis=1)) / 2


@pytest.mark.parametrize("size", [(128, 128, 64), (16, 8, 11), (4, 4, 4)])
def test_clipping_keeps_area_and_cells(size):
    t = sphere(3)
    source, cells, out = mesh.clip(t, size)
    assert abs(areas(out).sum() - areas(t).sum()) < 1e-6
    low = cells[:, None, :] * np.array(size, float)
    assert (out >= low - 1e-12).all() and (out <= low + np.array(size) + 1e-12).all()
    assert np.allclose(np.bincount(source, areas(out), len(t)), areas(t))
    # Both sides of a plane have the same points: welded, the surface is closed again.
    v, f = mesh.weld(out)
    assert not mesh.border(f, len(v)).any() or set(np.unique(mesh.edges_of(f)[1])) <= {1, 2}


def test_faces_in_a_plane_belong_inside():
    up = np.array([[[0, 0, 64], [10, 0, 64], [0, 10, 64.0]]])
    assert mesh.clip(up, (128, 128, 64))[1].tolist() == [[0, 0, 0]]
    assert mesh.clip(up[:, ::-1], (128, 128, 64))[1].tolist() == [[0, 0, 1]]


def test_welding_keeps_first_order_and_drops_slivers():
    t = np.array([[[1, 0, 0], [2, 0, 0], [1, 1, 0]], [[2, 0, 0], [1, 1, 1e-12], [5, 5, 5]], [[1, 0, 0], [1, 0, 1e-11], [3, 3, 3.0]]])
    v, f = mesh.weld(t)
    assert v[:3].tolist() == t[0].tolist() and f.tolist() == [[0, 1, 2], [1, 2, 3]]


@pytest.mark.parametrize("how", [mesh.Greedy(), mesh.Greedy("onto_fixed"), mesh.Quadric()])
def test_simplifiers_hold_what_is_fixed(how):
    t = sphere(3)
    v, f = mesh.weld(t[t[:, :, 2].min(axis=1) >= 50])  # open below
    fixed = mesh.border(f, len(v))
    nv, nf, moved, _ = how.simplify(v, f, fixed=fixed, target_faces=len(f) // 4)
    assert 0 < len(nf) < len(f) * 0.6 and mesh.survive(v[fixed], nv) and 0 < moved < 40  # the sphere is 40 wide
    same = how.simplify(v, f, fixed=fixed, target_faces=len(f))
    assert same[0] is v and same[2] == 0


def test_quadric_is_closer_than_greedy():
    v, f = mesh.weld(sphere(3))
    none = np.zeros(len(v), bool)
    a, b = (h.simplify(v, f, fixed=none, target_faces=len(f) // 4) for h in (mesh.Quadric(), mesh.Greedy()))
    surface = v[f]
    assert mesh.surface_distance(a[0], surface) < mesh.surface_distance(b[0], surface) and mesh.deviation(v, a[0]) < 8


def test_relaxation_keeps_something():
    v, f = mesh.weld(sphere(0))
    none = np.zeros(len(v), bool)
    nv, nf, _, relaxed = mesh.relax(v, f, none, 1, mesh.Greedy())
    assert len(nf) and relaxed
    assert mesh.relax(v, f, none, 50, mesh.Greedy())[2:] == (0.0, True)


def test_distances():
    t = np.array([[[0, 0, 0], [10, 0, 0], [0, 10, 0.0]]])
    p = np.array([[1, 1, 3], [-3, 4, 0], [20, 0, 0], [0, 0, -2.0]])
    assert np.allclose(mesh.point_triangles(p, np.broadcast_to(t, (4, 1, 3, 3)))[:, 0], [9, 9, 100, 4])


def test_schedules_and_names():
    assert Decimation().name == "QUARTER" and Decimation(0.3).name == "CUSTOM" and Decimation.named("CUSTOM", 0.25).name == "QUARTER"
    assert (Decimation().target(1000, 3), Decimation(0.25, 32).target(1000, 3)) == (16, 32)
    for bad in (("QUARTER", 0.5), ("X", None), ("CUSTOM", None)):
        with pytest.raises(FormatError):
            Decimation.named(*bad)
    for bad in (0, 1, 2):
        with pytest.raises(FormatError):
            Decimation(bad)
    assert mesh.simplifier("greedy").name == "GREEDY" and mesh.simplifier().name == "QUADRIC"
    for bad in ("X", 5):
        with pytest.raises(FormatError):
            mesh.simplifier(bad)
