"""Geometry as column expressions: quantisation, snapping, planes, areas, distances, cameras."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 65535  # quantisation steps along a cell's side
ON_PLANE = 1e-6  # of a cell
AXES = "xyz"


def quantize(x: Column, origin: Column, extent: Column) -> Column:
    """Steps from the cell's origin, half to even; over half a step outside is an error."""
    t = (x - origin) / extent
    slack = 0.5 / STEPS
    q = F.rint(F.greatest(F.least(t, F.lit(1.0)), F.lit(0.0)) * STEPS).cast("int")
    return F.when((t < -slack) | (t > 1 + slack), F.raise_error(F.format_string("coordinate %s lies outside its cell", x.cast("string"))).cast("int")).otherwise(q)


def dequantize(q: Column, origin: Column, extent: Column) -> Column:
    return origin + q / STEPS * extent


def snap(xs: list[Column], cell_size: tuple, levels: int) -> tuple[list[Column], Column]:
    """(coordinates, on a plane?): near level-0 planes onto them; then the other axes onto the coarsest lattice.

    Near means within one step of the coarsest level's lattice, so that both sides of a plane round alike.
    """
    step = [s * (1 << (levels - 1)) / STEPS for s in cell_size]
    plane = [F.rint(x / float(s)) * float(s) for x, s in zip(xs, cell_size)]
    near = [F.abs(x - p) <= d for x, p, d in zip(xs, plane, step)]
    any_ = near[0] | near[1] | near[2]
    return [F.when(n, p).when(any_, F.rint(x / d) * d).otherwise(x) for x, p, d, n in zip(xs, plane, step, near)], any_


def on_planes(xs: list[Column], extent: tuple, tolerance: float = ON_PLANE) -> Column:
    """Whether a coordinate lies on a plane of cells with these sides, to a part of a cell."""
    near = [F.abs(x / float(e) - F.rint(x / float(e))) < tolerance for x, e in zip(xs, extent)]
    return near[0] | near[1] | near[2]


def cross(a: list, b: list, c: list) -> list[Column]:
    u, v = [q - p for p, q in zip(a, b)], [q - p for p, q in zip(a, c)]
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def area_squared(a: list, b: list, c: list) -> Column:
    """Four times the squared area."""
    n = cross(a, b, c)
    return n[0] * n[0] + n[1] * n[1] + n[2] * n[2]


def sound_face(a: Column, b: Column, c: Column, twice_area_squared: Column) -> Column:
    """Three different corners and an area."""
    return (a != b) & (b != c) & (a != c) & (twice_area_squared > 0)


def box_gap(lo: list[Column], hi: list[Column], eye: tuple) -> Column:
    """Distance of a point to a box, 0 inside."""
    d = [F.greatest(a - float(e), float(e) - b, F.lit(0.0)) for a, b, e in zip(lo, hi, eye)]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


@dataclass(frozen=True)
class Camera:
    position: tuple
    focal: float  # pixels

    @classmethod
    def perspective(cls, position: tuple, fov_y: float, height: float) -> Camera:
        if not 0 < fov_y < math.pi:
            raise ValueError(f"field of view {fov_y} is not between 0 and pi")
        return cls(tuple(map(float, position)), 0.5 * height / math.tan(0.5 * fov_y))

    def pixels(self, error: Column, lo: list[Column], hi: list[Column]) -> Column:
        """An error's size on the screen: endless where the camera is inside the box."""
        gap = box_gap(lo, hi, self.position)
        return F.when(gap <= 0, F.lit(float("inf"))).otherwise(error * self.focal / gap)


def overlaps(lo: list[Column], hi: list[Column], box: tuple) -> Column:
    """Closed boxes: touching counts."""
    (low, high), out = box, F.lit(True)
    for a, b, p, q in zip(lo, hi, low, high):
        out = out & (a <= float(q)) & (b >= float(p))
    return out


def inside_planes(lo: list[Column], hi: list[Column], planes: list) -> Column:
    """Whether a box's corner furthest along each normal (nx, ny, nz, d) is on its inner side."""
    out = F.lit(True)
    for *n, d in planes:
        far = sum((float(c) * (b if c >= 0 else a) for c, a, b in zip(n, lo, hi)), F.lit(0.0))
        out = out & (far + float(d) >= 0)
    return out


def target_faces(n: Column, level: Column, ratio: float, floor: int) -> Column:
    """max(floor, round(n * ratio**level)), half to even."""
    return F.greatest(F.lit(floor).cast("long"), F.rint(n * F.pow(F.lit(float(ratio)), level)).cast("long"))


def point_triangle_squared(p: list, a: list, b: list, c: list) -> Column:
    """Squared distance of a point to a triangle: the least of its three sides and, inside, its plane."""
    dot = lambda u, v: u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    minus = lambda u, v: [x - y for x, y in zip(u, v)]

    def side(u: list, v: list) -> Column:
        d, w = minus(v, u), minus(p, u)
        n = dot(d, d)
        t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(w, d) / n))).otherwise(0.0)
        r = [x - t * y for x, y in zip(w, d)]
        return dot(r, r)

    e, f, w = minus(b, a), minus(c, a), minus(p, a)
    ee, ef, ff, we, wf = dot(e, e), dot(e, f), dot(f, f), dot(w, e), dot(w, f)
    det = ee * ff - ef * ef
    s, t = ff * we - ef * wf, ee * wf - ef * we
    n = cross(a, b, c)
    nn = dot(n, n)
    inside = (det > 0) & (s >= 0) & (t >= 0) & (s + t <= det)
    plane = dot(w, n) * dot(w, n) / F.when(nn > 0, nn)
    return F.least(side(a, b), side(b, c), side(c, a), F.when(inside, plane))
