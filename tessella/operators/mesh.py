"""Mesh kernels in numpy, used inside Arrow functions: clip, weld, borders, simplification, distances."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np

from tessella.errors import FormatError


def half_space(p: np.ndarray, n: np.ndarray, axis: int, plane: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
    """Polygons (m, k, 3) of n corners cut at a plane each; what is on the side of `sign` stays.

    A cut point is computed from the edge's ends in a fixed order and put exactly on the plane, so
    both sides, and both triangles at an edge, get the same point.
    """
    m, k, _ = p.shape
    slots = np.arange(k)[None, :]
    real = slots < n[:, None]
    after = np.where(slots + 1 < n[:, None], slots + 1, 0)
    q = np.take_along_axis(p, after[:, :, None], axis=1)
    d = sign * (p[:, :, axis] - plane[:, None])
    e = np.take_along_axis(d, after, axis=1)
    keep, cross = real & (d >= 0), real & ((d > 0) & (e < 0) | (d < 0) & (e > 0))
    swap = np.zeros((m, k), bool)
    same = np.ones((m, k), bool)
    for c in range(3):
        swap |= same & (q[:, :, c] < p[:, :, c])
        same &= q[:, :, c] == p[:, :, c]
    a, b = np.where(swap[:, :, None], q, p), np.where(swap[:, :, None], p, q)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (plane[:, None] - a[:, :, axis]) / (b[:, :, axis] - a[:, :, axis])
        cut = a + t[:, :, None] * (b - a)
    cut[:, :, axis] = plane[:, None]
    out = np.stack([p, np.where(cross[:, :, None], cut, 0.0)], axis=2).reshape(m, 2 * k, 3)
    valid = np.stack([keep, cross], axis=2).reshape(m, 2 * k)
    order = np.argsort(~valid, axis=1, kind="stable")
    count = valid.sum(axis=1)
    wide = max(3, int(count.max(initial=0)))
    return np.take_along_axis(out, order[:, :wide, None], axis=1), count


def reached(triangles: np.ndarray, cell_size: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(triangle, cell indices (m, 3)): all cells that clip would give a part of each triangle, and a few
    that it only comes near to. Linear in what comes out."""
    p, n = triangles.astype(np.float64), np.full(len(triangles), 3)
    source, cells = np.arange(len(triangles)), np.zeros((len(triangles), 3), np.int64)
    for axis, size in enumerate(map(float, cell_size)):
        real = np.arange(p.shape[1])[None, :] < n[:, None]
        x, slack = p[:, :, axis], 1e-6 * size
        lo, hi = np.where(real, x, np.inf).min(axis=1), np.where(real, x, -np.inf).max(axis=1)
        first, last = (np.floor(v / size).astype(np.int64) for v in (lo - slack, hi + slack))
        first = np.maximum(first, 0)
        times = np.maximum(last - first + 1, 0)
        row = np.repeat(np.arange(len(p)), times)
        slab = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        p, n, source, cells, many = p[row], n[row], source[row], cells[row], times[row] > 1
        cells[:, axis] = slab
        for sign, plane in ((1, slab * size - slack), (-1, (slab + 1) * size + slack)):
            if many.any():
                q, m = half_space(p[many], n[many], axis, plane[many], sign)
                wide = max(p.shape[1], q.shape[1])
                p = np.pad(p, ((0, 0), (0, wide - p.shape[1]), (0, 0)))
                p[many], n[many] = np.pad(q, ((0, 0), (0, wide - q.shape[1]), (0, 0))), m
        alive = n >= 1
        p, n, source, cells = p[alive], n[alive], source[alive], cells[alive]
    return source, cells


def clip(triangles: np.ndarray, cell_size: tuple, low: np.ndarray | None = None, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source triangle, cell indices (m, 3), triangles (m, 3, 3)) of triangles cut at all cell planes.

    Axis by axis, each polygon is copied once per slab it reaches: linear in what comes out. A
    triangle that lies in a plane belongs to the cell on the side away from its normal. With low and
    high (cell indices, (n, 3)) only the parts in those cells, both included, are made.
    """
    p, n = triangles.astype(np.float64), np.full(len(triangles), 3)
    source, cells = np.arange(len(triangles)), np.zeros((len(triangles), 3), np.int64)
    normal = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]) if len(p) else np.zeros((0, 3))
    for axis, size in enumerate(map(float, cell_size)):
        real = np.arange(p.shape[1])[None, :] < n[:, None]
        x = p[:, :, axis]
        lo, hi = np.where(real, x, np.inf).min(axis=1), np.where(real, x, -np.inf).max(axis=1)
        first = np.floor(lo / size).astype(np.int64)
        last = np.maximum(first, np.floor((hi - 1e-9) / size).astype(np.int64))
        flat = (lo == hi) & (lo == first * size)
        first = np.where(flat & (normal[source, axis] > 0), np.maximum(first - 1, 0), first)
        last = np.where(flat, first, last)
        several = last > first
        if low is not None:
            first, last = np.maximum(first, low[source, axis]), np.minimum(last, high[source, axis])
        times = np.maximum(last - first + 1, 0)
        row = np.repeat(np.arange(len(p)), times)
        slab = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        p, n, source, cells, many = p[row], n[row], source[row], cells[row], several[row]
        cells[:, axis] = slab
        for sign, plane in ((1, slab * size), (-1, (slab + 1) * size)):
            if many.any():
                q, m = half_space(p[many], n[many], axis, plane[many], sign)
                wide = max(p.shape[1], q.shape[1])
                p = np.pad(p, ((0, 0), (0, wide - p.shape[1]), (0, 0)))
                p[many], n[many] = np.pad(q, ((0, 0), (0, wide - q.shape[1]), (0, 0))), m
        alive = n >= 3
        p, n, source, cells = p[alive], n[alive], source[alive], cells[alive]
    fans = np.maximum(n - 2, 0)
    row = np.repeat(np.arange(len(p)), fans)
    k = np.arange(len(row)) - np.repeat(np.cumsum(fans) - fans, fans)
    out = np.stack([p[row, 0], p[row, k + 1], p[row, k + 2]], axis=1) if len(row) else np.zeros((0, 3, 3))
    good = (np.cross(out[:, 1] - out[:, 0], out[:, 2] - out[:, 0]) ** 2).sum(axis=1) > 0
    return source[row][good], cells[row][good], out[good]


def weld_many(piece: np.ndarray, triangles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Soups (m, 3, 3) of many pieces, told by ascending numbers, at once: vertices and their pieces,
    faces (indices into all vertices) and their pieces.

    Positions equal to 9 decimals are one vertex of their piece. Sorted by place, each corner points at
    the earliest corner of its run; corners that point at themselves are the vertices, so these stand
    in order of first use. Faces that lose a corner go.
    """
    spots, of = triangles.reshape(-1, 3), np.repeat(piece, 3)
    near = np.round(spots, 9) + 0.0
    order = np.lexsort((near[:, 2], near[:, 1], near[:, 0], of))
    near, sorted_of = near[order], of[order]
    begins = np.ones(len(order), bool)
    begins[1:] = (near[1:] != near[:-1]).any(axis=1) | (sorted_of[1:] != sorted_of[:-1])
    earliest = np.empty(len(order), np.int64)
    earliest[order] = order[begins][np.cumsum(begins) - 1]
    own = earliest == np.arange(len(order))
    faces = (np.cumsum(own) - 1)[earliest].reshape(-1, 3)
    good = three(faces)
    return spots[own], of[own], faces[good], piece[good]


def weld(triangles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One soup (m, 3, 3) -> vertices in order of first use, faces."""
    v, _, f, _ = weld_many(np.zeros(len(triangles), np.int64), triangles)
    return v, f


def edges_of(faces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different edges (a < b) and how many faces each has."""
    if not len(faces):
        return np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    ends = faces[:, [0, 1, 1, 2, 2, 0]].reshape(-1, 2)
    wide = int(faces.max()) + 1
    keys, count = np.unique(ends.min(axis=1) * wide + ends.max(axis=1), return_counts=True)
    return np.stack([keys // wide, keys % wide], axis=1), count


def border(faces: np.ndarray, n: int) -> np.ndarray:
    """Mask of the vertices at edges with one face."""
    edges, count = edges_of(faces)
    out = np.zeros(n, bool)
    out[edges[count == 1].ravel()] = True
    return out


def compact(vertices: np.ndarray, faces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    used = np.unique(faces)
    return vertices[used], np.searchsorted(used, faces).reshape(-1, 3)


def on_planes(v: np.ndarray, extent: tuple | np.ndarray, tolerance: float = 1e-6) -> np.ndarray:
    """Mask of the vertices on a plane of cells of this extent, or of one extent each."""
    t = v / np.asarray(extent, float)
    return (np.abs(t - np.rint(t)) < tolerance).any(axis=1)


def three(faces: np.ndarray) -> np.ndarray:
    return (faces[:, 0] != faces[:, 1]) & (faces[:, 1] != faces[:, 2]) & (faces[:, 0] != faces[:, 2])


PLACEMENTS = ("midpoint", "onto_fixed")


def shortest_first(vertices: np.ndarray, faces: np.ndarray) -> list[list[int]]:
    """Edges in the order (length, a, b)."""
    edges, _ = edges_of(faces)
    step = vertices[edges[:, 1]] - vertices[edges[:, 0]]
    return edges[np.lexsort((edges[:, 1], edges[:, 0], (step * step).sum(axis=1)))].tolist()


def greedy(vertices: np.ndarray, faces: np.ndarray, fixed: np.ndarray, target: int, placement: str = "midpoint") -> tuple[np.ndarray, np.ndarray, float]:
    """Shortest edges first, merged until `target` faces are left; fixed vertices never move.

    Each vertex knows its living faces, so a merge visits only those: a face with both ends dies, the
    others get the end that stays. The error is the largest way a vertex went.
    """
    if placement not in PLACEMENTS:
        raise ValueError(f"unknown placement {placement!r}")
    living = len(faces)
    if living <= target:
        return vertices, faces, 0.0
    spot, held, home, corners = vertices.tolist(), fixed.tolist(), list(range(len(vertices))), faces.tolist()
    around: list[list[int]] = [[] for _ in home]
    for i, face in enumerate(corners):
        for x in face:
            around[x].append(i)

    def stays(x: int) -> int:
        while home[x] != x:
            home[x] = x = home[home[x]]
        return x

    for one, other in shortest_first(vertices, faces):
        keep, go = stays(one), stays(other)
        if held[go]:
            keep, go = go, keep
        if keep == go or held[go]:
            continue
        if placement == "midpoint" and not held[keep]:
            spot[keep] = [(p + q) / 2 for p, q in zip(spot[keep], spot[go])]
        home[go] = keep
        for i in around[go]:
            face = corners[i]
            if face and keep in face:
                corners[i] = None
                living -= 1
            elif face:
                face[face.index(go)] = keep
                around[keep].append(i)
        around[go] = []
        if living <= target:
            break
    at = np.array(spot).reshape(-1, 3)
    moved = float(np.sqrt(((at[[stays(x) for x in home]] - vertices) ** 2).sum(axis=1)).max(initial=0))
    out = np.array([f for f in corners if f], np.int64).reshape(-1, 3)
    return (*compact(at, out), moved) if len(out) else (np.zeros((0, 3)), out, moved)


def quadrics(vertices: np.ndarray, faces: np.ndarray) -> np.ndarray:
    """Sums of each vertex's face planes, weighed by area: the ten different entries of a 4 x 4 matrix."""
    p = vertices[faces]
    normal = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
    size = np.sqrt((normal**2).sum(axis=1))
    unit = normal / np.maximum(size, 1e-300)[:, None]
    plane = np.concatenate([unit, -(unit * p[:, 0]).sum(axis=1, keepdims=True)], axis=1)
    i, j = np.triu_indices(4)
    each = plane[:, i] * plane[:, j] * size[:, None]
    out = np.zeros((len(vertices), 10))
    for c in range(3):
        np.add.at(out, faces[:, c], each)
    return out


def misfit(q: list[float], s: list[float]) -> float:
    """The quadric's value at a spot."""
    x, y, z = s
    xx, xy, xz, xw, yy, yz, yw, zz, zw, ww = q
    return x * (xx * x + 2 * (xy * y + xz * z + xw)) + y * (yy * y + 2 * (yz * z + yw)) + z * (zz * z + 2 * zw) + ww


class Surroundings:
    """What a collapse asks of vertices and faces, for many pieces in one pass: edges, borders, quadrics."""

    def __init__(self, vertices: np.ndarray, faces: np.ndarray) -> None:
        self.edges, count = edges_of(faces)
        self.open = np.zeros(len(vertices), bool)
        self.open[self.edges[count == 1].ravel()] = True
        self.quadrics = quadrics(vertices, faces)

    def of(self, vs: slice) -> Surroundings:
        """Those of the piece with these vertices, numbered from 0."""
        out = object.__new__(Surroundings)
        lo, hi = np.searchsorted(self.edges[:, 0], (vs.start, vs.stop))
        out.edges, out.open, out.quadrics = self.edges[lo:hi] - vs.start, self.open[vs], self.quadrics[vs]
        return out


def quadric(vertices: np.ndarray, faces: np.ndarray, fixed: np.ndarray, target: int, known: Surroundings | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Edges of least quadric error first; fixed and border vertices stay where they are."""
    if len(faces) <= target:
        return vertices, faces, 0.0
    known = known or Surroundings(vertices, faces)
    edges, held, at, q, corners = known.edges, (fixed | known.open).tolist(), vertices.tolist(), known.quadrics.tolist(), faces.tolist()
    version, living = [0] * len(at), len(corners)
    around: list[set] = [set() for _ in at]
    for i, face in enumerate(corners):
        for x in face:
            around[x].add(i)

    def best(a: int, b: int) -> tuple[float, list[float]]:
        """Least misfit and its spot: of the end that is held, or of both ends and their middle."""
        both = [x + y for x, y in zip(q[a], q[b])]
        if held[a] or held[b]:
            s = at[a] if held[a] else at[b]
            return misfit(both, s), s
        p, r = at[a], at[b]
        m = [(p[0] + r[0]) / 2, (p[1] + r[1]) / 2, (p[2] + r[2]) / 2]
        x, y, z = misfit(both, p), misfit(both, r), misfit(both, m)
        return (x, p) if x <= y and x <= z else (y, r) if y <= z else (z, m)

    heap = [(best(a, b)[0], a, b, 0, 0) for a, b in edges.tolist() if not (held[a] and held[b])]
    heapify(heap)
    while heap and living > target:
        _, a, b, va, vb = heappop(heap)
        if version[a] != va or version[b] != vb:
            continue
        shared = around[a] & around[b]
        if not shared:
            continue
        if held[b]:
            a, b = b, a
        spot = best(a, b)[1]
        if any(turns(corners[i], end, at, spot) for end in (a, b) if at[end] != spot for i in around[end] - shared):
            continue
        at[a], q[a] = spot, [x + y for x, y in zip(q[a], q[b])]
        for i in shared:
            for x in corners[i]:
                around[x].discard(i)
            corners[i] = None
        living -= len(shared)
        for i in around[b]:
            corners[i] = [a if x == b else x for x in corners[i]]
        around[a] |= around[b]
        around[b] = set()
        version[a] += 1
        version[b] = -1
        for x in sorted({x for i in around[a] for x in corners[i]} - {a}):
            if not (held[a] and held[x]):
                heappush(heap, (best(a, x)[0], a, x, version[a], version[x]))
    out = np.array([f for f in corners if f], np.int64).reshape(-1, 3)
    if not len(out):
        return np.zeros((0, 3)), out, 0.0
    v, f = compact(np.array(at), out)
    return v, f, deviation(vertices, v)


def misfits(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """misfit of many quadrics (n, 10) at a spot (n, 3) each."""
    x, y, z = s.T
    xx, xy, xz, xw, yy, yz, yw, zz, zw, ww = q.T
    return x * (xx * x + 2 * (xy * y + xz * z + xw)) + y * (yy * y + 2 * (yz * z + yw)) + z * (zz * z + 2 * zw) + ww


def best_spots(p: np.ndarray, r: np.ndarray, q: np.ndarray, hold_p: np.ndarray, hold_r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges (ends p and r, quadrics q of both): least misfits and their spots, as quadric's `best`."""
    m = (p + r) / 2
    x, y, z = misfits(q, p), misfits(q, r), misfits(q, m)
    first, second = (x <= y) & (x <= z), y <= z
    first, second = hold_p | ~hold_r & first, hold_r | second
    return np.where(first, x, np.where(second, y, z)), np.where(first[:, None], p, np.where(second[:, None], r, m))


def holds(faces: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which faces (n, m, 3) of each row have its corner x (n)."""
    x = x[:, None]
    return (faces[:, :, 0] == x) | (faces[:, :, 1] == x) | (faces[:, :, 2] == x)


def greedy_many(vertices: np.ndarray, of_vertex: np.ndarray, faces: np.ndarray, of_face: np.ndarray, held: np.ndarray, target: np.ndarray, edges: np.ndarray, placement: str = "midpoint") -> tuple[np.ndarray, ...]:
    """greedy of many small pieces side by side, an edge of each in a step, with the same outcome.

    vertices, faces (indices into them), edges and their pieces as for quadric_many. Returns the
    vertices moved, the faces, which of the faces are left, and where each vertex went.
    """
    n = len(target)
    nv, nf, ne = (np.bincount(x, minlength=n) for x in (of_vertex, of_face, of_vertex[edges[:, 0]]))
    v_at, f_at, e_at = (np.cumsum(x) - x for x in (nv, nf, ne))
    step = vertices[edges[:, 1]] - vertices[edges[:, 0]]
    edges = edges[np.lexsort((edges[:, 1], edges[:, 0], (step * step).sum(axis=1), of_vertex[edges[:, 0]]))]
    spot, living = vertices.copy(), nf.copy()
    table = np.full((n, int(nf.max())), -1)
    table[of_face, np.arange(len(faces)) - f_at[of_face]] = np.arange(len(faces))
    faces_of = np.where(table[:, :, None] >= 0, faces[table], -1)  # -1: none, or gone
    home = v_at[:, None] + np.arange(int(nv.max()))  # what stays of each vertex
    live = np.arange(n)
    for k in range(int(ne.max(initial=0))):
        live = live[(ne[live] > k) & (living[live] > target[live])]
        if not len(live):
            break
        ends = edges[e_at[live] + k] - v_at[live][:, None]
        keep, go = home[live, ends[:, 0]], home[live, ends[:, 1]]
        keep, go = np.where(held[go], go, keep), np.where(held[go], keep, go)
        good = (keep != go) & ~held[go]
        now, keep, go = live[good], keep[good], go[good]
        if placement == "midpoint":
            free = ~held[keep]
            spot[keep[free]] = (spot[keep[free]] + spot[go[free]]) / 2
        home[now] = np.where(home[now] == go[:, None], keep[:, None], home[now])
        own = faces_of[now]
        dead = holds(own, keep) & holds(own, go)
        living[now] -= dead.sum(axis=1)
        own = np.where(own == go[:, None, None], keep[:, None, None], own)
        own[dead] = -1
        faces_of[now] = own
    corners, alive = faces.copy(), np.zeros(len(faces), bool)
    left = faces_of[:, :, 0] >= 0
    corners[table[left]], alive[table[left]] = faces_of[left], True
    return spot, corners, alive, home[of_vertex, np.arange(len(vertices)) - v_at[of_vertex]]


MANY_VERTICES = 64  # pieces of more vertices are collapsed one by one


def quadric_many(vertices: np.ndarray, of_vertex: np.ndarray, faces: np.ndarray, of_face: np.ndarray, held: np.ndarray, target: np.ndarray, known: Surroundings) -> tuple[np.ndarray, ...]:
    """quadric of many small pieces side by side, a pop of each in a step, with the same outcome.

    vertices, faces (indices into them) and their pieces (0 .. n - 1, ascending); held: also the border.
    Returns the vertices moved, the faces, and which of the faces are left. An edge's cost stands at
    (a, b) in its piece's table, so the first least one is what a heap of (cost, a, b) would give.
    """
    n = len(target)
    nv, nf = (np.bincount(x, minlength=n) for x in (of_vertex, of_face))
    v_at, f_at = (np.concatenate([[0], np.cumsum(x)])[:-1] for x in (nv, nf))
    wide, tall = int(nv.max()), int(nf.max())
    spot, q, corners = vertices.copy(), known.quadrics.copy(), faces.copy()
    table = np.full((n, tall), -1)  # each piece's faces
    table[of_face, np.arange(len(faces)) - f_at[of_face]] = np.arange(len(faces))
    cost = np.full((n, wide * wide), np.inf)
    a, b = known.edges.T
    free = ~(held[a] & held[b])
    a, b = a[free], b[free]
    own = of_vertex[a]
    cost[own, (a - v_at[own]) * wide + b - v_at[own]] = best_spots(spot[a], spot[b], q[a] + q[b], held[a], held[b])[0]
    alive, living = np.ones(len(faces), bool), nf.copy()
    live = np.arange(n)
    faces_of = np.where(table[:, :, None] >= 0, corners[table], -1)  # (n, tall, 3); -1: none, or gone
    while True:
        at = cost[live].argmin(axis=1)
        more = (living[live] > target[live]) & (cost[live, at] < np.inf)
        live, at = live[more], at[more]
        if not len(live):
            return spot, corners, alive
        cost[live, at] = np.inf
        a, b = at // wide + v_at[live], at % wide + v_at[live]
        swap = held[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        own = faces_of[live]
        with_a, with_b = (holds(own, x) for x in (a, b))
        shared = with_a & with_b
        good = shared.any(axis=1)
        both = q[a] + q[b]
        to = best_spots(spot[a], spot[b], both, held[a], held[b])[1]
        for end, has in ((a, with_a), (b, with_b)):
            row, k = np.nonzero(has & ~shared & (good & ((spot[end, 0] != to[:, 0]) | (spot[end, 1] != to[:, 1]) | (spot[end, 2] != to[:, 2])))[:, None])
            face = own[row, k]
            c = np.where(face[:, 0] == end[row], 0, np.where(face[:, 1] == end[row], 1, 2))
            i = np.arange(len(row))
            o, p, r, s = spot[end[row]], spot[face[i, (c + 1) % 3]], spot[face[i, (c + 2) % 3]], to[row]
            (ax, ay, az), (bx, by, bz), (cx, cy, cz), (dx, dy, dz) = (x.T for x in (p - o, r - o, p - s, r - s))
            bad = (ay * bz - az * by) * (cy * dz - cz * dy) + (az * bx - ax * bz) * (cz * dx - cx * dz) + (ax * by - ay * bx) * (cx * dy - cy * dx) <= 0
            good[row[bad]] = False
        if not good.any():
            continue
        now, a, b, own, shared, with_a, with_b = live[good], a[good], b[good], own[good], shared[good], with_a[good], with_b[good]
        spot[a], q[a] = to[good], both[good]
        alive[table[now][shared]] = False
        living[now] -= shared.sum(axis=1)
        own = np.where(own == b[:, None, None], a[:, None, None], own)
        own[shared] = -1
        faces_of[now] = own
        corners[table[now][with_b & ~shared]] = own[with_b & ~shared]
        square = cost.reshape(n, wide, wide)
        i, j = a - v_at[now], b - v_at[now]
        for x in (i, j):
            square[now, x, :] = np.inf
            square[now, :, x] = np.inf
        row, k = np.nonzero((with_a | with_b) & ~shared)
        x, row = own[row, k].ravel(), np.repeat(row, 3)
        wanted = (x != a[row]) & ~(held[a[row]] & held[x])
        x, row = x[wanted], row[wanted]
        y = a[row]
        square[now[row], i[row], x - v_at[now[row]]] = best_spots(spot[y], spot[x], q[y] + q[x], held[y], held[x])[0]


def turns(face: list[int], corner: int, at: list[list[float]], spot: list[float]) -> bool:
    """Whether a face turns over, or loses its area, when this corner goes to the spot."""
    k = face.index(corner)
    (ox, oy, oz), (px, py, pz), (rx, ry, rz) = at[corner], at[face[k - 2]], at[face[k - 1]]
    sx, sy, sz = spot
    ax, ay, az, bx, by, bz = px - ox, py - oy, pz - oz, rx - ox, ry - oy, rz - oz
    cx, cy, cz, dx, dy, dz = px - sx, py - sy, pz - sz, rx - sx, ry - sy, rz - sz
    return (ay * bz - az * by) * (cy * dz - cz * dy) + (az * bx - ax * bz) * (cz * dx - cx * dz) + (ax * by - ay * bx) * (cx * dy - cy * dx) <= 0


def deviation(before: np.ndarray, after: np.ndarray, block: int = 2048) -> float:
    """Largest distance of a vertex to the nearest one afterwards."""
    worst = 0.0
    for lo in range(0, len(before), block):
        near = np.full(len(before[lo : lo + block]), np.inf)
        for at in range(0, len(after), block):
            d = before[lo : lo + block, None, :] - after[None, at : at + block, :]
            near = np.minimum(near, (d * d).sum(axis=2).min(axis=1))
        worst = max(worst, float(near.max(initial=0)))
    return worst**0.5


def deviations(before: np.ndarray, of_before: np.ndarray, after: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Squares of the deviation of each piece: pieces of `before` ascend and all have vertices, `after` has so many of each, one at least."""
    n = counts[of_before]
    ends = np.cumsum(n)
    row = np.repeat(np.arange(len(before)), n)
    spot = np.arange(len(row)) + np.repeat((np.cumsum(counts) - counts)[of_before] - (ends - n), n)
    x, y, z = (before[row] - after[spot]).T
    near = np.minimum.reduceat(x * x + y * y + z * z, ends - n)
    return np.maximum.reduceat(near, np.flatnonzero(np.diff(of_before, prepend=-1)))


def per_piece(of_vertex: np.ndarray, of_face: np.ndarray, n: int) -> Iterator[tuple[slice, slice]]:
    """Where the vertices and faces of pieces 0 .. n - 1 stand."""
    v, f = (np.searchsorted(x, np.arange(n + 1)).tolist() for x in (of_vertex, of_face))
    for k in range(n):
        yield slice(v[k], v[k + 1]), slice(f[k], f[k + 1])


def squared(t: np.ndarray) -> np.ndarray:
    """Four times the squared areas of triangles (n, 3, 3)."""
    return (np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]) ** 2).sum(axis=1) if len(t) else np.zeros(0)


def snap(v: np.ndarray, cell_size: tuple, levels: int, steps: int) -> np.ndarray:
    """geometry.snap on an array of points."""
    size = np.array(cell_size, float)
    step = np.array([s * (1 << (levels - 1)) / steps for s in cell_size])
    plane = np.rint(v / size) * size
    near = np.abs(v - plane) <= step
    return np.where(near, plane, np.where(near.any(axis=-1, keepdims=True), np.rint(v / step) * step, v))


def lost(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Mask of the positions that do not stand among those afterwards, exactly."""
    held = {r.tobytes() for r in after + 0.0}
    return np.array([r.tobytes() not in held for r in before + 0.0], bool)


def survive(before: np.ndarray, after: np.ndarray) -> bool:
    """Whether each position stands among those afterwards, exactly."""
    return not lost(before, after).any()


class Greedy:
    name, uses_fixed_mask = "GREEDY", True

    def __init__(self, placement: str = "midpoint") -> None:
        self.placement = placement

    def simplify(self, v: np.ndarray, f: np.ndarray, *, fixed: np.ndarray, target_faces: int) -> tuple:
        return (*greedy(v, f, fixed, target_faces, self.placement), self.name)

    def simplify_many(self, v: np.ndarray, of_vertex: np.ndarray, f: np.ndarray, of_face: np.ndarray, *, fixed: np.ndarray, target_faces: np.ndarray, known: None = None) -> list[tuple | None]:
        """(vertices, faces, error) of each piece; None where there is nothing to do, or nothing is left."""
        if self.placement not in PLACEMENTS:
            raise ValueError(f"unknown placement {self.placement!r}")
        spot, corners, alive, home = greedy_many(v, of_vertex, f, of_face, fixed, target_faces, edges_of(f)[0], self.placement)
        moved = np.sqrt(((spot[home] - v) ** 2).sum(axis=1))
        used = np.zeros(len(v), bool)
        used[corners[alive].ravel()] = True
        number = np.cumsum(used) - 1
        out: list[tuple | None] = []
        for target, (vs, fs) in zip(target_faces, per_piece(of_vertex, of_face, len(target_faces))):
            left = alive[fs]
            if len(left) <= target or not left.any():
                out.append(None)
                continue
            keep = used[vs]
            out.append((spot[vs][keep], number[corners[fs][left]] - number[vs.start + int(keep.argmax())], float(moved[vs].max(initial=0))))
        return out


class Quadric:
    """Quadric collapse; where a border or fixed vertex would be lost, the fallback's result."""

    name, uses_fixed_mask, knows = "QUADRIC", False, Surroundings

    def __init__(self, fallback: Greedy | None = None) -> None:
        self.fallback = fallback or Greedy()

    def simplify(self, v: np.ndarray, f: np.ndarray, *, fixed: np.ndarray, target_faces: int, known: Surroundings | None = None) -> tuple:
        known = known or Surroundings(v, f)
        nv, nf, error = quadric(v, f, fixed, max(1, target_faces), known)
        if len(nf) and not survive(v[fixed | known.open], nv):
            return self.fallback.simplify(v, f, fixed=fixed, target_faces=target_faces)
        return nv, nf, error, self.name

    def simplify_many(self, v: np.ndarray, of_vertex: np.ndarray, f: np.ndarray, of_face: np.ndarray, *, fixed: np.ndarray, target_faces: np.ndarray, known: Surroundings) -> list[tuple | None]:
        """(vertices, faces, error) of each piece; None where `simplify` has more to do than one collapse."""
        held = fixed | known.open
        spot, corners, alive = quadric_many(v, of_vertex, f, of_face, held, np.maximum(1, target_faces), known)
        used = np.zeros(len(v), bool)
        used[corners[alive].ravel()] = True
        number = np.cumsum(used) - 1
        counts, faces_left = np.bincount(of_vertex[used], minlength=len(target_faces)), np.bincount(of_face[alive], minlength=len(target_faces))
        # There is nothing to do, nothing is left, or a held vertex may be lost.
        none = (np.bincount(of_face, minlength=len(target_faces)) <= target_faces) | (faces_left == 0)
        none[of_vertex[held & ~used]] = True
        some = counts[of_vertex] > 0
        moved = np.zeros(len(target_faces))
        moved[np.unique(of_vertex[some])] = deviations(v[some], of_vertex[some], spot[used], counts) if some.any() else 0
        out: list[tuple | None] = []
        for k, (vs, fs) in enumerate(per_piece(of_vertex, of_face, len(target_faces))):
            if none[k]:
                out.append(None)
                continue
            keep = used[vs]
            out.append((spot[vs][keep], number[corners[fs][alive[fs]]] - number[vs.start + int(keep.argmax())], float(moved[k]) ** 0.5))
        return out


SIMPLIFIERS: dict[str, Callable] = {"GREEDY": Greedy, "QUADRIC": Quadric}


def simplifier(which: object = None) -> object:
    """By name, as given, or the default."""
    if which is None:
        return Quadric()
    if isinstance(which, str):
        if which.upper() not in SIMPLIFIERS:
            raise FormatError(f"unknown simplifier {which!r}; there are {sorted(SIMPLIFIERS)}")
        return SIMPLIFIERS[which.upper()]()
    if not callable(getattr(which, "simplify", None)):
        raise FormatError(f"{which!r} has no simplify method")
    return which


def relax(v: np.ndarray, f: np.ndarray, fixed: np.ndarray, target: int, how: object, **known: object) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """Simplifies to the target, doubled until something is left; else the piece as it is."""
    t = max(1, target)
    while t < len(f):
        nv, nf, error, _ = how.simplify(v, f, fixed=fixed, target_faces=t, **known)
        if len(nf):
            return nv, nf, error, t != target
        t *= 2
    return v, f, 0.0, True


def nearest_faces(points: np.ndarray, triangles: np.ndarray, k: int) -> np.ndarray:
    """For each point the k triangles with the nearest centres, nearest first, ties to the first."""
    d = ((points[:, None, :] - (triangles[:, 0] + triangles[:, 1] + triangles[:, 2])[None] / 3) ** 2).sum(axis=2)
    k = min(k, d.shape[1])
    if 4 * k < d.shape[1]:  # only what may be among them is sorted
        least = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        d = np.where(d <= least, d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def surface_distances(points: np.ndarray, triangles: np.ndarray, k: int = 32) -> np.ndarray:
    """Squared distance of each point to a surface, over the k triangles with the nearest centres of each."""
    out = np.zeros(len(points))
    for lo in range(0, len(points) if len(triangles) else 0, 512):
        p = points[lo : lo + 512]
        out[lo : lo + 512] = point_triangles(p, triangles[nearest_faces(p, triangles, k)]).min(axis=1)
    return out


def surface_distance(points: np.ndarray, triangles: np.ndarray, k: int = 32) -> float:
    """The largest of them, not squared."""
    return float(surface_distances(points, triangles, k).max(initial=0.0)) ** 0.5


def point_triangles(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Squared distances of points (m, 3) to triangles (m, k, 3, 3)."""
    a, b, c = t[:, :, 0], t[:, :, 1], t[:, :, 2]
    w = p[:, None, :] - a
    dot = lambda x, y: (x * y).sum(axis=2)

    def side(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        d, r = v - u, p[:, None, :] - u
        n = dot(d, d)
        s = np.clip(np.divide(dot(r, d), n, out=np.zeros_like(n), where=n > 0), 0, 1)
        r = r - s[:, :, None] * d
        return dot(r, r)

    e, f = b - a, c - a
    ee, ef, ff, we, wf = dot(e, e), dot(e, f), dot(f, f), dot(w, e), dot(w, f)
    det, s, u = ee * ff - ef * ef, ff * we - ef * wf, ee * wf - ef * we
    n = np.cross(e, f)
    nn = dot(n, n)
    inside = (det > 0) & (s >= 0) & (u >= 0) & (s + u <= det)
    plane = np.divide(dot(w, n) ** 2, nn, out=np.full_like(nn, np.inf), where=(nn > 0) & inside)
    return np.minimum.reduce([side(a, b), side(b, c), side(c, a), plane])
