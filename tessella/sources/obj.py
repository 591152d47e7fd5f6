"""Surfaces as OBJ text: vertices, then faces counted from 1."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tessella.sources import files


def obj_lines(vertices: np.ndarray, faces: np.ndarray) -> Iterator[str]:
    for x, y, z in vertices.tolist():
        yield f"v {x!r} {y!r} {z!r}"
    for a, b, c in faces.tolist():
        yield f"f {a + 1} {b + 1} {c + 1}"


def export_obj(collection: object, object_id: int, path: str, level: int = 0) -> int:
    """Writes one object of a collection; the number of faces. It goes through the driver whole."""
    v, f = collection.object_mesh(object_id, level)
    files.put(collection.spark, path, ("\n".join(obj_lines(v, f)) + "\n").encode())
    return len(f)
