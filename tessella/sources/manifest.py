"""The manifest: the document at a collection's root, written last."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from tessella.errors import FormatError
from tessella.functions.blobs import check_encoding
from tessella.operators.pyramid import Decimation

NAME = "manifest.json"
VERSION = "1"
CELLS, OBJECTS = "catalog/cells.parquet", "catalog/objects.parquet"


def level_path(level: int, part: int) -> str:
    return f"level={level}/part-{part:05d}.parquet"


def relative(path: str) -> str:
    """The path, refused where it would leave the collection."""
    if not path or path.startswith("/") or ".." in path.split("/"):
        raise FormatError(f"path {path!r} is not inside the collection")
    return path


@dataclass(frozen=True)
class File:
    path: str
    bytes: int | None = None
    row_groups: int | None = None

    @classmethod
    def of(cls, raw: object) -> File:
        if isinstance(raw, str):
            return cls(relative(raw))
        if not isinstance(raw, dict) or not isinstance(raw.get("path"), str):
            raise FormatError(f"{raw!r} names no file")
        return cls(relative(raw["path"]), raw.get("bytes"), raw.get("rowGroups"))

    def to_dict(self) -> dict:
        out = {"path": self.path, "bytes": self.bytes, "rowGroups": self.row_groups}
        return {k: v for k, v in out.items() if v is not None}


@dataclass
class Manifest:
    cell_size: tuple
    levels: int
    codec: str = "NONE"
    compression: str = "NONE"
    boundary: str = "LOCKED"
    decimation: Decimation = field(default_factory=Decimation)
    counts: dict = field(default_factory=dict)
    cells: File = File(CELLS)
    objects: File = File(OBJECTS)
    level_files: dict[int, list[File]] | None = None

    def to_json(self) -> bytes:
        files: dict = {"cells": self.cells.to_dict(), "objects": self.objects.to_dict()}
        if self.level_files is not None:
            files["levels"] = {str(n): [f.to_dict() for f in fs] for n, fs in sorted(self.level_files.items())}
        return json.dumps(
            {
                "specVersion": VERSION,
                "grid": {"cellSize": list(self.cell_size), "levels": self.levels, "sortKey": "MORTON"},
                "encoding": {
                    "positions": "UINT16_QUANTIZED_PER_CELL", "indices": "UINT32", "codec": self.codec, "compression": self.compression, "boundary": self.boundary,
                    "decimation": self.decimation.name, "ratio": self.decimation.ratio, "floorFaces": self.decimation.floor_faces,
                },
                "counts": self.counts,
                "files": files,
            },
            indent=2,
        ).encode()

    @classmethod
    def from_json(cls, body: bytes) -> Manifest:
        """Unknown keys are ignored; unknown versions and values are refused."""
        try:
            raw = json.loads(body)
        except ValueError as e:
            raise FormatError(f"the manifest of {len(body)} bytes is no JSON: {e}") from e
        if not isinstance(raw, dict):
            raise FormatError("the manifest is no object")
        if str(raw.get("specVersion", "")) != VERSION:
            raise FormatError(f"specVersion {raw.get('specVersion')!r} is not {VERSION!r}")
        grid, enc = raw.get("grid"), raw.get("encoding")
        if not isinstance(grid, dict) or not isinstance(enc, dict):
            raise FormatError("the manifest has no grid or no encoding")
        size, levels = grid.get("cellSize"), grid.get("levels")
        if not isinstance(size, list) or len(size) != 3 or not all(isinstance(s, int) and s >= 1 for s in size):
            raise FormatError(f"cellSize {size!r}")
        if not isinstance(levels, int) or levels < 1:
            raise FormatError(f"levels {levels!r}")
        for key, held, legal in (("sortKey", grid, ("MORTON",)), ("positions", enc, ("UINT16_QUANTIZED_PER_CELL",)), ("boundary", enc, ("LOCKED", "OPEN"))):
            if held.get(key, legal[0]) not in legal:
                raise FormatError(f"{key} {held[key]!r} is none of {legal}")
        check_encoding(enc.get("codec", "NONE"), enc.get("compression", "NONE"), enc.get("indices", "UINT32"))
        files = raw.get("files") or {}
        parts = files.get("levels")
        named = {int(n): [File.of(f) for f in fs] for n, fs in parts.items() if fs} if isinstance(parts, dict) else None
        return cls(
            tuple(size), levels, enc.get("codec", "NONE"), enc.get("compression", "NONE"), enc.get("boundary", "LOCKED"),
            Decimation.named(enc.get("decimation", "QUARTER"), enc.get("ratio"), enc.get("floorFaces", 4)),
            raw.get("counts") or {}, File.of(files.get("cells", CELLS)), File.of(files.get("objects", OBJECTS)), named)
