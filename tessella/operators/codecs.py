"""How quantised positions and indices become blobs: one codec for each value of the manifest's `codec`.

A codec packs an (n, 3) array of 16-bit positions or an (m, 3) array of 32-bit indices and takes them
apart again; the order of faces must stay, since offsets name runs of them. More codecs are entered
in `CODECS` by their name.
"""

from __future__ import annotations

import importlib
from typing import Protocol

import numpy as np
import pyarrow as pa

from tessella.errors import FormatError, MissingExtraError


class BlobCodec(Protocol):
    name: str

    def encode_positions(self, quantized: np.ndarray, compression: str = "NONE") -> bytes: ...

    def decode_positions(self, blob: bytes, n: int, compression: str = "NONE") -> np.ndarray: ...

    def encode_indices(self, faces: np.ndarray, n: int, compression: str = "NONE") -> bytes: ...

    def decode_indices(self, blob: bytes, m: int, compression: str = "NONE") -> np.ndarray: ...


def three_columns(raw: bytes, kind: str, n: int, what: str) -> np.ndarray:
    """n numbers as rows of three; a blob of another length is an error."""
    if len(raw) != np.dtype(kind).itemsize * n or n % 3:
        raise FormatError(f"{what} of {len(raw)} bytes for {n} numbers")
    return np.frombuffer(raw, kind).reshape(-1, 3)


class Raw:
    """The numbers as they are, little-endian; ZSTD may go over them."""

    name = "NONE"

    @staticmethod
    def out(raw: bytes, compression: str) -> bytes:
        return pa.compress(raw, "zstd", asbytes=True) if compression == "ZSTD" else raw

    @staticmethod
    def into(blob: bytes, size: int, compression: str) -> bytes:
        if compression != "ZSTD":
            return blob
        try:
            return pa.decompress(blob, size, "zstd", asbytes=True)
        except (pa.ArrowException, OSError, ValueError) as e:
            raise FormatError(f"a compressed blob: {e}") from e

    def encode_positions(self, quantized: np.ndarray, compression: str = "NONE") -> bytes:
        return self.out(quantized.astype("<u2").tobytes(), compression)

    def decode_positions(self, blob: bytes, n: int, compression: str = "NONE") -> np.ndarray:
        return three_columns(self.into(blob, 6 * n, compression), "<u2", 3 * n, "positions")

    def encode_indices(self, faces: np.ndarray, n: int, compression: str = "NONE") -> bytes:
        return self.out(faces.astype("<u4").tobytes(), compression)

    def decode_indices(self, blob: bytes, m: int, compression: str = "NONE") -> np.ndarray:
        return three_columns(self.into(blob, 4 * m, compression), "<u4", m, "indices")


class Meshopt:
    """The package meshoptimizer's vertex and index buffers. Positions travel as four 16-bit numbers, the last 0."""

    name, stride = "MESHOPT", 8

    @staticmethod
    def package() -> object:
        try:
            return importlib.import_module("meshoptimizer")
        except ImportError as e:
            raise MissingExtraError("codec MESHOPT needs the package meshoptimizer") from e

    def encode_positions(self, quantized: np.ndarray, compression: str = "NONE") -> bytes:
        wide = np.zeros((len(quantized), 4), "<u2")
        wide[:, :3] = quantized
        return bytes(self.package().encode_vertex_buffer(wide, len(wide), self.stride))

    def decode_positions(self, blob: bytes, n: int, compression: str = "NONE") -> np.ndarray:
        # Asked for without an element type: its bytes are what counts.
        raw = np.ascontiguousarray(self.package().decode_vertex_buffer(n, self.stride, blob)).tobytes()
        if len(raw) != self.stride * n:
            raise FormatError(f"positions of {len(raw)} bytes for {n} vertices")
        return np.frombuffer(raw, "<u2").reshape(-1, 4)[:, :3]

    def encode_indices(self, faces: np.ndarray, n: int, compression: str = "NONE") -> bytes:
        flat = np.ascontiguousarray(faces.astype("<u4").ravel())
        return bytes(self.package().encode_index_buffer(flat, len(flat), n))

    def decode_indices(self, blob: bytes, m: int, compression: str = "NONE") -> np.ndarray:
        raw = np.ascontiguousarray(self.package().decode_index_buffer(m, 4, blob)).tobytes()
        return three_columns(raw, "<u4", m, "indices")


CODECS: dict[str, BlobCodec] = {c.name: c for c in (Raw(), Meshopt())}


def codec_for(name: str) -> BlobCodec:
    if name not in CODECS:
        raise FormatError(f"unknown codec {name!r}; there are {sorted(CODECS)}")
    return CODECS[name]
