"""Binary columns: little-endian 16-bit positions and 32-bit indices, packed by built-in functions.

Packing by expressions keeps a plan in the JVM; the build packs whole cells with numpy instead
(`tessella.operators.pyramid`). Both give the same bytes.
"""

from __future__ import annotations

import importlib.util

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.errors import FormatError, MissingExtraError

CODECS = ("NONE", "MESHOPT")
COMPRESSIONS = ("NONE", "ZSTD")


def hex_le(x: Column, width: int) -> Column:
    """An unsigned number of `width` bytes as little-endian hex digits."""
    digits = F.lpad(F.hex(x), 2 * width, "0")
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(width - 1, -1, -1)])


def pack(values: Column, width: int) -> Column:
    """array of numbers -> binary."""
    return F.unhex(F.array_join(F.transform(values, lambda x: hex_le(x, width)), ""))


def unpack(blob: Column, width: int) -> Column:
    """binary -> array of numbers; a length that is no multiple of the width is an error."""
    digits = F.hex(blob)

    def value(i: Column) -> Column:
        part = [F.substr(digits, i * (2 * width) + 2 * b + 1, F.lit(2)) for b in range(width - 1, -1, -1)]
        return F.conv(F.concat(*part), 16, 10).cast("long")

    n = F.octet_length(blob)
    numbers = F.transform(F.sequence(F.lit(0), (n / width).cast("int") - 1), value)
    empty = F.array().cast("array<bigint>")
    return F.when(n % width != 0, F.raise_error(F.format_string("a blob of %d bytes holds no whole numbers", n)).cast("array<bigint>")).when(n == 0, empty).otherwise(numbers)


def check_encoding(codec: str, compression: str, indices: str = "UINT32") -> None:
    """Refuses pairs and codecs that cannot be read or written."""
    if codec not in CODECS:
        raise FormatError(f"unknown codec {codec!r}")
    if compression not in COMPRESSIONS:
        raise FormatError(f"unknown compression {compression!r}")
    if codec == "MESHOPT" and compression == "ZSTD":
        raise FormatError("MESHOPT blobs are not compressed a second time")
    if indices not in ("UINT32", "UINT16"):
        raise FormatError(f"unknown indices {indices!r}")
    if indices == "UINT16":
        raise FormatError("16-bit indices are named by the format, but blobs of them are not written or read")
    if codec == "MESHOPT" and importlib.util.find_spec("meshoptimizer") is None:
        raise MissingExtraError("codec MESHOPT needs the package meshoptimizer")
