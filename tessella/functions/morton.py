"""Octree addresses as column expressions: Morton codes, parents, boxes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 17  # of each axis: codes stay under 2**53, exact as doubles
LIMIT = 1 << BITS

# The masks of the usual bit spread by three.
SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def long(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("long")


def bit(n: Column, one: int = 1) -> Column:
    """`one` shifted left by a column, as a long."""
    return F.call_function("shiftleft", F.lit(one).cast("long"), n.cast("int"))


def spread(x: Column) -> Column:
    for shift, mask in SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def gather(x: Column) -> Column:
    x = x.bitwiseAND(F.lit(SPREAD[-1][1]))
    masks = [m for _, m in SPREAD[-2::-1]] + [LIMIT - 1]
    for (shift, _), mask in zip(SPREAD[::-1], masks):
        x = x.bitwiseXOR(F.shiftright(x, shift)).bitwiseAND(F.lit(mask))
    return x


def encode(i: Column | str, j: Column | str, k: Column | str, checked: bool = True) -> Column:
    """Bit n of i, j, k is bit 3n, 3n + 1, 3n + 2 of the code; an index outside 0 .. 2**17 - 1 is an error."""
    i, j, k = long(i), long(j), long(k)
    code = spread(i).bitwiseOR(F.shiftleft(spread(j), 1)).bitwiseOR(F.shiftleft(spread(k), 2))
    if not checked:
        return code
    low, high = F.least(i, j, k), F.greatest(i, j, k)
    said = F.format_string("cell index outside 0 .. 2^17 - 1: (%d, %d, %d)", i, j, k)
    return F.when((low < 0) | (high >= LIMIT), F.raise_error(said).cast("long")).otherwise(code)


def decode(cell: Column | str) -> tuple[Column, Column, Column]:
    cell = long(cell)
    return tuple(gather(F.shiftright(cell, n) if n else cell) for n in range(3))


def interleave(cells: np.ndarray) -> np.ndarray:
    """encode on an array (n, 3) of indices that are known to be inside."""
    out = np.zeros(len(cells), np.int64)
    for axis in range(3):
        x = cells[:, axis].astype(np.int64)
        for shift, mask in SPREAD:
            x = (x | x << shift) & mask
        out |= x << axis
    return out


def deinterleave(codes: np.ndarray) -> np.ndarray:
    """decode on an array: (n, 3)."""
    masks = [m for _, m in SPREAD[-2::-1]] + [LIMIT - 1]
    out = np.empty((len(codes), 3), np.int64)
    for axis in range(3):
        x = codes >> axis & SPREAD[-1][1]
        for (shift, _), mask in zip(SPREAD[::-1], masks):
            x = (x ^ x >> shift) & mask
        out[:, axis] = x
    return out


def ancestor(cell: Column | str, up: int) -> Column:
    """Of the same place, `up` levels above."""
    return F.shiftright(long(cell), 3 * up) if up else long(cell)


def octant(cell: Column | str) -> Column:
    """Which child of its parent a cell is."""
    return long(cell).bitwiseAND(F.lit(7)).cast("int")


def of_point(x: Column | str, size: float) -> Column:
    """Index along one axis of the cell that holds a coordinate."""
    return F.floor((F.col(x) if isinstance(x, str) else x) / F.lit(float(size))).cast("long")


def box(cell: Column | str, level: Column, cell_size: tuple) -> tuple[list[Column], list[Column]]:
    """(origin, extent) of a cell, three columns each."""
    scale = F.lit(1 << level) if isinstance(level, int) else bit(level)
    extent = [F.lit(float(s)) * scale for s in cell_size]
    return [n * e for n, e in zip(decode(cell), extent)], extent


def count_upto(limits: list[int], x: Column) -> Column:
    """How many of the ascending limits are at most x: a binary search in one literal."""
    if not limits:
        return F.lit(0)
    held, n = F.lit(np.array(limits, np.int64)), len(limits)
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.element_at(held, F.least(at + step, F.lit(n))) <= x), at + step).otherwise(at))
