"""The scalar functions for SQL: temporary SQL functions, inlined by the optimizer like any expression."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessella.functions.geometry import STEPS
from tessella.functions.morton import LIMIT


def gathered(x: str, axis: int) -> str:
    return f"aggregate(sequence(0, 16), 0L, (a, n) -> a | shiftleft(shiftright({x}, 3 * n + {axis}) & 1L, n))"


def placed(x: str, axis: int) -> str:
    return f"aggregate(sequence(0, 16), 0L, (a, n) -> a | shiftleft(shiftright({x}, n) & 1L, 3 * n + {axis}))"


FUNCTIONS = {
    "morton_encode(i BIGINT, j BIGINT, k BIGINT)": ("BIGINT", f"CASE WHEN least(i, j, k) < 0 OR greatest(i, j, k) >= {LIMIT} THEN CAST(raise_error('cell index out of range') AS BIGINT) ELSE {placed('i', 0)} | {placed('j', 1)} | {placed('k', 2)} END"),
    "morton_decode(cell BIGINT)": ("STRUCT<i: BIGINT, j: BIGINT, k: BIGINT>", f"named_struct('i', {gathered('cell', 0)}, 'j', {gathered('cell', 1)}, 'k', {gathered('cell', 2)})"),
    "cell_ancestor(cell BIGINT, up INT)": ("BIGINT", "shiftright(cell, 3 * up)"),
    "cell_octant(cell BIGINT)": ("INT", "CAST(cell & 7L AS INT)"),
    "quantize(x DOUBLE, origin DOUBLE, extent DOUBLE)": ("INT", f"CAST(rint(greatest(least((x - origin) / extent, 1D), 0D) * {STEPS}) AS INT)"),
    "dequantize(q INT, origin DOUBLE, extent DOUBLE)": ("DOUBLE", f"origin + q / {STEPS} * extent"),
    "box_gap(lx DOUBLE, ly DOUBLE, lz DOUBLE, hx DOUBLE, hy DOUBLE, hz DOUBLE, px DOUBLE, py DOUBLE, pz DOUBLE)": ("DOUBLE", "sqrt(pow(greatest(lx - px, px - hx, 0D), 2) + pow(greatest(ly - py, py - hy, 0D), 2) + pow(greatest(lz - pz, pz - hz, 0D), 2))"),
    "screen_error(error DOUBLE, gap DOUBLE, focal DOUBLE)": ("DOUBLE", "CASE WHEN gap <= 0 THEN CAST('Infinity' AS DOUBLE) ELSE error * focal / gap END"),
    "target_faces(n BIGINT, level INT, ratio DOUBLE, floor_faces BIGINT)": ("BIGINT", "greatest(floor_faces, CAST(rint(n * pow(ratio, level)) AS BIGINT))"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes them known to the session's SQL; returns their names."""
    for signature, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    return [s.split("(")[0] for s in FUNCTIONS]
