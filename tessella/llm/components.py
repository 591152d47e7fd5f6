"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import arrow, cut

FEW = 500_000  # edges that one task takes as they are (8 MB), instead of rounds of joins


def joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes, ascending, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = list(range(len(nodes)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in zip(at[: len(u)].tolist(), at[len(u) :].tolist()):
        x, y = top(x), top(y)
        root[max(x, y)] = min(x, y)
    return nodes, nodes[[top(x) for x in range(len(nodes))]]


def in_one_task(edges: DataFrame) -> DataFrame:
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            node, label = joined(*(np.concatenate(x) for x in zip(*held)))
            for lo in range(0, len(node), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)], pa.int64()) for x in (node, label)], names=["node", "label"])

    return cut(arrow(edges.coalesce(1), over, "node long, label long"), "labels")


def connected_components(edges: DataFrame, limit: int = 60, few: int = FEW) -> DataFrame:
    """edges (a, b): rows (node, label), label the smallest node reachable; nodes without an edge have no row.

    Null ends and self links are ignored. Nothing is collected but a count and a checksum per round. A
    table of `few` edges at most is joined by one task, with the same result.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, seen = cut(e, "edges"), None
    if dict(e.dtypes) == {"u": "bigint", "v": "bigint"} and e.count() <= few:
        return in_one_task(e)
    for _ in range(limit):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e = cut(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)
