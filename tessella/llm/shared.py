"""Shared plumbing: the folder all executors see, lineage cuts, row-group streaming."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessella.llm.words import mix
from tessella.sources import scratch as scratch_tables
from tessella.sources.scratch import held, remove, scratch, shared_dir

__all__ = ["arrow", "cut", "held", "integer", "literal_table", "remove", "scratch", "shared_dir", "small_batches", "stream_groups", "unused", "KeyFilter", "map_arrow"]


BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Where the session does not say, Arrow batches of texts are kept small (rows and bytes): a batch
    is held by the JVM and by Python, on the way in and out."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def cut(df: DataFrame, label: str, since: set[str] | None = None) -> DataFrame:
    """scratch.cut with small batches."""
    small_batches(df.sparkSession)
    return scratch_tables.cut(df, label, since)


def unused(columns: list[str], names: tuple[str, ...]) -> dict[str, str]:
    """The names with one underscore before them, or as many as keep them apart from all columns."""
    held, lead = {c.lower() for c in columns}, "_"
    while held & {(lead + n).lower() for n in names}:
        lead += "_"
    return {n: lead + n for n in names}


KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a local table of the plan, without a job or a Python worker to make it."""
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows)) or [[]] * len(fields)
    return spark.createDataFrame(pa.table([pa.array(c, KINDS[k]) for c, (_, k) in zip(cols, fields)], names=[n for n, _ in fields]))


def integer(df: DataFrame, column: str) -> None:
    """Ids that are to be ordered as numbers must be numbers: a cast would turn others into nulls."""
    kind = dict(df.dtypes)[column]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{column} is {kind}; integers are needed")


def stream_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of equal keys over batches that are sorted by them; yields slices, never a whole partition.

    A run that spans several batches is yielded as several (key, slice) pairs in order.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        table = pa.Table.from_batches([batch])
        change = None
        for key in keys:
            col = table.column(key).combine_chunks()
            one = pa.compute.not_equal(col[1:], col[:-1]) if n > 1 else pa.array([], pa.bool_())
            change = one if change is None else pa.compute.or_(change, one)
        cuts = [0, *(i + 1 for i, c in enumerate(change.to_pylist()) if c), n]
        for lo, hi in zip(cuts, cuts[1:]):
            yield tuple(batch.column(batch.schema.get_field_index(k))[lo].as_py() for k in keys), batch.slice(lo, hi - lo)


FILTER_BITS = 27  # a key filter has 2**27 bits (16 MB) at most


class KeyFilter:
    """A Bloom filter of 64-bit keys of bounded size: it keeps rows from a shuffle that would join nothing.

    Bits for about eight a key, up to 2**FILTER_BITS; with more keys it only lets more rows pass.
    """

    def __init__(self, keys: DataFrame, column: str) -> None:
        spark = keys.sparkSession
        self.bits = min(FILTER_BITS, max(16, (8 * keys.count()).bit_length()))
        bits, spots = self.bits, self.spots

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(1 << bits - 3, np.uint8)
            for batch in batches:
                for at in spots(batch.column(0).to_numpy(), bits):
                    np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], names=["bits"])

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(1 << bits - 3, np.uint8)
            for batch in batches:
                for x in batch.column(0):
                    held |= np.frombuffer(x.as_buffer(), np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], names=["bits"])

        one = keys.select(column).coalesce(8).mapInArrow(fill, "bits binary")
        rows = one.repartition(1).mapInArrow(join, "bits binary").collect()  # one bitmap
        self.shared = spark.sparkContext.broadcast(bytes(rows[0][0]) if rows else bytes(1 << bits - 3))

    @staticmethod
    def spots(keys: np.ndarray, bits: int) -> list[np.ndarray]:
        x = keys.view(np.uint64)
        return [(mix(x ^ np.uint64(c)) >> np.uint64(64 - bits)).astype(np.int64) for c in (0x51A9, 0xC0DE5)]

    def test(self) -> Callable[[np.ndarray], np.ndarray]:
        """For executors: which of an array of keys may be held."""
        shared, bits, spots = self.shared, self.bits, self.spots

        def may(keys: np.ndarray) -> np.ndarray:
            held = np.frombuffer(shared.value, np.uint8)
            ok = np.ones(len(keys), bool)
            for at in spots(keys, bits):
                ok &= held[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
            return ok

        return may


def trimmed(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn, and at its end what a reused worker would hold on to goes back to the system."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return over


def arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow that leaves no memory behind in its workers."""
    return df.mapInArrow(trimmed(fn), schema)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow for functions of one batch."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(over, schema)
