"""Near-duplicate documents by banded SetSketch registers, joint likelihood and an exact check.

Steps, all distributed:

1. one pass over the texts: distinct word shingles, a 128-bit key of the set, SetSketch registers;
   documents with equal sets form one class, which is numbered and handled once;
2. bands of registers are hashed; in each bucket every class is paired with the bucket's smallest one;
3. pairs whose likelihood estimate is far below the threshold go; the rest are checked on full sets;
   linked pairs are merged into components;
4. buckets that still hold several components are compared across components, in blocks of bounded
   size: each pair once, in the first band it shares, by likelihood first and full sets then. No
   link inside a bucket is lost, although only links are listed and pairs inside a component are
   never looked at.

Defined cases: null, empty or blank texts have no shingles and link with nothing. Ids are integers.
Rows with a null id take no part and get component_id null, kept true. Repeated rows are each
reported. Texts of any length are read whole, in parts. An empty table gives no rows. Only the two
named columns are read, so extra columns with any names are harmless.

Recall: a link at the threshold misses all bands with chance (1 - p**rows)**bands, p the chance that
two registers agree: about 1e-6 for the defaults at 0.85 similarity (p = 0.86), and for 40 bands of 6
at 0.80 (p = 0.82). Its estimate falls below threshold - margin with less than that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.components import connected_components
from tessella.llm.shared import arrow, cut, integer, stream_groups
from tessella.llm.sketch import SPACING, Sketcher, greater, jaccard
from tessella.llm.words import shingle_sets

BANDS, ROWS = 32, 7
MARGIN = 0.12  # about five standard errors of the estimate at 224 registers and 0.85
BLOCK = 1024  # classes of a bucket that are compared at once, at most
BLOCK_ITEMS = 2_000_000  # and shingles of theirs, about
LEAVES = 64  # checks against one centre that share a copy of it


def agreement(percent: int) -> float:
    """Chance that a register is equal in two sets of one size at the threshold."""
    return 1 - 2 * float(greater(np.float64((1 - percent / 100) / 2)))


def margin(percent: int, registers: int) -> float:
    """MARGIN in the standard errors of another threshold and number of registers."""

    def error(percent: int, registers: int) -> float:
        p, step = agreement(percent), (SPACING - 1) / SPACING
        return float(np.sqrt(p * (1 - p) / registers) * (1 - (1 - percent / 100) / 2 * step))

    return MARGIN * error(percent, registers) / error(85, BANDS * ROWS)


def features(docs: DataFrame, id_col: str, text_col: str, width: int, registers: int) -> DataFrame:
    """id, n_shingles, k1, k2 (null for empty sets), sketch."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(registers)
        for batch in batches:
            n, k1, k2, sketch = [], [], [], []
            for items, key in shingle_sets(batch.column(1), width):
                a, b = key or (None, None)
                n.append(len(items)), k1.append(a), k2.append(b)
                sketch.append(sketcher(items).tobytes() if len(items) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sketch, pa.binary())], names=["id", "n", "k1", "k2", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return arrow(rows, over, "id long, n long, k1 long, k2 long, sketch binary")


def estimated(pairs: DataFrame, floor: float) -> DataFrame:
    """Pairs (a, b, na, nb, sa, sb) whose likelihood estimate reaches `floor`."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, other = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (4, 5))
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            good = jaccard(one, other, na, nb) >= floor
            yield batch.select([0, 1]).filter(pa.array(good))

    return arrow(pairs.select("a", "b", "na", "nb", "sa", "sb"), over, "a long, b long")


def similar(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """100 * |intersection| >= percent * |union| of two sorted sets."""
    small, large = (one, other) if len(one) < len(other) else (other, one)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(one) + len(other) - common)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * |intersection| >= percent * |union|, on full sets (key, items).

    b's set meets a's in a group (a, part) of bounded size; a's is copied once per part. Groups are
    streamed in order, so a task holds one centre and one leaf.
    """
    # A table of its own: where a centre has very many pairs, the joins with it can be dealt anew.
    parts = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / LEAVES).cast("int").alias("parts")), "parts")
    leaves = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    leaves = leaves.join(sets.withColumnRenamed("key", "b"), "b").select("a", "part", F.lit(1).alias("role"), "b", "items")
    heads = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(sets.withColumnRenamed("key", "a"), "a")
    rows = heads.select("a", "part", F.lit(0).alias("role"), F.col("a").alias("b"), "items").union(leaves)
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "role")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, items = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, part, role, b = (batch.column(i).to_pylist() for i in range(4))
            out: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                own = np.frombuffer(batch.column(4)[i].as_py(), np.uint64)
                if role[i] == 0:
                    held, items = (a[i], part[i]), own
                elif held == (a[i], part[i]):
                    if similar(own, items, percent):
                        out.append((a[i], b[i]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return arrow(rows, over, "a long, b long")


def crossed(members: DataFrame, percent: int, floor: float, rows: int) -> DataFrame:
    """Links between different labels within a group (band, bh, i, j) of members.

    members: label, key, n, sketch, items, side. A pair is handled in the first band it shares, by
    likelihood and then on full sets; only links come out.
    """

    def compare(band: int, one: list, other: list | None) -> Iterator[tuple[int, int]]:
        la, ka, na, sa, ia = one
        lb, kb, nb, sb, ib = other or one
        for i in range(len(ka)):
            lo = i + 1 if other is None else 0
            ok = (lb[lo:] != la[i]) & (100 * np.minimum(nb[lo:], na[i]) >= percent * np.maximum(nb[lo:], na[i]))
            at = np.flatnonzero(ok & (kb[lo:] != ka[i])) + lo
            if len(at) and band:
                before = (sb[at, : band * rows] == sa[i, : band * rows]).reshape(len(at), band, rows).all(axis=2).any(axis=1)
                at = at[~before]
            if len(at):
                at = at[jaccard(np.broadcast_to(sa[i], (len(at), sa.shape[1])), sb[at], np.full(len(at), na[i]), nb[at]) >= floor]
                yield from ((int(ka[i]), int(kb[x])) for x in at if similar(ia[i], ib[x], percent))

    def columns(slices: list[pa.RecordBatch], side: int) -> list:
        t = pa.Table.from_batches(slices)
        t = t.filter(pa.compute.equal(t["side"], side))
        sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 1), np.uint8)
        return [t[c].to_numpy() for c in ("label", "key", "n")] + [sketch, [np.frombuffer(x.as_buffer(), np.uint64) for x in t["items"]]]

    def finish(key: tuple, slices: list[pa.RecordBatch]) -> list:
        band, _, i, j = key
        return [(min(p), max(p)) for p in compare(band, columns(slices, 0), None if i == j else columns(slices, 1))]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, slices, found = None, [], []
        for key, part in stream_groups(batches, ["band", "bh", "i", "j"]):
            if key != held and slices:
                found += finish(held, slices)
                slices = []
                if len(found) > 50_000:
                    yield emit(found)
                    found = []
            held = key
            slices.append(part)
        if slices:
            found += finish(held, slices)
        if found:
            yield emit(found)

    def emit(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int64()), pa.array([r[1] for r in found], pa.int64())], names=["a", "b"])

    group = ["band", "bh", "i", "j"]
    ordered = members.select(*group, "side", "label", "key", "n", "sketch", "items").repartition(*group).sortWithinPartitions(*group)
    return arrow(ordered, over, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, width: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Rows (id_col, n_shingles, component_id, kept), one for each row of docs."""
    integer(docs, id_col)
    floor = percent / 100 - margin(percent, bands * rows)
    feats = cut(features(docs, id_col, text_col, width, bands * rows), "features")
    known = feats.where("k1 is not null and id is not null")
    classes = known.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("rows"))
    # Written once and only read from then on, so that the numbers hold.
    classes = cut(classes.withColumn("key", F.monotonically_increasing_id()), "classes")
    hashed = [F.xxhash64(F.lit(i), F.substring("sketch", i * rows + 1, rows)) for i in range(bands)]
    banded = classes.select("key", "n", F.posexplode(F.array(*hashed)).alias("band", "bh"))
    shared = banded.groupBy("band", "bh").agg(F.min("key").alias("a"), F.count("*").alias("size"), F.sum("n").alias("items")).where("size > 1")
    buckets = cut(banded.drop("n").join(shared, ["band", "bh"]), "buckets")  # only those with two classes at least
    stars = buckets.where("a <> key").select("a", F.col("key").alias("b")).distinct()
    sketches = classes.select("key", "n", "sketch")

    def with_sketches(pairs: DataFrame) -> DataFrame:
        left = sketches.toDF("a", "na", "sa")
        return pairs.join(left, "a").join(sketches.toDF("b", "nb", "sb"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")

    # Full sets of the classes that share a bucket with another, from one member's text each.
    wanted = classes.join(buckets.select("key").distinct(), "key", "left_semi").select("key", "k1", "k2", "id")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, k1, k2 = (batch.column(i).to_pylist() for i in range(3))
            out, good = [], []
            for i, (items, key) in enumerate(shingle_sets(batch.column(3), width)):
                if key == (k1[i], k2[i]):  # of several texts under an id, the class's own
                    good.append(keys[i]), out.append(items.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(good, pa.int64()), pa.array(out, pa.binary())], names=["key", "items"])

    sets = arrow(texts.join(wanted, "id").select("key", "k1", "k2", "text"), sets_of, "key long, items binary")
    sets = cut(sets.dropDuplicates(["key"]), "sets")

    links = cut(verified(estimated(with_sketches(stars), floor), sets, percent), "links")
    labels = connected_components(links)
    mixed = buckets.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    several = mixed.groupBy("band", "bh").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("band", "bh")
    # A bucket of two whose pair failed is settled: its only pair was its star.
    members = mixed.where("size > 2").join(several, ["band", "bh"], "left_semi").join(sketches, "key").join(sets, "key")
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, mixed["items"] / BLOCK_ITEMS)).cast("int")
    members = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("band", "bh", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "label", "key", "n", "sketch", sets["items"])
    more = cut(crossed(members, percent, floor, rows), "links")
    if not more.isEmpty():
        labels = connected_components(links.union(more))
    # Only classes of several rows or with links have anything to tell their documents.
    own = classes.join(labels.withColumnRenamed("node", "key"), "key", "left").select("k1", "k2", "id", "rows", "label", F.coalesce("label", "key").alias("group"))
    least = own.groupBy("group").agg(F.min("id").alias("component_id"))
    told = own.where("rows > 1 or label is not null").join(least, "group").select("k1", "k2", "component_id")
    out = feats.select("id", "n", "k1", "k2").join(told, ["k1", "k2"], "left")
    component = F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))
