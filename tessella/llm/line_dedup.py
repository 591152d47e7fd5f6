"""Near-duplicate lines by a segment-partition edit join.

Two lines within `threshold` edits (bytes of UTF-8, inserted, deleted or replaced): if one is cut
into threshold + 1 segments, at least one segment stands unchanged in the other, near its own place.
So each line is indexed under its segments (length, segment number, content) and probes the
substrings that may match a segment of a line as long as itself or up to `threshold` shorter
(the multi-match-aware ranges). Lines that meet are verified by length, byte counts and a banded
bit-parallel edit distance on what differs between them.

Linked lines form classes; the first occurrence (smallest document id, then line number) of a class
stays, all others go. Equal lines are one line with a count before anything is joined.

How it runs: keys are packed by hash range into numpy blobs, so the shuffle moves 16 bytes a key and
no row per key; each range is sorted in one task of bounded size (the number of ranges follows the
data). Groups with the same members are kept once, large groups are split into blocks that meet
pairwise, and within a block only links that join two components are verified further and emitted:
at most one less than its lines.

Defined cases: null or empty texts have no lines and stay as they are. Lines under `min_bytes` are
never linked to others; those of `exact_bytes` or more that hold more than white space go where they
equal another, the rest always stay (without `exact_bytes` all lines under `min_bytes` do). A line repeated within a document stays once. Null ids count as the
smallest id; rows with equal ids count as one document for what comes first (equal rows both keep
their lines). Line ends are "\\n" alone; a removed line takes its line end with it. Empty tables give
no rows. Other columns pass through; none of their names matter, but names that begin with "_line".
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.components import connected_components
from tessella.llm.shared import arrow, cut, integer, stream_groups, unused
from tessella.llm.words import mix

THRESHOLD = 2
MIN_BYTES = 32
EXACT_BYTES = 1  # shortest lines that go where they equal another
BLOCK = 2048  # lines of a group that are compared at once
RANGE_KEYS = 1 << 20  # keys of a hash range, about
PACK_KEYS, SEEN = 1 << 20, 200_000  # keys of a pack, about; lines that are known not to be packed twice by a task
LOWEST = -(1 << 63)


def distance(a: bytes, b: bytes, most: int) -> int:
    """Edit distance up to `most`, else most + 1: a banded bit-parallel column scan.

    Equal ends are cut off first; the band of 2 * most + 1 diagonals slides along the rows, its
    vertical differences held in two machine words.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    n = min(len(a), len(b))
    lo, hi = 0, n
    while lo < hi:  # common prefix
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    a, b, n = a[lo:], b[lo:], n - lo
    lo, hi = 0, n
    while lo < hi:  # common suffix
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[-mid:] == b[-mid:] else (lo, mid - 1)
    a, b = a[: len(a) - lo], b[: len(b) - lo]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return min(len(b), most + 1)
    # Band of the column j: rows j - most .. j + most; bit k is row j - most + k.
    width, m, n = 2 * most + 1, len(a), len(b)
    mask = (1 << width) - 1
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    plus, minus, score = mask >> most << most, 0, most  # D[i][0] = i below the diagonal; rows above 0 do not count
    for j in range(n):
        match = where.get(b[j], 0)
        shift = j - most
        eq = (match >> shift if shift >= 0 else match << -shift) & mask
        x = eq | minus
        zero = (((x & plus) + plus) ^ plus) | x
        up = minus | ~(zero | plus)
        down = zero & plus
        # The score follows the band's lowest diagonal: i = j + most.
        if not zero >> (width - 1) & 1:
            score += 1
        if score > 2 * most + n - m:  # it falls by one a row at most on the way up
            return most + 1
        slid = zero >> 1
        plus, minus = (down | ~(slid | up)) & mask, up & slid & mask
    # From row n + most of the last column up to row m.
    k = width - 1
    for _ in range(n + most - m):
        k -= 1
        score -= (plus >> k & 1) - (minus >> k & 1)
    return min(score, most + 1)


def segments(length: int, threshold: int) -> list[tuple[int, int]]:
    """(start, size) of threshold + 1 segments of nearly equal size, the longer ones last."""
    n = threshold + 1
    short, longer = divmod(length, n)
    out, at = [], 0
    for i in range(n):
        size = short + (i >= n - longer)
        out.append((at, size))
        at += size
    return out


def places(length: int, threshold: int, least: int) -> list[tuple[int, int, int]]:
    """(seed, start, end) of all substrings of a line of this length that are looked up.

    The seed tells the indexed line's length and segment. The line's own segments are among them, so
    one list serves as index and as probe.
    """
    out = []
    for target in range(max(least, length - threshold), length + 1):
        delta = length - target
        for i, (p, size) in enumerate(segments(target, threshold)):
            if size:
                back = threshold - i
                lo, hi = max(p - i, p + delta - back, 0), min(p + i, p + delta + back, length - size)
                out += [(target * (threshold + 1) + i, s, s + size) for s in range(lo, hi + 1)]
    return out


def line_id(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def counts(line: bytes, least: int, exact: int) -> bool:
    """Whether a line belongs to a class: with lines near it, or under `least` bytes with equal ones alone."""
    return len(line) >= least or (len(line) >= exact and not line.isspace())


def line_rows(docs: DataFrame, least: int, exact: int) -> DataFrame:
    """id, dk, h1, h2, no of the first occurrence of each line in each document. docs: id, dk, text."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                who, h1, h2, no = [], [], [], []
                for i, text in enumerate(batch.column(2).slice(lo, 500)):
                    seen = set()
                    for k, line in enumerate(text.as_buffer().to_pybytes().split(b"\n") if text.is_valid else ()):
                        if line not in seen and counts(line, least, exact):
                            seen.add(line)
                            who.append(lo + i), h1.append(line_id(line)), h2.append(xxhash.xxh3_64_intdigest(line, 1) - (1 << 63)), no.append(k)
                if who:
                    at = pa.array(who)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(no, pa.int32())], names=["id", "dk", "h1", "h2", "no"])

    return arrow(docs, over, "id long, dk long, h1 long, h2 long, no int")


def packed_keys(docs: DataFrame, threshold: int, least: int, ranges: int) -> DataFrame:
    """range, keys (32 bits that the range does not tell), lines: packed look-up keys of all lines."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, plan = xxhash.xxh3_64_intdigest, {}
        keys, lines, seen = array("Q"), array("q"), set()

        def flush() -> pa.RecordBatch:
            k, x = np.frombuffer(keys, np.uint64), np.frombuffer(lines, np.int64)
            which = ((k >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(which, kind="stable")
            names, first = np.unique(which[order], return_index=True)
            parts = [order[a:b] for a, b in zip(first, [*first[1:], len(order)])]
            short = k.astype(np.uint32)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([short[p].tobytes() for p in parts], pa.binary()), pa.array([x[p].tobytes() for p in parts], pa.binary())], names=["range", "keys", "lines"])

        for batch in batches:
            for text in batch.column(2):
                for line in text.as_buffer().to_pybytes().split(b"\n") if text.is_valid else ():
                    n = len(line)
                    if n < least or (own := line_id(line)) in seen:
                        continue
                    seen.add(own)
                    spots = plan.get(n)
                    if spots is None:
                        spots = plan[n] = places(n, threshold, least)
                    keys.extend([digest(line[a:b], seed) for seed, a, b in spots])
                    lines.extend([own] * len(spots))
                if len(keys) > PACK_KEYS:
                    yield flush()
                    keys, lines, seen = array("Q"), array("q"), set() if len(seen) > SEEN else seen
        if keys:
            yield flush()

    return arrow(docs, over, "range int, keys binary, lines binary")


def groups(packs: DataFrame, ranges: int) -> DataFrame:
    """gid, size, line: the lines that share a key, where there are two at least."""

    def meet(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lines = (np.concatenate([np.frombuffer(x.as_buffer(), t) for p in parts for x in p.column(c)]) for c, t in (("keys", np.uint32), ("lines", np.int64)))
        order = np.lexsort((lines, keys))
        keys, lines = keys[order], lines[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (lines[1:] != lines[:-1])
        keys, lines = keys[new], lines[new]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff([*first, len(keys)])
        with np.errstate(over="ignore"):
            own = mix(lines.view(np.uint64))
            gid = mix(np.add.reduceat(own, first) + size.astype(np.uint64)).view(np.int64)
        row = np.repeat(np.arange(len(first)), size)
        good = size[row] > 1
        for lo in range(0, int(good.sum()), 100_000):
            at = np.flatnonzero(good)[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(gid[row[at]]), pa.array(size[row[at]].astype(np.int64)), pa.array(lines[at])], names=["gid", "size", "line"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = None, []
        for key, part in stream_groups(batches, ["range"]):
            if key != held and parts:
                yield from meet(parts)
                parts = []
            held = key
            parts.append(part)
        if parts:
            yield from meet(parts)

    return arrow(packs.repartition(ranges, "range").sortWithinPartitions("range"), over, "gid long, size long, line long").dropDuplicates(["gid", "line"])


def links(members: DataFrame, threshold: int) -> DataFrame:
    """a, b: links that join components within a group (gid, i, j) of members (line, text, side)."""

    def compare(lines: list[int], texts: list[bytes], side: list[int]) -> Iterator[tuple[int, int]]:
        root = list(range(len(lines)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        both = len(set(side)) > 1
        size, flags = np.array([len(t) for t in texts]), np.array(side)
        counts = np.zeros((len(texts), 32), np.int32)
        for i, t in enumerate(texts):
            counts[i] = np.bincount(np.frombuffer(t, np.uint8) & 31, minlength=32)
        for i in range(len(lines) - 1):
            near = np.abs(size[i + 1 :] - size[i]) <= threshold
            if both:
                near &= flags[i + 1 :] != flags[i]
            at = np.flatnonzero(near) + i + 1
            if len(at):
                at = at[np.abs(counts[at] - counts[i]).sum(axis=1) <= 2 * threshold]
            for j in at.tolist():
                a, b = find(i), find(j)
                if a != b and distance(texts[i], texts[j], threshold) <= threshold:
                    root[a] = b
                    yield lines[i], lines[j]

    def emit(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lines, texts, side, found = None, [], [], [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("gid", "i", "j", "line", "text", "side")]
            for gid, i, j, line, text, s in zip(*columns):
                if (gid, i, j) != held:
                    if len(lines) > 1:
                        found += compare(lines, texts, side)
                    held, lines, texts, side = (gid, i, j), [], [], []
                lines.append(line), texts.append(text), side.append(s)
            if len(found) > 10_000:
                yield emit(found)
                found = []
        if len(lines) > 1:
            found += compare(lines, texts, side)
        if found:
            yield emit(found)

    group = ["gid", "i", "j"]
    return arrow(members.select(*group, "line", "text", "side").repartition(*group).sortWithinPartitions(*group), over, "a long, b long").distinct()


def removals(docs: DataFrame, threshold: int, least: int, exact: int, block: int = 0) -> DataFrame:
    """id, dk, gone: for documents (id, dk, text) the ids of lines that stay elsewhere."""
    block = block or BLOCK
    rows = cut(line_rows(docs, least, exact), "lines")
    per_line = 3 * (threshold + 1) ** 2 // 2
    ranges = max(8, -(-rows.count() * per_line // RANGE_KEYS))
    met = cut(groups(packed_keys(docs, threshold, least, ranges), ranges), "groups")
    classes = cut(rows.groupBy("h1", "h2").agg(F.min(F.struct("id", "dk", "no")).alias("first"), F.count("*").alias("n")), "line-classes")
    # The text of the lines that met another, from the document where each stands first.
    wanted = classes.join(met.select(F.col("line").alias("h1")).distinct(), "h1", "left_semi")
    wanted = wanted.groupBy("first.id", "first.dk").agg(F.collect_set("h1").alias("wanted"))

    def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                ids, texts = [], []
                for text, want in zip(batch.column(0).slice(lo, 500), batch.column(1).slice(lo, 500).to_pylist()):
                    want = set(want)
                    for line in text.as_buffer().to_pybytes().split(b"\n"):
                        if len(line) >= least and (own := line_id(line)) in want:
                            want.discard(own)
                            ids.append(own), texts.append(line)
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary())], names=["line", "text"])

    texts = arrow(docs.join(wanted, ["id", "dk"]).select("text", "wanted"), lines_of, "line long, text binary").dropDuplicates(["line"])
    members = met.join(texts, "line").withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("line"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("gid", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "line", "text")
    labels = connected_components(links(members, threshold))
    known = classes.join(labels.withColumnRenamed("node", "h1"), "h1", "left").where("n > 1 or label is not null")
    known = cut(known.select("h1", "h2", "first", F.coalesce("label", "h1").alias("label")), "repeated")
    stays = known.groupBy("label").agg(F.min("first").alias("stays"))
    where = known.join(stays, "label").select("h1", "h2", "stays")
    gone = rows.join(where, ["h1", "h2"]).where(F.struct("id", "dk", "no") != F.col("stays"))
    return gone.groupBy("id", "dk").agg(F.collect_list("h1").alias("gone"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("id"), F.xxhash64(F.col(text_col)).alias("dk"), F.col(text_col).alias("text"))


def kept_lines(text: bytes, gone: list[int] | None, least: int, exact: int) -> tuple[bytes, int, int]:
    """The text without removed and repeated lines, its number of lines, how many went."""
    lines, out, seen, gone = text.split(b"\n"), [], set(), set(gone or ())
    for line in lines:
        if counts(line, least, exact):
            if line in seen:
                continue
            seen.add(line)
            if gone and line_id(line) in gone:
                continue
        out.append(line)
    return b"\n".join(out), len(lines), len(lines) - len(out)


def added(docs: DataFrame) -> dict[str, str]:
    """What the columns that dedup_lines adds are called."""
    return unused(docs.columns, ("line_n", "line_removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, min_bytes: int = MIN_BYTES, exact_bytes: int = EXACT_BYTES) -> DataFrame:
    """docs' columns with the deduplicated text, and _line_n, _line_removed (0 for null texts)."""
    integer(docs, id_col)
    own, exact, made = keyed(docs, id_col, text_col), max(1, exact_bytes), added(docs)
    gone = removals(own, threshold, min_bytes, exact)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("id"), F.xxhash64(F.col(text_col)).alias("dk"), row)
    names = [*docs.columns, *made.values()]
    held = unused(names, ("gone",))["gone"]
    rows = rows.join(gone, ["id", "dk"], "left").select("row.*", F.col("gone").alias(held))
    at, n = docs.columns.index(text_col), len(docs.columns)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                done = [kept_lines(t.as_buffer().to_pybytes(), g, min_bytes, exact) if t.is_valid and len(t.as_buffer()) else (None if not t.is_valid else b"", 0, 0) for t, g in zip(part.column(at), part.column(n).to_pylist())]
                text = pa.array([d[0] for d in done], pa.binary()).cast(pa.string())
                cols = [text if i == at else part.column(i) for i in range(n)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return arrow(rows, over, f"{fields}, `{made['line_n']}` long, `{made['line_removed']}` long")
