"""Repeated passages by an enhanced suffix array and its common-prefix interval tree.

Every byte that lies in a string of `least` bytes which also starts anywhere else is marked, over all
documents, exactly. Strings never cross documents.

How a corpus-wide suffix array is kept small and distributed:

1. Anchors. In each window of `least` bytes the k-grams of smallest hash are anchors (about 1 byte in
   50). Equal windows have equal anchors, so two equal windows meet under an anchor's k-gram. The
   keys go through the shuffle packed by hash range; k-grams that occur once end here.
2. Contexts. What stands around an anchor inside its windows (at most `least` - k bytes before it,
   `least` bytes from it on) decides everything. Equal contexts, told by 128 bits of two families
   of polynomial hashes over random tables (contexts are short), are one entry with a count: copies and periodic runs collapse, and a context that occurs twice is a
   repeat of its own.
3. The tree. The different contexts of one k-gram are sorted by what follows the anchor: a sparse
   enhanced suffix array (order and common prefixes). One scan with a stack gives its intervals,
   each a set of places with a common right side. Inside an interval the left sides are sorted too:
   an interval whose members extend equally to the left is not maximal, and where they differ it
   splits into the maximal repeats, each with all its places. A repeat of `least` bytes or more marks
   its places from its left end to its right end.
4. Spans go back to the documents and are joined to runs.

The contexts of a k-gram that are more than `largest` are split first, by halves of where a shared
window may lie and by what must agree then, until one task can scan each part's tree; nothing that
shares a window is parted on the way.

`repeat_groups` puts the tree's maximal repeats out, each with all its places; `repeated_spans` the
merged runs. A group reaches as far as the contexts do (300 bytes at most); longer repeats are
several overlapping groups.

Defined cases: null texts are empty; empty and short texts have no repeats. Equal rows repeat each
other, whatever their ids; null ids are as good as any. Only the named columns are read. Empty
tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import KeyFilter, arrow, cut
from tessella.llm.words import BASE, PIECE, Powers, mix, runs, seeded, texts_of

LEAST, GRAM = 200, 100
LARGEST = 20_000  # contexts of a k-gram whose tree one task scans
OTHER = 0xC2B2AE3D27D4EB4F  # base of the second family of hashes
RANGE_KEYS = 1 << 18  # anchors of a hash range, about


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def intervals(prefixes: list[int]) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of the interval tree of a suffix array, children before parents.

    prefixes[i]: common prefix of the suffixes in places i and i + 1.
    """
    stack: list[tuple[int, int]] = []
    for i, p in enumerate([*prefixes, -1]):
        first = i
        while stack and stack[-1][0] > p:
            top, first = stack.pop()
            yield top, first, i
        if not stack or stack[-1][0] < p:
            stack.append((p, first))


def maximal_repeats(rights: list[bytes], lefts: list[bytes], least: int, every: bool = False) -> Iterator[tuple[int, int, list[int]]]:
    """(left, right, places): sets of places whose texts agree for `left` bytes before them and
    `right` bytes from them on, left + right >= least, and which extend in neither direction together.

    rights: what follows each place; lefts: what stands before it, reversed. All of them with `every`;
    else those that add something to what their places are given in already, which is all that
    coverage needs.
    """
    order = sorted(range(len(rights)), key=rights.__getitem__)
    prefixes = [common(rights[a], rights[b]) for a, b in zip(order, order[1:])]
    rank, spot = [0] * len(lefts), [0] * len(lefts)
    for r, i in enumerate(order):
        spot[i] = r
    by_left = sorted(range(len(lefts)), key=lefts.__getitem__)
    for r, i in enumerate(by_left):
        rank[i] = r
    best = [-1] * len(lefts)  # the longest left side that was given, of each place
    for right, first, last in intervals(prefixes):
        need = least - right
        members = sorted(order[first : last + 1], key=rank.__getitem__)
        sides = [common(lefts[a], lefts[b]) for a, b in zip(members, members[1:])]
        if max(sides) < need:
            continue
        # Left-extension diversity: the interval tree of the left sides splits it into maximal sets.
        for left, lo, hi in intervals(sides):
            if left >= need and left + right >= least:
                places = members[lo : hi + 1]
                if every:
                    at = [spot[i] for i in places]
                    if min(prefixes[min(at) : max(at)]) == right:  # else they go on together to the right
                        yield left, right, places
                    continue
                new = [i for i in places if best[i] < left]
                if new:
                    for i in new:
                        best[i] = left
                    yield left, right, places


class Anchors:
    """Anchors of texts, many texts at once."""

    def __init__(self, least: int, gram: int) -> None:
        self.least, self.gram = least, gram
        self.families = [(Powers(base), seeded(256, seed)) for base, seed in ((BASE, 23), (OTHER, 29))]
        self.wide = least - gram + 1

    def sums(self, raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Prefix sums and inverse powers, of each family of hashes."""
        n = len(raw)
        for powers, table in self.families:
            up, down = powers.upto(n + 1)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(table[raw] * up[:n], out=total[1:])
            yield total, down

    def slide(self, x: np.ndarray, pick: np.ufunc, fill: int) -> np.ndarray:
        """pick over x[i : i + wide] for each i (x is padded with fill)."""
        w, n = self.wide, len(x)
        rows = -(-(n + w) // w)
        y = np.full(rows * w, fill, np.uint64)
        y[:n] = x
        y = y.reshape(rows, w)
        ahead = pick.accumulate(y, axis=1).ravel()
        back = pick.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
        return pick(back[:n], ahead[w - 1 : w - 1 + n])

    def __call__(self, raw: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
        """places, text numbers, gram hashes, context digests (two halves), context starts, context ends. own: text offsets."""
        n, k, least = len(raw), self.gram, self.least
        none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.uint64, np.int64, np.int64))
        if n < least:
            return none
        with np.errstate(over="ignore"):
            (total, down), other = self.sums(raw)
            h = mix((total[k:] - total[:-k]) * down[: n - k + 1]) | np.uint64(1)
            low = self.slide(h, np.minimum, 2**64 - 1)[: n - least + 1]
            # Windows that cross a text's end do not count.
            good = np.zeros(n + 1, np.int64)
            start, end = own[:-1], own[1:]
            long = end - start >= least
            np.add.at(good, start[long], 1)
            np.add.at(good, end[long] - least + 1, -1)
            low = np.where(np.cumsum(good)[: len(low)] > 0, low, 0)
            full = np.zeros(n - k + 1 + self.wide - 1, np.uint64)
            full[self.wide - 1 : self.wide - 1 + len(low)] = low
            high = self.slide(full, np.maximum, 0)[: n - k + 1]
            at = np.flatnonzero(high == h)
            which = np.searchsorted(own, at, side="right") - 1
            lo, hi = np.maximum(own[which], at - (least - k)), np.minimum(own[which + 1], at + least)
            sides = (at - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (hi - at).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
            c, e = (mix((x[hi] - x[lo]) * y[lo] + sides) for x, y in ((total, down), other))
        return at, which, h[at], c, e, lo, hi


def over_texts(column: pa.Array, anchors: Anchors) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple]]:
    """(first row, bytes, text offsets, anchors) for runs of rows."""
    off, raw = texts_of(column)
    for lo, hi in runs(off, PIECE):
        part, own = raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        yield lo, part, own, anchors(part, own)


def packed(docs: DataFrame, least: int, gram: int, ranges: int) -> DataFrame:
    """range, h, c, e, d, n packed: the anchors' k-grams, contexts (two halves), documents and how often in each."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, held, size = Anchors(least, gram), [], 0

        def flush() -> pa.RecordBatch:
            h, c, e, d, n = (np.concatenate([x[i] for x in held]) for i in range(5))
            with np.errstate(over="ignore"):  # anchors are minima, so their hashes are small: mixed anew
                which = ((mix(h ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(which, kind="stable")
            names, first = np.unique(which[order], return_index=True)
            parts = [order[a:b] for a, b in zip(first, [*first[1:], len(order)])]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *(pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in (h, c, e, d, n))], names=["range", "h", "c", "e", "d", "n"])

        for batch in batches:
            d = batch.column(0).to_numpy()
            for lo, _, _, (_, which, h, c, e, _, _) in over_texts(batch.column(1), anchors):
                order = np.lexsort((e, c, h, which))
                which, h, c, e = which[order], h[order], c[order], e[order]
                new = np.ones(len(h), bool)
                new[1:] = (which[1:] != which[:-1]) | (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (e[1:] != e[:-1])
                first = np.flatnonzero(new)
                n = np.minimum(np.diff([*first, len(h)]), 2).astype(np.uint8)  # once, or more often
                held.append((h[first], c[first], e[first], d[lo + which[first]], n))
                size += len(first)
                if size > 400_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return arrow(docs.select("d", "text"), over, "range int, h binary, c binary, e binary, d binary, n binary")


def occurrences(packs: DataFrame, ranges: int) -> DataFrame:
    """h, c, e, d, twice, kinds, lead: the anchors whose k-gram occurs twice at least.

    twice: the context does too; kinds: different contexts of the k-gram; lead: one row of a context.
    """
    kinds = (("h", np.uint64), ("c", np.uint64), ("e", np.uint64), ("d", np.int64), ("n", np.uint8))

    def meet(parts: list) -> Iterator[pa.RecordBatch]:
        h, c, e, d, n = (np.concatenate([np.frombuffer(p[i], t) for p in parts]) for i, (_, t) in enumerate(kinds))
        order = np.lexsort((d, e, c, h))
        h, c, e, d, n = h[order], c[order], e[order], d[order], n[order].astype(np.int64)
        new_h = np.concatenate([[True], h[1:] != h[:-1]])
        new_c = new_h | np.concatenate([[True], (c[1:] != c[:-1]) | (e[1:] != e[:-1])])
        of_h, of_c = np.cumsum(new_h) - 1, np.cumsum(new_c) - 1
        at_h, at_c = np.flatnonzero(new_h), np.flatnonzero(new_c)
        total, twice, several = np.add.reduceat(n, at_h), np.add.reduceat(n, at_c) > 1, np.add.reduceat(new_c.astype(np.int64), at_h)
        keep = np.flatnonzero(total[of_h] > 1)
        # Copies of a document have equal rows; one is enough.
        same = np.zeros(len(h), bool)
        same[1:] = ~new_c[1:] & (d[1:] == d[:-1])
        keep = keep[~same[keep]]
        for lo in range(0, len(keep), 200_000):
            i = keep[lo : lo + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(h[i].view(np.int64)), pa.array(c[i].view(np.int64)), pa.array(e[i].view(np.int64)), pa.array(d[i]), pa.array(twice[of_c[i]]), pa.array(several[of_h[i]]), pa.array(new_c[i])], names=["h", "c", "e", "d", "twice", "kinds", "lead"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = None, []
        for batch in batches:
            cols = [batch.column(x) for x in ("h", "c", "e", "d", "n")]
            for i, key in enumerate(batch.column("range").to_pylist()):
                if key != held and parts:
                    yield from meet(parts)
                    parts = []
                held = key
                parts.append([x[i].as_py() for x in cols])
        if parts:
            yield from meet(parts)

    return arrow(packs.repartition(ranges, "range").sortWithinPartitions("range"), over, "h long, c long, e long, d long, twice boolean, kinds long, lead boolean")


def pressed(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs (d, d2, text) with compressed texts, for the shuffle; only those whose d may be in wanted."""
    may = KeyFilter(wanted, "d").test()

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            batch = batch.filter(pa.array(may(batch.column(0).to_numpy())))
            raw = [x.as_buffer() for x in batch.column(2)]
            if raw:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in raw], pa.int64()), pa.array([codec.compress(x, asbytes=True) for x in raw], pa.binary())], names=["d", "d2", "size", "z"])

    return arrow(docs.where("text is not null").select("d", "d2", "text"), over, "d long, d2 int, size long, z binary")


def unpressed(size: pa.Array, z: pa.Array) -> pa.Array:
    codec = pa.Codec("zstd")
    return pa.array([codec.decompress(x.as_buffer(), n, asbytes=True) for n, x in zip(size.to_pylist(), z)], pa.binary())


def contexts(docs: DataFrame, leads: DataFrame, least: int, gram: int) -> DataFrame:
    """h, c, e, before (reversed), after of each lead (h, c, e, d); copies of a document repeat its rows."""
    wanted = leads.groupBy("d").agg(F.collect_list(F.struct("h", "c", "e")).alias("wanted"))  # a document's own anchors at most

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(least, gram)
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                lists = part.column(2).to_pylist()
                rows = []
                for first, raw, _, (at, which, h, c, e, a, b) in over_texts(unpressed(part.column(0), part.column(1)), anchors):
                    keys = list(zip(*(x.view(np.int64).tolist() for x in (h, c, e))))
                    ends = np.searchsorted(which, np.arange(int(which[-1]) + 2) if len(which) else [0, 0])
                    for t in range(len(ends) - 1):
                        want = {(x["h"], x["c"], x["e"]) for x in lists[first + t]}
                        for i in range(ends[t], ends[t + 1]):
                            if keys[i] in want:
                                want.discard(keys[i])
                                rows.append((*keys[i], raw[a[i] : at[i]][::-1].tobytes(), raw[at[i] : b[i]].tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["h", "c", "e", "before", "after"])

    joined = pressed(docs, leads.select("d").distinct()).join(wanted, "d").select("size", "z", "wanted")
    return arrow(joined, over, "h long, c long, e long, before binary, after binary")


def by_gram(found: DataFrame, give: Callable[[int, list[tuple]], Iterator[tuple]], schema: str, kinds: tuple) -> DataFrame:
    """What `give` makes of each k-gram and its different contexts (c, e, before, after)."""
    names = [f.split()[0] for f in schema.split(", ")]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, out = None, [], []

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)

        for batch in batches:
            for h, *row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if h != held:
                    if rows:
                        out += give(held, rows)
                    held, rows = h, []
                if not rows or rows[-1][:2] != tuple(row[:2]):
                    rows.append(tuple(row))
            if len(out) > 20_000:
                yield emit()
                out = []
        if rows:
            out += give(held, rows)
        if out:
            yield emit()

    ordered = found.select("h", "c", "e", "before", "after").repartition("h").sortWithinPartitions("h", "c", "e")
    return arrow(ordered, over, schema)


SPANS = "h long, c long, e long, spans array<int>", (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))


def covered(found: DataFrame, least: int) -> DataFrame:
    """h, c, e, spans: for contexts (h, c, e, before, after), flat pairs of bytes marked before and after."""

    def give(h: int, rows: list[tuple]) -> Iterator[tuple]:
        spans: list[list[int]] = [[] for _ in rows]
        if len(rows) == 2:
            left, right = common(rows[0][2], rows[1][2]), common(rows[0][3], rows[1][3])
            if left + right >= least:
                spans = [[left, right]] * 2
        else:
            for left, right, places in maximal_repeats([r[3] for r in rows], [r[2] for r in rows], least):
                for i in places:
                    spans[i] += [left, right]
        return ((h, *r[:2], s) for r, s in zip(rows, spans) if s)

    return by_gram(found, give, *SPANS)


def windows(found: DataFrame, least: int) -> DataFrame:
    """h, c, e, left, w: the windows of `least` bytes of each context, by how many of them stand before the k-gram, digested."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for h, c, e, before, after in zip(*(batch.column(i).to_pylist() for i in range(5))):
                text, at = before[::-1] + after, len(before)
                lefts = range(max(0, least - len(after)), at + 1)
                if lefts:
                    n = len(lefts)
                    yield pa.RecordBatch.from_arrays([pa.array([x] * n, pa.int64()) for x in (h, c, e)] + [pa.array(lefts, pa.int32()), pa.array([digest(text[at - x : at - x + least]) for x in lefts], pa.binary())], names=["h", "c", "e", "left", "w"])

    return arrow(found.select("h", "c", "e", "before", "after"), over, "h long, c long, e long, left int, w binary")


def keys_of(text: bytes, before: int, lo: int, hi: int, least: int) -> bytes | None:
    """What contexts have in common that share a window with lo to hi bytes before the k-gram; None where there is none."""
    a, b = before - lo, before + least - hi
    return xxhash.xxh3_128_digest(text[a:b]) if a >= 0 and b <= len(text) else None


def counted(found: DataFrame, least: int, gram: int, largest: int) -> DataFrame:
    """The same as covered for k-grams of very many contexts: split until one task can scan each tree.

    Two contexts share a window if they agree for L bytes before the k-gram and least - L from it on,
    for some L. So they agree on the middle of all windows with L in a range, and are grouped by that;
    ranges are halved, and with them groups of more than `largest` contexts. What is left when a range
    is one L shares that very window.
    """
    rows = cut(found.select("h", "c", "e", "before", "after", F.lit(0).alias("lo"), F.lit(least - gram).alias("hi")), "large")
    spans, key = None, ["h", "lo", "hi", "k"]

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, c, e, before, after, lo, hi in zip(*(batch.column(i).to_pylist() for i in range(7))):
                text, n, mid = before[::-1] + after, len(before), (lo + hi) // 2
                for a, b in ((lo, mid), (mid + 1, hi)):
                    k = keys_of(text, n, a, b, least)
                    if k is not None:
                        out.append((h, c, e, before, after, a, b, k))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["h", "c", "e", "before", "after", "lo", "hi", "k"])

    while True:
        split = cut(arrow(rows.select("h", "c", "e", "before", "after", "lo", "hi"), halves, "h long, c long, e long, before binary, after binary, lo int, hi int, k binary"), "halves")
        sizes = split.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
        split = cut(split.join(sizes, key), "halves")
        whole = split.where("lo = hi").select("h", "c", "e", F.array("lo", F.lit(least) - F.col("lo")).cast("array<int>").alias("spans"))
        few = split.where((F.col("lo") < F.col("hi")) & (F.col("n") <= largest)).withColumn("h2", F.xxhash64(*key))
        own = covered(few.select(F.col("h2").alias("h"), "c", "e", "before", "after"), least).withColumnRenamed("h", "h2")
        own = own.join(few.select("h2", "c", "e", "h"), ["h2", "c", "e"]).select("h", "c", "e", "spans")
        got = cut(whole.union(own), "spans")
        spans = got if spans is None else spans.union(got)
        rows = split.where((F.col("lo") < F.col("hi")) & (F.col("n") > largest)).drop("k", "n")
        if rows.isEmpty():
            return spans.groupBy("h", "c", "e").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, d and d2 (the text's key), text."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("d"), F.hash(F.col(text_col)).alias("d2"), F.col(text_col).alias("text"))


def marked(docs: DataFrame, least: int = LEAST, gram: int = GRAM, largest: int = LARGEST) -> DataFrame:
    """d, d2, size, z, starts, ends: texts of docs (d, d2, text) that hold repeats, and the marked runs."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(8, -(-size * 2 // (least - gram) // RANGE_KEYS))
    found = cut(occurrences(packed(docs, least, gram, ranges), ranges), "anchors")
    leads = found.where("lead and kinds > 1")
    few, many = leads.where(F.col("kinds") <= largest), leads.where(F.col("kinds") > largest)
    spans = covered(contexts(docs, few, least, gram), least)
    if not many.isEmpty():
        spans = spans.union(counted(contexts(docs, many, least, gram).dropDuplicates(["h", "c", "e"]), least, gram, largest))
    mine = cut(found.join(cut(spans, "spans"), ["h", "c", "e"], "left").where("twice or spans is not null").select("d", "h", "c", "e", "twice", "spans"), "marks")
    dirty = mine.select("d").distinct()
    mine = mine.groupBy("d").agg(F.collect_list(F.struct("h", "c", "e", "twice", "spans")).alias("marks"))  # a document's own anchors at most

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(least, gram)
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                lists, starts, ends = part.column(4).to_pylist(), [[] for _ in range(part.num_rows)], [[] for _ in range(part.num_rows)]
                for first, _, own, (at, which, h, c, e, a, b) in over_texts(unpressed(part.column(2), part.column(3)), anchors):
                    keys = list(zip(*(x.view(np.int64).tolist() for x in (h, c, e))))
                    cuts = np.searchsorted(which, np.arange(len(own)))
                    for t in range(len(own) - 1):
                        marks = {(x["h"], x["c"], x["e"]): (x["twice"], x["spans"]) for x in lists[first + t]}
                        edge = np.zeros(int(own[t + 1] - own[t]) + 1, np.int64)
                        for i in range(cuts[t], cuts[t + 1]):
                            twice, spans_ = marks.get(keys[i], (False, None))
                            if twice:
                                edge[a[i] - own[t]] += 1
                                edge[b[i] - own[t]] -= 1
                            elif spans_:
                                for left, right in zip(spans_[::2], spans_[1::2]):
                                    edge[at[i] - left - own[t]] += 1
                                    edge[at[i] + right - own[t]] -= 1
                        mark = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
                        step = np.diff(mark)
                        starts[first + t], ends[first + t] = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                good = pa.array([len(s) > 0 for s in starts])
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (starts, ends)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), *lists], names=["d", "d2", "size", "z", "starts", "ends"]).filter(good)

    joined = pressed(docs, dirty).join(mine, "d").select("d", "d2", "size", "z", "marks")
    return arrow(joined, over, "d long, d2 int, size long, z binary, starts array<long>, ends array<long>")


GROUPS = "h long, c long, e long, grp long, left int, right int", (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM, largest: int = LARGEST) -> DataFrame:
    """group, length, id, start: all places (bytes) of each maximal repeat around an anchor.

    A group's places hold equal bytes, `least` at least, and go on together in neither direction
    within their contexts. Equal rows are places of their own. Of k-grams with more than `largest`
    contexts the groups are the windows of `least` bytes.
    """
    own = keyed(docs, id_col, text_col)
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(8, -(-size * 2 // (least - gram) // RANGE_KEYS))
    texts = own.dropDuplicates(["d", "d2"])
    found = cut(occurrences(packed(own, least, gram, ranges), ranges), "anchors")
    leads = found.where("lead")
    twice = found.where("lead and twice").select("h", "c", "e", F.lit(True).alias("whole"))

    def give(h: int, rows: list[tuple]) -> Iterator[tuple]:
        n = 0
        for left, right, places in maximal_repeats([r[3] for r in rows], [r[2] for r in rows], least, every=True) if len(rows) > 1 else ():
            n += 1
            for i in places:
                yield (h, *rows[i][:2], n, left, right)
        for i, r in enumerate(rows):  # a context that is there twice is a repeat wherever no group reaches so far
            yield (h, *r[:2], -1 - i, len(r[2]), len(r[3]))

    few, many = leads.where(F.col("kinds") <= largest), leads.where(F.col("kinds") > largest)
    groups = by_gram(contexts(texts, few, least, gram), give, *GROUPS)
    if not many.isEmpty():
        rows = windows(contexts(texts, many, least, gram).dropDuplicates(["h", "c", "e"]), least)
        groups = groups.union(rows.select("h", "c", "e", F.xxhash64("left", "w").bitwiseAND(F.lit(2**63 - 1)).alias("grp"), "left", (F.lit(least) - F.col("left")).alias("right")))
    groups = groups.join(twice, ["h", "c", "e"], "left").where("grp >= 0 or whole").drop("whole")
    mine = cut(found.select("d", "h", "c", "e").distinct().join(groups, ["h", "c", "e"]), "groups")
    dirty, lists = mine.select("d").distinct(), mine.groupBy("d").agg(F.collect_list(F.struct("h", "c", "e", "grp", "left", "right")).alias("marks"))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(least, gram)
        for batch in batches:
            d, d2, z, marks = (batch.column(i).to_pylist() for i in (0, 1, 2, 4))
            for k in range(batch.num_rows):
                part, out = batch.slice(k, 1), []
                held: dict[tuple, list] = {}
                for x in marks[k]:
                    held.setdefault((x["h"], x["c"], x["e"]), []).append(x)
                for _, _, _, (at, _, h, c, e, _, _) in over_texts(unpressed(part.column(2), part.column(3)), anchors):
                    for i, key in zip(at.tolist(), zip(*(x.view(np.int64).tolist() for x in (h, c, e)))):
                        out += [(d[k], d2[k], key[0], x["grp"], x["left"] + x["right"], i - x["left"]) for x in held.get(key, ())]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=["d", "d2", "h", "grp", "length", "start"])

    joined = pressed(texts, dirty).join(lists, "d").select("d", "d2", "size", "z", "marks")
    places = arrow(joined, over, "d long, d2 int, h long, grp long, length long, start long")
    out = own.select("id", "d", "d2").join(places, ["d", "d2"]).select(F.xxhash64("h", "grp", "length").alias("group"), "length", F.col("id").alias(id_col), "start")
    several = out.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return out.join(several, "group")


def without(text: bytes, starts: list[int], ends: list[int]) -> bytes:
    out, at = [], 0
    for a, b in zip(starts, ends):
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """id, start, end (bytes) of each marked run of each row of docs."""
    own = keyed(docs, id_col, text_col)
    runs_ = marked(own, least).dropDuplicates(["d", "d2"]).select("d", "d2", F.explode(F.arrays_zip("starts", "ends")).alias("s"))
    return own.select("id", "d", "d2").join(runs_, ["d", "d2"]).select(F.col("id").alias(id_col), F.col("s.starts").alias("start"), F.col("s.ends").alias("end"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs."""
    own = keyed(docs, id_col, text_col)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            gone, n, sha = [], [], []
            for size, z, starts, ends in zip(*(batch.column(i) for i in range(2, 6))):
                starts, ends = starts.as_py(), ends.as_py()
                kept = without(codec.decompress(z.as_buffer(), size.as_py(), asbytes=True), starts, ends)
                gone.append(size.as_py() - len(kept)), n.append(len(starts)), sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=["d", "d2", "gone", "spans", "sha"])

    found = arrow(marked(own, least), over, "d long, d2 int, gone long, spans long, sha string").dropDuplicates(["d", "d2"])
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = own.select("id", "d", "d2", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    return rows.join(found, ["d", "d2"], "left").select(F.col("id").alias(id_col), "n_bytes", F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"))
