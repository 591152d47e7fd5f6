"""Nearest neighbours by largest inner product with cross-polytope hashing.

A hash of a unit vector is the signed axis nearest to it after a pseudo-rotation (three rounds of
random signs and a fast Hadamard transform). `parts` such hashes make a bucket, `tables` tables hold
every vector; a query probes its best buckets in each table, and all vectors found are ranked by
their exact inner product in double precision.

Buckets tell directions, so vectors are grouped by length (number of components) and by ranges of
norm, each a factor `RATIO` wide, and each group has tables of its own. How many tables and probes a
group gets is planned from its size, at every size alike: the k nearest of n directions begin at a
cosine that falls as n does, and a seeded simulation tells how many tables and probes find a vector
at that cosine with a chance of `RECALL`; of all such plans the cheapest is taken. A group of few
vectors so comes to probe all its buckets. Random directions are the worst case: on clustered
vectors the neighbours are nearer and found more surely. A query that finds fewer than k ids is
answered by a scan of all vectors in blocks, which is exact.

Equal vectors form one class with its k + 1 smallest ids, which is all that a top-k list can use.
Vectors travel packed, by (group, table, bucket); a bucket with many vectors or queries is split
into a grid of cells of bounded size. Per cell and query only the k + 1 best are kept.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no
part, neither do rows with a null id; ids are integers. Vectors of other lengths than the query's are
no candidates. Equal scores go to the smaller id. Rows with the query's own id are no candidates, so
repeated rows do not find themselves. With fewer candidates than k, all are returned. An empty table
gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.shared import arrow, cut, integer, stream_groups
from tessella.llm.words import seeded

RATIO = 0.8  # width of a range of norms
RECALL = 0.96  # chance that a neighbour at the k-th place of random directions is found
TABLES, PROBES = (2, 24), 256  # tables of a plan, at least and at most; probes at most
WIDE_FROM = 1 << 20  # vectors of a group from which buckets of two hashes are weighed too
COPY_COST = 40  # what moving a vector costs, in inner products
CHUNK = 4096  # vectors that a packed set of rows comes from
CELL_QUERIES, CELL_VECTORS = 4096, 65536
TIES = 1 << 17  # vectors whose exact scores are held at once, about
SCAN_CHUNK, SCAN_VECTORS, SCAN_CELLS = 512, 2048, 64  # vectors of a packed set and, at least, of a cell of a scan; its cells while these do


class Hasher:
    def __init__(self, dim: int, tables: int, parts: int, seed: int = 1) -> None:
        self.width = 1 << max(0, dim - 1).bit_length()
        n = tables * parts * 3 * self.width
        self.signs = np.where(seeded(n, seed) >> np.uint64(63), 1.0, -1.0).reshape(tables, parts, 3, self.width)

    def rotate(self, x: np.ndarray, table: int, part: int) -> np.ndarray:
        y = np.zeros((len(x), self.width))
        y[:, : x.shape[1]] = x
        for signs in self.signs[table, part]:
            y = y * signs
            h = 1
            while h < self.width:
                y = y.reshape(len(x), -1, 2, h)
                y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), -1)
                h *= 2
            y /= np.sqrt(self.width)
        return y

    def buckets(self, x: np.ndarray, table: int, probes: int) -> np.ndarray:
        """The best `probes` buckets of each row, best first; fewer where there are no more."""
        parts = self.signs.shape[1]
        best, value = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for part in range(parts):
            y = self.rotate(x, table, part)
            both = np.concatenate([y, -y], axis=1)
            r = min(probes, both.shape[1])
            top = np.argpartition(-both, r - 1, axis=1)[:, :r]
            score = np.take_along_axis(both, top, axis=1)
            best = (best[:, :, None] * (2 * self.width) + top[:, None, :]).reshape(len(x), -1)
            value = (value[:, :, None] + score[:, None, :]).reshape(len(x), -1)
            order = np.argsort(-value, axis=1, kind="stable")[:, :probes]
            best, value = np.take_along_axis(best, order, axis=1), np.take_along_axis(value, order, axis=1)
        return best


@cache
def found_chance(dim: int, cosine: float, parts: int, most: int) -> np.ndarray:
    """By number of probes up to `most`: the chance that a vector at this cosine is in a probed bucket of a table."""
    rng, n, rank = np.random.default_rng(dim), 400, []
    hasher = Hasher(dim, 4, parts, seed=7)
    for t in range(4):
        x, z = (rng.normal(size=(n, dim)) for _ in range(2))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
        y = cosine * x + (1 - cosine * cosine) ** 0.5 * z
        probed, own = hasher.buckets(x, t, most), hasher.buckets(y, t, 1)
        hit = probed == own
        rank.append(np.where(hit.any(axis=1), hit.argmax(axis=1), probed.shape[1]))
    return np.cumsum(np.bincount(np.concatenate(rank), minlength=most + 1)[:most]) / (4 * n)


def planned(dim: int, n: int, k: int, queries: int, recall: float = RECALL) -> tuple[int, int, int]:
    """(parts, tables, probes) of a group of n vectors: the cheapest that holds the recall."""
    every = 2 << max(0, dim - 1).bit_length()
    if k >= n or dim < 2:
        return 1, 1, every
    cosine = round(min(0.98, max(0.0, -NormalDist().inv_cdf(k / n) / dim**0.5)), 2)
    best = n + every * queries, n * queries, (1, 1, every)
    best = best[0] * COPY_COST + best[1], best[2]
    for parts in (1, 2) if n >= WIDE_FROM else (1,):
        most = min(PROBES, every**parts)
        chance = found_chance(dim, cosine, parts, most)
        for tables in range(TABLES[0], TABLES[1] + 1):
            probes = int(np.searchsorted(chance, 1 - (1 - recall) ** (1 / tables))) + 1
            if probes <= most:
                cost = COPY_COST * tables * (n + probes * queries) + n * queries * tables * probes / every**parts
                best = min(best, (cost, (parts, tables, probes)))
    return best[1]


def packed(rows: DataFrame, side: int, plans: dict | None) -> DataFrame:
    """(key, low, grp, vector) rows packed by bucket: grp, tab, bucket, side, salt, n, keys, lows, vectors.

    plans: (parts, tables, probes) of each group (length, range of norms). Vectors go to their own
    group, queries (side 0) to all of their length. Without plans, for a scan, each length is one bucket.
    """
    chunk = CHUNK if plans else min(CHUNK, SCAN_CHUNK)
    names = ["dim", "grp", "tab", "bucket", "side", "salt", "n", "keys", "lows", "vectors"]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers: dict = {}

        def bucketed(dim: int, x: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
            """(group, table, rows, their buckets) of unit vectors; rows may repeat."""
            every = [g for d, g in plans if d == dim]
            for tables in {(plans[dim, g][0], plans[dim, g][1]) for g in every}:
                groups = [g for g in every if plans[dim, g][:2] == tables]
                if side:
                    groups = [g for g in groups if (own == g).any()]
                if not groups:
                    continue
                hasher = hashers.setdefault((dim, *tables), Hasher(dim, tables[1], tables[0]))
                most = 1 if side else max(plans[dim, g][2] for g in groups)
                for t in range(tables[1]):
                    if side:
                        at = np.flatnonzero(np.isin(own, groups))
                        found = hasher.buckets(x[at], t, 1)[:, 0]
                        for g in groups:
                            yield g, t, at[own[at] == g], found[own[at] == g]
                    else:
                        found = hasher.buckets(x, t, most)
                        for g in groups:
                            f = found[:, : plans[dim, g][2]]
                            yield g, t, np.repeat(np.arange(len(x)), f.shape[1]), f.ravel()

        for batch in batches:
            for lo in range(0, batch.num_rows, chunk):
                part = batch.slice(lo, chunk)
                size = part.column(3).value_lengths().to_numpy(zero_copy_only=False)
                for dim in np.unique(size).tolist():
                    some = part.filter(pa.array(size == dim))
                    keys, lows, own = (some.column(i).to_numpy() for i in range(3))
                    x = some.column(3).flatten().to_numpy().reshape(some.num_rows, dim)
                    wide = x.astype(np.float64)
                    wide = wide / np.abs(wide).max(axis=1, keepdims=True)
                    unit = wide / np.linalg.norm(wide, axis=1, keepdims=True)
                    every = np.arange(len(x))
                    for g, t, rows_, which in bucketed(dim, unit, own) if plans else [(0, 0, every, 0 * every)]:
                        if not len(rows_):
                            continue
                        order = np.argsort(which, kind="stable")
                        buckets, first = np.unique(which[order], return_index=True)
                        out = [rows_[order[a:b]] for a, b in zip(first, [*first[1:], len(order)])]
                        ints = [pa.array([v] * len(out), pa.int32()) for v in (dim, g, t)]
                        yield pa.RecordBatch.from_arrays(
                            [*ints, pa.array(buckets), pa.array([side] * len(out), pa.int32()), pa.array([int(keys[i[0]]) for i in out], pa.int64()), pa.array([len(i) for i in out], pa.int64()), *(pa.array([v[i].tobytes() for i in out], pa.binary()) for v in (keys, lows, x))],
                            names=names)

    return arrow(rows.select("key", "low", "grp", "x"), over, "dim int, grp int, tab int, bucket long, side int, salt long, n long, keys binary, lows binary, vectors binary")


def better(score: np.ndarray, low: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best different keys: larger score, then smaller id."""
    order = np.lexsort((low, -score))
    _, first = np.unique(keys[order], return_index=True)
    return order[np.sort(first)[:k]]


def k_best(q: np.ndarray, keys: np.ndarray, lows: np.ndarray, x: np.ndarray, k: int) -> list[np.ndarray]:
    """(score, key, low) of the k best vectors of each query, ties by smaller low; score -inf where there are none."""
    s = q @ x.T
    take = min(k, s.shape[1])
    out = [np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64), np.zeros((len(q), k), np.int64)]
    # All that may reach the k-th score, up to rounding of the block's product.
    slack = 4 * x.shape[1] * np.finfo(np.float64).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
    least = np.partition(s, s.shape[1] - take, axis=1)[:, s.shape[1] - take] - slack
    near = s >= least[:, None]
    ends = np.cumsum(near.sum(axis=1))
    lo = 0
    while lo < len(q):  # queries with a bounded number of finds, one at least
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TIES, side="right")))
        row, col = np.nonzero(near[lo:hi])
        # Exact and in a fixed order, whatever the block's shape was.
        exact = (q[lo + row] * x[col]).sum(axis=1)
        order = np.lexsort((lows[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        good = rank < k
        for a, v in zip(out, (exact, keys[col], lows[col])):
            a[lo + row[good], rank[good]] = v[good]
        lo = hi
    return out


def rank_cells(cells: DataFrame, k: int, kind: str) -> DataFrame:
    """qkey and its k best (keys, lows, scores) of each cell; queries (side 0) come before vectors."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, queries, q, best = None, [], None, None

        def finish() -> Iterator[pa.RecordBatch]:
            if best is None:
                return
            qkeys, found, out = q[0], best, []
            for i in range(len(qkeys)):
                ok = found[0][i] > -np.inf
                out.append(tuple(a[i][ok].tobytes() for a in (found[1], found[2], found[0])))
            yield pa.RecordBatch.from_arrays([pa.array(qkeys), *(pa.array(c, pa.binary()) for c in zip(*out))], names=["qkey", "keys", "lows", "scores"])

        for key, part in stream_groups(batches, ["dim", "grp", "tab", "bucket", "qb", "vb"]):
            if key != held:
                yield from finish()
                held, queries, q, best = key, [], None, None
            for i in range(part.num_rows):
                side = part.column("side")[i].as_py()
                keys, lows = (np.frombuffer(part.column(c)[i].as_py(), np.int64) for c in ("keys", "lows"))
                x = np.frombuffer(part.column("vectors")[i].as_py(), kind).reshape(len(keys), -1).astype(np.float64)
                if side == 0:
                    queries.append((keys, x))
                    continue
                if not queries:
                    continue
                if q is None:
                    q = np.concatenate([a for a, _ in queries]), np.concatenate([b for _, b in queries])
                new = k_best(q[1], keys, lows, x, k)
                if best is not None:
                    new = [np.concatenate([a, b], axis=1) for a, b in zip(best, new)]
                order = np.lexsort((new[2], -new[0]), axis=1)[:, :k]
                best = [np.take_along_axis(a, order, axis=1) for a in new]
        yield from finish()

    return arrow(cells, over, "qkey long, keys binary, lows binary, scores binary")


def merged(partial: DataFrame, k: int) -> DataFrame:
    """qkey, key, score: the k best classes of each query."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, best = None, None

        def emit(q: int, b: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([q] * len(b[1]), pa.int64()), pa.array(b[1]), pa.array(b[0])], names=["qkey", "key", "score"])

        for (q,), part in stream_groups(batches, ["qkey"]):
            if q != held:
                if held is not None:
                    yield emit(held, best)
                held, best = q, (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
            s, keys, lows = (np.frombuffer(b"".join(part.column(c).to_pylist()), t) for c, t in (("scores", np.float64), ("keys", np.int64), ("lows", np.int64)))
            s, keys, lows = np.concatenate([best[0], s]), np.concatenate([best[1], keys]), np.concatenate([best[2], lows])
            at = better(s, lows, keys, k)
            best = s[at], keys[at], lows[at]
        if held is not None:
            yield emit(held, best)

    return arrow(partial.repartition("qkey").sortWithinPartitions("qkey"), over, "qkey long, key long, score double")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", plan: tuple[int, int, int] | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found to each row whose id is divisible by `every`.

    plan: (parts, tables, probes) for all groups, instead of what their sizes ask for.
    """
    integer(vectors, id_col)
    element = dict(vectors.dtypes)[vector_col].removeprefix("array<").removesuffix(">")
    kind = "float32" if element == "float" else "float64"
    x = F.col("x")
    good = x.isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if element == "float" else "array<double>").alias("x"))
    # Two hashes name equal vectors; a class keeps its k + 1 smallest ids.
    rows = rows.where(F.col("id").isNotNull() & good).select("id", "x", F.xxhash64("x").alias("h1"), F.hash("x").alias("h2"))
    first = rows.dropDuplicates(["id", "h1", "h2"]).withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("n") <= k + 1)
    largest = F.array_max(F.transform("x", lambda v: F.abs(v).cast("double")))
    norm = largest * F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + (v / largest) * (v / largest)))
    classes = first.groupBy("h1", "h2").agg(F.first("x").alias("x"), F.sort_array(F.collect_list("id")).alias("ids"))
    classes = classes.withColumns({"grp": F.floor(F.log(norm) / -np.log(RATIO)).cast("int"), "low": F.col("ids")[0]})
    # Written once and only read from then on, so that the numbers hold.
    classes = cut(classes.withColumn("key", F.monotonically_increasing_id()), "classes")
    asks = rows.where(F.col("id") % every == 0).select("id", "h1", "h2").distinct().join(classes.select("h1", "h2", "key"), ["h1", "h2"]).select("id", "key")
    ask_classes = classes.join(asks.select("key").distinct(), "key", "left_semi").select("key", "low", "grp", "x")
    sizes = classes.groupBy(F.size("x").alias("dim"), "grp").count().collect()  # one row a length and range of norms
    asked = dict(ask_classes.groupBy(F.size("x")).count().collect())  # one a length
    plans = {(d, g): plan or planned(d, n, k, asked[d]) for d, g, n in sizes if d in asked}

    def best(ask: DataFrame, plans: dict | None) -> DataFrame:
        hashed = classes.select("key", "low", "grp", "x").where(F.size("x").isin([*asked]))
        both = cut(packed(hashed, 1, plans).union(packed(ask, 0, plans)), "packed")
        spot = ["dim", "grp", "tab", "bucket"]
        # Cells of a bucket: from counts, a bounded number of rows where buckets are few; else joined.
        grid = both.groupBy(*spot).agg(F.sum(F.when(F.col("side") == 0, F.col("n"))).alias("qn"), F.sum(F.when(F.col("side") == 1, F.col("n"))).alias("vn")).where("qn > 0 and vn > 0")
        most = F.lit(CELL_VECTORS) if plans else F.least(F.lit(CELL_VECTORS), F.greatest(F.lit(SCAN_VECTORS), F.col("vn") / SCAN_CELLS))
        grid = grid.select(*spot, F.ceil(F.col("qn") / CELL_QUERIES).cast("int").alias("qbs"), F.ceil(F.col("vn") / most).cast("int").alias("vbs"))
        cells = both.join(grid, spot).withColumns({"own_q": F.pmod(F.xxhash64("salt"), F.col("qbs")).cast("int"), "own_v": F.pmod(F.xxhash64("salt"), F.col("vbs")).cast("int")})
        span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        to = F.when(F.col("side") == 0, F.transform(span("vbs"), lambda v: F.struct(F.col("own_q").alias("qb"), v.alias("vb")))).otherwise(F.transform(span("qbs"), lambda q: F.struct(q.alias("qb"), F.col("own_v").alias("vb"))))
        cells = cells.withColumn("to", F.explode(to)).select(*spot, "to.qb", "to.vb", "side", "keys", "lows", "vectors")
        cells = cells.repartition(*spot, "qb", "vb").sortWithinPartitions(*spot, "qb", "vb", "side")
        return merged(rank_cells(cells, k + 1, kind), k + 1)

    top = cut(best(ask_classes, plans), "top") if plans else best(ask_classes, None)
    if plans:
        # k ids besides the query's own, or all vectors are scanned for it.
        enough = top.join(classes.select("key", "ids"), "key").groupBy("qkey").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("found")).where(F.col("found") > k)
        short = cut(ask_classes.join(enough.select(F.col("qkey").alias("key")), "key", "left_anti"), "short")
        if not short.isEmpty():
            top = top.join(short.select(F.col("key").alias("qkey")), "qkey", "left_anti").union(best(short, None))
    out = top.join(classes.select("key", F.explode("ids").alias("vec_id")), "key")
    out = out.join(asks.select(F.col("key").alias("qkey"), F.col("id").alias("query_id")), "qkey").where("query_id <> vec_id")
    out = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
