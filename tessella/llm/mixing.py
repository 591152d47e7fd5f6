"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern; each pattern can
give its words once, twice, ... up to `repeats` times, at a convex cost (copy c costs c), to any of
its sources; each source takes its target. The cheapest flow of the most words says how many words
each (pattern, source) contributes; documents are then taken in the order of a keyed hash.

Targets: sources in code-point order, null last, weigh 1, 2, 3, repeating (or as given), and share
all words; a target stops at `repeats` times its source's words and the excess is shared again.

Selection: a pattern that gives q full passes and a rest takes every document q times and, in hash
order, one time more until the rest is used up; the document at the boundary is taken in part, so
each source's words meet its target to within rounding. The boundary is found from sums over hash
buckets, so no task holds a source: only the one bucket at the boundary is ordered.

How often a document is taken follows from its text, id and pattern alone and a row of the plan for
each pattern; the driver holds that plan (a few hundred bytes a pattern; patterns are counted before
they are fetched only by what the data hold, there is no limit on them). Plans are broadcast up to
`PLAN_ROWS` patterns and joined beyond.

Defined cases: null or empty texts have size 0 and are taken 0 times; texts of any length count
whole; null ids are documents like others (hashed as an empty string); repeated rows are separate
documents that share a hash and are ordered by text; where they tie at the boundary they share what
is left; an empty table gives no rows. Other columns pass through, whatever their names: what is
added is called _size, _source_size, _target and _taken, with more underscores where docs has one of
these (see `added`).
"""

from __future__ import annotations

import json
from collections import deque
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.shared import cut, literal_table, unused

WEIGHTS = (1, 2, 3)
REPEATS = 3
SEED = "mix-1"
PLAN_ROWS = 50_000  # patterns whose plan is broadcast
ADDED = ("size", "source_size", "target", "taken")


def n_words(text: Column) -> Column:
    """Number of runs of other characters than ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def targets(sizes: dict, weights: tuple = WEIGHTS, repeats: int = REPEATS) -> dict:
    """Exact target of each source: a share by weight, at most repeats times its size."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(names)}
    left, open_, out = Fraction(sum(sizes.values())), set(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] >= repeats * sizes[s]}
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        for s in full:
            out[s] = Fraction(repeats * sizes[s])
            left -= out[s]
        open_ -= full
    return out


def min_cost_flow(patterns: dict, quotas: dict, repeats: int = REPEATS) -> dict:
    """Words from (pattern, source), most words at least cost.

    patterns: {tuple of sources: words}; quotas: {source: words}. The graph is start - pattern -
    source - end. Copy c of a pattern costs c, whichever way it goes, so all paths of one cost are the
    ones over the c-th copies: the primal-dual method has one phase a copy, each a maximum flow by
    levels and blocking flows on the residual graph of the phase before.
    """
    names, places = list(patterns), list(quotas)
    spot = {s: 2 + len(names) + i for i, s in enumerate(places)}
    graph: list[list[int]] = [[] for _ in range(2 + len(names) + len(places))]
    to: list[int] = []
    room: list[int] = []

    def arc(a: int, b: int, capacity: int) -> int:
        for x, y, c in ((a, b, capacity), (b, a, 0)):
            graph[x].append(len(to))
            to.append(y)
            room.append(c)
        return len(to) - 2

    starts = [arc(0, 2 + i, 0) for i in range(len(names))]
    flows = {(p, s): arc(2 + i, spot[s], repeats * patterns[p]) for i, p in enumerate(names) for s in p}
    for s in places:
        arc(spot[s], 1, quotas[s])
    for _ in range(repeats):
        for e, p in zip(starts, names):
            room[e] += patterns[p]
        while True:
            level = [-1] * len(graph)
            level[0], queue = 0, deque([0])
            while queue:
                a = queue.popleft()
                for e in graph[a]:
                    if room[e] and level[to[e]] < 0:
                        level[to[e]] = level[a] + 1
                        queue.append(to[e])
            if level[1] < 0:
                break
            tried, path, a = [0] * len(graph), [], 0
            while True:
                if a == 1:  # as much as the path holds, and back to its first full arc
                    amount = min(room[e] for e in path)
                    for e in path:
                        room[e] -= amount
                        room[e ^ 1] += amount
                    full = next(i for i, e in enumerate(path) if not room[e])
                    a = to[path[full] ^ 1]
                    del path[full:]
                    continue
                while tried[a] < len(graph[a]):
                    e = graph[a][tried[a]]
                    if room[e] and level[to[e]] == level[a] + 1:
                        break
                    tried[a] += 1
                if tried[a] < len(graph[a]):
                    path.append(graph[a][tried[a]])
                    a = to[path[-1]]
                elif path:
                    a = to[path.pop() ^ 1]
                    tried[a] += 1
                else:
                    break
    return {k: room[e ^ 1] for k, e in flows.items() if room[e ^ 1]}


def added(docs: DataFrame) -> dict[str, str]:
    """What the columns that mix adds are called."""
    return unused(docs.columns, ADDED)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """docs' rows and columns, and _size, _source_size, _target, _taken.

    source_col: a string, or an array of strings for documents of several sources (then _source_size
    and _target are those of the pattern's first source; sums of _taken by flow meet all quotas).
    """
    spark, names = docs.sparkSession, added(docs)
    many = dict(docs.dtypes)[source_col].startswith("array")
    nothing = F.array(F.lit(None).cast("string"))
    members = F.when(F.size(source_col) > 0, F.array_sort(F.array_distinct(source_col))).otherwise(nothing) if many else F.array(F.col(source_col).cast("string"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    tie = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.to_json(members, {"ignoreNullFields": "false"}).alias("pattern"), key.alias("key"), tie.alias("tie"), n_words(F.col(text_col)).alias("size"))
    # Texts are read once for the plan; what it needs of them is some bytes a row.
    slim = cut(rows.select("pattern", "key", "tie", "size"), "mix").withColumn("bucket", F.substring("key", 1, 3))
    # By hash bucket first: a source with a third of the rows is spread over 4096 groups.
    by_bucket = cut(slim.groupBy("pattern", "bucket").agg(F.sum("size").alias("words")), "mix-sums")
    words = {r["pattern"]: int(r["words"]) for r in by_bucket.groupBy("pattern").agg(F.sum("words").alias("words")).collect()}  # one row a pattern
    own = {p: tuple(json.loads(p)) for p in words}
    sizes: dict = {}
    for p, n in words.items():
        for s in own[p]:
            sizes[s] = sizes.get(s, 0) + n
    goal = targets(sizes, weights, repeats)
    flow = min_cost_flow({own[p]: n for p, n in words.items()}, {s: round(q) for s, q in goal.items()}, repeats)
    plan = []
    for p, n in words.items():
        given = sum(flow.get((own[p], s), 0) for s in own[p])
        first = min(own[p], key=lambda s: (s is None, s or ""))
        plan.append((p, sizes[first], float(goal[first]), given // n if n else 0, given % n if n else 0))
    small = F.broadcast if len(plan) <= PLAN_ROWS else lambda df: df
    schema = "pattern string, source_size long, target double, passes long, rest long"
    asked = small(literal_table(spark, plan, schema))
    # The document at which each pattern's rest ends: first its bucket, then its place within.
    order = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = by_bucket.withColumn("upto", F.sum("words").over(order)).join(asked, "pattern").where("upto > rest and upto - words <= rest")
    ends = ends.select("pattern", "bucket", (F.col("rest") - F.col("upto") + F.col("words")).alias("left"))  # one row a pattern
    edge = slim.join(small(ends), ["pattern", "bucket"]).groupBy("pattern", "left", "key", "tie").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    order = Window.partitionBy("pattern").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("upto", F.sum(F.col("n") * F.col("size")).over(order)).where("upto > left and upto - n * size <= left")
    part = ((F.col("left") - F.col("upto")) / F.col("n") + F.col("size")).cast("long")  # equal rows share what is left
    last = {r["pattern"]: r for r in edge.select("pattern", "key", "tie", part.alias("part")).collect()}  # one row a pattern
    plan = [(*row, *((last[row[0]]["key"], last[row[0]]["tie"], last[row[0]]["part"]) if row[0] in last else ("", "", 0))) for row in plan]
    full = small(literal_table(spark, plan, f"{schema}, end string, end_tie string, part long").drop("rest"))
    out = rows.join(full, "pattern")
    at = F.when(F.col("key") == F.col("end"), F.when(F.col("tie") < F.col("end_tie"), F.col("size")).when(F.col("tie") == F.col("end_tie"), F.col("part")))
    more = F.coalesce(at, F.when(F.col("key") < F.col("end"), F.col("size")), F.lit(0))
    out = out.withColumn("taken", F.col("passes") * F.col("size") + more)
    return out.select("row.*", *[F.col(n).alias(names[n]) for n in ADDED])
