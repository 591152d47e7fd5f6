import hashlib
import random

import pytest

from tessella.llm import line_dedup, queries

SCHEMA = "doc_id long, text string, line string, gid string"


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j] + (x != y), p[j + 1] + 1, q[-1] + 1))
        p = q
    return p[-1]


def near(a, b, most):
    if abs(len(a) - len(b)) > most or sum(abs(a.count(c) - b.count(c)) for c in {*a, *b}) > 2 * most:
        return False
    return len(a) > 500 or edits(a, b) <= most  # the long ones of these tests differ by a byte


def brute(rows, threshold, least):
    """Texts after dedup, for rows with different ids."""
    where = {}
    for i, t, *_ in rows:
        for no, line in enumerate((t or "").encode().split(b"\n")):
            if len(line) >= least:
                where.setdefault(line, (i, no))
                where[line] = min(where[line], (i, no))
    lines = sorted(where)
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(lines):
        for b in lines[:k]:
            if near(a, b, threshold):
                root[find(a)] = find(b)
    first = {}
    for x in lines:
        first[find(x)] = min(first.get(find(x), where[x]), where[x])
    out = {}
    for i, t, *_ in rows:
        if t is None:
            out[i] = None
            continue
        kept, seen = [], set()
        for no, line in enumerate(t.encode().split(b"\n")):
            if len(line) >= least:
                if line in seen:
                    continue
                seen.add(line)
                if first[find(line)] != (i, no):
                    continue
            kept.append(line)
        out[i] = b"\n".join(kept).decode()
    return out


def texts(seed, n=60):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(6, 40))) for _ in range(40)]

    def line():
        s = list(rng.choice(pool))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            k = rng.randrange(3)
            if k and s:
                s[rng.randrange(len(s))] = rng.choice("abxyz")
            elif s:
                del s[rng.randrange(len(s))]
            if not k:
                s.insert(rng.randint(0, len(s)), "q")
        return "".join(s)

    return ["\n".join(line() for _ in range(rng.randint(1, 8))) for _ in range(n)]


@pytest.mark.parametrize("threshold,block", [(2, 2048), (1, 3), (3, 4)])
def test_same_as_brute_force(spark, monkeypatch, threshold, block):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rows = [(i * 7 % 1009, t, "", "") for i, t in enumerate([*texts(threshold), None, "", "\n\n", "x" * 20000, "x" * 20001, "a\nb\na"])]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA), threshold=threshold, min_bytes=8, exact_bytes=8).collect()
    assert {r["doc_id"]: r["text"] for r in got} == brute(rows, threshold, 8) and len(got) == len(rows)


def test_edit_distance():
    rng = random.Random(5)
    for _ in range(3000):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12)))
        b = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12)))
        for most in (0, 1, 2, 4):
            assert line_dedup.distance(a, b, most) == min(edits(a, b), most + 1)


def test_null_and_repeated_ids_and_empty_tables(spark):
    line = "a line that is long enough to count, at least thirty-two bytes"
    rows = [(None, line, "", ""), (5, line + "!", "", ""), (5, line + "!", "", ""), (5, "other\n" + line, "", ""), (6, f"{line}?\nshort\nshort", "", "")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted([("None", line), ("5", ""), ("5", ""), ("5", "other"), ("6", "short")])
    own = line_dedup.dedup_lines(spark.createDataFrame(rows[1:3], SCHEMA)).collect()
    assert [r["text"] for r in own] == [line + "!"] * 2
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []
    clash = [(1, line, "a", "b"), (2, line, "c", "d")]
    out = line_dedup.dedup_lines(spark.createDataFrame(clash, "doc_id long, text string, _line_n string, _Line_Removed string")).orderBy("doc_id").collect()
    assert [tuple(r) for r in out] == [(1, line, "a", "b", 1, 0), (2, "", "c", "d", 1, 1)]


def brute_with_short(rows, threshold, least):
    """The same, and of equal lines under `least` bytes that are not blank the first alone."""
    seen, out = set(), {}
    for i, t in sorted(brute(rows, threshold, least).items()):
        kept = []
        for line in (t or "").split("\n"):
            if len(line.encode()) < least and line.strip(" \t\r\x0b\x0c"):
                if line in seen:
                    continue
                seen.add(line)
            kept.append(line)
        out[i] = None if t is None else "\n".join(kept)
    return out


def test_equal_short_lines_go(spark):
    rows = [(i * 7 % 1009, t, "", "") for i, t in enumerate([*texts(7), None, "", "\n\n", "a\nb\na", " a\n \nb\n \n", "c\n\n\t\nc", "All rights reserved.\nx", "y\nAll rights reserved.", "z\nAll rights reserved?"])]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA), min_bytes=24, exact_bytes=1).collect()}
    assert got == brute_with_short(rows, 2, 24)
    assert sum((t or "").split("\n").count("All rights reserved.") for t in got.values()) == 1 and "z\nAll rights reserved?" in got.values()


def test_query_removes_equal_short_lines(spark, sf):
    got = {r["doc_id"]: r for r in queries.op7_line_dedup(spark, sf).collect()}
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_with_short(rows, line_dedup.THRESHOLD, line_dedup.MIN_BYTES)
    assert {i: r["kept_sha256"] for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
