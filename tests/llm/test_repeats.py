import hashlib
import random
from collections import Counter

import pytest

from tessella.llm import queries, repeats

SCHEMA = "doc_id long, text string, d string, h string"


def brute(rows, least=200):
    raw = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i : i + least] for t in raw for i in range(len(t) - least + 1))
    out = []
    for r, t in zip(rows, raw):
        mark = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                mark[i : i + least] = b"\1" * least
        kept = bytes(x for x, m in zip(t, mark) if not m)
        n = sum(1 for p, m in zip(b"\0" + mark, mark) if m and not p)
        out.append((r[0], len(t), sum(mark), n, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts(seed):
    rng = random.Random(seed)
    body = lambda n: "".join(rng.choice("abc é") for _ in range(n))
    shared = [body(n) for n in (150, 199, 200, 201, 260, 900)]
    out = []
    for _ in range(70):
        parts = [rng.choice(shared)[rng.choice([0, 0, 3, 40]) :] if rng.random() < 0.6 else body(rng.randint(0, 300)) for _ in range(rng.randint(1, 5))]
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("largest,gram", [(repeats.LARGEST, repeats.GRAM), (2, repeats.GRAM), (5, repeats.GRAM), (20_000, 40), (2, 40)])
def test_same_bytes_as_brute_force(spark, largest, gram, monkeypatch):
    monkeypatch.setattr(repeats.marked, "__defaults__", (200, gram, largest))
    odd = [None, "", "a" * 199, "b" * 200, "c" * 201, "c" * 1000, "xyz" * 200, "long " * 9000, texts(1)[0], texts(1)[0], "ab" * 150 + "q", "é" * 400]
    rows = [(i if i % 9 else None, t, "", "") for i, t in enumerate([*texts(largest), *odd])]
    got = repeats.digests(spark.createDataFrame([*rows, rows[3]], SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == brute([*rows, rows[3]])


def test_interval_tree_gives_all_maximal_repeats():
    rng = random.Random(4)
    for _ in range(200):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randint(2, 24)))
        at = range(len(text))
        got = {}
        for left, right, places in repeats.maximal_repeats([text[i:] for i in at], [text[:i][::-1] for i in at], 3):
            for i in places:
                got.setdefault(i, set()).update(range(i - left, i + right))
        want = set()
        for i in range(len(text) - 2):
            if any(text[j : j + 3] == text[i : i + 3] for j in range(len(text) - 2) if j != i):
                want |= set(range(i, i + 3))
        assert set().union(*got.values(), set()) == want


def test_every_maximal_repeat_with_all_its_places():
    rng = random.Random(9)
    for _ in range(200):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randint(2, 20)))
        at, n = range(len(text)), len(text)
        got = {(left, right, tuple(sorted(places))) for left, right, places in repeats.maximal_repeats([text[i:] for i in at], [text[:i][::-1] for i in at], 3, every=True)}
        want = set()
        for left in range(n):
            for right in range(max(0, 3 - left), n + 1):
                by = {}
                for i in at:
                    if i >= left and i + right <= n:
                        by.setdefault(text[i - left : i + right], []).append(i)
                for places in by.values():
                    ahead = {text[i - left - 1 : i - left] if i > left else i for i in places}
                    behind = {text[i + right : i + right + 1] or i for i in places}
                    if len(places) > 1 and len(ahead) > 1 and len(behind) > 1:
                        want.add((left, right, tuple(places)))
        assert got == want


def test_groups_have_all_places(spark):
    rng = random.Random(3)
    body = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    one, two = body(250), body(420)
    texts_ = [body(40) + one + body(30), one + body(90), body(7) + two, two + two[:250], body(300), two, two, None, ""]
    rows = [(i, t, "", "") for i, t in enumerate(texts_)]
    raw = {i: (t or "").encode() for i, t, *_ in rows}
    for largest in (repeats.LARGEST, 1):
        got = repeats.repeat_groups(spark.createDataFrame(rows, SCHEMA), largest=largest).collect()
        by = {}
        for r in got:
            by.setdefault(r["group"], set()).add((raw[r["doc_id"]][r["start"] : r["start"] + r["length"]], r["doc_id"], r["start"]))
        for places in by.values():
            assert len({p[0] for p in places}) == 1 and len(next(iter(places))[0]) >= 200
            what = next(iter(places))[0]
            everywhere = {(i, k) for i, t in raw.items() for k in range(len(t) - len(what) + 1) if t[k : k + len(what)] == what}
            assert {p[1:] for p in places} <= everywhere and len(places) > 1
        marks = {i: bytearray(len(t)) for i, t in raw.items()}
        for r in got:
            marks[r["doc_id"]][r["start"] : r["start"] + r["length"]] = b"\1" * r["length"]
        assert sorted((i, sum(m)) for i, m in marks.items()) == sorted((r[0], r[2]) for r in brute(rows))
        if largest > 1:
            full = [places for places in by.values() if next(iter(places))[0] in one.encode()]
            assert any({p[1] for p in places} == {0, 1} for places in full)


def test_spans_and_empty_tables(spark):
    t = "".join(random.Random(1).choice("abcdef") for _ in range(300))
    df = spark.createDataFrame([(1, "x" + t, "", ""), (2, t + "yy", "", ""), (3, "z", "", "")], SCHEMA)
    assert sorted(map(tuple, repeats.repeated_spans(df).collect())) == [(1, 1, 301), (2, 0, 300)]
    assert repeats.digests(df.limit(0)).collect() == [] and repeats.repeat_groups(df.limit(0)).collect() == []


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op3_repeats(spark, sf).collect()), key=str) == brute(rows)
