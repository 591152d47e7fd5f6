import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import near_dedup
from tessella.llm.sketch import Sketcher, jaccard, merge
from tessella.llm.words import seeded

SCHEMA = "doc_id long, text string, n_shingles string, kept string"


def brute(rows, percent=85):
    sets = []
    for i, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted((r[0], len(sets[i]), low[find(i)], r[0] == low[find(i)]) for i, r in enumerate(rows))


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéTHN") for _ in range(rng.randint(1, 4)))
    out = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([3, 5, 40, 120, 300]))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    return [*out, None, "", " \n\t ", "one", "ONE", "x " * 30000, out[0], out[0]]


@pytest.mark.parametrize("block", [1024, 3])
def test_same_components_as_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = [(i * 7 % 1000, t, "clash", "clash") for i, t in enumerate(texts(block))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_empty_table_null_ids_and_repeated_rows(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "a b c d e f", None, None), (4, "a b c d e f", None, None), (4, "a b c d e f", None, None), (2, "A b c d e f", None, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 2, None, True), (4, 2, 2, False), (4, 2, 2, False), (2, 2, 2, True)], key=str)


def test_registers_merge_and_estimate():
    s, items = Sketcher(4096), seeded(3000, 9)
    a, b = items[:2000], items[500:]
    assert (merge(s(a), s(b)) == s(items)).all()
    got = jaccard(s(a)[None], s(b)[None], np.array([2000]), np.array([2500]))
    assert abs(got[0] - 0.5) < 0.04


def test_query_on_small_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = near_dedup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()
    rows = [(r[0], r[1]) for r in docs.select("doc_id", F.col("text")).collect()]
    assert sorted(map(tuple, got)) == brute(rows)


@pytest.mark.parametrize("letters", [1024, 2048, 4096])
def test_words_that_collide_under_polynomial_hashes_stay_apart(spark, letters):
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(letters))
    swapped = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, swapped), (3, word), (4, " ".join(word[i : i + 64] for i in range(0, letters, 64))), (5, " ".join(swapped[i : i + 64] for i in range(0, letters, 64)))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == sorted((r[0], r[2], r[3]) for r in brute(rows))


def test_ids_must_be_integers_and_may_repeat_with_other_texts(spark):
    with pytest.raises(TypeError):
        near_dedup.near_duplicates(spark.createDataFrame([("a", "x")], "doc_id string, text string"))
    base = " ".join(f"w{i}" for i in range(50))
    rows = [(1, base), (1, "another text"), (2, base + " more"), (3, "another text")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [(1, 1, 1), (1, 46, 1), (2, 47, 1), (3, 1, 1)]


def test_hashes_of_a_word_do_not_depend_on_what_stands_around_it():
    from tessella.llm.words import WordHasher

    rng, h = random.Random(3), WordHasher()
    words = ["".join(rng.choice("abcé\x00") for _ in range(n)) for n in range(1, 80)]
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    for family in (0, 1):
        whole = h.hashes(raw, *h.spans(raw, np.zeros(1, np.int64)), family)
        alone = [h.hashes(x := np.frombuffer(w.encode(), np.uint8), np.zeros(1, np.int64), np.array([len(x)]), family)[0] for w in words]
        assert whole.tolist() == [int(x) for x in alone] and len(set(whole.tolist())) == len(words)
