import random
import re

from tessella.llm import licenses, queries

SCHEMA = "doc_id long, text string, score string, labels string"


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [p for p, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_places_equal_brute_force(spark):
    rng = random.Random(3)
    pool = "gnu general public license apache cc by mit MIT License. é the of-x".split()
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 200))) for _ in range(60)]
    texts += [None, "", "cc", "cc by", "CC-BY 4.0", "the GNU General\nPublic License!", "mit license", "apache license " * 5000, "cc by", "cc by"]
    rows = [(None if i == 3 else i, t, "", "") for i, t in enumerate(texts)]
    got = licenses.scan(spark.createDataFrame([*rows, rows[0], (5, "mit license", "", "")], SCHEMA)).collect()
    want = sorted([(r[0], *brute(r[1])) for r in [*rows, rows[0], (5, "mit license", "", "")]], key=str)
    assert sorted([(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got], key=str) == want
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_bodies_are_found_with_insertions(spark):
    body = licenses.BODIES[3][1].split()
    edited = body[:9] + ["really"] + body[9:17] + body[18:]
    texts = ["x y " * 40 + " ".join(edited) + " z", " ".join(body[:6]), " ".join(random.Random(1).sample(body, len(body)))]
    got = licenses.scan(spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], SCHEMA)).orderBy("doc_id").collect()
    assert [r["labels"] for r in got] == ["mit", "", ""] and got[0]["score"] >= 0.5 and got[0]["n_base"] == 0


def test_positions_that_several_diagonals_hold_count_once(spark):
    body = licenses.plain_words(licenses.BODIES[3][1])
    part = body[: len(body) // 3]
    texts = [" ".join(part + ["x"] + part[2:] + ["y"] + part[1:]), licenses.BODIES[2][1], licenses.BODIES[8][1].replace(",", "\n")]
    got = licenses.scan(spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], SCHEMA)).orderBy("doc_id").collect()
    assert [(r["labels"], r["score"]) for r in got] == [("", 0.0), ("mit", 1.0), ("bsd", 1.0)]


def test_query_on_small_tables(spark, sf):
    got = queries.op4_licenses(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == sorted((i, *brute(t)) for i, t in texts.items())
    plan = queries.op4_licenses(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
