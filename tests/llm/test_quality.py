import zlib

import numpy as np

from tessella.llm import quality, queries

SCHEMA = "doc_id long, text string, score string, lang string"


def test_pairwise_ranking_learns_an_order():
    rng = np.random.default_rng(1)
    x = rng.random((400, len(quality.NAMES)))
    good = x[:, 3] + 0.01 * rng.random(400) > 0.4
    m = quality.fit(x, good)
    assert ((quality.score(x, m) >= 0.7) == good).mean() > 0.97
    assert 0 <= quality.score(x, m).min() <= quality.score(x, m).max() <= 1


def test_odd_rows_and_tables(spark):
    docs = spark.createDataFrame([(1, None, "s", None), (1, None, "s", None), (None, "", "s", "e"), (3, "Words of a text. " * 20000, None, None), (4, "x", "", ""), (5, "\x00 é  y", "", "")], SCHEMA)
    labels = spark.createDataFrame([(3, 1, 0), (1, 0, 0), (4, None, 0), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert {(r["doc_id"], r["held_out"]) for r in got if r["doc_id"]} == {(i, zlib.crc32(str(i).encode()) % 4 == 2) for i in (1, 3, 4, 5)}
    assert quality.classify(docs.limit(0), labels).collect() == []
    assert all(r["predicted"] == 1 for r in quality.classify(docs, labels.limit(0)).collect())
    assert quality.scored(docs, None).columns == ["doc_id", "text", "lang", "score"]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op2_quality(spark, sf).collect()}
    marks = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in marks if got[r["doc_id"]]["held_out"]]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.97
    again = {r["doc_id"]: r for r in queries.op2_quality(spark, sf).collect()}
    assert got == again
