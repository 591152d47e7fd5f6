import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline  # noqa: E402
from test_line_dedup import brute_with_short as line_brute  # noqa: E402
from test_near_dedup import brute as near_brute  # noqa: E402

from tessella.llm import line_dedup, mixing, near_dedup, pieces  # noqa: E402


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages, seen = [f for _, f in corpus_pipeline.STAGES], [docs]
    for f in stages:
        seen.append(f(spark, seen[-1], sf).cache())
        seen[-1].count()
    assert all(x.columns == docs.columns for x in seen[:-1])
    rows = [{r["doc_id"]: r for r in x.collect()} for x in seen[:4]]
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    marked = [i for i in rows[0] if i in marks]
    assert sum((i in rows[1]) == bool(marks[i]) for i in marked) >= 0.95 * len(marked)
    texts = line_brute([(i, r["text"]) for i, r in rows[1].items()], line_dedup.THRESHOLD, line_dedup.MIN_BYTES)
    assert {i: t for i, t in texts.items() if t.strip() or t == rows[1][i]["text"]} == {i: r["text"] for i, r in rows[2].items()}
    assert all(r["n_chars"] == len(r["text"]) for r in rows[2].values())
    assert sorted(rows[3]) == [r[0] for r in near_brute([(i, r["text"]) for i, r in rows[2].items()], corpus_pipeline.NEAR_PERCENT) if r[3]]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes, largest, taken = {}, {}, {}
    for r in rows[3].values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + words(r["text"])
        largest[r["source"]] = max(words(r["text"]), largest.get(r["source"], 0))
    goal = mixing.targets(sizes)
    for r in seen[4].collect():
        taken[r["source"]] = taken.get(r["source"], 0) + words(r["text"])
    assert all(abs(taken.get(s, 0) - goal[s]) <= largest[s] / 2 + 1 for s in goal)
    p = pieces.Pieces(pieces.load())
    assert all(p.decode(r["ids"]) == r["text"] and len(r["ids"]) == r["n_pieces"] for r in seen[5].collect())
    assert {(r["doc_id"], r["text"]) for r in seen[5].collect()} == {(r["doc_id"], r["text"]) for r in seen[4].collect()}


def test_odd_rows_and_an_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    long = "A line of words that is long enough to be compared with others."
    own = ("ids", "_score", "_size", "_taken", "_n", "_copies", "_line_n", "_row_number", "row", "pattern", "gone")
    rows = [(1, long, "en", "a", 3), (1, long, "en", "a", 3), (None, "null id", None, None, None), (4, None, "en", "b", 0), (5, "", "en", "b", 0), (2, "spam spam", "en", "a", 1)]
    df = spark.createDataFrame([(*r, *(f"{c} {r[0]}" for c in own)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in own))
    for docs in (df, df.limit(0)):
        for _, f in corpus_pipeline.STAGES[:-1]:
            docs = f(spark, docs, str(tmp_path))
            assert docs.columns == df.columns
        got = docs.collect()
        assert all(r[c] == f"{c} {r['doc_id']}" for r in got for c in own)
        last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert sorted(str(r["text"]) for r in last) == sorted(str(r["text"]) for r in got)


def test_documents_without_words_and_ties(spark, sf):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate([None, "", " \n", "one two three", "one two three", "x y"])], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_repeated_lines(spark, docs, sf).collect()) == [0, 1, 2, 3, 5]
    assert sorted(r["doc_id"] for r in corpus_pipeline.keep_one_of_each_group(spark, docs, sf).collect()) == [0, 1, 2, 3, 5]
    assert sorted({r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, sf).collect()}) == [3, 4, 5]


def test_near_duplicates_from_similarity_80(spark, sf):
    def text(name, own):  # 100 shingles, `own` of them its own
        return " ".join([f"{name}{i}" for i in range(104 - own)] + [f"{name}own{own}x{i}" for i in range(own)])

    rows = [(1, text("a", 0)), (2, text("a", 10)), (3, text("b", 0)), (4, text("b", 13)), (5, text("c", 0)), (6, text("c", 5))]  # 90/110, 87/113, 95/105
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.keep_one_of_each_group(spark, docs, sf).collect()) == [1, 3, 4, 5]


def test_bands_and_margin_hold_recall_at_80():
    bands, rows, percent = corpus_pipeline.NEAR_BANDS, corpus_pipeline.NEAR_ROWS, corpus_pipeline.NEAR_PERCENT
    assert percent == 80 and (1 - near_dedup.agreement(percent) ** rows) ** bands < 2e-6
    assert near_dedup.margin(percent, bands * rows) > near_dedup.margin(85, 224) == near_dedup.MARGIN


def test_a_run_keeps_one_scratch_table(spark, sf):
    from tessella.llm.shared import held

    before = held()
    out = corpus_pipeline.run(spark, sf)
    rows = out.collect()
    assert rows and out.columns == ["doc_id", "source", "n_pieces", "ids", "text"] and len(held() - before) == 1
    assert all(len(r["ids"]) == r["n_pieces"] for r in rows)
