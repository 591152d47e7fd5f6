import pickle
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark import cloudpickle

from tessella.llm import pieces, queries

TEXTS = ["", " ", "  a", "Hello  world\n\n é\t x ", "日本語 and ελληνικά", "▁ own mark ▁▁x", "a￾b", "￿ ﷐x\U0001fffe ", "🦊" * 3 + " ​", "x" * 500, "ab " * 20000, "\x00\x01 \x7f", "a\r\nb", "<s> </s> <0x0A>", "�", "é" * 200, " ▁ ", "x² m³"]


@pytest.fixture(scope="module")
def model():
    return pieces.load()


def slow(p, text, salt=0):
    """The agenda by its definition, chunk by chunk: all adjacent pairs are looked at for each merge."""
    codes = (" " if p.prefix and text else "") + text
    cut = pieces.borders(p.kinds[np.array([ord(c) for c in codes], np.int64)]) if codes else []
    starts = [i for i, x in enumerate(cut) if x] + [len(codes)]
    place = pieces.mix(np.arange(len(starts) - 1, dtype=np.uint64) * pieces.PLACE + np.uint64(salt))
    place = pieces.mix(place ^ pieces.mix(np.array([p.seed], np.uint64)))
    out = []
    for key, a, b in zip(place.tolist(), starts, starts[1:]):
        symbols = [(i, c if codes[a:b] == "▁" else c.replace(" ", "▁")) for i, c in enumerate(codes[a:b])]
        while True:
            best = None
            for k in range(len(symbols) - 1):
                (at, x), (_, y) = symbols[k : k + 2]
                score = p.scores.get(x + y)
                if score is not None and not (p.limit and p.skipped(key, at, p.ids[x + y])) and (best is None or score > best[0]):
                    best = score, k
            if best is None:
                break
            k = best[1]
            symbols[k : k + 2] = [(symbols[k][0], symbols[k][1] + symbols[k + 1][1])]
        own = codes[a:b] == "▁"
        out += [x for _, s in symbols for x in ([p.ids[s]] if s in p.ids and not own else [p.byte[c] for c in s.encode()])]
    return out


def test_without_dropout_it_is_the_models_own_encoding(model):
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    p = pieces.Pieces(model, 0.0)
    rng = random.Random(1)
    texts = [t for t in TEXTS if "▁" not in t and "\x00" not in t and "<" not in t] + ["".join(rng.choice("abcde éthnr\n  ,.T") for _ in range(rng.randint(1, 300))) for _ in range(300)]
    for t in texts:
        assert p.encode(t) == sp.encode(t), t


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 1.0])
def test_every_segmentation_decodes_to_its_text(model, rate):
    p = pieces.Pieces(model, rate)
    rng = random.Random(2)
    every = ["".join(chr(c) for c in range(lo, lo + 2048) if not 0xD800 <= c < 0xE000) for lo in range(0, 0x110000, 2048 * 17)]
    marks = ["".join(chr(0xFFFE + 0x10000 * plane + i) + "a " for i in (0, 1)) for plane in range(17)]
    for t in [*TEXTS, *every, *marks, *("".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0xD7FF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(80)) for _ in range(100))]:
        assert p.decode(p.encode(t, 7)) == t


@pytest.mark.parametrize("rate,deep", [(0.1, 6), (0.1, 0), (0.5, 2), (0.5, 6), (1.0, 3)])
def test_equals_the_agenda_by_definition(model, monkeypatch, rate, deep):
    monkeypatch.setattr(pieces, "DEEP", deep)
    p, rng = pieces.Pieces(model, rate), random.Random(4)
    words = ["the", "internationalisation", "a" * 30, "日🦊x", "b" * 50, "ab" * 60, "x", "▁", "é", "½"] + ["".join(rng.choice("etaoinsrh") for _ in range(rng.randint(1, 20))) for _ in range(40)]
    texts = [t for t in TEXTS if len(t) < 600] + ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", ",", ""]) for _ in range(60)) for _ in range(15)]
    for _ in range(2):  # new and remembered
        ids, begins = p.encode_many(pa.array(texts), list(range(len(texts))))
        assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:])] == [slow(p, t, i) for i, t in enumerate(texts)]


def test_a_small_tree_and_long_texts_in_parts_change_nothing(model, monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choice(["the ", "  words", " é", "\n", "internationalisation ", "▁", "a"]) for _ in range(3000))
    p = pieces.Pieces(model)
    want = p.encode(text, 3)
    monkeypatch.setattr(pieces, "RUN", 100)
    monkeypatch.setattr(pieces, "KEPT", 20)
    assert pieces.Pieces(model).encode(text, 3) == want == slow(p, text, 3)
    assert pieces.Pieces(model).encode(" " * 5000, 3) == p.encode(" " * 5000, 3)


def test_tables_travel(model):
    p = pieces.Pieces(model, 0.3)
    other = pickle.loads(cloudpickle.dumps(p))
    assert other.encode("internationalisation of words", 5) == p.encode("internationalisation of words", 5)


def test_each_place_draws_its_own_segmentation(model):
    p, rng = pieces.Pieces(model), random.Random(6)
    n = 20000
    for word in ("the", "words", "reading"):
        ids, begins = p.encode_many(pa.array([word] * n), list(range(n)))
        got = Counter(tuple(ids[a:b].tolist()) for a, b in zip(begins, begins[1:]))
        free = pieces.Pieces(model)
        free.skipped = lambda *_: rng.random() < pieces.DROPOUT
        want = Counter(tuple(free.merge(" " + word)) for _ in range(n))
        assert len(got) > 1 and all(abs(got[x] - want[x]) < 400 for x in {*got, *want})
    long, begins = p.encode_many(pa.array(["internationalisation " * 2000]), [1])
    assert len(long) > len(pieces.Pieces(model, 0.0).encode("internationalisation " * 2000))
    assert len({tuple(x) for x in np.lib.stride_tricks.sliding_window_view(long, 8).tolist()}) > 1000


def test_frames_and_query(spark, sf):
    rows = [(i if i else None, t, "c", "d") for i, t in enumerate([*TEXTS, None, "same", "same"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string")
    both = pieces.decode(pieces.encode(df)).collect()
    once = pieces.encode(df, decoded="decoded").collect()
    assert [(r["doc_id"], r["decoded"]) for r in both] == [(r[0], r[1]) for r in rows] and both[0]["ids"] == [] and both[-3]["ids"] is None
    assert sorted(map(str, both)) == sorted(map(str, once))
    assert pieces.digests(df.limit(0)).collect() == [] and pieces.encode(df.limit(0)).collect() == []
    assert all(r["lossless"] for r in pieces.digests(df).collect())
    got = queries.op8_pieces(spark, sf).collect()
    assert all(r["lossless"] for r in got) and len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_query_equals_the_definition(spark, sf):
    import hashlib

    p = pieces.Pieces(pieces.load())
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r["ids_sha256"] for r in queries.op8_pieces(spark, sf).collect()}
    short = sorted(docs, key=lambda i: len(docs[i]))[:60]
    assert {i: hashlib.sha256(np.array(slow(p, docs[i], p.salt(i)), "<i4").tobytes()).hexdigest() for i in short} == {i: got[i] for i in short}
