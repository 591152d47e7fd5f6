import numpy as np
import pytest

from tessella.llm import neighbours, queries

SCHEMA = "vec_id long, embedding array<float>, key string, score string"


def brute(rows, k, every):
    ok = [(i, np.array(v, np.float64)) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v)) and len(v) == 8]
    ids, x = np.array([i for i, _ in ok]), np.array([v for _, v in ok])
    out = {}
    for i, v in ok:
        if i % every == 0:
            s = (v * x).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), s[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


ALL = (1, 1, 16)  # all buckets of vectors of length 8


@pytest.mark.parametrize("lengths", [True, False])
def test_with_all_buckets_probed_it_is_exact(spark, lengths):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    if not lengths:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(v) for v in x[i % 200]], "", "") for i in range(300)]
    rows += [(400, None, "", ""), (420, [0.0] * 8, "", ""), (440, [1.0] * 7 + [None], "", ""), (460, [float("nan")] * 8, "", ""), (480, [float("inf")] * 8, "", ""), (500, [1.0] * 3, "", ""), (None, [1.0] * 8, "", ""), (520, [], "", "")]
    got, want = found(neighbours.nearest(spark.createDataFrame(rows, SCHEMA), plan=ALL)), brute(rows, 20, 20)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-15) for q in want)


def test_vectors_of_several_lengths_and_of_integers(spark):
    rng = np.random.default_rng(12)
    rows = [(i, [int(v) for v in rng.integers(-9, 9, size=8 if i % 3 else 5)]) for i in range(200)]
    rows = [r for r in rows if any(r[1])]
    got = found(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<int>"), every=5))
    for q, v in rows:
        if q % 5 == 0:
            own = [(i, float(np.dot(v, w))) for i, w in rows if len(w) == len(v) and i != q]
            want = sorted(own, key=lambda r: (-r[1], r[0]))[:20]
            assert len(got[q]) == 20 and len({i for i, _ in want} & {i for i, _ in got[q]}) >= 16
            assert all((i, s) in own for i, s in got[q])


def test_all_tied_products_go_to_smaller_ids(spark):
    rows = [(200, [1.0, 0.0])] + [(600 + i, [1.0, float(i)]) for i in range(1, 400)]
    got = found(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=200))
    assert got[200] == [(i, 1.0) for i in range(601, 621)]


def test_cells_split_and_few_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_QUERIES", 3)
    monkeypatch.setattr(neighbours, "CELL_VECTORS", 10)
    monkeypatch.setattr(neighbours, "CHUNK", 7)
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=8).astype(np.float32)], "", "") for i in range(150)]
    assert {q: [i for i, _ in v] for q, v in found(neighbours.nearest(spark.createDataFrame(rows, SCHEMA), every=5, plan=ALL)).items()} == {q: [i for i, _ in v] for q, v in brute(rows, 20, 5).items()}
    few = found(neighbours.nearest(spark.createDataFrame(rows[:4], SCHEMA)))
    assert {q: len(v) for q, v in few.items()} == {0: 3}
    same = [(i, [1.0] * 8, "", "") for i in range(90)]
    assert found(neighbours.nearest(spark.createDataFrame(same, SCHEMA)))[0] == [(i, 8.0) for i in range(1, 21)]
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA)).collect() == []


def recall(got, want):
    pairs = [(len({i for i, _ in want[q]} & {i for i, _ in got[q]}), len(want[q])) for q in want]
    return sum(a for a, _ in pairs) / sum(b for _, b in pairs)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    got = found(queries.op10_neighbours(spark, f"/root/testdata/{sf}"))
    x, ids = np.array([v for _, v in rows], np.float64), np.array([i for i, _ in rows])
    want = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = (x * x[q]).sum(axis=1)
        want[ids[q]] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s)) if j != q][:20]
    assert all(len(got[q]) == 20 for q in want) and recall(got, want) >= 0.93
    assert all((i, s) in zip(ids.tolist(), (x * x[ids == q][0]).sum(axis=1).tolist()) for q in [*want][:3] for i, s in got[q])


@pytest.mark.parametrize("norms", ["spread", "one large", "clusters"])
def test_recall_of_other_directions_and_norms(spark, norms):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 32))
    if norms == "clusters":
        x = 0.3 * x + rng.normal(size=(60, 32))[rng.integers(0, 60, size=6000)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms == "spread":
        x *= np.exp(0.3 * rng.normal(size=(6000, 1)))
    elif norms == "one large":
        x[1234] *= 10
    rows = [(i, [float(v) for v in y], "", "") for i, y in enumerate(x.astype(np.float32))]
    x, every = np.array([r[1] for r in rows]), 50
    want = {q: [(int(j), 0.0) for j in np.argsort(-(x @ x[q]), kind="stable") if j != q][:20] for q in range(0, 6000, every)}
    got = found(neighbours.nearest(spark.createDataFrame(rows, SCHEMA), every=every))
    assert recall(got, want) >= 0.93


def test_plans_hold_the_recall_they_name():
    for dim, n, queries_ in ((64, 500, 25), (64, 50_000, 2500), (16, 4000, 10)):
        parts, tables, probes = neighbours.planned(dim, n, 20, queries_)
        cosine = -neighbours.NormalDist().inv_cdf(20 / n) / dim**0.5
        chance = neighbours.found_chance(dim, round(cosine, 2), parts, probes)[-1]
        assert 1 - (1 - chance) ** tables >= neighbours.RECALL
    assert neighbours.planned(64, 20, 20, 1) == (1, 1, 128)


def test_queries_that_find_too_few_are_completed(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(v) for v in y], "", "") for i, y in enumerate(x.astype(np.float32))]
    got, want = found(neighbours.nearest(spark.createDataFrame(rows, SCHEMA), every=5, plan=(1, 1, 1))), brute(rows, 20, 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


@pytest.mark.parametrize("ties", [1 << 17, 50])
def test_ties_at_the_boundary_go_to_smaller_ids(spark, monkeypatch, ties):
    monkeypatch.setattr(neighbours, "TIES", ties)
    rng = np.random.default_rng(6)
    x = np.unique(rng.integers(0, 2, size=(400, 8)), axis=0)
    x = rng.permutation(x[x.any(axis=1)])  # different binary vectors, many of equal inner product
    rows = [(i, [float(v) for v in y], "", "") for i, y in enumerate(x)]
    got, want = found(neighbours.nearest(spark.createDataFrame(rows, SCHEMA), every=5, plan=ALL)), brute(rows, 20, 5)
    assert got == want
    q, y = rng.integers(0, 2, size=(30, 8)).astype(float), x.astype(float)
    lows = rng.permutation(len(y))
    score, _, low = neighbours.k_best(q, lows, lows, y, 5)
    for i in range(len(q)):
        assert low[i].tolist() == lows[np.lexsort((lows, -(y @ q[i])))[:5]].tolist()


def test_few_rows_and_equal_vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(v) for v in y], "", "") for i, y in enumerate(x.astype(np.float32))]
    few = found(neighbours.nearest(spark.createDataFrame(rows[:4], SCHEMA)))
    assert {q: [i for i, _ in v] for q, v in few.items()} == {q: [i for i, _ in v] for q, v in brute(rows[:4], 20, 20).items()}
    same = [(i, [1.0] * 8, "", "") for i in range(90)]
    assert found(neighbours.nearest(spark.createDataFrame(same, SCHEMA)))[0] == [(i, 8.0) for i in range(1, 21)]
