"""Document quality by Bradley-Terry pairwise ranking.

A score is learned from preference pairs (a document marked good, one marked bad): logistic loss on
the difference of their feature vectors, so no intercept and no absolute target. The cut is a
quantile of the training documents' scores, the one that separates the marks best; scores are then
moved so that the cut stands at `threshold`.

Fitting reads a bounded sample (`max_rows` labelled rows, those with the smallest hash of their id)
as feature vectors; scoring is one pass over all texts without a shuffle. Features come from the
text alone.

Defined cases: null and empty texts have a feature vector of their own (all counts zero) and get a
score; a table without labels of both kinds gives every text the score `threshold` (all kept);
labels that are null, or of ids without a document, are not used; of several labels or texts for one
id each pair counts. Rows are scored one by one, so repeated rows and null ids get the same score as
any. Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import arrow, small_batches
from tessella.llm.words import WordHasher, runs, texts_of

MAX_ROWS = 20_000  # labelled rows that are used to fit, at most
PAIRS = 60_000  # preference pairs drawn from them
THRESHOLD = 0.7
NAMES = ["log_words", "mean_word", "distinct_words", "top_word", "distinct_pairs", "upper", "digit", "stop_marks", "other_marks", "markup", "high", "controls", "log_lines", "distinct_lines", "line_words", "deflate", "long_words", "short_words", "top_byte", "upper_start"]


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def byte_classes() -> np.ndarray:
    """upper, digit, sentence marks, other marks, markup, above 127, control."""
    t = np.zeros((256, 7), np.float64)
    t[65:91, 0] = 1
    t[48:58, 1] = 1
    t[[ord(c) for c in ".,;:?'\"-"], 2] = 1
    t[[ord(c) for c in "!$%&()*+/@#~^=_`"], 3] = 1
    t[[ord(c) for c in "<>{}[]|\\"], 4] = 1
    t[128:, 5] = 1
    t[:9, 6] = t[14:32, 6] = t[127, 6] = 1
    return t


def feature_rows(column: pa.Array) -> np.ndarray:
    """One row of features for each text."""
    hasher, classes = WordHasher(), byte_classes()
    off, raw = texts_of(column)
    out = np.zeros((len(column), len(NAMES)))
    up = raw_upper = np.zeros(256, bool)
    raw_upper[65:91] = True
    for lo, hi in runs(off):
        part, own = raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        if not len(part):
            continue
        a, b = hasher.spans(part, own[:-1])
        words, first = hasher.hashes(part, a, b), np.searchsorted(a, own)
        size, capital = b - a, up[part[a]]
        for i in range(hi - lo):
            w = words[first[i] : first[i + 1]]
            if not len(w):
                continue
            text, n, length = part[own[i] : own[i + 1]], len(w), size[first[i] : first[i + 1]]
            count = np.bincount(text, minlength=256)
            share = count @ classes / len(text)
            counts = np.unique(w, return_counts=True)[1]
            with np.errstate(over="ignore"):
                pairs = len(np.unique(w[1:] * np.uint64(3) + w[:-1])) / (n - 1) if n > 1 else 1.0
            body = text.tobytes()
            lines = body.split(b"\n")
            out[lo + i] = [
                np.log1p(n), min(length.mean(), 30) / 10, len(counts) / n, counts.max() / n, pairs, *share[:6], share[6],
                np.log1p(len(lines)), len(set(lines)) / len(lines), np.log1p(n / len(lines)), len(zlib.compress(body, 1)) / (len(body) + 20),
                (length > 15).mean(), (length < 3).mean(), count.max() / len(text), capital[first[i] : first[i + 1]].mean(),
            ]
    return out


def expand(x: np.ndarray) -> np.ndarray:
    """Features with their square roots and squares, for thresholds on either side."""
    return np.concatenate([x, np.sqrt(np.abs(x)), x * x], axis=1)


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, rounds: int = 30) -> dict:
    """Weights, centre, spread and cut. Newton steps on the pairwise logistic loss."""
    z = expand(x)
    mean, spread = z.mean(axis=0), z.std(axis=0) + 1e-9
    z = (z - mean) / spread
    rng = np.random.default_rng(0)
    won, lost = (np.flatnonzero(good), np.flatnonzero(~good))
    d = z[rng.choice(won, pairs)] - z[rng.choice(lost, pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w)), d.T @ (1 - p) / pairs - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    order = np.argsort(s, kind="stable")
    right = np.concatenate([[good.sum()], good.sum() + np.cumsum(np.where(good[order], -1, 1))])  # kept from each quantile on
    best = np.flatnonzero(right >= right.max() - 0.0005 * len(s))
    at = int(best[0])  # of quantiles about as good, the one that keeps most
    ranked = s[order]
    cut = ranked[0] - 1 if at == 0 else ranked[-1] + 1 if at == len(s) else (ranked[at - 1] + ranked[at]) / 2
    return {"w": w, "mean": mean, "spread": spread, "cut": float(cut), "quantile": at / len(s), "scale": float(np.std(s) / 2 + 1e-9)}


def score(x: np.ndarray, model: dict | None, threshold: float = THRESHOLD) -> np.ndarray:
    if model is None:
        return np.full(len(x), threshold)
    s = (expand(x) - model["mean"]) / model["spread"] @ model["w"]
    at = np.log(threshold / (1 - threshold))
    out = 1 / (1 + np.exp(-np.clip((s - model["cut"]) / model["scale"] + at, -500, 500)))
    return np.where(s >= model["cut"], np.maximum(out, threshold), np.minimum(out, np.nextafter(threshold, 0)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> dict | None:
    """The model, or None where the training rows do not hold both marks."""
    small_batches(docs.sparkSession)
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_mark")).where(~held_out(F.col("_id")) & F.col("_id").isNotNull() & F.col("_mark").isin(0, 1))
    marks = marks.orderBy(F.xxhash64("_id"), "_id", "_mark").limit(max_rows)  # bounded, so small enough to broadcast
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(marks), "_id").select("_id", "_mark", "text")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = feature_rows(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "mark", "x"])

    got = arrow(rows, over, "id long, mark int, x binary").orderBy("id", "mark", "x").limit(max_rows).toArrow()
    good = np.array(got["mark"].to_pylist(), int) == 1
    if not good.any() or good.all():
        return None
    return fit(np.frombuffer(b"".join(got["x"].to_pylist())).reshape(len(good), -1), good)


def scored(docs: DataFrame, model: dict | None, text_col: str = "text", threshold: float = THRESHOLD, name: str = "score") -> DataFrame:
    """docs with a column `name`; `name` replaces a column so called."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    kept = [i for i, c in enumerate(docs.columns) if c != name]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = score(feature_rows(batch.column(at)), model, threshold)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(s)], names=[*(batch.schema.names[i] for i in kept), name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.schema.fields[i] for i in kept))
    return arrow(docs, over, f"{fields}, `{name}` double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """id, held_out, score, predicted for each row of docs."""
    docs = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    model = train(docs, labels, id_col, "text", label_col)
    out = scored(docs, model, "text", threshold)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
