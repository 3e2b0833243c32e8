"""Operator 5: quality classifier by Naive Bayes support vectors.

Features are indicators: byte trigrams of the text and its lower-cased words, hashed into DIM
places. Each indicator is scaled by the log ratio of its smoothed share among good and among bad
texts (Naive Bayes), a text's vector has unit length, and a linear hinge-loss model is fitted
by dual coordinate descent. A logistic curve through the margins of texts that the fit did not
see turns margins into scores.

The model is fitted on labelled rows only, on at most SAMPLE of them, those with the least hash
of doc_id; no hold-out row is among them. Scoring covers whole texts of all rows and needs no
shuffle: the model, DIM numbers, is broadcast.

Defined results: null and empty texts have no features and get the score of the bias alone.
Labels that are null are left out; repeated labels count each time. Without labels of both kinds
the score is the share of good labels, or 0.5 without any. The hold-out remainder of a null
doc_id counts as 0, so that such a row is never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, text

BITS = 17
DIM = 1 << BITS
#: Labelled rows that the model is fitted on, at most.
SAMPLE = 8_000
COST, EPOCHS, SMOOTH = 1.0, 12, 1.0
THRESHOLD = 0.3


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place) of each text's distinct features, by text and place."""
    n = len(offsets) - 1
    seen = np.zeros(n << BITS, bool)
    if len(data) >= 3:
        of = np.repeat(np.arange(n), np.diff(offsets))
        grams = data[:-2].astype(np.uint64) | data[1:-1].astype(np.uint64) << np.uint64(8) | data[2:].astype(np.uint64) << np.uint64(16)
        at = ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - BITS)).astype(np.int64)
        inside = of[:-2] == of[2:]
        seen[(of[:-2][inside] << BITS) + at[inside]] = True
    starts, ends, first = text.words(data, offsets)
    if len(starts):
        at = (text.span_hashes(data, starts, ends) >> np.uint64(65 - BITS)).astype(np.int64) + (DIM >> 1)
        seen[(np.repeat(np.arange(n), np.diff(first)) << BITS) + at] = True
    at = np.flatnonzero(seen)
    return at >> BITS, at & (DIM - 1)


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Steps with at most 256 rows each, so that the array of indicators stays small."""
    for part, data, offsets in text.steps(batches, "text", 1 << 20):
        for a in range(0, part.num_rows, 256):
            b = min(part.num_rows, a + 256)
            yield part.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


class Svm:
    """weights over places, a bias, and the curve from margins to scores."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def margins(self, rows: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(rows, self.weights[places], n) / np.maximum(1e-12, np.sqrt(np.bincount(rows, self.squares[places], n))) + self.bias

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def descend(places: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss over unit vectors r[places] / norm, with a bias term of one."""
    w, bias = np.zeros(len(r)), 0.0
    alpha = np.zeros(len(y))
    x = [(v / max(1e-12, float(np.sqrt(v @ v)))).astype(np.float32) for v in (r[p] for p in places)]
    q = np.array([float(v @ v) + 1 for v in x])
    # each class has half of the cost
    top = cost * np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)).tolist():
            p = places[i]
            g = y[i] * (float(w[p] @ x[i]) + bias) - 1
            old = alpha[i]
            new = min(max(old - g / q[i], 0.0), top[i])
            if new != old:
                d = (new - old) * y[i]
                w[p] += d * x[i]
                bias += d
                alpha[i] = new
                moved = max(moved, abs(new - old))
        if moved < 1e-3:
            break
    return w, bias


def curve(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of labels over margins, by Newton steps on smoothed targets."""
    good, bad = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, float(np.log((good + 1) / (bad + 1)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        h = p * (1 - p) + 1e-9
        g = np.array([((p - t) * m).sum() + 1e-3 * (a - 1), (p - t).sum()])
        k = np.array([[(h * m * m).sum() + 1e-3, (h * m).sum()], [(h * m).sum(), h.sum()]])
        step = np.linalg.solve(k, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


def fit(places: list[np.ndarray], y: np.ndarray, seed: int = 11) -> Svm:
    """The model of feature places and labels (1 and -1)."""
    good, bad = int((y > 0).sum()), int((y < 0).sum())
    if not good or not bad:
        share = good / len(y) if len(y) else 0.5
        share = min(max(share, 1e-9), 1 - 1e-9)
        model = Svm(np.zeros(DIM), 0.0, 1.0, float(np.log(share / (1 - share))))
        model.squares = np.ones(DIM)
        return model

    def ratios(which: np.ndarray) -> np.ndarray:
        counts = {1: np.full(DIM, SMOOTH), -1: np.full(DIM, SMOOTH)}
        for i in which:
            counts[int(y[i])][places[i]] += 1
        counts = [counts[1], counts[-1]]
        return np.log((counts[0] / counts[0].sum()) / (counts[1] / counts[1].sum()))

    rng = np.random.default_rng(seed)
    fold = rng.integers(0, 3, len(y))
    margins = np.zeros(len(y))
    for f in range(3):
        inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if len(set(y[inside])) < 2:
            continue
        r = ratios(inside)
        w, b = descend([places[i] for i in inside], y[inside], r, COST, EPOCHS, seed + f)
        for i in outside:
            v = r[places[i]]
            margins[i] = float(w[places[i]] @ v) / max(1e-12, float(np.sqrt(v @ v))) + b
    slope, shift = curve(margins, y)
    r = ratios(np.arange(len(y)))
    w, b = descend(places, y, r, COST, EPOCHS, seed + 9)
    model = Svm(w * r, b, slope, shift)
    model.squares = r * r
    return model


def held_out() -> F.Column:
    return F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"), F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Svm:
    """The model of the labelled rows of docs that are not held out, of at most `sample` labels."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)").where(~held_out())
    # a good and a bad half at most, so that few bad labels among many still count
    own = frames.cut(own, "labels")
    some = None
    for q in (0, 1):
        half = own.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2)
        some = half if some is None else some.union(half)
    share = {r.quality: r.n for r in own.groupBy("quality").agg(F.count("*").alias("n")).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in batches_of(batches):
            rows, places = features(data, offsets)
            at = np.searchsorted(rows, np.arange(part.num_rows + 1))
            raw = [places[at[i] : at[i + 1]].astype("<u4").tobytes() for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(raw, pa.binary())], ["doc_id", "quality", "places"])

    got = docs.join(F.broadcast(some), "doc_id").select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, places binary").toArrow()  # at most `sample` labels
    got = got.sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    places = [np.frombuffer(x.as_buffer(), "<u4") for x in got.column("places")]
    y = np.where(np.array(got.column("quality").to_pylist(), np.int64) == 1, 1, -1)
    model = fit(places, y)
    # scores speak of the labels' own shares, not of the sample's
    if share.get(0) and share.get(1) and (y > 0).any() and (y < 0).any():
        model.shift += float(np.log(share[1] / share[0]) - np.log((y > 0).sum() / (y < 0).sum()))
    return model


def score(docs: DataFrame, model: Svm, *extra: str) -> DataFrame:
    """(doc_id, score, text, extra...) for each row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select("doc_id", "text", *extra)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for part, data, offsets in batches_of(batches):
            rows, places = features(data, offsets)
            yield part.append_column("score", pa.array(m.scores(m.margins(rows, places, part.num_rows))))

    return own.mapInArrow(run, schema)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents")
    model = train(docs, frames.table(spark, sf_dir, "labels"))
    out = score(docs, model).select("doc_id", held_out().alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
