"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios, trained on labelled text.

Training: of the labelled rows that may be learned from, at most TRAIN_ROWS (by a hash of their id) are
read; of equal texts one counts. Executors count in how many toxic and other documents each hashed n-gram
occurs; n-grams whose shares differ by more than LEAST_Z standard errors become features, the KEPT strongest ones
at most. A feature's value is its naive Bayes log-count ratio if it occurs, else 0; a logistic regression
with an L2 penalty weighs these values. Scoring reads whole texts and nothing else.

Cases: a null text is empty and gets the score of a text without features; a null doc_id is held out from
training and scored; with no labelled rows of both kinds every score is the share of toxic ones (0 without
any); a doc_id labelled several times is toxic if any label says so; repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import least, normalised, text_of

TRAIN_ROWS = 8000
SIZES = (3, 4, 5)
BUCKETS = 1 << 18
KEPT = 8192
LEAST_Z = 3.5
WINDOW = 1 << 18  # code points that are hashed at a time
_K = np.uint64(0x9E3779B97F4A7C15)


def windows(text: str) -> Iterator[np.ndarray]:
    """The hash buckets of all n-grams of the text in lower case, with a space at either end; of a long text in overlapping windows."""
    whole, more = f" {text.lower()} ", max(SIZES) - 1
    for k in range(0, max(1, len(whole) - more), WINDOW):
        yield _ngrams(whole[k : k + WINDOW + more])


def ngrams(text: str) -> np.ndarray:
    """The distinct buckets."""
    return np.unique(np.concatenate([np.unique(w) for w in windows(text)]))


def _ngrams(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    points[(points >= 9) & (points <= 13)] = 32
    out, h = [], points
    for n in range(2, max(SIZES) + 1):
        if len(points) < n:
            break
        h = (h[:-1] * _K) ^ points[n - 1 :]
        if n in SIZES:
            out.append((((h ^ (h >> np.uint64(29))) * _K) >> np.uint64(64 - 18)).astype(np.int32))
    return np.concatenate(out) if out else np.empty(0, np.int32)


@dataclass
class Model:
    place: np.ndarray  # by bucket: position of the feature, or -1
    weights: np.ndarray  # by feature: its weight times its log-count ratio
    bias: float

    def features(self, text: str) -> np.ndarray:
        found = (self.place[w] for w in windows(text))
        return np.unique(np.concatenate([f[f >= 0] for f in found]))

    def score(self, text: str) -> float:
        x = self.bias + float(self.weights[self.features(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5."""
    return F.crc32(doc_id.cast("string")) % 5


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of either kind each bucket occurs, once a task."""
    counts = np.zeros((2, BUCKETS), np.int32)
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[label, ngrams(text)] += 1
    there = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(counts[1, there].astype(np.int64)), pa.array(counts[0, there].astype(np.int64))], names=["bucket", "pos", "neg"])


def _featured(batches: Iterator[pa.RecordBatch], place: np.ndarray) -> Iterator[pa.RecordBatch]:
    model = Model(place, np.empty(0), 0.0)
    for batch in batches:
        found = [model.features(t).astype("<i4").tobytes() for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.binary())], names=["label", "features"])


def fit_weights(rows: np.ndarray, cols: np.ndarray, ratios: np.ndarray, labels: np.ndarray, penalty: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression on binary features times their ratios, by accelerated gradient steps of adapted length."""
    n, k = len(labels), len(ratios)
    w, b = np.zeros(k), float(np.log((labels.sum() + 1) / (n - labels.sum() + 1)))
    first, second = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        x = b + np.bincount(rows, weights=(w * ratios)[cols], minlength=n)
        error = 1 / (1 + np.exp(-np.clip(x, -500, 500))) - labels
        slope = np.append((np.bincount(cols, weights=error[rows], minlength=k) * ratios + penalty * w) / n, error.sum() / n)
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        step = 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - float(step[-1])
    return w * ratios, b


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Learns from `labels` (doc_id, toxic): no more than `most` rows of them, chosen by hash, whose remainder is not 0."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    usable = usable.where(remainder(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("label").alias("label"))
    usable = usable.withColumn("h", F.xxhash64("doc_id"))
    chosen = usable.join(F.broadcast(least(usable.select("h"), "h", most)), "h", "left_semi").select("doc_id", "label")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.xxhash64(normalised()).alias("body"))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("body").agg(F.min_by(F.struct("text", "label"), "doc_id").alias("row")).select("row.text", "row.label")
    rows = rows.persist()
    try:
        n = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        pos, neg = n.get(1, 0), n.get(0, 0)
        if not pos or not neg:
            share = pos / (pos + neg) if pos + neg else 0.0
            return Model(np.full(BUCKETS, -1, np.int32), np.zeros(0), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
        counts = rows.mapInArrow(_counted, "bucket int, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        share = (F.col("pos") + F.col("neg")) / F.lit(pos + neg)
        error = F.sqrt(share * (1 - share) * (1 / pos + 1 / neg)) + F.lit(1 / (pos + neg))
        z = F.abs(F.col("pos") / pos - F.col("neg") / neg) / error
        best = counts.where("pos + neg >= 3").withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "bucket").limit(KEPT).collect()
        place = np.full(BUCKETS, -1, np.int32)
        place[[r.bucket for r in best]] = np.arange(len(best))
        there = np.array([[r.pos, r.neg] for r in best], float).reshape(-1, 2) + 0.5
        ratios = np.log(there[:, 0] / (pos + 1)) - np.log(there[:, 1] / (neg + 1))
        found = rows.mapInArrow(lambda b: _featured(b, place), "label int, features binary").collect()
    finally:
        rows.unpersist()
    each = [np.frombuffer(r.features, "<i4") for r in found]
    row = np.repeat(np.arange(len(each)), [len(x) for x in each])
    weights, bias = fit_weights(row, np.concatenate(each), ratios, np.array([r.label for r in found], float))
    return Model(place, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers and at most KEPT weights

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in batches:
            values = [of.score(batch.column(1)[k].as_py()) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(scored, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted."""
    scores = score(docs, train(docs, labels, most))
    held = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(True))
    return scores.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def tolerated(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs whose score is below 0.5, with the columns of docs, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most))
    place = docs.columns.index("text")

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in batches:
            texts = batch.column(place)
            yield batch.filter(pa.array([of.score(texts[k].as_py() or "") < 0.5 for k in range(batch.num_rows)], pa.bool_()))

    return docs.mapInArrow(passed, docs.schema)
