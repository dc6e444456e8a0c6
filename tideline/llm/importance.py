"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Words and word pairs of each text are hashed into BUCKETS; over the target (labelled good) and over all
documents their shares give two generative models. A document's log-weight is the log-ratio of its probabilities under them, the
sum over its n-grams. Gumbel noise, a
function of the document's id, its text and a seed, is added, and the documents with the largest sums are kept: a sample without replacement
with probabilities in proportion to the weights.

The k-th largest sum is found by two rounds of histograms; only documents of one narrow range are ranked.

Cases: a null or empty text has no n-grams and log-weight 0; a null doc_id is scored, as the empty
id; labels repeated for an id count once; with no target text all weights are equal; equal sums fall to the
smaller id; repeated rows are ranked each, with noise of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.common import body, each_row, sized, text_of, uniform, work_dir, written

BUCKETS = 10_000
KEEP = 0.85
RANGES = 4096


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def grams(text: str) -> np.ndarray:
    """Buckets of the words and pairs of words of the text."""
    words = text.lower().split()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:]
    pairs = (pairs ^ (pairs >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (np.concatenate([h, pairs ^ (pairs >> np.uint64(32))]) % np.uint64(BUCKETS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        good = batch.column(1).to_pylist()
        for k in range(batch.num_rows):
            counts = np.bincount(grams(batch.column(0)[k].as_py()), minlength=BUCKETS)
            raw += counts
            if good[k]:
                target += counts
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS), pa.int32()), pa.array(raw), pa.array(target)], names=["bucket", "raw", "target"])


def ratios(docs: DataFrame, labels: DataFrame, hold_out: bool = True) -> np.ndarray:
    """ln(target share / raw share) by bucket. Target: labels with quality 1; with hold_out, for evaluation, without those whose id's crc32 mod 5 is 0."""
    at = work_dir(docs.sparkSession)
    good = labels.where("quality = 1").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0 if hold_out else F.lit(True)).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = written(good.withColumn("good", F.lit(True)), f"{at}/good")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(sized(good), "doc_id", "left")
    counts = rows.select("text", F.coalesce("good", F.lit(False)).alias("good")).mapInArrow(_counted, "bucket int, raw long, target long")
    sums = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).orderBy("bucket").toPandas()  # BUCKETS rows
    raw, target = (sums[c].to_numpy(float) if len(sums) else np.zeros(BUCKETS) for c in ("raw", "target"))
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def top(rows: DataFrame, value: str, k: int, at: str) -> DataFrame:
    """rows (a written table) with the column kept: whether it is one of the k largest by value, then smallest doc_id."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    if low is None or k <= 0:
        return rows.withColumn("kept", F.lit(False))
    width = (high - low) / RANGES or 1.0
    coarse = F.least(F.floor((F.lit(high) - F.col(value)) / F.lit(width)), F.lit(RANGES - 1))
    fine = F.least(F.floor(((F.lit(high) - F.col(value)) / F.lit(width) - F.col("coarse")) * RANGES), F.lit(RANGES - 1))
    rows = rows.withColumn("coarse", coarse).withColumn("fine", fine)

    def end(counts: list, need: int) -> tuple[int, int]:
        before = 0
        for place, n in sorted(counts):
            if before + n >= need:
                return place, before
            before += n
        return RANGES, before

    first, before = end([tuple(r) for r in rows.groupBy("coarse").count().collect()], k)  # RANGES rows at most
    second, more = end([tuple(r) for r in rows.where(F.col("coarse") == first).groupBy("fine").count().collect()], k - before)
    edge = (F.col("coarse") == first) & (F.col("fine") == second)
    sure = (F.col("coarse") < first) | ((F.col("coarse") == first) & (F.col("fine") < second))
    rank = F.row_number().over(W.orderBy(F.desc(value), F.col("doc_id").asc_nulls_last()))
    ranked = rows.where(edge).withColumn("kept", rank <= k - before - more)
    return rows.where(~edge).withColumn("kept", sure).unionByName(ranked).drop("coarse", "fine")


def resample(docs: DataFrame, labels: DataFrame, keep: float = KEEP, seed: str = "gumbel", hold_out: bool = True) -> DataFrame:
    """A row per document: doc_id, log_weight, gumbel_score, kept (the share `keep` of all rows, rounded up)."""
    spark, at = docs.sparkSession, work_dir(docs.sparkSession)
    shared = spark.sparkContext.broadcast(ratios(docs, labels, hold_out))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [float(shared.value[grams(batch.column(2)[k].as_py())].sum()) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(weights, pa.float64())], names=["doc_id", "body", "log_weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("body"), text_of().alias("text")).mapInArrow(weighed, "doc_id long, body string, log_weight double")
    noise = -F.log(-F.log(uniform(F.col("doc_id"), F.col("body"), F.col("copy"), seed)))
    scored = written(each_row(rows).withColumn("gumbel_score", F.col("log_weight") + noise), f"{at}/scored")
    n = scored.count()
    return top(scored, "gumbel_score", -int(-n * keep // 1), at).select("doc_id", "log_weight", "gumbel_score", "kept")
