"""I-Match fingerprints with randomised lexicons.

Of a text's distinct words, those whose inverse document frequency lies in a band are kept, sorted (by their
64-bit hashes) and hashed: once all of them, and once each of several random subsets of the lexicon. A subset
keeps a word by a hash of the word and the subset alone; subsets come in densities 1/4 to 1/1024, so that texts of any
length have some in which few of their words fall. Likeness is the share of equal hashes at the density where it is greatest.

Document frequencies are exact and cover all documents. A word of the band occurs in documents / exp(upper edge) texts at
least, so the lexicon has exp(upper edge) times the mean number of distinct words of a text at most, however many texts there
are: about 22,000 times at the usual band. Up to LEXICON words it is broadcast, a larger one goes to the executors as a file that they map.

Cases: a null text is empty; a text without words of the band uses all its words; one without any word has
the fingerprint of zeros, like any other such text only; equal texts have equal fingerprints; a null doc_id
comes first in the order, repeated ids follow by a hash of their texts; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import string
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import least, text_of, work_dir, written

BAND = (3.0, 10.0)
DENSITIES = (1, 2, 3, 4, 5)  # powers of 1/4
SUBSETS = 10
LEAST_COMPARED = 6
LEXICON = 8_000_000
NO_ID = -(2**63)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_KEPT, _COUNTED = 400_000, 1_000_000


def term(word: str) -> int:
    """Hash of a word in lower case, without punctuation at either end; 0 if nothing is left."""
    bare = word.strip(string.punctuation).lower()
    return (xxhash.xxh3_64_intdigest(bare) or 1) if bare else 0


class _Terms(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _KEPT:
            self.clear()
        self[word] = h = term(word)
        return h


_terms = _Terms()


def terms(text: str) -> np.ndarray:
    """Ascending distinct hashes of the words."""
    words = text.split()
    found = np.unique(np.fromiter(map(_terms.__getitem__, words), np.uint64, len(words)))
    return found[1:] if len(found) and not found[0] else found


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) of runs of texts."""
    found, n = [], 0

    def rows() -> pa.RecordBatch:
        names, counts = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(counts)], names=["term", "df"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            found.append(terms(text))
            n += len(found[-1])
            if n >= _COUNTED:
                yield rows()
                found, n = [], 0
    if n:
        yield rows()


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """term: the hashes of the words whose inverse document frequency, ln(documents / df), lies in the band."""
    counts = docs.select(text_of().alias("text")).mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.log(F.lit(float(max(docs.count(), 1))) / F.col("df"))
    return counts.where((idf >= band[0]) & (idf <= band[1])).select("term")


def shared(spark: SparkSession, lexicon: DataFrame) -> Callable[[], np.ndarray]:
    """What gives a task the lexicon, a written table: its ascending hashes."""
    if lexicon.count() <= LEXICON:
        held = spark.sparkContext.broadcast(np.sort(lexicon.toPandas()["term"].to_numpy(np.int64).view(np.uint64)))
        return lambda: held.value
    parts = 64
    with tempfile.NamedTemporaryFile(prefix="lexicon-", suffix=".u64", delete=False) as file:
        for k in range(parts):  # ranges of unsigned hashes in order; one is in memory at a time
            high = F.shiftrightunsigned("term", 58)
            part = lexicon.where(high == k).toPandas()["term"].to_numpy(np.int64)
            file.write(np.sort(part.view(np.uint64)).tobytes())
    spark.sparkContext.addFile(file.name)
    name = os.path.basename(file.name)
    return lambda: np.memmap(SparkFiles.get(name), np.uint64, "r")


_SEEDS = np.array([xxhash.xxh3_64_intdigest(f"{d}/{k}") for d in DENSITIES for k in range(SUBSETS)], np.uint64)[:, None]
_SHIFTS = np.array([64 - 2 * d for d in DENSITIES for _ in range(SUBSETS)], np.uint64)[:, None]
_PLACES = np.arange(len(_SEEDS), dtype=np.uint64)[:, None]


def subsets_of(found: np.ndarray) -> np.ndarray:
    """By word, the subsets that hold it, as bits."""
    out = np.zeros(len(found), np.uint64)
    for start in range(0, len(found), 8192):
        x = (found[None, start : start + 8192] ^ _SEEDS) * _K1
        member = (((x ^ (x >> np.uint64(32))) * _K2) >> _SHIFTS) == 0
        out[start : start + 8192] = (member.astype(np.uint64) << _PLACES).sum(axis=0, dtype=np.uint64)
    return out


class Lexicon:
    """The lexicon of a task. What it says of a word, it remembers."""

    def __init__(self, inside: np.ndarray):
        self.inside = inside
        self.places: dict[str, int] = {}
        self.hashes, self.bits, self.kept, self.n = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64), np.zeros(1024, bool), 0

    def contains(self, found: np.ndarray) -> np.ndarray:
        if not len(self.inside):
            return np.zeros(len(found), bool)
        at = np.searchsorted(self.inside, found)
        return self.inside[np.minimum(at, len(self.inside) - 1)] == found

    def _learn(self, words: list[str]) -> None:
        hashes = np.fromiter(map(term, words), np.uint64, len(words))
        if self.n + len(words) > _KEPT:
            self.places.clear()
            self.n = 0
        while self.n + len(words) > len(self.hashes):
            self.hashes, self.bits, self.kept = (np.concatenate([a, np.zeros_like(a)]) for a in (self.hashes, self.bits, self.kept))
        to = slice(self.n, self.n + len(words))
        self.hashes[to], self.bits[to], self.kept[to] = hashes, subsets_of(hashes), self.contains(hashes)
        self.places.update(zip(words, range(self.n, self.n + len(words)), strict=True))
        self.n += len(words)

    def fingerprint(self, text: str) -> np.ndarray:
        """Hashes of the whole band and of each subset, 0 for an empty one."""
        words = list(set(text.split()))
        places = list(map(self.places.get, words))
        if None in places:
            new = [w for w, k in zip(words, places, strict=True) if k is None]
            self._learn(new if self.n + len(new) <= _KEPT else words)
            places = list(map(self.places.__getitem__, words))
        at = np.array(places, np.int64)
        hashes = self.hashes[at]
        found, first = np.unique(hashes, return_index=True)
        at = at[first]
        if len(found) and not found[0]:
            found, at = found[1:], at[1:]
        kept = self.kept[at]
        if kept.any():
            found, at = found[kept], at[kept]
        out = np.zeros(1 + len(_SEEDS), np.uint32)
        if not len(found):
            return out
        out[0] = xxhash.xxh32_intdigest(found.tobytes()) | 1
        bits = self.bits[at]
        there = np.flatnonzero(bits)
        found, bits = found[there], bits[there]
        which, word = np.nonzero(np.unpackbits(bits.astype("<u8").view(np.uint8).reshape(-1, 8).T, axis=0, bitorder="little"))
        sequence, ends = found[word].tobytes(), 8 * np.searchsorted(which, np.arange(len(_SEEDS)), "right")
        start = 0
        for k, end in enumerate(ends.tolist(), 1):
            if end > start:
                out[k] = xxhash.xxh32_intdigest(sequence[start:end]) | 1
                start = end
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 to 1; 1 if all words of the band are the same."""
    if a[0] == b[0]:
        return 1.0
    equal = ((a == b) & (a != 0))[1:].reshape(len(DENSITIES), SUBSETS).sum(axis=1)
    there = ((a != 0) | (b != 0))[1:].reshape(len(DENSITIES), SUBSETS).sum(axis=1)
    return float((equal / np.maximum(there, LEAST_COMPARED)).max())


def spelled(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by as many first ones of the following text, or all."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


KIND = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(batches: Iterator[pa.RecordBatch], inside: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket, the documents of a bucket in order, then as a tail the one that follows them."""
    lexicon = Lexicon(inside)
    out: list[tuple] = []
    waiting: tuple | None = None  # doc_id, text, fingerprint
    names = [c.split()[0] for c in KIND.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for k in range(batch.num_rows):
            tail, doc_id, text = (batch.column(c)[k].as_py() for c in (1, 2, 4))
            if tail and waiting is None:
                continue
            own = lexicon.fingerprint(text)
            if waiting is not None:
                name, before, print_before = waiting
                other = edited(before, text)
                print_other = lexicon.fingerprint(other)
                out.append((None if name == NO_ID else name, len(before), hashlib.sha256(other.encode()).hexdigest(), spelled(print_before), spelled(print_other), likeness(print_before, print_other), likeness(print_before, own)))
            waiting = None if tail else (doc_id, text, own)
        if len(out) >= 500:
            yield batch_of(out)
            out = []
    if out:
        yield batch_of(out)


def _place(key: Column, bounds: list[tuple[int, int]]) -> Column:
    """Number of bounds that are at most the key, by bisection."""
    if not bounds:
        return F.lit(0)
    fixed = F.array(*(F.struct(F.lit(a).cast("long").alias("doc_id"), F.lit(b).cast("long").alias("body")) for a, b in bounds))
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    inside = lambda at, step: (at + step <= len(bounds)) & (F.try_element_at(fixed, at + step) <= key)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(inside(at, step), at + step).otherwise(at))


def compare(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """A row per document, as in KIND: its fingerprint against those of its edited text and of the next document.

    Documents are dealt by ranges of doc_id and a hash of the text (so that many rows of one id, or without any, spread
    too), bounded by a sample; the first document of a range goes to the range before it too, as the tail that
    follows its last document, and that of the first to the last.
    """
    spark, at = docs.sparkSession, work_dir(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_of().alias("text")).select("doc_id", F.xxhash64("text").alias("body"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    inside = shared(spark, written(lexicon(docs, band), f"{at}/lexicon"))
    keys = written(rows.select("doc_id", "body", F.xxhash64("doc_id", "body", F.lit("sample")).alias("sample")), f"{at}/keys")
    sampled = keys.join(F.broadcast(least(keys.select("sample"), "sample", 64 * parts)), "sample", "left_semi").select("doc_id", "body").distinct()
    found = sorted(map(tuple, sampled.collect()))  # 64 rows a partition
    bounds = sorted({found[k * len(found) // (4 * parts)] for k in range(1, 4 * parts)}) if found else []
    key = F.struct("doc_id", "body")
    firsts = {b: (i, h) for b, (i, h) in keys.groupBy(_place(key, bounds).alias("bucket")).agg(F.min(key)).collect()}  # a row per range
    order = sorted(firsts)
    before = {b: order[k - 1] for k, b in enumerate(order)}
    placed = rows.withColumn("bucket", _place(key, bounds))
    every = range(len(bounds) + 1)
    nothing = F.lit(None).cast("struct<doc_id:bigint,body:bigint>")
    first_of = F.element_at(F.array(*(F.struct(F.lit(firsts[b][0]).cast("long").alias("doc_id"), F.lit(firsts[b][1]).cast("long").alias("body")) if b in firsts else nothing for b in every)), F.col("bucket") + 1)
    before_of = F.element_at(F.array(*(F.lit(before.get(b, 0)) for b in every)), F.col("bucket") + 1)
    tails = placed.where(key == first_of).groupBy("bucket", "doc_id", "body").agg(F.min("text").alias("text"))
    tails = tails.select(before_of.alias("bucket"), F.lit(1).alias("tail"), "doc_id", "body", "text")
    dealt = placed.select("bucket", F.lit(0).alias("tail"), "doc_id", "body", "text").unionByName(tails)
    ranged = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "tail", "doc_id", "body", "text")
    return ranged.mapInArrow(lambda b: _compared(b, inside()), KIND)
