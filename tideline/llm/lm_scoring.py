"""Cross-entropy difference of two matched n-gram models.

The target model is read from documents labelled as good, the background model from all documents. Both are
word bigram models of one form, smoothed by unigrams (Dirichlet priors), over one shared vocabulary: all words of the corpus, the end of
a text, and one more for words that it lacks. In any context the probabilities of these sum to one. Words and bigrams are counted exactly, by 64-bit ids, in tables that grow with
the corpus. The models are matched in mass too: the counts of the background, which covers all documents, are scaled to the number of the target's
tokens, so that rare words cost as much under either. Per document: the loss per token under either model (its words and its end), and target loss minus background loss (low: like the target).

Documents are taken in chunks of about CHUNK words. A chunk sends its distinct words and bigrams with their counts to
slots by id, a slot adds up what all chunks sent and replies in the order of each message, and a chunk is scored
with the replies to it: no task holds more than a chunk or a slot, and no word is in more rows than there are chunks.

Cases: a null or empty text, or one without words, has no tokens, and null losses; a null doc_id is scored and
never target text; labels repeated for an id count once; with no target text at all, the target model is uniform over
the vocabulary; repeated rows are counted and scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import packed, released, sized, text_of, unpacked, work_dir, written

CHUNK = 1_000_000
SLOTS, SLOT_BYTES = 256, 8_000_000  # at least so many slots, and one for so many bytes of text
CONTEXT_MASS = 5.0  # tokens of a context that the unigram estimate counts for
SMOOTHING = 0.5
END = np.uint64(1)  # id of the end of a text
_SENT = "chunk long, slot int, sent binary"
_BLOBS = {"parquet.block.size": 16 << 20, "parquet.enable.dictionary": False}  # a writer holds a block in memory


def words(text: str) -> list[str]:
    return text.lower().split()


class _Ids(dict):
    """64-bit ids of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_ids = _Ids()


def _pair_ids(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = first * np.uint64(0x9E3779B97F4A7C15) ^ second
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Chunk:
    """Distinct words and bigrams of a run of documents, in an order that its words alone decide."""

    def __init__(self, lengths: np.ndarray, places: np.ndarray, ids: np.ndarray, slots: int):
        """Tokens of each document, place of each token in the distinct ids, number of slots. A slot is a range of ids."""
        self.places = places
        self.starts = np.cumsum(lengths)[lengths > 0] - lengths[lengths > 0]
        self.follows = np.ones(len(places), bool)  # whether a word has one before it in its document
        self.follows[self.starts] = False
        after = np.flatnonzero(self.follows)
        pairs, self.pair = np.unique(places[after - 1].astype(np.int64) * max(len(ids), 1) + places[after], return_inverse=True)
        self.first, self.second = np.divmod(pairs, max(len(ids), 1))
        self.ids = [ids, _pair_ids(ids[self.first], ids[self.second])]
        self.order = [np.argsort(i) for i in self.ids]
        first = np.array([-(-(k << 64) // slots) for k in range(1, slots)], np.uint64)
        self.ends = [np.append(np.searchsorted(i[o], first), len(i)) for i, o in zip(self.ids, self.order, strict=True)]

    def messages(self, good: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """For each slot: ids of words and of bigrams as differences, counts of all text and of target text (of the words that `good` marks)."""
        counts = []
        for k, (found, mask) in enumerate(((self.places, good), (self.pair, good[self.follows]))):
            size = len(self.ids[k])
            counts.append([np.bincount(x, minlength=size).astype(np.uint32)[self.order[k]] for x in (found, found[mask])])
        ids = [i[o] for i, o in zip(self.ids, self.order, strict=True)]
        at = [0, 0]
        for slot, ends in enumerate(zip(*self.ends, strict=True)):
            parts = [slice(a, b) for a, b in zip(at, ends, strict=True)]
            at = ends
            steps = (np.diff(i[p], prepend=np.uint64(0)) for i, p in zip(ids, parts, strict=True))
            yield slot, packed(*steps, *(np.concatenate([counts[0][k][parts[0]], counts[1][k][parts[1]]]) for k in (0, 1)))

    def counts(self, replies: list[list[np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Counts of words and bigrams in the whole corpus and in its target text, from the replies of all slots in order."""
        out = []
        for k in (0, 1):
            both = []
            for kind in (0, 1):
                sizes = np.diff(self.ends[kind], prepend=0)
                words_there = np.diff(self.ends[0], prepend=0)
                cut = [slice(0, w) if kind == 0 else slice(w, w + s) for w, s in zip(words_there, sizes, strict=True)]
                full = np.zeros(len(self.ids[kind]), np.int64)
                full[self.order[kind]] = np.concatenate([r[k][c] for r, c in zip(replies, cut, strict=True)])
                both.append(full)
            out.append(tuple(both))
        return out

    def losses(self, single: np.ndarray, double: np.ndarray, total: int, kinds: int, scale: float = 1.0) -> np.ndarray:
        """Sums of -ln P of the tokens of each document that has any, each given the one before it; all counts are taken times `scale`."""
        alone = (scale * single + SMOOTHING) / (scale * total + SMOOTHING * kinds)
        p = (scale * double + CONTEXT_MASS * alone[self.second]) / (scale * single[self.first] + CONTEXT_MASS)
        each = -np.log(alone)[self.places]
        each[self.follows] = -np.log(p)[self.pair]
        return np.add.reduceat(each, self.starts) if len(self.starts) else np.zeros(0)


def _rows(chunks: list[int], slots: list[int], sent: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(slots, pa.int32()), pa.array(sent, pa.binary())], names=["chunk", "slot", "sent"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks, in slot -1, from rows of doc_id, text and whether it is target text."""
    docs, good, found, size = [], [], [], 0

    def rows() -> pa.RecordBatch:
        lengths = np.array([len(f) for f in found], np.int64)
        ids, places, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")  # small places for frequent words
        rank = np.empty(len(ids), np.int32)
        rank[order] = np.arange(len(ids), dtype=np.int32)
        known = np.array([d is not None for d in docs], bool)
        row = packed(np.array([d or 0 for d in docs], np.int64), known, np.array(good, bool), lengths, rank[places], ids[order])
        return _rows([uuid.uuid4().int >> 65], [-1], [row])

    for batch in batches:
        for k in range(batch.num_rows):
            text = words(batch.column(1)[k].as_py())
            docs.append(batch.column(0)[k].as_py())
            good.append(batch.column(2)[k].as_py())
            found.append(np.append(np.fromiter(map(_ids.__getitem__, text), np.uint64, len(text)), END) if text else np.zeros(0, np.uint64))
            size += len(text) + 1
            if size >= CHUNK:
                yield rows()
                docs, good, found, size = [], [], [], 0
    if docs:
        yield rows()


def _opened(data: bytes, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Chunk]:
    """Of a chunk: ids of its documents, whether they have one, whether they are target text, their lengths, and the Chunk."""
    ids, known, good, lengths, places, word_ids = unpacked(data, np.int64, bool, bool, np.int64, np.int32, np.uint64)
    return ids, known, good, lengths, Chunk(lengths, places, word_ids, slots)


def _messages(batches: Iterator[pa.RecordBatch], slots: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            _, _, good, lengths, chunk = _opened(batch.column(2)[k].as_py(), slots)
            slot, sent = zip(*chunk.messages(np.repeat(good, lengths)), strict=True)
            yield _rows([batch.column(0)[k].as_py()] * len(sent), list(slot), list(sent))


def _replies(table: pa.Table) -> pa.Table:
    """To each message of a slot, the sums of its words and bigrams over all messages; once, the slot's distinct words and their sums."""
    sent = [unpacked(b, np.uint64, np.uint64, np.uint32, np.uint32) for b in table["sent"].to_pylist()]
    sums, whole = [], []
    for kind in (0, 1):
        ids, at = np.unique(np.concatenate([np.cumsum(m[kind], dtype=np.uint64) for m in sent]), return_inverse=True)
        both = []
        for k in (2, 3):
            n = np.concatenate([m[k][: len(m[0])] if kind == 0 else m[k][len(m[0]) :] for m in sent])
            total = np.zeros(len(ids), np.int64)
            np.add.at(total, at, n)
            both.append(total[at])
            if kind == 0:
                whole.append(int(total.sum()))
        if kind == 0:
            kinds = len(ids)
        sums.append(both)
    out, done = [], [0, 0]
    for m in sent:
        ends = [done[kind] + len(m[kind]) for kind in (0, 1)]
        out.append(packed(*(np.concatenate([sums[kind][k][done[kind] : ends[kind]] for kind in (0, 1)]) for k in (0, 1))))
        done = ends
    rest = [0] * (len(sent) - 1)
    return pa.table({
        "chunk": table["chunk"], "slot": table["slot"], "sent": pa.array(out, pa.binary()), "kinds": pa.array([kinds, *rest], pa.int64()),
        "n": pa.array([whole[0], *rest], pa.int64()), "good": pa.array([whole[1], *rest], pa.int64()),
    })


def score(docs: DataFrame, labels: DataFrame, hold_out: bool = True) -> DataFrame:
    """A row per document: doc_id, n_tokens, target_loss, background_loss, ce_difference. Target: labels with quality 1; with hold_out, for evaluation, without those whose id's crc32 mod 5 is 0."""
    spark, at = docs.sparkSession, work_dir(docs.sparkSession)
    good = labels.where("quality = 1").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0 if hold_out else F.lit(True)).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = written(good.withColumn("good", F.lit(True)), f"{at}/good")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    slots = max(SLOTS, (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SLOT_BYTES)
    marked = rows.join(sized(good), "doc_id", "left").select("doc_id", "text", F.coalesce("good", F.lit(False)).alias("good"))
    chunks = written(marked.mapInArrow(_chunks, _SENT), f"{at}/chunks", **_BLOBS)
    replies = written(chunks.mapInArrow(lambda b: _messages(b, slots), _SENT).groupBy("slot").applyInArrow(_replies, f"{_SENT}, kinds long, n long, good long"), f"{at}/replies", **_BLOBS)
    released(spark)
    kinds, total, target = (x or 0 for x in replies.agg(F.sum("kinds"), F.sum("n"), F.sum("good")).first())

    def scored(table: pa.Table) -> pa.Table:
        found = dict(zip(table["slot"].to_pylist(), table["sent"].to_pylist(), strict=True))
        ids, known, _, lengths, chunk = _opened(found[-1], slots)
        every, marked = chunk.counts([unpacked(found[s], np.int64, np.int64) for s in range(slots)])
        there, columns = lengths > 0, []
        for counts, size, scale in ((marked, target, 1.0), (every, total, target / total if target else 1.0)):
            loss = np.zeros(len(lengths))
            loss[there] = chunk.losses(*counts, size, kinds + 1, scale) / lengths[there]
            columns.append(pa.array(loss, mask=~there))
        return pa.table({"doc_id": pa.array(ids, mask=~known), "n_tokens": pa.array(lengths - there), "target_loss": columns[0], "background_loss": columns[1]})

    both = chunks.unionByName(replies.select("chunk", "slot", "sent"))
    losses = both.groupBy("chunk").applyInArrow(scored, "doc_id long, n_tokens long, target_loss double, background_loss double")
    return losses.withColumn("ce_difference", F.col("target_loss") - F.col("background_loss"))
