"""Token ids in binary segments with Elias-Fano boundaries.

Documents are encoded where they lie; their ids, in 2 or 4 bytes each, are put in order of doc_id by a range partitioning
(and of a hash of the text, so that many rows of one id, or without any, spread too), and each task writes
segments of about SEGMENT_IDS ids. A segment is one block of bytes (see `segment_bytes`): the ids of its
documents, concatenated, and where each document ends, as an Elias-Fano sequence: low bits packed, high bits
in unary, and the place of every 64th one, from which `Segment.end` selects any end in near-minimal space. The documents' own
numbers, which ascend, are a second such sequence. Readers select from both; no table of 64-bit numbers is stored or made.
Segments are the rows of a Parquet table: its commit protocol makes the files of a lost task vanish, any store that
Spark writes holds it, and `Segment(row.data)` reads a block wherever it lies; `export` copies the blocks of a table to plain files.

A tokenizer that drops white space and never joins across it may be run word by word (`by_word`): then each
distinct word is encoded once a worker and remembered, with the same ids as for the whole text. Texts that a tokenizer without these
properties would encode otherwise are tried first (PROBES), and refused as an error.

Cases: a null or empty text has no ids but the end id; a null doc_id comes first; repeated rows are written each, in order of a hash of
their texts; an empty table writes no segment and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.common import removed, sized, text_of, work_dir, written

SEGMENT_IDS = 1 << 17
SAMPLED = 64
NO_ID = -(2**63)
_MAGIC = b"TLEF"
_HEADER = struct.Struct("<4sBBBxIQqII")  # magic, bytes an id, low bits of ends and of numbers, documents, ids, first number, bytes of high bits of either
_WORDS_KEPT = 600_000
_BLOBS = {"parquet.block.size": 16 << 20, "parquet.enable.dictionary": False, "compression": "zstd"}

_TYPED = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
_ODD_SPACE = re.compile("[\x1c-\x1f]")


#: Texts that show whether words may be encoded one by one.
PROBES = (
    "two words", "a  b", " lead", "trail ", "tab\tnew\nline", "Case CASE don't it's 'll", "x\xa0y\u3000z", "é É ﬁ Ǆ ΑΣ İ 漢字 á", "<|endoftext|> a<|endoftext|>b",
    "12a3 ... !? |a|b| {}[]~^", "\U0001f642\U0001f643 mixed\U0001f642word", "the The THE tHe", "a-b_c/d e,f.g",
)


class Encoder:
    """Ids of texts as packed little-endian numbers of `width` bytes."""

    def __init__(self, path: str, by_word: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 65536 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.words = _Words(self) if by_word else None
        if by_word and (wrong := next((t for t in PROBES if self(t) != self.whole(t)), None)) is not None:
            raise ValueError(f"this tokenizer cannot be run word by word: {wrong!r} gets other ids")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def __call__(self, text: str) -> bytes:
        if self.words is None or _ODD_SPACE.search(text):  # str.split() parts at these too, the tokenizer doesn't
            return self.whole(text)
        return b"".join(map(self.words.__getitem__, text.split()))


class _Words(dict):
    """Packed ids by word. Plain words (Latin letters, then punctuation) go straight to the tokenizer's model."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.whole, self.kind, self.model = encoder.whole, encoder.kind, encoder.tokenizer.model
        self.parts: dict[str, bytes] = {}
        # the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.letters = {b: b if b in own else next(rest) for b in range(256)}

    def part(self, text: str) -> bytes:
        if (ids := self.parts.get(text)) is None:
            if len(self.parts) >= _WORDS_KEPT:
                self.parts.clear()
            spelled = text.encode().decode("latin-1").translate(self.letters)
            ids = self.parts[text] = np.array([t.id for t in self.model.tokenize(spelled)], self.kind).tobytes()
        return ids

    def __missing__(self, word: str) -> bytes:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        if plain := _TYPED.fullmatch(word):
            ids = self.part(plain[1].lower()) + (self.part(plain[2]) if plain[2] else b"")
        else:
            ids = self.whole(word)
        self[word] = ids
        return ids


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, by_word: bool) -> Encoder:
    """One encoder a worker, so that its words outlive a task."""
    if (path, by_word) not in _encoders:
        _encoders[path, by_word] = Encoder(path, by_word)
    return _encoders[path, by_word]


def elias_fano(values: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """Number of low bits, low bits, high bits and samples of an ascending sequence of unsigned numbers."""
    n, most = len(values), int(values[-1]) if len(values) else 0
    low = max(0, (most // max(n, 1)).bit_length() - 1)
    values = values.astype(np.uint64)
    lows = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    high[ones] = 1
    pack = lambda bits: np.packbits(bits, bitorder="little").tobytes()
    return low, pack(lows.ravel()), pack(high), ones[::SAMPLED].astype("<u4").tobytes()


class Sequence:
    """An Elias-Fano sequence, read in place."""

    def __init__(self, low: int, lows: memoryview, highs: memoryview, samples: memoryview):
        self.low, self.lows, self.highs, self.samples = low, lows, highs, np.frombuffer(samples, "<u4")

    def __getitem__(self, k: int) -> int:
        """The k-th number: its one among the high bits, selected from the sample before it, and its low bits."""
        at = int(self.samples[k // SAMPLED])
        left, byte = k % SAMPLED, at // 8
        word = self.highs[byte] & (0xFF << (at % 8)) & 0xFF
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = self.highs[byte]
        for _ in range(left):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        first = k * self.low
        raw = int.from_bytes(self.lows[first // 8 : (first + self.low + 7) // 8], "little")
        return ((one - k) << self.low) | (raw >> (first % 8)) & ((1 << self.low) - 1)


def segment_bytes(doc_ids: list[int], packed: list[bytes], width: int) -> bytes:
    """header | samples, low bits, high bits of the ends | the same of the documents' numbers above the first | ids"""
    ends = np.cumsum([len(p) // width for p in packed])
    numbers = np.array(doc_ids, np.int64).view(np.uint64)
    first = doc_ids[0] if doc_ids else 0
    low, lows, highs, samples = elias_fano(ends)
    low_id, lows_id, highs_id, samples_id = elias_fano(numbers - numbers[:1]) if doc_ids else (0, b"", b"", b"")
    head = _HEADER.pack(_MAGIC, width, low, low_id, len(packed), int(ends[-1]) if len(packed) else 0, first, len(highs), len(highs_id))
    return b"".join([head, samples, lows, highs, samples_id, lows_id, highs_id, *packed])


class Segment:
    """A segment's bytes, read without copying."""

    def __init__(self, data: bytes):
        magic, self.width, low, low_id, self.n, self.n_ids, self.first, n_high, n_high_id = _HEADER.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a token segment")
        at, views = _HEADER.size, []
        samples = 4 * -(-self.n // SAMPLED)
        for size in (samples, -(-self.n * low // 8), n_high, samples, -(-self.n * low_id // 8), n_high_id, self.width * self.n_ids):
            views.append(memoryview(data)[at : at + size])
            at += size
        if at != len(data):
            raise ValueError("a token segment of the wrong length")
        self.ends, self.numbers = Sequence(low, views[1], views[2], views[0]), Sequence(low_id, views[4], views[5], views[3])
        self.ids = np.frombuffer(views[6], f"<u{self.width}")

    def end(self, k: int) -> int:
        """Where document k ends."""
        return self.ends[k]

    def doc_id(self, k: int) -> int:
        return (self.numbers[k] + self.first + 2**63) % 2**64 - 2**63

    def document(self, k: int) -> np.ndarray:
        return self.ids[self.end(k - 1) if k else 0 : self.end(k)]


KIND = "part int, segment int, before long, n_docs long, n_ids long, data binary"
_ROW = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])


def _encoded(batches: Iterator[pa.RecordBatch], path: str, by_word: bool, end_id: int) -> Iterator[pa.RecordBatch]:
    """doc_id, body, text as doc_id, body, ids."""
    encode = encoder(path, by_word)
    last = np.array([end_id], encode.kind).tobytes()
    for whole in batches:
        for start in range(0, whole.num_rows, 1000):
            batch = whole.slice(start, 1000)
            ids = pa.array((encode(batch.column(2)[k].as_py()) + last for k in range(batch.num_rows)), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], names=["doc_id", "body", "ids"])


def _segments(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows of doc_id and ids, in order, as segments."""
    part, segment, before, ids, docs, packed, full = TaskContext.get().partitionId(), 0, 0, 0, [], [], SEGMENT_IDS * width

    def block() -> pa.RecordBatch:
        row = {"part": part, "segment": segment, "before": before, "n_docs": len(docs), "n_ids": ids // width, "data": segment_bytes(docs, packed, width)}
        return pa.RecordBatch.from_pylist([row], schema=_ROW)

    for batch in batches:
        for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            docs.append(name)
            packed.append(data)
            ids += len(data)
            if ids >= full:
                yield block()
                segment, before, ids, docs, packed = segment + 1, before + ids // width, 0, [], []
    if docs:
        yield block()


def write(docs: DataFrame, out: str, tokenizer: str, end_id: int, by_word: bool = False) -> DataFrame:
    """Writes the segments of docs to the table `out` and returns it."""
    at, width = work_dir(docs.sparkSession), encoder(tokenizer, by_word).width
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_of().alias("text")).select("doc_id", F.xxhash64("text").alias("body"), "text")
    encoded = written(rows.mapInArrow(lambda b: _encoded(b, tokenizer, by_word, end_id), "doc_id long, body long, ids binary"), f"{at}/encoded", **_BLOBS)
    ordered = encoded.repartitionByRange("doc_id", "body").sortWithinPartitions("doc_id", "body", "ids").select("doc_id", "ids")
    ordered.mapInArrow(lambda b: _segments(b, width), KIND).write.mode("overwrite").option("compression", "zstd").parquet(out)
    removed(docs.sparkSession, f"{at}/encoded")
    return docs.sparkSession.read.schema(KIND).parquet(out)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            segment, first = Segment(batch.column(1)[k].as_py()), batch.column(0)[k].as_py()
            ids, starts, sums, names = segment.ids.astype("<u4"), [0], [], []
            for d in range(segment.n):
                names.append(segment.doc_id(d))
                starts.append(segment.end(d))
                sums.append(zlib.crc32(ids[starts[-2] : starts[-1]]))
            ends, names = np.array(starts, np.int64), np.array(names, np.int64)
            named = pa.array(names, mask=names == NO_ID)
            yield pa.RecordBatch.from_arrays([named, pa.array(ends[:-1] + first), pa.array(np.diff(ends)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read(table: DataFrame) -> DataFrame:
    """A row per document of the segments: doc_id, start, n_tokens, ids_crc32."""
    at = work_dir(table.sparkSession)
    parts = table.groupBy("part").agg(F.max(F.col("before") + F.col("n_ids")).alias("ids"))  # as many rows as range partitions
    sums = parts.select("part", (F.sum("ids").over(W.orderBy("part")) - F.col("ids")).alias("offset"))
    placed = table.join(sized(written(sums, f"{at}/parts")), "part").select((F.col("before") + F.col("offset")).alias("first"), "data")
    return placed.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def export(table: DataFrame, folder: str) -> int:
    """Copies the blocks of a table to files part-segment.tlef of a folder that this process sees; one block at a time is in memory."""
    n = 0
    for n, row in enumerate(table.select("part", "segment", "data").toLocalIterator(), 1):
        with open(f"{folder}/{row.part:06d}-{row.segment:06d}.tlef", "wb") as file:
            file.write(row.data)
    return n
