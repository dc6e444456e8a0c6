"""Jaccard self-join of documents on their word n-grams: a size-aware heavy-light join.

Two sets of n and m shingles link when their intersection i satisfies 100 i >= T (n + m - i).

Shingles have one order: by the number of texts that hold them, rarest first, then by hash. A set of n shingles shares
with any linked one at least one of its rarest n - ceil(T n / 100) + 1, its prefix.

Light sets (few shingles) are listed under every subset that a linked set can have in common with them: subsets of
each fixed size c from ceil(T n / 100) to n. Two light sets link only if they share such a subset for c = i.

Heavy sets scan the inverted lists of the shingles of their prefix. A shingle that only one text holds has nothing to
scan, so a set whose prefix holds such ones only is done; a passage that many documents share lies behind the prefix
of all documents of which it isn't most. Light sets stand on the inverted lists too where a heavy set could link.

The boundary between light and heavy is chosen by cost, from the data: for each size up to MOST_LIGHT the lists under
subsets are counted against the lengths of the inverted lists that the sets of this size would scan.

The frequencies are exact and cover all texts. Documents are taken in chunks; a chunk sends its distinct shingles with their
counts to slots (ranges of hashes), a slot adds up and answers with those that occur more than once. Chunks and slots
both grow with the root of the input beyond a size, so that a message keeps a worthwhile length.

Sets with equal content are one class from the start (a hot group of copies is one row a chunk), and a list is a row a
task before the shuffle. Lists are grouped into candidate components; each is cut into cells of bounded size, bands of
size against neighbouring bands, slots against slots, and a cell counts all intersections of its sets exactly and
returns a spanning forest of the links. No pairs of a group are emitted. Components of these links are the result.
A candidate component too large for one cell is first compared with one of its members, in one pass: those linked with it
need no comparison among each other, and by the triangle inequality of Jaccard distance only few others can link with them.

Shingles and classes are 64-bit hashes: among 1e8 different sets the chance that any two share a class is
3e-4; among 5e10, some 70 pairs would. Frequencies and lists take 48 bits of a shingle, since a chance meeting there
changes the order or adds a candidate only.

Cases: a null or empty text, or one without words, has an empty set and links with nothing; a text of fewer
words than a shingle is one shingle; repeated rows are copies; a null doc_id takes part, and is never the least
of a component unless all its ids are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from itertools import combinations
from math import comb, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import packed, released, removed, sized, text_of, unpacked, work_dir, written
from tideline.llm.components import STARS, components, forest, stars

MOST_MEMBERS, MOST_SHINGLES = 512, 500_000
MOST_LIGHT = 64
MOST_WORDS = 100_000  # whose hashes a task remembers, at some 500 bytes each
LEADERS = 4
CHUNK, SLOT_BYTES, SLOTS = 1_000_000, 4_000_000, 64
GROWS_FROM = 1 << 40  # bytes of text from which chunks and slots grow, by its root and up to 16 times
_BITS = np.uint64(16)  # that frequencies and lists leave out
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BLOBS = {"parquet.block.size": 16 << 20, "parquet.enable.dictionary": False}  # a writer holds a block in memory


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M1
    return x ^ (x >> np.uint64(32))


class _Words(dict):
    """Hashes of words; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def _let_go() -> None:
    """Gives back what a task no longer needs: its worker stays, idle beside the busy ones, for as long as Spark has tasks."""
    _words.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps what many small arrays leave
        trim(0)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the shingles of a UTF-8 text: A-Z in lower case, words apart by ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    rows = len(words) - width + 1
    out = np.full(rows, width, np.uint64)
    for k in range(width):
        out = _mix(out + hashes[k : k + rows] * _M1)
    return np.unique(out)


def class_of(shingles: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - 2**63


def least_overlap(n: int, percent: int) -> int:
    """How many shingles a set of n must share with any linked one."""
    return -(-percent * n // 100)


def n_subsets(n: int, percent: int) -> int:
    """Lists that a light set of n shingles stands under."""
    return sum(comb(n, d) for d in range(n - least_overlap(n, percent) + 1))


def subsets(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Names of the subsets of each size that a linked set can share, by their sums of weights."""
    weights = _mix(shingles ^ _M1)
    whole, n = weights.sum(dtype=np.uint64), len(shingles)
    sums = []
    for d in range(n - least_overlap(n, percent) + 1):
        size = np.uint64((n - d) * int(_M2) & (2**64 - 1))
        left = weights[np.array(list(combinations(range(n), d)), np.int64)].sum(axis=1, dtype=np.uint64) if d else np.zeros(1, np.uint64)
        sums.append(_mix((whole - left) ^ size))
    return np.concatenate(sums)


def boundary(costs: dict[int, tuple[int, int, int]], percent: int) -> int:
    """The size up to which sets are light, for the least cost. costs: by size, number of sets, entries on inverted lists, and rows that scanning these reads."""

    def cost(b: int) -> int:
        total = 0
        for n, (sets, entries, scanned) in costs.items():
            if n > b:
                total += entries + scanned
            else:
                total += sets * n_subsets(n, percent) + (entries if n >= least_overlap(b + 1, percent) else 0)
        return total

    best, least = 0, None
    for b in range(MOST_LIGHT + 1):
        if b and n_subsets(b, percent) > 1 << 20:  # no list could be that long for one set
            break
        if least is None or (c := cost(b)) <= least:
            best, least = b, cost(b)
    return best


_SENT = "chunk long, slot int, sent binary"


def _sent(chunks: list[int], slots: list[int], sent: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(slots, pa.int32()), pa.array(sent, pa.binary())], names=["chunk", "slot", "sent"])


class _Chunk:
    """Documents of a chunk while they are gathered."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.keys: list[int] = []
        self.of: list[int] = []  # by document: place of its class, -1 without words
        self.places: dict[int, int] = {}
        self.first: list[int] = []  # by class: its first document
        self.sets: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, key: int, shingles: np.ndarray) -> None:
        at = -1
        if len(shingles):
            cls = class_of(shingles)
            if (at := self.places.get(cls, -1)) < 0:
                at = self.places[cls] = len(self.sets)
                self.sets.append(shingles)
                self.size += len(shingles)
        self.ids.append(doc_id)
        self.keys.append(key)
        self.of.append(at)
        self.size += 1

    def rows(self, chunk: int, slots: int) -> pa.RecordBatch:
        """The chunk itself, under a negative slot, and its message to each slot: ascending hashes as differences, and in how many of its classes each occurs."""
        sizes = np.array([len(s) for s in self.sets], np.int64)
        hashes = np.concatenate([np.zeros(0, np.uint64), *self.sets]) >> _BITS
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.zeros(0, np.int64)
        counts, hashes = np.diff(first, append=len(owner)).astype(np.int32), hashes[first]
        light = np.concatenate([np.zeros(0, np.uint64), *(s for s in self.sets if len(s) <= MOST_LIGHT)])
        known = np.array([i is not None for i in self.ids], bool)
        head = packed(
            np.array([i or 0 for i in self.ids], np.int64), known, np.array(self.keys, np.int64), np.array(self.of, np.int32),
            np.array(list(self.places), np.int64), sizes.astype(np.int32), owner, counts, light,
        )
        ends = np.searchsorted(hashes, np.array([-(-(k << 48) // slots) for k in range(1, slots + 1)], np.uint64))
        at, to, sent = 0, [-1 - chunk % 997], [head]
        for slot, end in enumerate(ends.tolist()):
            if end > at:
                to.append(slot)
                sent.append(packed(np.array([at], np.int64), np.diff(hashes[at:end], prepend=np.uint64(0)), counts[at:end]))
            at = end
        return _sent([chunk] * len(to), to, sent)


_HEAD = (np.int64, bool, np.int64, np.int32, np.int64, np.int32, np.int32, np.int32, np.uint64)


def _chunked(batches: Iterator[pa.RecordBatch], size: int, slots: int, words: int) -> Iterator[pa.RecordBatch]:
    """Rows of doc_id, key, text as chunks and their messages. Names follow from the partition, so that a task that runs again sends the same."""
    chunk, name = _Chunk(), TaskContext.get().partitionId() << 32
    for batch in batches:
        ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for k in range(batch.num_rows):
            chunk.add(ids[k], keys[k], shingle_set(batch.column(2)[k].as_buffer().to_pybytes(), size))
            if chunk.size >= words:
                yield chunk.rows(name, slots)
                chunk, name = _Chunk(), name + 1
    if chunk.ids:
        yield chunk.rows(name, slots)
    del chunk
    _let_go()


def _answers(table: pa.Table) -> pa.Table:
    """To each message of a slot, those of its hashes that occur more than once in the corpus, with their places and frequencies. A chunk passes."""
    if table["slot"][0].as_py() < 0:
        return table
    sent = [unpacked(b, np.int64, np.uint64, np.int32) for b in table["sent"].to_pylist()]
    hashes = [np.cumsum(m[1], dtype=np.uint64) for m in sent]
    found, at = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([m[2] for m in sent]), minlength=len(found)).astype(np.int64)[at]
    out, done = [], 0
    for m, h in zip(sent, hashes, strict=True):
        df = total[done : done + len(h)]
        done += len(h)
        several = np.flatnonzero(df > 1)
        out.append(packed(several + m[0][0], h[several], df[several]))
    return pa.table({"chunk": table["chunk"], "slot": table["slot"], "sent": pa.array(out, pa.binary())})


_LISTED = "list long, cls long, n int, df long"


def _prefixes(table: pa.Table, percent: int) -> pa.Table:
    """Of each class of a chunk, the shingles of its prefix that other texts hold too: (list, cls, n, df)."""
    found = dict(zip(table["slot"].to_pylist(), table["sent"].to_pylist(), strict=True))
    _, _, _, _, cls, sizes, owner, counts, _ = unpacked(found.pop(min(found)), *_HEAD)
    answers = [unpacked(found[s], np.int64, np.uint64, np.int64) for s in sorted(found)]
    places, hashes, df = (np.concatenate([np.zeros(0, kind), *(a[k] for a in answers)]) for k, kind in enumerate((np.int64, np.uint64, np.int64)))
    starts = np.cumsum(counts) - counts
    many = counts[places]
    each = np.repeat(starts[places] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    of, hashes, df = owner[each], np.repeat(hashes, many), np.repeat(df, many)
    n = sizes.astype(np.int64)
    prefix = n + percent * n // -100 + 1  # n - ceil(T n / 100) + 1
    need = prefix - (n - np.bincount(of, minlength=len(n)))  # of those that others hold too
    wanted = need[of] > 0
    of, hashes, df = of[wanted], hashes[wanted], df[wanted]
    order = np.lexsort((hashes, df, of))
    of, hashes, df = of[order], hashes[order], df[order]
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    taken = rank < need[of]
    of = of[taken]
    return pa.table({"list": hashes[taken].view(np.int64), "cls": cls[of], "n": sizes[of], "df": df[taken]})


_NAMED = "doc_id long, key long, cls long, n long"


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, key, class and size of the documents of chunks."""
    for batch in batches:
        for data in batch.column(0).to_pylist():
            ids, known, keys, of, cls, sizes, *_ = unpacked(data, *_HEAD)
            none = of < 0
            cls, sizes = np.append(cls, 0), np.append(sizes, 0).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(keys), pa.array(cls[of], mask=none), pa.array(sizes[of])], names=["doc_id", "key", "cls", "n"])


def _light(batches: Iterator[pa.RecordBatch], percent: int, most: int) -> Iterator[pa.RecordBatch]:
    """(list, cls) of the light sets of chunks: their subsets. A negative list, so that none meets a shingle's."""
    for batch in batches:
        for data in batch.column(0).to_pylist():
            _, _, _, _, cls, sizes, _, _, light = unpacked(data, *_HEAD)
            stored = np.flatnonzero(sizes <= MOST_LIGHT)
            ends = np.cumsum(sizes[stored])
            mine = [(k, light[e - sizes[k] : e]) for k, e in zip(stored.tolist(), ends.tolist(), strict=True) if sizes[k] <= most]
            found = [subsets(s, percent) for _, s in mine]
            lists = (np.concatenate([np.zeros(0, np.uint64), *found]) | np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(lists), pa.array(np.repeat(cls[[k for k, _ in mine]] if mine else cls[:0], [len(f) for f in found]))], names=["list", "cls"])


_REDUCED = "list long, u long, v array<long>"


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's part of each list as one row (list, one of its classes), and stars (null, u, v) that tie the others to it."""

    def rows(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        lists, cls = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((cls, lists))
        lists, cls = lists[order], cls[order]
        new = np.concatenate(([True], lists[1:] != lists[:-1]))
        first = np.flatnonzero(new)
        lead = cls[first][np.cumsum(new) - 1]
        pairs = np.unique(np.stack([cls, lead])[:, cls != lead], axis=1)
        tied = stars(forest(zip(*pairs.tolist(), strict=True)))
        u, v = pa.array(np.concatenate([cls[first], tied.column(0).to_numpy()])), pa.concat_arrays([pa.nulls(len(first), pa.list_(pa.int64())), tied.column(1)])
        names = pa.concat_arrays([pa.array(lists[first]), pa.nulls(len(tied), pa.int64())])
        return pa.RecordBatch.from_arrays([names, u, v], names=["list", "u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= 2_000_000:
            yield rows(held)
            held, n = [], 0
    if n:
        yield rows(held)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate edges between the classes on the lists of one partition: a spanning forest, as stars."""
    found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    edges: list[tuple[int, int]] = []
    if found:
        lists, cls = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        order = np.argsort(lists, kind="stable")
        lists, cls = lists[order], cls[order]
        same = np.flatnonzero(lists[1:] == lists[:-1])
        pairs = np.stack([cls[same], cls[same + 1]])
        pairs = np.unique(np.sort(pairs[:, pairs[0] != pairs[1]], axis=0), axis=1)
        edges = forest(zip(*pairs.tolist(), strict=True))
    yield stars(edges)


def links(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among the sets, as positions. All intersections are counted, by inverted lists of the shingles."""
    m, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    if m == 2:
        common = np.intersect1d(*sets, assume_unique=True).size
        return iter([(0, 1)] if 100 * common >= percent * (sizes.sum() - common) else [])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.concatenate(([True], values[1:] != values[:-1]))
    column = np.cumsum(first) - 1
    several = np.bincount(column)[column] > 1
    owner, column = owner[several], column[several]
    common = np.zeros((m, m), np.float32)
    if len(column):
        _, column = np.unique(column, return_inverse=True)
        step = max(64, 4_000_000 // m)
        for start in range(0, int(column[-1]) + 1, step):
            a, b = np.searchsorted(column, [start, start + step])
            has = np.zeros((m, step), np.float32)
            has[owner[a:b], column[a:b] - start] = 1
            common += has @ has.T
    common = common.astype(np.int64)
    i, j = np.nonzero(np.triu(100 * common >= percent * (sizes[:, None] + sizes[None, :] - common), 1))
    return iter(forest(zip(i.tolist(), j.tolist(), strict=True)))


def _checked(cell: pd.DataFrame, percent: int) -> pd.DataFrame:
    edges = []
    for _, part in cell.groupby("comp", sort=False):
        part = part.drop_duplicates("cls")
        cls = part["cls"].tolist()
        if len(cls) > 1:
            edges += [(cls[i], cls[j]) for i, j in links([np.frombuffer(s, np.uint64) for s in part["shingles"]], percent)]
    return pd.DataFrame(edges, columns=["u", "v"], dtype="int64")


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows of text, cls and others: the text's set in place of the text, where it is that of the class and new to the task."""
    seen: set[int] = set()
    for whole in batches:
        for start in range(0, whole.num_rows, 500):
            batch = whole.slice(start, 500)
            found: list[bytes | None] = []
            for k, cls in enumerate(batch.column(1).to_pylist()):
                shingles = None if cls in seen else shingle_set(batch.column(0)[k].as_buffer().to_pybytes(), size)
                if shingles is None or not len(shingles) or class_of(shingles) != cls:
                    found.append(None)
                    continue
                if len(seen) < 2_000_000:
                    seen.add(cls)
                found.append(shingles.tobytes())
            sets = pa.array(found, pa.binary())
            names = [*whole.schema.names[1:], "shingles"]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], sets], names=names).filter(sets.is_valid())
    _let_go()


def _measured(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows of cls, comp, n, set and the set of the component's leader: the Jaccard distance in place of the sets."""
    for batch in batches:
        apart, linked = [], []
        for data, leader in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            a, b = np.frombuffer(data, np.uint64), np.frombuffer(leader, np.uint64)
            common = np.intersect1d(a, b, assume_unique=True).size
            apart.append(1 - common / (len(a) + len(b) - common))
            linked.append(100 * common >= percent * (len(a) + len(b) - common))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(apart, pa.float64()), pa.array(linked, pa.bool_())], names=["cls", "comp", "n", "apart", "linked"])


def _large(members: DataFrame) -> DataFrame:
    """The components that do not fit in a cell."""
    stats = members.groupBy("comp").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    return stats.where((F.col("members") > MOST_MEMBERS) | (F.col("shingles") > MOST_SHINGLES)).select("comp")


def _led(members: DataFrame, texts: DataFrame, classes: DataFrame, size: int, percent: int, at: str) -> tuple[DataFrame, DataFrame | None]:
    """members with large components replaced by what one pass against a leader each leaves to compare, and the links found.

    All sets linked with the leader are one component. With r the greatest distance among them, a set farther from the leader
    than r + 1 - T links with none of them; and a nearer one only with those whose distance to the leader differs by 1 - T at most.
    """
    stored, links_found, most = None, None, 1 - percent / 100 + 1e-9
    for turn in range(LEADERS):
        large = written(_large(members), f"{at}/large-{turn}")
        if large.isEmpty():
            break
        inside = written(members.join(sized(large), "comp", "left_semi").select("cls", "comp", "n"), f"{at}/inside-{turn}")
        if stored is None:
            wanted = written(inside.select("cls").distinct().join(classes, "cls").select("key", "cls"), f"{at}/wanted")
            rows = texts.join(sized(wanted), "key").select("text", "cls").mapInArrow(lambda b: _sets(b, size), "cls long, shingles binary")
            stored = written(rows.groupBy("cls").agg(F.first("shingles").alias("shingles")), f"{at}/stored")
        lead = written(inside.groupBy("comp").agg(F.min_by("cls", F.xxhash64("cls", F.lit(turn))).alias("lead")), f"{at}/lead-{turn}")
        leaders = lead.join(stored.withColumnRenamed("shingles", "leader"), F.col("lead") == F.col("cls")).select("comp", "leader")
        leaders = written(leaders, f"{at}/leaders-{turn}")
        pairs = inside.join(stored, "cls").join(sized(leaders), "comp").select("cls", "comp", "n", "shingles", "leader")
        found = written(pairs.mapInArrow(lambda b: _measured(b, percent), "cls long, comp long, n long, apart double, linked boolean"), f"{at}/measured-{turn}")
        reach = found.where("linked").groupBy("comp").agg((F.max("apart") + most).alias("reach"))
        near = (~F.col("linked")) & (F.col("apart") <= F.col("reach"))
        rim = found.join(sized(written(reach, f"{at}/reach-{turn}")), "comp").where(near).groupBy("comp").agg((F.min("apart") - most).alias("inner"), F.first("reach").alias("reach"))
        rim = sized(written(rim, f"{at}/rim-{turn}"))
        on_rim = found.join(rim, "comp").where(near | (F.col("linked") & (F.col("apart") >= F.col("inner"))))
        named = lambda rows, name: rows.select("cls", F.xxhash64("comp", F.lit(turn), F.lit(name)).alias("comp"), "n")
        again = named(found.where("not linked"), "rest").unionByName(named(on_rim, "rim"))
        linked = found.where("linked").join(sized(lead), "comp").where("cls <> lead").select(F.col("lead").alias("u"), F.col("cls").alias("v"))
        links_found = linked if links_found is None else links_found.unionByName(linked)
        members = written(members.join(sized(large), "comp", "left_anti").select("cls", "comp", "n").unionByName(again), f"{at}/members-{turn}")
    if stored is not None:
        removed(members.sparkSession, f"{at}/stored")
    return members, links_found


def _cells(members: DataFrame, percent: int, at: str) -> DataFrame:
    """(cls, cells) of the members: cell and component for each that the class belongs to. Two members of a component that can link share a cell."""
    stats = written(members.groupBy("comp").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles")).where("members > 1"), f"{at}/stats")
    is_large = (F.col("members") > MOST_MEMBERS) | (F.col("shingles") > MOST_SHINGLES)
    sides = stats.select("comp", is_large.alias("large"))
    groups = max(1, int(stats.where(~is_large).agg(F.coalesce(F.sum("shingles"), F.lit(0))).first()[0]) // MOST_SHINGLES * 4)
    members = members.join(sized(written(sides, f"{at}/sides")), "comp")
    one = F.array(F.struct(F.pmod(F.xxhash64("comp"), F.lit(groups)).alias("cell"), "comp"))
    small = members.where("not large").select("cls", one.alias("cells"))
    if sides.where("large").isEmpty():
        dealt = small
    else:
        banded = members.where("large").withColumn("band", F.floor(F.log("n") / F.log(F.lit(100 / percent + 0.005))).cast("long"))
        parts = F.ceil(F.greatest(F.count(F.lit(1)) / MOST_MEMBERS, F.sum("n") / MOST_SHINGLES))
        bands = written(banded.groupBy("comp", "band").agg(parts.cast("long").alias("parts")), f"{at}/bands")
        for name, shift in (("own", 0), ("above", -1), ("below", 1)):
            near = bands.select("comp", (F.col("band") + shift).alias("band"), F.col("parts").alias(name))
            banded = banded.join(sized(near), ["comp", "band"], "left")
        slot = F.pmod(F.xxhash64("cls", F.lit("slot")), F.coalesce("own", F.lit(1)))
        upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0).cast("long"), F.col(c) - 1)).otherwise(F.array().cast("array<bigint>"))
        named = lambda *x: F.struct(F.xxhash64("comp", *x).alias("cell"), "comp")
        many = F.concat(
            F.transform(upto("own"), lambda j: named("band", F.lit(0), F.least("slot", j), F.greatest("slot", j))),
            F.transform(upto("above"), lambda j: named("band", F.lit(1), "slot", j)),
            F.transform(upto("below"), lambda j: named(F.col("band") - 1, F.lit(1), j, "slot")),
        )
        dealt = small.unionByName(banded.withColumn("slot", slot).select("cls", many.alias("cells")))
    return dealt.groupBy("cls").agg(F.flatten(F.collect_list("cells")).alias("cells"))


def key_of(docs: DataFrame) -> Column:
    """A 64-bit name of a row's id and text, by which rows are found again."""
    return F.xxhash64(F.col("doc_id").cast("long"), text_of())


def _candidates(texts: DataFrame, size: int, percent: int, at: str, kept: str) -> tuple[DataFrame, DataFrame]:
    """The documents (_NAMED), and candidate edges between classes (STARS): at least one path joins any two that link."""
    spark = texts.sparkSession
    bytes_in = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    grown = min(16, max(1, isqrt(max(1, bytes_in // GROWS_FROM))))
    slots, words = max(SLOTS, bytes_in // (SLOT_BYTES * grown)), CHUNK * grown
    messages = texts.mapInArrow(lambda b: _chunked(b, size, slots, words), _SENT)
    answers = written(messages.groupBy("slot").applyInArrow(_answers, _SENT), f"{at}/answers", **_BLOBS)
    released(spark)
    chunks = answers.where("slot < 0").select("sent")
    documents = written(chunks.mapInArrow(_named, _NAMED), kept)
    listed = written(answers.groupBy("chunk").applyInArrow(lambda t: _prefixes(t, percent), _LISTED), f"{at}/listed")
    released(spark)
    per = {r.n: [r.sets, 0, 0] for r in documents.where(f"n between 1 and {MOST_LIGHT}").groupBy("n").agg(F.count_distinct("cls").alias("sets")).collect()}
    for r in listed.where(f"n <= {MOST_LIGHT}").groupBy("n").agg(F.count(F.lit(1)).alias("entries"), F.sum("df").alias("scanned")).collect():
        per[r.n][1:] = r.entries, r.scanned
    most = boundary({n: tuple(c) for n, c in per.items()}, percent)
    entries = listed.where(F.col("n") >= least_overlap(most + 1, percent)).select("list", "cls")
    # each task passes one Python function: a second one on top would take a second worker, and Spark keeps both
    light = chunks.mapInArrow(lambda b: _reduced(_light(b, percent, most)), _REDUCED)
    reduced = written(entries.mapInArrow(_reduced, _REDUCED).unionByName(light), f"{at}/reduced")
    removed(spark, f"{at}/answers")
    removed(spark, f"{at}/listed")
    lists = reduced.where("list is not null").select("list", F.col("u").alias("cls")).repartition("list").mapInArrow(_met, STARS)
    met = written(lists.unionByName(reduced.where("list is null").select("u", "v")), f"{at}/met")
    removed(spark, f"{at}/reduced")
    released(spark)
    return documents, met


def _joined(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """A row per document: doc_id, key (see key_of), cls, n, root (a class of its component), component_id."""
    at, kept = work_dir(docs.sparkSession), work_dir(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key_of(docs).alias("key"), text_of().alias("text"))
    documents, met = _candidates(texts, size, percent, at, f"{kept}/documents")
    coarse = written(components(met, f"{at}/coarse-rounds"), f"{at}/coarse")
    # of a class, the row with the least known id
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("first")
    classes = written(documents.where("cls is not null").groupBy("cls").agg(first, F.max("n").alias("n")).select("cls", "n", "first.doc_id", "first.key"), f"{at}/classes")
    members = written(classes.select("cls", "n").join(sized(coarse.select(F.col("node").alias("cls"), F.col("root").alias("comp"))), "cls").select("cls", "comp", "n"), f"{at}/members")
    members, led = _led(members, texts, classes, size, percent, at)
    dealt = written(_cells(members, percent, at).join(classes, "cls").select("key", "cls", "cells"), f"{at}/dealt")
    wanted = texts.join(sized(dealt), "key").select("text", "cls", "cells")
    found = wanted.mapInArrow(lambda b: _sets(b, size), "cls long, cells array<struct<cell:long,comp:long>>, shingles binary")
    cells = found.select("cls", "shingles", F.explode("cells").alias("of")).select("cls", "shingles", "of.comp", "of.cell")
    linked = cells.groupBy("cell").applyInPandas(lambda c: _checked(c, percent), "u long, v long")
    linked = written(linked if led is None else linked.unionByName(led), f"{at}/links")
    released(docs.sparkSession)
    exact = written(components(linked, f"{at}/exact-rounds"), f"{at}/exact")
    rooted = classes.join(sized(exact.select(F.col("node").alias("cls"), "root")), "cls", "left").select("cls", "doc_id", F.coalesce("root", "cls").alias("root"))
    rooted = written(rooted, f"{at}/rooted")
    tops = rooted.join(sized(written(exact.select("root").distinct(), f"{at}/roots")), "root", "left_semi").groupBy("root").agg(F.min("doc_id").alias("top"), F.lit(True).alias("several"))
    named = rooted.join(sized(written(tops, f"{at}/tops")), "root", "left")
    named = written(named.select("cls", "root", F.when(F.col("several"), F.col("top")).otherwise(F.col("doc_id")).alias("component_id")), f"{kept}/named")
    removed(docs.sparkSession, at)  # the result reads what is kept only
    with_words = documents.where("cls is not null").join(named, "cls").select("doc_id", "key", "cls", "n", "root", "component_id")
    empty = documents.where("cls is null").select("doc_id", "key", "cls", "n", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    return with_words.unionByName(empty)


def join(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (the least doc_id that links reach, its own included)."""
    return _joined(docs, size, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def representatives(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """One row of docs for each component, the one with the least known doc_id, with the columns of docs. Rows without words all stay."""
    at = work_dir(docs.sparkSession)
    found = written(_joined(docs, size, percent).where("cls is not null").select("doc_id", "key", "root"), f"{at}/found")
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("best"), F.count(F.lit(1)).alias("rows"))
    best = written(best.where("rows > 1").select("root", F.col("best.key").alias("stays")), f"{at}/best")
    others = written(found.join(sized(best), "root").where("key <> stays").select("key").distinct(), f"{at}/others")
    again = written(found.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key"), f"{at}/again")
    named = docs.withColumn("_key", key_of(docs))
    rest = named.join(sized(others.withColumnRenamed("key", "_key")), "_key", "left_anti")
    if again.isEmpty():
        return rest.select(*docs.columns)
    twice = sized(again.withColumnRenamed("key", "_key"))
    one = rest.join(twice, "_key", "left_semi").groupBy("_key").agg(F.first(F.struct(*docs.columns)).alias("_row")).select("_row.*")
    return rest.join(twice, "_key", "left_anti").select(*docs.columns).unionByName(one)
