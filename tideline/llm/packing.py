"""Best-fit packing of documents into bins of a fixed number of words, under conflicts.

A document longer than a bin is cut into full pieces, each a bin of its own, and a rest that is packed.
No bin holds two documents of one source or of one cluster of duplicates. Bins stand in order of what is
left in them and carry a bitmap of their sources and one of their clusters; a document looks at the bin
with the least room that takes it, and goes on to the next until one is compatible, else it opens a bin.

Documents are dealt by a hash into shards of about SHARD pieces, at every size of the table, and each shard is packed on its own, in
descending size: a task holds the narrow rows of one shard only, whatever source or cluster they have. Equal rows are told
apart by an ordinal, so that they spread over shards too. Pieces and bins are named by what they hold: reruns agree.

Cases: a null or empty text has size 0 and is packed without taking room; null sources conflict with each
other, as one source does; repeated rows are duplicates and never share a bin; an empty table gives an empty
result; a null doc_id is packed as any other.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import each_row, n_words, normalised, work_dir, written

SHARD = 4096
SCHEMA = "doc_id long, piece long, size long, source string, cluster long, bin_id string, bin_used long"


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """The bin of each item, in the given order. sources and clusters are bitmaps with a bit each, or 0 for no conflict."""
    rooms: list[int] = []  # what is left, ascending, each value once
    bins: dict[int, list[int]] = defaultdict(list)  # bins by what is left, oldest first
    has_source: list[int] = []
    has_cluster: list[int] = []
    placed = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        k = bisect_left(rooms, size)
        found = -1
        while k < len(rooms):  # successors, tightest first
            room = rooms[k]
            for b in bins[room]:
                if not has_source[b] & source and not has_cluster[b] & cluster:
                    found = b
                    break
            if found >= 0:
                break
            k += 1
        if found >= 0:
            bins[room].remove(found)
            if not bins[room]:
                del bins[room], rooms[k]
        else:
            found, room = len(has_source), capacity
            has_source.append(0)
            has_cluster.append(0)
        has_source[found] |= source
        has_cluster[found] |= cluster
        room -= size
        if room not in bins:
            insort(rooms, room)
        insort(bins[room], found)
        placed.append(found)
    return placed


def bits(values: list, apart: bool = False) -> list[int]:
    """A bit for each value. apart: values that occur once conflict with nothing and get none."""
    counts, at = Counter(values), {}
    return [0 if apart and counts[v] == 1 else 1 << at.setdefault(v, len(at)) for v in values]


def pack_shard(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    rows = rows.sort_values(["size", "doc_id", "piece", "cluster", "source", "copy"], ascending=[False] + [True] * 5, kind="stable").reset_index(drop=True)
    sources = [None if pd.isna(s) else s for s in rows["source"]]
    placed = best_fit(rows["size"].tolist(), bits(sources), bits(rows["cluster"].tolist(), True), capacity)
    used = rows.groupby(pd.Series(placed))["size"].transform("sum")
    shard = int(rows["shard"].iloc[0]) if len(rows) else 0
    return rows.assign(bin_id=[f"{shard}-{b}" for b in placed], bin_used=used)[["doc_id", "piece", "size", "source", "cluster", "bin_id", "bin_used"]]


def pack(docs: DataFrame, capacity: int = 2048, shard: int = SHARD) -> DataFrame:
    """A row per piece of a document: SCHEMA. bin_id names the bin, bin_used is the number of words in it."""
    at = work_dir(docs.sparkSession)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words().alias("words"), F.xxhash64(normalised()).alias("cluster"))
    sizes = written(each_row(named), f"{at}/sizes")
    full = F.floor(F.col("words") / capacity)
    pieces = sizes.select("*", full.alias("full"), (F.col("words") - full * capacity).alias("rest"))
    rest = pieces.where((F.col("rest") > 0) | (F.col("words") == 0)).select("doc_id", F.col("full").alias("piece"), F.col("rest").alias("size"), "source", "cluster", "copy")
    shards = max(1, -(-sizes.count() // shard))
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "copy", F.lit("shard")), F.lit(shards)))
    packed = dealt.groupBy("shard").applyInPandas(lambda rows: pack_shard(rows, capacity), SCHEMA)
    whole = pieces.where("full > 0").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece"), "source", "cluster", "copy")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    name = F.concat_ws("-", F.lit("full"), text("doc_id"), F.lpad(F.hex("cluster"), 16, "0"), F.lpad(F.hex(F.xxhash64("source")), 16, "0"), text("copy"), text("piece"))
    alone = whole.select("doc_id", "piece", F.lit(capacity).cast("long").alias("size"), "source", "cluster", name.alias("bin_id"), F.lit(capacity).cast("long").alias("bin_used"))
    return packed.unionByName(alone)


def pieces_of(text: str | None, capacity: int) -> Iterator[str]:
    """The texts of the pieces, in order: words joined by one space."""
    words = (text or "").encode().split()
    for k in range(0, max(1, len(words)), capacity):
        yield b" ".join(words[k : k + capacity]).decode()
