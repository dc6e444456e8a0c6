"""Connected components of a graph given by its edges.

Edges are rows (u, v), or stars: rows (u, v) with an array v of neighbours of u, which a hub of many edges takes less of.
Tasks first replace the edges of a partition by a spanning forest, as stars. When all edges that are left fit in one bounded
task (a count shows it), that task's forest is the answer. Else a large star links each larger neighbour of a node to
the least neighbour and a small star each smaller one; both keep the components, and shorten all paths to their least
node, so that rounds grow with the logarithm of the longest path. Every round is written to the shared folder; nothing
is collected. A node with very many neighbours is aggregated map-side, and its rows meet the one row of its least
neighbour in a broadcast of checked size or in a join whose partitions Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import removed, sized, work_dir, written

#: Edges that one task may hold.
MOST_EDGES = 500_000


def forest(edges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest of the edges: each node but the roots with its root, the least node it reaches."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, r) for x in list(parent) if (r := root(x)) != x]


STARS = "u long, v array<long>"
_MOST_IN_A_ROW = 4096


def stars(edges: Iterable[tuple[int, int]]) -> pa.RecordBatch:
    """Edges (node, root) as rows of STARS."""
    by_root: dict[int, list[int]] = {}
    for node, root in edges:
        by_root.setdefault(root, []).append(node)
    rows = [(r, nodes[k : k + _MOST_IN_A_ROW]) for r, nodes in by_root.items() for k in range(0, len(nodes), _MOST_IN_A_ROW)]
    u, v = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.list_(pa.int64()))], names=["u", "v"])


def _edges(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if isinstance(v, list):
            yield from ((u, x) for x in v)
        else:
            yield u, v


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as spanning forests, one of every MOST_EDGES edges."""
    held: list[tuple[int, int]] = []
    for batch in batches:
        held += _edges(batch)
        if len(held) > MOST_EDGES and len(held := forest(held)) > MOST_EDGES:
            yield stars(held)
            held = []
    yield stars(forest(held))


def components(edges: DataFrame, at: str | None = None) -> DataFrame:
    """(node, root) for each node of the edges between different nodes; root is the least node of its component. Tables are written to `at`."""
    spark, at = edges.sparkSession, at or work_dir(edges.sparkSession)
    now, k = written(edges.select("u", "v").mapInArrow(_forests, STARS), f"{at}/0"), 0
    while True:
        k += 1
        if (now.agg(F.sum(F.size("v"))).first()[0] or 0) <= MOST_EDGES:
            after = written(now.coalesce(1).mapInArrow(_forests, STARS), f"{at}/{k}")
            removed(spark, f"{at}/{k - 1}")
            break
        flat = now.select(F.explode("v").alias("u"), F.col("u").alias("v"))
        before = _state(flat)
        shorter = _shortened(flat, f"{at}/{k}-stars")
        if _state(shorter) == before:
            after = now
            break
        now = written(shorter.mapInArrow(_forests, STARS), f"{at}/{k}")
        removed(spark, f"{at}/{k - 1}")
        removed(spark, f"{at}/{k}-stars")
    # now every edge leads from a node to its root
    nodes = after.select(F.explode("v").alias("node"), F.col("u").alias("root"))
    return nodes.unionByName(after.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _shortened(now: DataFrame, path: str) -> DataFrame:
    both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{path}-large")
    large = both.where("v > u").join(sized(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    large = written(large, f"{path}-edges")
    least = written(large.groupBy("u").agg(F.min("v").alias("m")), f"{path}-small")
    moved = large.join(sized(least), "u")
    small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
    after = written(small, path)
    for gone in ("large", "edges", "small"):
        removed(now.sparkSession, f"{path}-{gone}")
    return after


def _state(edges: DataFrame) -> tuple[int, str]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], str(row[1])
