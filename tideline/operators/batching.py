"""Queues and publish batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.ordering import ordinal


def queue_depths(rows: DataFrame, queue: str = "queue") -> DataFrame:
    return rows.groupBy(queue).agg(F.count(F.lit(1)).alias("depth"))


#: Rows of a queue that are handed over together, as a micro-batch.
FLUSH = 256


def batch_rows(most: int, flush: int = FLUSH) -> int:
    """Rows of a full publish batch: whole micro-batches, as many as reach `most`."""
    return -(-most // flush) * flush


def publish_batches(rows: DataFrame, most: int, flush: int = FLUSH, queue: str = "queue", order: str = "seq_no", part: str = "file", counted: DataFrame | None = None) -> DataFrame:
    """rows with batch: a queue's rows wait in micro-batches of `flush`, and whole ones are drained until a batch has `most` rows or more.

    `counted` may give the same rows' queues and parts by a shorter plan.
    """
    placed = ordinal(rows, "_k", order, [queue], part, counted)
    return placed.withColumn("batch", F.floor((F.col("_k") - 1) / batch_rows(most, flush))).drop("_k")


def drained(micro_batches: list[int], most: int) -> list[int]:
    """Sizes of the publish batches drained from micro-batches that wait in a queue: a whole one is added while there is room at all."""
    out, size = [], 0
    for n in micro_batches:
        size += n
        if size >= most:
            out.append(size)
            size = 0
    return [*out, size] if size else out


def newest_event(rows: DataFrame) -> DataFrame:
    """newest_ms: the greatest event time; times of 0 and before don't count."""
    ms = F.unix_millis("occurred_at")
    return rows.agg(F.max(F.when(ms > 0, ms)).alias("newest_ms"))


def in_queues(rows: DataFrame, queues: int, key: str = "key", order: str = "seq_no") -> DataFrame:
    """rows dealt by key, each key's rows in order."""
    return rows.repartition(queues, key).sortWithinPartitions(key, order)
