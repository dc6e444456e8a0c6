"""Audits of what a flow has delivered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_of_each(rows: DataFrame, key: str = "id", arrival: str = "arrival") -> DataFrame:
    """The first arrival of each id, found by a partial aggregation rather than a sort."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*others), arrival).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in others))


def order_violations(rows: DataFrame, key: str = "key", arrival: str = "arrival", seq: str = "seq_no", step: int | None = None) -> DataFrame:
    """Rows whose sequence number does not grow (or, with `step`, does not grow by it) within their key."""
    before = F.lag(seq).over(W.partitionBy(key).orderBy(arrival))
    bad = F.col(seq) <= F.col("previous_seq") if step is None else F.col(seq) != F.col("previous_seq") + step
    return rows.withColumn("previous_seq", before).where(F.col("previous_seq").isNotNull() & bad)


def lifecycle_violations(rows: DataFrame, key: str = "key", seq: str = "seq_no") -> DataFrame:
    """Rows that break c, u.., d: with violation first_not_create, create_again or after_delete."""
    before = F.lag("op").over(W.partitionBy(key).orderBy(seq))
    what = (
        F.when(F.col("previous_op").isNull() & (F.col("op") != "c"), "first_not_create")
        .when(F.col("previous_op") == "d", "after_delete")
        .when(F.col("previous_op").isNotNull() & (F.col("op") == "c"), "create_again")
    )
    return rows.withColumn("previous_op", before).withColumn("violation", what).where("violation is not null")


def op_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("op").agg(F.count(F.lit(1)).alias("n"))


def gaps(rows: DataFrame, number: str, first: int = 1) -> DataFrame:
    """(gap_first, gap_last): the runs of numbers missing between `first` and the greatest.

    Each number is compared with the one before it in its block and with the greatest of the blocks before.
    """
    seen = rows.select(F.col(number).cast("long").alias("s")).where(F.col(number) >= first).distinct().withColumn("b", F.floor(F.col("s") / 65536))
    tops = seen.groupBy("b").agg(F.max("s").alias("top"))
    carried = tops.select("b", F.coalesce(F.max("top").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(first - 1)).alias("before"))
    previous = F.coalesce(F.lag("s").over(W.partitionBy("b").orderBy("s")), F.col("before"))
    return seen.join(carried, "b").withColumn("p", previous).where("s > p + 1").select((F.col("p") + 1).alias("gap_first"), (F.col("s") - 1).alias("gap_last"))


def absent(expected: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The expected ids that no row has."""
    return expected.select(key).join(rows.select(key), key, "left_anti")


def replays(rows: DataFrame, key: str = "id", payload: str = "payload") -> DataFrame:
    """(id, copies, payloads) of the ids that came more than once; payloads over 1 are errors."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("copies"), F.count_distinct(payload).alias("payloads")).where("copies > 1")


def image_violations(rows: DataFrame) -> DataFrame:
    """Rows whose images do not fit their op: c has none before, d none after, u has both, and others must have theirs."""
    b, a = F.col("before").isNull(), F.col("after").isNull()
    good = F.when(F.col("op") == "c", b & ~a).when(F.col("op") == "d", a & ~b).when(F.col("op") == "u", ~b & ~a).otherwise(False)
    return rows.where(~good)


def queue_spread(rows: DataFrame, queue: str = "queue") -> DataFrame:
    return rows.agg(F.count_distinct(queue).alias("queues"))
