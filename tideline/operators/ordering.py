"""Order of a log: sequence numbers, order within transactions, committed positions.

A window over the whole log would put all rows into one task. Instead every ordinal and running value is taken
within the log's files and joined with the totals of the files before, of which there is a row a file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _joined(rows: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An equi-join on the keys by which the windows have dealt the rows already, so that only `small` moves. Keys are not null."""
    return rows.join(small, list(keys), "left")


def ordinal(rows: DataFrame, name: str, order: str = "log_seq", within: Sequence[str] = (), part: str = "file", counted: DataFrame | None = None) -> DataFrame:
    """rows with `name`: the contiguous ordinal from 1 in ascending `order`, within groups; `part` ascends with the order.

    `counted` may give the same rows by a shorter plan, of which only the groups and the part are read.
    """
    counts = (rows if counted is None else counted).groupBy(*within, part).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*within).orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*within, part, before.alias("_start"))
    local = F.row_number().over(W.partitionBy(*within, part).orderBy(order))
    return _joined(rows.withColumn("_local", local), starts, [*within, part]).withColumn(name, (F.col("_local") + F.col("_start")).cast("long")).drop("_local", "_start")


def last_before(rows: DataFrame, name: str, value: Column, order: str = "log_seq", part: str = "file") -> DataFrame:
    """rows with `name`: the last non-null `value` of a row strictly before, over all parts."""
    rows = rows.withColumn("_v", value)
    lasts = rows.groupBy(part).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_last"))
    carried = lasts.select(part, F.last("_last", ignorenulls=True).over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    local = F.last("_v", ignorenulls=True).over(W.partitionBy(part).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return _joined(rows.withColumn("_local", local), carried, [part]).withColumn(name, F.coalesce("_local", "_carried")).drop("_v", "_local", "_carried")


def tx_order(rows: DataFrame, name: str = "tx_order", transaction: Sequence[str] = ("file", "gtid"), order: Sequence[str] = ("log_seq",)) -> DataFrame:
    """rows with their ordinal in the transaction. Comes before any filter, for rows that are filtered out count."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*transaction).orderBy(*order)).cast("int"))


def current_file(log: DataFrame) -> DataFrame:
    """log with current_file: the file that the last rotation named, the record's own before any."""
    return last_before(log, "_rotated", F.col("next_file")).withColumn("current_file", F.coalesce("_rotated", "file")).drop("_rotated")


def with_transactions(log: DataFrame) -> DataFrame:
    """Raw records with what the open transaction gives them.

    gtid: of the transaction a record lies in; tx_no: a number of the transaction in its file; committed_file,
    committed_pos, committed_gno: where the last transaction before it ended. A transaction begins with its gtid record (or
    BEGIN), ends with xid or any other query record, and does not cross files.
    """
    from tideline.functions.gtids import gtid, is_ddl

    by_file = W.partitionBy("file").orderBy("log_seq")
    ends = (F.col("kind") == "xid") | ((F.col("kind") == "query") & is_ddl(F.col("query")))
    before = by_file.rowsBetween(W.unboundedPreceding, -1)
    opened = F.when(F.col("kind") == "gtid", F.struct("log_seq", gtid(F.col("sid"), F.col("gno")).alias("gtid"), "gno"))
    log = log.withColumn("tx_no", F.coalesce(F.sum(ends.cast("long")).over(before), F.lit(0)))
    log = log.withColumn("_open", F.last(opened, ignorenulls=True).over(W.partitionBy("file", "tx_no").orderBy("log_seq")))
    log = log.withColumn("gtid", F.col("_open.gtid"))
    end = F.when(ends, F.struct(F.col("file").alias("file"), F.col("pos").alias("pos"), F.col("_open.gno").alias("gno")))
    log = last_before(log, "committed", end)
    return log.select("*", F.col("committed.file").alias("committed_file"), F.col("committed.pos").alias("committed_pos"), F.col("committed.gno").alias("committed_gno")).drop("_open", "committed")


def log_head(log: DataFrame) -> DataFrame:
    """file, pos: the current coordinates of the log; no row means that there is no log."""
    head = log.agg(F.max_by(F.struct("file", "pos"), "log_seq").alias("head"))
    return head.select("head.file", "head.pos").where("file is not null")
