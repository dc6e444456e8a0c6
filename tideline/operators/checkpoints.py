"""Gap-free checkpoints: how far all of 1..N is acknowledged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 1 << 16


def prefix(acks: DataFrame, seq: str = "seq_no") -> DataFrame:
    """checkpoint: the highest N with 1..N acknowledged, 0 if 1 is not; one row.

    Numbers are counted in blocks of BLOCK; only the first block that has a gap is looked at by row.
    """
    seqs = acks.select(F.col(seq).cast("long").alias("s")).where("s >= 1").distinct()
    block = F.floor((F.col("s") - 1) / BLOCK)
    blocks = seqs.groupBy(block.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    full = blocks.where(F.col("n") == BLOCK).withColumn("_k", F.row_number().over(W.orderBy("b")) - 1).where("b = _k").agg(F.count(F.lit(1)).alias("full"))
    inside = seqs.crossJoin(F.broadcast(full)).where((F.floor((F.col("s") - 1) / BLOCK)) == F.col("full"))  # full is one row
    ranked = inside.withColumn("_k", F.row_number().over(W.partitionBy("full").orderBy("s")) + F.col("full") * BLOCK)
    more = ranked.where("s = _k").agg(F.count(F.lit(1)).alias("more"))
    return full.crossJoin(F.broadcast(more)).select((F.col("full") * BLOCK + F.col("more")).cast("long").alias("checkpoint"))


def outstanding(acks: DataFrame, seq: str = "seq_no") -> DataFrame:
    """outstanding: how many acknowledged numbers lie beyond the prefix; those below count no more."""
    return acks.select(F.col(seq).alias("s")).distinct().crossJoin(F.broadcast(prefix(acks, seq))).agg(F.coalesce(F.sum((F.col("s") > F.col("checkpoint")).cast("long")), F.lit(0)).alias("outstanding"))


def ticks(acks: DataFrame, tick: str, seq: str = "seq_no") -> DataFrame:
    """(tick, checkpoint) for each tick after which the prefix moved. acks: tick in which a number was acknowledged.

    The prefix after tick t is one less than the least number acknowledged later than t, or never: so it follows from
    the running maximum of ticks over the numbers in order, as far as they are contiguous.
    """
    first = acks.groupBy(F.col(seq).cast("long").alias("s")).agg(F.min(tick).alias("t")).where("s >= 1")
    blocks = first.withColumn("b", F.floor((F.col("s") - 1) / BLOCK))
    sums = blocks.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("m"))
    order = W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("b", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("n0"), F.max("m").over(order).alias("m0"))
    by = W.partitionBy("b").orderBy("s")
    rows = blocks.join(before, "b").withColumn("k", F.row_number().over(by) + F.col("n0")).where("s = k")
    reached = rows.withColumn("at", F.greatest("m0", F.max("t").over(by.rowsBetween(W.unboundedPreceding, 0))))
    return reached.groupBy(F.col("at").alias("tick")).agg(F.max("s").alias("checkpoint"))


def lanes(acks: DataFrame, lane: str, seq: str = "seq_no") -> DataFrame:
    """Per lane the last acknowledged number and how many it has: a report only, for their least maximum is no checkpoint."""
    return acks.groupBy(lane).agg(F.max(seq).alias("last_seq"), F.count(F.lit(1)).alias("acked"))


def is_zero(gtid_set, file, offset):
    """Whether a saved position says nothing; its sequence number does not count."""
    return (F.coalesce(gtid_set, F.lit("")) == "") & (F.coalesce(file, F.lit("")) == "") & (F.coalesce(offset, F.lit(0)) == 0)


def latest(states: DataFrame, key: str = "flow_id", order: str = "seq_no") -> DataFrame:
    """One row a key: the one with the greatest order."""
    others = [c for c in states.columns if c != key]
    return states.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_s")).select(key, *(F.col(f"_s.{c}").alias(c) for c in others))


def upserted(table: DataFrame, changes: DataFrame, key: str = "flow_id", order: str = "seq_no") -> DataFrame:
    """table with the last change of each key in place of its row."""
    new = latest(changes, key, order)
    return table.join(new.select(key), key, "left_anti").unionByName(new.select(*table.columns))


def resume_from(saved: DataFrame, head: DataFrame, gtid: bool) -> DataFrame:
    """Where each flow (flow_id, gtid_set, binlog_file, binlog_pos) starts: its saved place, else the head (gtid_set, file, pos; one row)."""
    both = saved.crossJoin(F.broadcast(head.select(F.col("gtid_set").alias("_g"), F.col("file").alias("_f"), F.col("pos").alias("_p"))))
    zero = is_zero(F.col("gtid_set"), F.col("binlog_file"), F.col("binlog_pos"))
    none = F.coalesce("gtid_set", F.lit("")) == ""
    if gtid:
        error = F.raise_error(F.lit("the saved position has no gtid set, but the flow runs in gtid mode")).cast("string")
        return both.select("flow_id", F.when(zero, F.col("_g")).when(none, error).otherwise(F.col("gtid_set")).alias("gtid_set"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("pos"))
    named = F.coalesce("binlog_file", F.lit("")) != ""
    return both.select("flow_id", F.lit(None).cast("string").alias("gtid_set"), F.when(named, F.col("binlog_file")).otherwise(F.col("_f")).alias("file"), F.when(named, F.col("binlog_pos")).otherwise(F.col("_p")).alias("pos"))
