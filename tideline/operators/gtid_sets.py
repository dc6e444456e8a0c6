"""Sets of transaction identifiers: uuid:a-b:c-d,uuid2:..."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parsed(sets: DataFrame, text: str = "gtid_set") -> DataFrame:
    """The intervals of each set: the columns of sets, uuid, first, last."""
    parts = sets.select("*", F.explode(F.split(F.coalesce(F.col(text), F.lit("")), ",")).alias("_part")).where(F.trim("_part") != "")
    pieces = F.split(F.trim("_part"), ":")
    rows = parts.select(*sets.columns, F.lower(pieces[0]).alias("uuid"), F.explode(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))).alias("_range"))
    ends = F.split(F.trim("_range"), "-")
    return rows.select(*sets.columns, "uuid", ends[0].cast("long").alias("first"), F.coalesce(F.get(ends, 1), ends[0]).cast("long").alias("last"))


def intervals(gtids: DataFrame) -> DataFrame:
    """(uuid, gno) as maximal intervals (uuid, first, last): runs in which gno less its rank is constant."""
    ranked = gtids.select("uuid", "gno").distinct().withColumn("_run", F.col("gno") - F.row_number().over(W.partitionBy("uuid").orderBy("gno")))
    return ranked.groupBy("uuid", "_run").agg(F.min("gno").alias("first"), F.max("gno").alias("last")).drop("_run")


def merged(ranges: DataFrame) -> DataFrame:
    """(uuid, first, last), overlapping or touching, as maximal intervals."""
    by = W.partitionBy("uuid").orderBy("first", "last")
    reach = F.max("last").over(by.rowsBetween(W.unboundedPreceding, -1))
    marked = ranges.withColumn("_new", F.when(reach.isNull() | (F.col("first") > reach + 1), 1).otherwise(0))
    numbered = marked.withColumn("_run", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("uuid", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_run")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return merged(a.select("uuid", "first", "last").unionByName(b.select("uuid", "first", "last")))


def rendered(ranges: DataFrame) -> DataFrame:
    """gtid_set: one row with the canonical text, empty for no intervals."""
    one = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string")))
    per = ranges.groupBy("uuid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", one.alias("text")))), lambda x: x["text"]), ":").alias("text"))
    whole = per.agg(F.array_sort(F.collect_list(F.concat_ws(":", "uuid", "text"))).alias("a"))
    return whole.select(F.array_join("a", ",").alias("gtid_set"))


def prefix_text(uuid: Column, last: Column) -> Column:
    """The text of the set 1..last of one uuid."""
    return F.when(last > 1, F.concat(uuid, F.lit(":1-"), last.cast("string"))).when(last == 1, F.concat(uuid, F.lit(":1")))


def not_executed(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """rows (uuid, gno) outside the intervals: these a resumed flow gets. The intervals of a uuid are one array, so keys are equal."""
    sets = merged(ranges).groupBy("uuid").agg(F.collect_list(F.struct("first", "last")).alias("_done"))
    joined = rows.join(F.broadcast(sets) if sets.limit(10_001).count() <= 10_000 else sets, "uuid", "left")
    done = F.exists(F.coalesce("_done", F.array().cast("array<struct<first:bigint,last:bigint>>")), lambda i: F.col("gno").between(i["first"], i["last"]))
    return joined.where(~F.coalesce(done, F.lit(False))).drop("_done")
