"""From row records to row images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.gtids import op_of


def current_image(op: Column, before: Column, after: Column) -> Column:
    """The image that a change leaves: before it for a deletion, after it else."""
    return F.when(op == "d", before).otherwise(after)


def row_images(log: DataFrame) -> DataFrame:
    """A row for each changed row of the row records: op, row_index, before, after (arrays by position).

    The rows of an update come in pairs, and a last one without its pair is ignored; records of other kinds go.
    """
    records = log.withColumn("op", op_of(F.col("kind"))).where("op is not null")
    stride = F.when(F.col("op") == "u", 2).otherwise(1)
    n = F.floor(F.size("rows") / stride).cast("int")
    at = lambda i, shift: F.get("rows", i * stride + shift)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    found = records.select("*", F.explode(places).alias("row_index"))
    i = F.col("row_index")
    before = F.when(F.col("op") != "c", at(i, 0))
    after = F.when(F.col("op") == "c", at(i, 0)).when(F.col("op") == "u", at(i, 1))
    return found.withColumn("before", before).withColumn("after", after).drop("rows")
