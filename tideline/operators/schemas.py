"""Layouts of tables, as of a place in the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.gtids import is_ddl
from tideline.functions.tables import wire_kind


def layouts(columns: DataFrame) -> DataFrame:
    """columns (db, table, name, ordinal, data_type, is_key, valid_from_seq) as one row a version, in ordinal order."""
    entry = F.struct("ordinal", "name", wire_kind(F.col("data_type")).alias("kind"), "is_key")
    rows = columns.groupBy("db", "table", "valid_from_seq").agg(F.array_sort(F.collect_list(entry)).alias("c"))
    names = lambda a: F.transform(a, lambda x: x["name"])
    return rows.select(
        "db", "table", "valid_from_seq", names(F.col("c")).alias("columns"), F.transform("c", lambda x: x["kind"]).alias("kinds"),
        names(F.filter("c", lambda x: x["is_key"])).alias("pk"),
    )


def required(rows: DataFrame, versions: DataFrame) -> DataFrame:
    """The tables that rows have and no version knows: a flow must fail on any."""
    return rows.select("db", "table").distinct().join(versions, ["db", "table"], "left_anti")


def versions_of(log: DataFrame) -> DataFrame:
    """Where a version of the layouts may begin: after each query record that isn't BEGIN."""
    return log.where((F.col("kind") == "query") & is_ddl(F.col("query"))).select((F.col("log_seq") + 1).alias("valid_from_seq"), "query")


def latest(versions: Column, seq: Column) -> Column:
    """Of an ascending array of versions the last whose valid_from_seq is not after seq."""
    return F.try_element_at(F.filter(versions, lambda v: v["valid_from_seq"] <= seq), F.lit(-1))


def asof(rows: DataFrame, versions: DataFrame, width: Column | None = None) -> DataFrame:
    """rows with schema: the version of their table valid at log_seq, null if none.

    Versions become one array a table, so that the join is one of equal keys with a row a table, and no
    range join. If `width` (the number of values of a row) is given and differs from that version's, the first later
    version of the right width is taken, if there is one.
    """
    version = F.struct("valid_from_seq", "columns", "kinds", "pk")
    tables = versions.groupBy("db", "table").agg(F.array_sort(F.collect_list(version)).alias("_versions"))
    joined = rows.join(F.broadcast(tables) if tables.limit(100_001).count() <= 100_000 else tables, ["db", "table"], "left")
    found = latest(F.col("_versions"), F.col("log_seq"))
    if width is not None:
        later = F.get(F.filter("_versions", lambda v: (v["valid_from_seq"] > F.col("log_seq")) & (F.size(v["columns"]) == width)), 0)
        found = F.when(F.size(found["columns"]) == width, found).otherwise(F.coalesce(later, found))
    return joined.withColumn("schema", found).drop("_versions")


def named_row(values: Column, columns: Column) -> Column:
    """A positional row as a map by name, cut to the shorter of the two; null stays null."""
    width = F.least(F.size(columns), F.size(values))
    return F.when(values.isNotNull(), F.map_from_arrays(F.slice(columns, 1, width), F.slice(values, 1, width)))


def width_mismatch(rows: DataFrame, values: str) -> DataFrame:
    """rows (with schema) whose number of values is not that of the columns."""
    return rows.where(F.size(values) != F.size("schema.columns"))
