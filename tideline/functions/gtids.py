"""Transaction identifiers, event identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_sid(sid: Column) -> Column:
    """16 bytes as 8-4-4-4-12 lower-case hex; other lengths as plain hex."""
    digits = F.lower(F.hex(sid))
    parts = [F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(F.octet_length(sid) == 16, F.concat_ws("-", *parts)).otherwise(digits)


def gtid(sid: Column, gno: Column) -> Column:
    """sid:gno; null for an anonymous transaction (a sid of zeros, or gno 0)."""
    known = sid.isNotNull() & (gno > 0) & ~F.hex(sid).rlike("^0*$")
    return F.when(known, F.concat_ws(":", format_sid(sid), gno.cast("string")))


def event_id(gtid: Column, tx_order: Column, file: Column, pos: Column, row_index: Column) -> Column:
    """gtid#tx_order, or file:pos:row where there is no gtid. Replays give the same."""
    by_place = F.concat_ws(":", file, pos.cast("string"), row_index.cast("string"))
    return F.when(F.coalesce(gtid, F.lit("")) != "", F.concat(gtid, F.lit("#"), tx_order.cast("string"))).otherwise(by_place)


def op_of(kind: Column) -> Column:
    """c, u, d for row records, in any version of their format; null for others."""
    base = F.regexp_replace(F.lower(kind), "(_rows)?_?(event)?_?v?[0-2]?$", "")
    return F.when(base == "write", "c").when(base == "update", "u").when(base == "delete", "d")


def is_ddl(query: Column) -> Column:
    return F.upper(F.trim(query)) != "BEGIN"
