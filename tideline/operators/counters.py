"""Counters, lags and restarts over status snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Numbers of the states in metrics.
STATES = {"created": 0, "starting": 1, "running": 2, "stopping": 3, "stopped": 4, "failed": 5}


def deltas(snapshots: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """snapshots with delta, the growth since the one before (a smaller value is a fresh start), and total, its running sum."""
    by = W.partitionBy(key).orderBy(order)
    now, before = F.col(value), F.coalesce(F.lag(value).over(by), F.lit(0))
    grown = snapshots.withColumn("delta", F.when(now < before, now).otherwise(now - before))
    return grown.withColumn("total", F.sum("delta").over(by.rowsBetween(W.unboundedPreceding, 0)))


def lag_seconds(now_ms: Column, event_ms: Column) -> Column:
    """Seconds since an event, never below 0; null for no event."""
    return F.when(event_ms > 0, F.greatest(F.lit(0.0), (now_ms - event_ms) / 1000))


def backoff(attempt: Column, first: int = 1, most: int = 60) -> Column:
    """Seconds before restart number `attempt`, from 0: doubled each time, up to `most`."""
    return F.least(F.lit(most), F.lit(first) * F.pow(F.lit(2), attempt)).cast("long")


def state_number(state: Column) -> Column:
    return F.coalesce(*(F.when(state == s, F.lit(n)) for s, n in STATES.items()))
