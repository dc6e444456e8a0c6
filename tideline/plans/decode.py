"""From a raw log to change events and sink records, as one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import envelope, gtids, keys, tables
from tideline.operators import gtid_sets, ordering, rows, schemas

CONNECTOR = "mysql"


def change_events(log: DataFrame, versions: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), key_overrides: Mapping[str, Sequence[str]] | None = None, queues: int = 8, executed: DataFrame | None = None, after: tuple[str, int] | None = None) -> DataFrame:
    """Change events of a raw log: id, op, before, after (JSON texts), source, occurred_at, key, position, seq_no, queue, file.

    The order within transactions is taken before the filter; all else after it. Rows move once, by file. With
    `executed` (intervals of GTIDs), or `after` (a file and position), what lies inside, or before, is left out. position.gtid_set
    is the prefix up to the last commit before the row, as it is for a server whose numbers have no gaps.
    """
    fqtn = tables.fqtn()
    wanted = tables.captured(fqtn, include, exclude)
    images = rows.row_images(ordering.with_transactions(log))
    images = ordering.tx_order(images, transaction=("file", "tx_no"), order=("log_seq", "row_index")).where(wanted)
    counted = rows.row_images(log.select("log_seq", "file", "kind", "db", "table", "rows")).where(wanted)
    if executed is not None or after is not None:
        known = images
        if executed is not None:
            parts = F.col("gtid")
            known = known.withColumn("uuid", F.regexp_extract(parts, "^(.*):[0-9]+$", 1)).drop("gno").withColumn("gno", F.regexp_extract(parts, ":([0-9]+)$", 1).try_cast("bigint"))
            known = gtid_sets.not_executed(known, executed).drop("uuid")
        if after is not None:
            known = known.where((F.col("file") > after[0]) | ((F.col("file") == after[0]) & (F.col("pos") > after[1])))
        images, counted = known, known
    images = images.withColumn("place", F.struct("log_seq", "row_index"))
    images = ordering.ordinal(images, "seq_no", "place", counted=counted)
    values = rows.current_image(F.col("op"), F.col("before"), F.col("after"))
    images = schemas.asof(images.withColumn("current", values), versions, F.size("current"))
    images = images.withColumn("schema", F.coalesce("schema", F.raise_error(F.concat(F.lit("table not found: "), fqtn)).cast(images.schema["schema"].dataType)))
    names, kinds = F.col("schema.columns"), F.col("schema.kinds")
    source = F.struct(
        F.lit(CONNECTOR).alias("connector"), "server_id", "db", "table", "gtid", "file", "pos", "tx_order",
    )
    uuid = F.regexp_extract("gtid", "^(.*):[0-9]+$", 1)
    position = F.struct(gtid_sets.prefix_text(uuid, F.col("committed_gno")).alias("gtid_set"), F.col("committed_file").alias("file"), F.col("committed_pos").alias("offset"), "seq_no")
    key = _key(fqtn, key_overrides)
    found = images.select(
        gtids.event_id(F.col("gtid"), F.col("tx_order"), F.col("file"), F.col("pos"), F.col("row_index")).alias("id"), "op",
        envelope.object_of_arrays(names, kinds, F.col("before")).alias("before"), envelope.object_of_arrays(names, kinds, F.col("after")).alias("after"),
        source.alias("source"), F.col("ts").alias("occurred_at"), key.alias("key"), position.alias("position"), "seq_no", "file", "log_seq",
    )
    return found.withColumn("queue", keys.queue_of(F.col("key"), queues))


def queued(log: DataFrame, versions: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), key_overrides: Mapping[str, Sequence[str]] | None = None, queues: int = 8) -> DataFrame:
    """file, queue of the change events, without their order: nothing moves but the layouts."""
    fqtn = tables.fqtn()
    images = rows.row_images(log.select("log_seq", "file", "kind", "db", "table", "rows")).where(tables.captured(fqtn, include, exclude))
    images = schemas.asof(images.withColumn("current", rows.current_image(F.col("op"), F.col("before"), F.col("after"))), versions, F.size("current"))
    return images.select("file", keys.queue_of(_key(fqtn, key_overrides), queues).alias("queue"))


def _key(fqtn: Column, key_overrides: Mapping[str, Sequence[str]] | None) -> Column:
    """The key of a row with its schema and its values as `current`."""
    of = lambda wanted: keys.key_of_arrays(fqtn, F.col("schema.columns"), F.col("schema.kinds"), F.col("current"), wanted)
    overrides = {t: of(F.array(*map(F.lit, c))) for t, c in (key_overrides or {}).items()}
    return keys.resolve(fqtn, of(F.col("schema.pk")), overrides)


def payloads(events: DataFrame) -> DataFrame:
    """events with payload: the envelope."""
    return events.withColumn("payload", _envelope())


def _envelope() -> Column:
    return envelope.envelope(F.col("id"), F.col("op"), F.col("before"), F.col("after"), envelope.source_object(), F.col("occurred_at"))


class Serializer(Protocol):
    """What a sink's key and value are, from the columns of change_events(), as binary columns."""

    def key(self) -> Column: ...

    def value(self) -> Column: ...


class JsonSerializer:
    """The entity key and the envelope, as UTF-8."""

    def key(self) -> Column:
        return F.encode("key", "UTF-8")

    def value(self) -> Column:
        return F.encode(_envelope(), "UTF-8")


def sink_records(events: DataFrame, template: str = "cdc.{database}.{table}", overrides: Mapping[str, str] | None = None, serializer: Serializer | None = None) -> DataFrame:
    """topic, key, value of each event, with seq_no, queue and file for order. JSON unless another serializer is given."""
    topic = tables.topic(F.col("source.db"), F.col("source.table"), template, overrides)
    form = serializer or JsonSerializer()
    return events.select(topic.alias("topic"), form.key().alias("key"), form.value().alias("value"), "id", "seq_no", "queue", "file")
