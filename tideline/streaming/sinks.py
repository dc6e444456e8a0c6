"""Where flows write their records. A batch is written whole or fails whole; a batch that comes again replaces itself."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame

#: Codecs by name; Parquet has no name of its own for lz4's frame.
COMPRESSION = {"": "lz4", "lz4": "lz4", "snappy": "snappy", "gzip": "gzip", "zstd": "zstd", "none": "none"}


def compression(name: str) -> str:
    if name not in COMPRESSION:
        raise ValueError(f"unknown compression {name!r}")
    return COMPRESSION[name]


class Sink(Protocol):
    #: Rows of a full publish batch; the flow sets it.
    batch_rows: int

    def write(self, records: DataFrame, batch_id: int) -> None:
        """Writes topic, key, value (and id, seq_no, queue for order); returns once they are durable, raises if not."""

    def err(self) -> Exception | None:
        """The first failure since the last reset(); nothing more is written until then."""

    def reset(self) -> None: ...

    def flush(self) -> None: ...

    def close(self) -> None: ...


class StickySink:
    """Keeps the first failure: what comes after it would leave a gap, so it is refused until a new run resets the sink."""

    batch_rows = 0

    def __init__(self):
        self._first: Exception | None = None

    def err(self) -> Exception | None:
        return self._first

    def reset(self) -> None:
        self._first = None

    def write(self, records: DataFrame, batch_id: int) -> None:
        if self._first is not None:
            raise RuntimeError(f"the sink failed before: {self._first}") from self._first
        try:
            self._write(records, batch_id)
        except Exception as e:
            self._first = e
            raise

    def _write(self, records: DataFrame, batch_id: int) -> None:
        raise NotImplementedError

    def flush(self) -> None:
        """Nothing waits: a write returns when its records are durable."""

    def close(self) -> None:
        self.flush()


class FileSink(StickySink):
    """Parquet files by topic under a folder for each batch; rows of a queue stand in order, a publish batch a file at most."""

    def __init__(self, path: str, codec: str = "lz4"):
        super().__init__()
        self.path, self.codec = path.rstrip("/"), compression(codec)

    def _write(self, records: DataFrame, batch_id: int) -> None:
        codec = "lz4_raw" if self.codec == "lz4" else self.codec
        dealt = records.repartition("queue").sortWithinPartitions("topic", "queue", "seq_no")
        dealt.write.mode("overwrite").option("compression", codec).option("maxRecordsPerFile", self.batch_rows).partitionBy("topic").parquet(f"{self.path}/batch={batch_id}")


class KafkaSink(StickySink):
    """Spark's Kafka writer, with all acknowledgements and idempotence. Needs the connector on the class path.

    max_inflight bounds the requests that are sent and not acknowledged: no more tasks than that write at once, and each
    connection has its share of them, 5 at most, up to which an idempotent producer keeps order.
    """

    def __init__(self, brokers: list[str], codec: str = "lz4", options: dict[str, str] | None = None, max_inflight: int = 0):
        super().__init__()
        if not brokers:
            raise ValueError("the kafka sink needs brokers")
        self.options = {
            "kafka.bootstrap.servers": ",".join(brokers), "kafka.acks": "all", "kafka.enable.idempotence": "true",
            "kafka.compression.type": compression(codec), **(options or {}),
        }
        self.max_inflight = max_inflight if max_inflight > 0 else 32

    def dealt(self, records: DataFrame, queues: int) -> tuple[DataFrame, int]:
        """Records by queue, in order, and the requests in flight that each task may have."""
        tasks = max(1, min(queues, self.max_inflight))
        return records.repartition(tasks, "queue").sortWithinPartitions("queue", "seq_no"), max(1, min(5, self.max_inflight // tasks))

    def _write(self, records: DataFrame, batch_id: int) -> None:
        rows, each = self.dealt(records, records.select("queue").distinct().count())
        options = {"kafka.max.in.flight.requests.per.connection": str(each), **self.options}
        rows.select("topic", "key", "value").write.format("kafka").options(**options).save()


class MemorySink(StickySink):
    """Counts and keeps small batches, for tests; can be told to fail."""

    def __init__(self):
        super().__init__()
        self.batches: list[tuple[int, list]] = []
        self.fail_next = 0

    def _write(self, records: DataFrame, batch_id: int) -> None:
        rows = records.orderBy("seq_no").collect()
        self.batches.append((batch_id, rows))
        if self.fail_next:
            self.fail_next -= 1
            raise RuntimeError("the sink was told to fail")


def deduplicated(records: DataFrame, event_time: str = "occurred_at", horizon: str | None = None) -> DataFrame:
    """A stream with one row an id. With a horizon the state forgets ids that are older; without, it keeps all."""
    if horizon is None:
        return records.dropDuplicates(["id"])
    return records.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(["id"])
