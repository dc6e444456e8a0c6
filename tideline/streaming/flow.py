"""A flow: a streaming job from a captured log to a sink, with its status and its position.

Each micro-batch holds whole transactions; it is decoded as a batch plan, written, and only then acknowledged, so
that the prefix of acknowledged numbers has no gap. Spark's checkpoint says where the log was read to; the position
in the store holds the coordinates of the last acknowledged commit, and what a saved position covers is left out of a
new run. A batch that fails after it was written comes again with the same ids.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.gtids import format_sid
from tideline.operators import batching, gtid_sets
from tideline.plans import decode
from tideline.streaming.sinks import Sink
from tideline.streaming.stores import Position, Store
from tideline.streaming.tracker import Tracker

CREATED, STARTING, RUNNING, STOPPING, STOPPED, FAILED = "created", "starting", "running", "stopping", "stopped", "failed"


@dataclass
class FlowSpec:
    """What a flow does; values of 0 take the defaults."""

    id: str
    path: str
    versions: DataFrame | Callable[[SparkSession], DataFrame]
    checkpoint_dir: str
    include: Sequence[str] = ()
    exclude: Sequence[str] = ()
    key_overrides: Mapping[str, Sequence[str]] = field(default_factory=dict)
    topic_template: str = "cdc.{database}.{table}"
    topic_overrides: Mapping[str, str] = field(default_factory=dict)
    queues: int = 0
    queue_capacity: int = 0
    batch_max_size: int = 0
    batch_max_wait_ms: int = 0
    commit_interval_ms: int = 0
    shutdown_timeout_s: float = 0
    gtid: bool = True
    serializer: decode.Serializer | None = None

    def __post_init__(self):
        if not self.id:
            raise ValueError("a flow needs an id")
        if not self.path:
            raise ValueError(f"flow {self.id}: a source is required")
        self.queues = self.queues if self.queues > 0 else 4
        self.queue_capacity = self.queue_capacity if self.queue_capacity > 0 else 4096
        self.batch_max_size = self.batch_max_size if self.batch_max_size > 0 else 500
        self.batch_max_wait_ms = self.batch_max_wait_ms if self.batch_max_wait_ms > 0 else 20
        self.commit_interval_ms = self.commit_interval_ms if self.commit_interval_ms > 0 else 1000
        self.shutdown_timeout_s = self.shutdown_timeout_s if self.shutdown_timeout_s > 0 else 30.0

    @property
    def batch_rows(self) -> int:
        """Rows of a full publish batch."""
        return batching.batch_rows(self.batch_max_size, min(batching.FLUSH, self.queue_capacity))

    @property
    def max_events(self) -> int:
        """What a micro-batch may hold: all queues full."""
        return self.queues * self.queue_capacity


class Flow:
    def __init__(self, spark: SparkSession, spec: FlowSpec, sink: Sink, store: Store):
        if sink is None or store is None:
            raise ValueError(f"flow {spec.id}: a sink and a store are required")
        self.spark, self.spec, self.sink, self.store = spark, spec, sink, store
        self.state, self.last_error, self.published, self.save_failures, self.last_event_ms = CREATED, "", 0, 0, 0
        self.persisted, self.tracker, self.queue_depths = Position(), Tracker(), []
        self._seq, self._query, self._stop, self._hard, self._last_save = 0, None, threading.Event(), threading.Event(), 0.0

    @property
    def id(self) -> str:
        return self.spec.id

    def status(self) -> dict:
        """A snapshot for monitoring; parts that say nothing are left out."""
        report = {
            "id": self.id, "status": self.state, "published_events": self.published,
            "checkpoint": asdict(self.tracker.checkpoint() or Position()), "persisted_checkpoint": asdict(self.persisted),
        }
        more = {"last_event_unix_ms": self.last_event_ms, "state_save_failures": self.save_failures, "queue_depths": self.queue_depths, "last_error": self.last_error}
        return report | {k: v for k, v in more.items() if v}

    def run(self, available_now: bool = False) -> None:
        """Runs until stop() or, with available_now, until what is there is done; raises if a part fails."""
        self.state, self.last_error = STARTING, ""
        try:
            self._run(available_now)
        except Exception as e:
            self.last_error, self.state = str(e).split("\n\nJVM stacktrace")[0], FAILED
            raise
        self.state = STOPPED

    def stop(self, hard: bool = False) -> None:
        """Asks for a graceful stop: the micro-batch in flight is finished. A hard one cuts it off; it comes again in the next run."""
        if self.state in (STARTING, RUNNING):
            self.state = STOPPING
        if hard:
            self._hard.set()
        self._stop.set()

    def _run(self, available_now: bool) -> None:
        from tideline.sources import captured

        captured.register(self.spark)
        self._stop.clear()
        self._hard.clear()
        self.sink.reset()
        self.sink.batch_rows = self.spec.batch_rows
        saved = self.store.load(self.id)
        self.persisted, self._resumed, self.tracker, self._seq, self._last_save = saved, saved, Tracker(), 0, time.monotonic()
        if self.spec.gtid and not saved.is_zero and not saved.gtid_set:
            raise ValueError(f"flow {self.id}: the saved position has no gtid set, but the flow runs in gtid mode")
        versions = self.spec.versions(self.spark) if callable(self.spec.versions) else self.spec.versions
        try:
            while True:
                query = self._query = self._started(versions, available_now)
                if self.state == STARTING:
                    self.state = RUNNING
                while query.isActive and not self._stop.wait(0.05):
                    self._commit(False)
                if self._stop.is_set() and query.isActive:
                    self._drain(query)
                if self._hard.is_set():
                    break
                if (error := query.exception()) is not None:
                    raise RuntimeError(str(error))
                # a bounded run admits one batch of the source's size at a time
                if not available_now or self._stop.is_set() or not sum(p["numInputRows"] for p in query.recentProgress):
                    break
        finally:
            self._commit(True)
            self.sink.close()

    def _started(self, versions: DataFrame, available_now: bool):
        checkpoint = f"{self.spec.checkpoint_dir.rstrip('/')}/{self.id}"
        log = self.spark.readStream.format("captured_log").option("path", self.spec.path).option("maxEvents", self.spec.max_events).option("gtid", str(self.spec.gtid).lower())
        if (end := self._planned(checkpoint)) is not None:
            log = log.option("plannedFile", end["file"]).option("plannedBytes", end["bytes"])
        writer = log.load().writeStream.foreachBatch(lambda rows, n: self._batch(rows, versions, n)).option("checkpointLocation", checkpoint).queryName(self.id)
        trigger = {"availableNow": True} if available_now else {"processingTime": f"{self.spec.batch_max_wait_ms} milliseconds"}
        return writer.trigger(**trigger).start()

    def _planned(self, checkpoint: str) -> dict | None:
        """The end of the last batch that an earlier run planned: there the source goes on."""
        try:
            logged = self.spark.read.text(f"{checkpoint}/offsets/[0-9]*").withColumn("n", F.regexp_extract(F.input_file_name(), "([0-9]+)$", 1).cast("long"))
            last = logged.where("value like '{%\"bytes\"%'").orderBy(F.desc("n")).limit(1).collect()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return json.loads(last[0].value) if last else None

    def _drain(self, query) -> None:
        """Lets the micro-batch in flight end within the timeout (unless the stop is hard), then stops the query; one that won't stop is abandoned."""
        until = time.monotonic() + self.spec.shutdown_timeout_s
        while query.isActive and query.status["isTriggerActive"] and time.monotonic() < until and not self._hard.is_set():
            time.sleep(0.02)
        late = query.isActive and query.status["isTriggerActive"] and not self._hard.is_set()
        stopper = threading.Thread(target=query.stop, daemon=True)
        stopper.start()
        stopper.join(2 * self.spec.shutdown_timeout_s)
        if stopper.is_alive():
            raise TimeoutError(f"flow {self.id} did not stop in time")
        if late:
            raise TimeoutError(f"flow {self.id}: the batch in flight was cut off at {self.spec.shutdown_timeout_s} s")

    def _batch(self, log: DataFrame, versions: DataFrame, batch_id: int) -> None:
        spec = self.spec
        saved, skip = self._resumed, {}
        if spec.gtid and saved.gtid_set:
            skip["executed"] = gtid_sets.parsed(self.spark.createDataFrame([(saved.gtid_set,)], "gtid_set string"))
        elif not spec.gtid and saved.file:
            skip["after"] = (saved.file, saved.offset)
        events = decode.change_events(log, versions, spec.include, spec.exclude, spec.key_overrides, spec.queues, **skip)
        records = decode.sink_records(events, spec.topic_template, spec.topic_overrides, spec.serializer).persist()
        try:
            ends = log.where("kind in ('xid', 'query')").agg(F.max_by(F.struct("file", "pos"), "log_seq").alias("at"), F.count(F.lit(1)).alias("n"))
            done = log.where("kind = 'gtid'").select(F.lower(F.hex("sid")).alias("uuid"), "gno")
            depth = {r.queue: r["count"] for r in records.groupBy("queue").count().collect()}  # a row a queue
            self.queue_depths = [depth.get(q, 0) for q in range(spec.queues)]
            self.sink.write(records, batch_id)
            end = ends.first()
            n = sum(depth.values())
            newest = log.where("kind in ('write', 'update', 'delete')").agg(F.max(F.unix_millis("ts"))).first()[0] or 0
            self._acknowledge(n, end, self._gtid_set(done), newest)
        finally:
            records.unpersist()
            self.queue_depths = [0] * spec.queues

    def _gtid_set(self, done: DataFrame) -> str:
        """The saved set and the transactions of this batch, as text."""
        before = (self.tracker.checkpoint() or self.persisted).gtid_set
        own = done.select(format_sid(F.unhex("uuid")).alias("uuid"), "gno")
        old = gtid_sets.parsed(self.spark.createDataFrame([(before,)], "gtid_set string"))
        return gtid_sets.rendered(gtid_sets.union(old, gtid_sets.intervals(own))).first()[0]

    def _acknowledge(self, n: int, end, gtid_set: str, newest: int) -> None:
        self._seq += n
        self.published += n
        self.last_event_ms = max(self.last_event_ms, newest)
        if end["n"]:
            # a batch of filtered rows only still moves the coordinates
            self.tracker.done_through(Position(gtid_set, end["at"]["file"], end["at"]["pos"], max(self._seq, 1) if n else self._seq + 1))
            if not n:
                self._seq += 1

    def _commit(self, now: bool) -> None:
        if not now and time.monotonic() - self._last_save < self.spec.commit_interval_ms / 1000:
            return
        self._last_save = time.monotonic()
        position = self.tracker.take_dirty()
        if position is None:
            return
        try:
            self.store.save(self.id, position)
            self.persisted = position
        except Exception as e:
            self.save_failures += 1
            self.tracker.redirty()
            self.last_error = f"state save: {e}"
