"""Flows: restarts, failures, stores, the tracker, configuration, the control plane."""

import json
import threading
import time
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from tideline.operators import audits
from tideline.sources import captured, fixture
from tideline.streaming import config, sinks, tracker
from tideline.streaming.flow import FAILED, STOPPED, Flow, FlowSpec
from tideline.streaming.manager import Manager
from tideline.streaming.metrics import Metrics
from tideline.streaming.stores import FileStore, Position, TableStore


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    path = tmp_path_factory.mktemp("captured")
    log = fixture.raw_log(spark, sf).where("log_seq < 1600")  # 400 rows, 100 transactions
    captured.write_captured(log.withColumn("file", F.when(F.col("log_seq") < 800, "binlog.000001").otherwise("binlog.000002")), str(path))
    return str(path)


def flow_of(spark, folder, tmp_path, sink=None, **more):
    spec = FlowSpec(id=more.pop("id", "f"), path=folder, versions=fixture.schema_versions, checkpoint_dir=str(tmp_path / "ckpt"), queues=4, queue_capacity=more.pop("capacity", 40), **more)
    return Flow(spark, spec, sink or sinks.MemorySink(), FileStore(str(tmp_path / "state")))


def ids(sink):
    return [r.id for _, rows in sink.batches for r in rows]


def test_batch_source(spark, folder):
    captured.register(spark)
    got = spark.read.format("captured_log").option("path", folder).load()
    assert got.count() == 600 and got.where("kind = 'gtid'").select(F.hex("sid")).distinct().count() == 1


def test_flow_delivers_all_in_whole_transactions(spark, folder, tmp_path):
    sink = sinks.MemorySink()
    flow = flow_of(spark, folder, tmp_path, sink)
    flow.run(available_now=True)
    got = ids(sink)
    assert len(got) == len(set(got)) == 400 and len(sink.batches) > 1
    for _, rows in sink.batches:
        transactions = [r.id.split("#")[0] for r in rows]
        assert all(transactions.count(t) == 4 for t in set(transactions))
    status = flow.status()
    assert status["status"] == STOPPED and status["published_events"] == 400
    assert status["persisted_checkpoint"]["gtid_set"] == f"{fixture.UUID}:1-100" and status["persisted_checkpoint"]["seq_no"] == 400


def test_a_failed_batch_comes_again_with_the_same_ids(spark, folder, tmp_path):
    sink = sinks.MemorySink()
    sink.fail_next = 1
    flow = flow_of(spark, folder, tmp_path, sink)
    with pytest.raises(RuntimeError):
        flow.run(available_now=True)
    assert flow.status()["status"] == FAILED and "told to fail" in flow.status()["last_error"]
    assert flow.status()["persisted_checkpoint"]["seq_no"] == 0
    flow.run(available_now=True)
    got = ids(sink)
    assert len(set(got)) == 400 and len(got) > 400
    rows = [(r.id, bytes(r.value).decode(), k) for k, (_, b) in enumerate(sink.batches) for r in b]
    again = audits.replays(spark.createDataFrame(rows, "id string, payload string, arrival int"))
    assert again.count() == len(got) - 400 and again.where("payloads > 1").count() == 0


def test_lost_stream_checkpoint_resumes_from_the_store(spark, folder, tmp_path):
    FileStore(str(tmp_path / "state")).save("f", Position(f"{fixture.UUID}:1-60", "binlog.000001", 1, 240))
    sink = sinks.MemorySink()
    flow_of(spark, folder, tmp_path, sink).run(available_now=True)
    assert len(ids(sink)) == 160 and min(int(i.split(":")[1].split("#")[0]) for i in ids(sink)) == 61


def test_new_records_after_a_restart(spark, sf, tmp_path):
    path = tmp_path / "log"
    log = fixture.raw_log(spark, sf)
    captured.write_captured(log.where("log_seq < 400"), str(path))
    sink = sinks.MemorySink()
    flow_of(spark, str(path), tmp_path, sink).run(available_now=True)
    assert len(ids(sink)) == 100
    captured.write_captured(log.where("log_seq < 800").withColumn("file", F.when(F.col("log_seq") < 400, "binlog.000001").otherwise("binlog.000002")), str(path))
    flow_of(spark, str(path), tmp_path, sink).run(available_now=True)
    assert len(ids(sink)) == len(set(ids(sink))) == 200


def test_file_mode_and_gtid_mode_without_a_set(spark, folder, tmp_path):
    FileStore(str(tmp_path / "state")).save("f", Position("", "binlog.000001", 150, 9))
    with pytest.raises(ValueError, match="no gtid set"):
        flow_of(spark, folder, tmp_path).run(available_now=True)


def test_file_sink_keeps_order_by_queue(spark, folder, tmp_path):
    flow = flow_of(spark, folder, tmp_path, sinks.FileSink(str(tmp_path / "out"), "zstd"), capacity=1000)
    flow.run(available_now=True)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 400 and {r.topic for r in got.select("topic").distinct().collect()} == {f"cdc.shop.{t}" for t in fixture.TABLES}


def test_failing_saves_are_counted_and_made_good(spark, folder, tmp_path):
    flow = flow_of(spark, folder, tmp_path)
    real, calls = flow.store, []

    class Flaky:
        def load(self, name):
            return real.load(name)

        def save(self, name, position):
            calls.append(position)
            if len(calls) == 1:
                raise OSError("disk")
            real.save(name, position)

    flow.store, flow.spec.commit_interval_ms = Flaky(), 1
    flow.run(available_now=True)
    assert flow.save_failures == 1 and real.load("f").seq_no == 400


def test_stop_drains(spark, folder, tmp_path):
    manager = Manager()
    sink = sinks.MemorySink()
    flow = flow_of(spark, folder, tmp_path, sink)
    manager.register(flow)
    with pytest.raises(KeyError):
        manager.register(flow)
    manager.start("f")
    manager.start("f")
    until = time.time() + 120
    while flow.published < 400 and time.time() < until:
        time.sleep(0.1)
    manager.stop("f")
    assert flow.status()["status"] == STOPPED and FileStore(str(tmp_path / "state")).load("f").seq_no == 400
    manager.stop_all()


def test_restart_budget():
    class Bad:
        id, runs = "bad", 0

        def run(self):
            self.runs += 1
            raise RuntimeError("no")

        def stop(self):
            pass

        def status(self):
            return {"id": "bad", "status": FAILED}

    bad, manager = Bad(), Manager(max_restarts=3, restart_backoff_s=0.01)
    manager.register(bad)
    manager.start("bad")
    time.sleep(0.5)
    assert bad.runs == 4


def test_tracker():
    p = lambda n: Position("g", "f", n * 10, n)
    t = tracker.Tracker()
    t.done(p(2))
    assert t.checkpoint() is None and t.outstanding() == 1 and t.take_dirty() is None
    t.redirty()
    assert t.take_dirty() is None
    t.done(p(1))
    assert t.checkpoint() == p(2) and t.take_dirty() == p(2) and t.take_dirty() is None
    t.redirty()
    assert t.take_dirty() == p(2)
    t.done(p(1), p(3))
    assert t.checkpoint() == p(3) and t.outstanding() == 0
    assert tracker.merge([(5, 7)], [1, 2, 4, 9]) == [(1, 2), (4, 7), (9, 9)]


def test_tracker_with_threads():
    t = tracker.Tracker()
    threads = [threading.Thread(target=lambda k=k: [t.done(Position("", "f", s, s)) for s in range(k + 1, 4001, 8)]) for k in range(8)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert t.checkpoint().seq_no == 4000 and t.outstanding() == 0


def test_stateful_prefixes(spark, tmp_path):
    for k, acks in enumerate(([3, 2], [1], [7, 5, 4], [6, 1])):
        spark.createDataFrame([("f", a) for a in acks], "flow_id string, seq_no bigint").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}.parquet"))
        time.sleep(0.02)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        acks = spark.readStream.schema("flow_id string, seq_no bigint").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        seen = []
        q = tracker.prefixes(acks).writeStream.outputMode("update").foreachBatch(lambda b, n: seen.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert max(r.checkpoint for r in seen) == 7 and seen[-1].outstanding == 0


def test_streaming_dedupe(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "id string, n int")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = sinks.deduplicated(spark.readStream.schema("id string, n int").parquet(str(tmp_path / "in")))
    got = []
    stream.writeStream.foreachBatch(lambda b, n: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in got) == ["a", "b"]


def test_stores(spark, tmp_path):
    for store in (FileStore(str(tmp_path / "s")), TableStore(spark, str(tmp_path / "t"))):
        assert store.load("x").is_zero
        store.save("x", Position("u:1", "f", 4, 2))
        store.save("x", Position("u:1-2", "f", 8, 1))
        store.save("y", Position("u:9", "f", 8, 1))
        assert store.load("x") == Position("u:1-2", "f", 8, 1)
    assert Position(seq_no=5).is_zero and not Position(file="f").is_zero
    with pytest.raises(ValueError):
        FileStore(str(tmp_path / "s")).load("../x")


def test_server_settings():
    captured.validate({"binlog_format": "row", "binlog_row_image": ""})
    for bad, gtid in (({}, False), ({"binlog_format": "MIXED"}, False), ({"binlog_format": "ROW", "binlog_row_image": "MINIMAL"}, False), ({"binlog_format": "ROW"}, True)):
        with pytest.raises(ValueError):
            captured.validate(bad, gtid)


@pytest.mark.parametrize("codec", ["", "lz4", "snappy", "gzip", "zstd", "none"])
def test_codecs(codec):
    sinks.compression(codec)
    sinks.KafkaSink(["b:1"], codec)


def test_unknown_codec():
    with pytest.raises(ValueError, match="unknown compression"):
        sinks.FileSink("/x", "brotli")


DEFINITION = {"id": "f", "source": {"log": {"path": "/x", "schemas": "/y", "include": ["a.*"]}}, "sink": {"file": {"path": "/z"}}, "state": {"store": "file"}, "Pipeline": {"QUEUES": 8}}


def test_config(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("CDC_SECRET", "s3")
    (tmp_path / "c.yaml").write_text("flows:\n  - id: a\n    password: ${CDC_SECRET}\n    autoStart: false\n")
    loaded = config.load(str(tmp_path / "c.yaml"))
    assert loaded["listen"] == ":8080" and loaded["flows"][0]["password"] == "s3" and not config.auto_start(loaded["flows"][0])
    assert config.auto_start({})
    with pytest.raises(config.ConfigError, match="NOPE_A, NOPE_B"):
        config.expanded("${NOPE_A} $NOPE_B")
    good = DEFINITION | {"state": {"store": "file", "dir": str(tmp_path / "s")}}
    spec = config.build(spark, good, str(tmp_path)).spec
    assert (spec.queues, spec.queue_capacity, spec.batch_max_size, spec.batch_max_wait_ms, spec.commit_interval_ms, spec.shutdown_timeout_s) == (8, 4096, 500, 20, 1000, 30.0)
    for part, said in (({"id": ""}, "id is required"), ({"source": {}}, "source.log"), ({"sink": {}}, "sink.kafka"), ({"state": {"store": "redis"}}, "unknown state store"), ({"state": {}}, "state.path"), ({"sink": {"file": {"path": "/z", "compression": "brotli"}}}, "unknown compression")):
        with pytest.raises(config.ConfigError, match=said):
            config.build(spark, good | part, str(tmp_path))
    with pytest.raises(config.ConfigError, match="class without an end"):
        config.build(spark, good | {"source": {"log": {"path": "/x", "schemas": "/y", "include": ["a[b"]}}}, str(tmp_path))


def test_metrics():
    m = Metrics(clock=lambda: 100.0)
    status = {"id": 'f"1', "status": "running", "published_events": 10, "checkpoint": {"seq_no": 4}, "persisted_checkpoint": {"seq_no": 3}, "last_event_unix_ms": 200_000, "queue_depths": [1, 2]}
    for n in (10, 25, 5):
        m.observe(status | {"published_events": n})
    text = m.text()
    assert 'cdc_publish_events_total{flow="f\\"1"} 30' in text and 'cdc_source_lag_seconds{flow="f\\"1"} 0' in text and 'queue="1"} 2' in text and "} 2\n" in text


def test_http(spark, tmp_path):
    manager = Manager()
    build = lambda d: config.build(spark, d, str(tmp_path))
    server = manager.server("127.0.0.1:0", build, Metrics())
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def call(path, body=None, post=False):
        request = urllib.request.Request(base + path, data=json.dumps(body).encode() if body is not None else (b"" if post else None))
        try:
            with urllib.request.urlopen(request, timeout=30) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    assert call("/healthz") == (200, "ok") and call("/readyz") == (200, "ok")
    good = DEFINITION | {"state": {"store": "file", "dir": str(tmp_path / "s")}}
    assert call("/v1/flows", good)[0] == 201 and call("/v1/flows", good)[0] == 409 and call("/v1/flows", {"id": "x"})[0] == 400
    assert json.loads(call("/v1/flows")[1])[0]["status"] == "created" and call("/v1/flows/f")[0] == 200
    assert call("/v1/flows/none")[0] == 404 and call("/v1/flows/none/start", post=True)[0] == 404 and call("/v1/flows/none/stop", post=True)[0] == 500
    assert call("/v1/flows/f/stop", post=True)[0] == 200 and call("/metrics")[0] == 200 and call("/else")[0] == 404
    manager.get("f").state = FAILED
    code, body = call("/readyz")
    assert code == 503 and json.loads(body) == {"ready": False, "failed_flows": ["f"]}
    server.shutdown()


def test_slices_hold_every_line_once(tmp_path, monkeypatch):
    path = tmp_path / "a.jsonl"
    lines = [json.dumps({"log_seq": k, "kind": "x" * (k % 7), "file": "é"}) for k in range(200)]
    path.write_text("\n".join(lines) + "\n")
    size = path.stat().st_size
    ends = [k for k, b in enumerate(path.read_bytes(), 1) if b == 10]
    for most in (1, 7, 41, 42, 43, 1000, 10**6):
        monkeypatch.setattr(captured, "SLICE", most)
        for first, last in ((0, size), (ends[3], ends[150])):
            got = [r[0] for s in captured.slices(str(path), first, last) for r in captured._lines(s)]
            assert got == list(range(200)) if not first else got == list(range(4, 151))


def test_ends_of_transactions():
    line = lambda **r: json.dumps(r).encode()
    assert captured.ends_transaction(line(kind="xid")) and captured.ends_transaction(line(kind="rotate", file="f"))
    assert captured.ends_transaction(line(kind="query", query="ALTER TABLE t")) and not captured.ends_transaction(line(kind="query", query=" begin "))
    assert not captured.ends_transaction(line(kind="write", rows=[['"kind": "xid"']])) and not captured.ends_transaction(b"\n")


def test_saved_log_is_read_again(spark, sf, tmp_path):
    log = fixture.raw_log(spark, sf)
    captured.save(log, f"file://{tmp_path}/log")
    again = captured.load(spark, f"file://{tmp_path}/log")
    assert again.schema.simpleString() == log.select(*again.columns).schema.simpleString()
    assert again.exceptAll(log.select(*again.columns)).count() == 0 and again.count() == log.count()


def test_a_failed_sink_refuses_until_reset(spark):
    sink, rows = sinks.MemorySink(), spark.createDataFrame([("t", 1)], "topic string, seq_no long")
    sink.fail_next = 1
    with pytest.raises(RuntimeError):
        sink.write(rows, 1)
    assert sink.err() is not None
    with pytest.raises(RuntimeError, match="failed before"):
        sink.write(rows, 2)
    sink.reset()
    sink.write(rows, 2)
    assert sink.err() is None and [n for n, _ in sink.batches] == [1, 2]


def test_requests_in_flight(spark):
    rows = spark.createDataFrame([(k % 8, k) for k in range(64)], "queue int, seq_no long")
    for most, tasks, each in ((0, 8, 4), (1, 1, 1), (4, 4, 1), (100, 8, 5)):
        dealt, share = sinks.KafkaSink(["b:1"], max_inflight=most).dealt(rows, 8)
        assert dealt.rdd.getNumPartitions() == tasks and share == each


def test_table_store_keeps_one_version(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/s")
    for k in range(1, 4):
        store.save("a", Position("g:1", "f", k, k))
        store.save("b", Position("", "f", 10 * k, k))
    assert TableStore(spark, f"file://{tmp_path}/s").load("a").offset == 3 and store.load("b").offset == 30 and store.load("c").is_zero
    assert len(list((tmp_path / "s").glob("flow_id=*/version=*"))) == 2
    TableStore(spark, f"file://{tmp_path}/s").save("a", Position("g:1", "f", 4, 4))
    assert store.load("a").offset == 4


def test_files_hold_a_publish_batch_at_most(spark, folder, tmp_path):
    flow = flow_of(spark, folder, tmp_path, sinks.FileSink(f"file://{tmp_path}/out"), capacity=1000)
    flow.spec.batch_max_size, flow.spec.queue_capacity = 10, 1000
    flow.run(available_now=True)
    per = spark.read.parquet(f"{tmp_path}/out/batch=*").groupBy(F.input_file_name()).count()
    assert per.agg(F.max("count")).first()[0] <= flow.spec.batch_rows == 256


def test_hard_stop_leaves_the_batch_to_the_next_run(spark, folder, tmp_path):
    class Slow(sinks.MemorySink):
        def _write(self, records, batch_id):
            time.sleep(8)
            super()._write(records, batch_id)

    flow = flow_of(spark, folder, tmp_path, Slow(), capacity=1000)
    runner = threading.Thread(target=lambda: flow.run(), daemon=True)
    runner.start()
    while flow.state != "running":
        time.sleep(0.05)
    time.sleep(2)
    flow.stop(hard=True)
    runner.join(30)
    assert not runner.is_alive() and flow.state in ("stopped", "failed") and flow.persisted.is_zero
    again = flow_of(spark, folder, tmp_path, sinks.MemorySink(), capacity=1000)
    again.run(available_now=True)
    assert again.published > 0
