"""Operators over logs: small cases, and scalable forms against simple ones."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import keys, tables
from tideline.model import RAW_LOG, SCHEMA_VERSION
from tideline.operators import audits, batching, checkpoints, counters, gtid_sets, ordering, rows, schemas
from tideline.plans import catalogue, decode
from tideline.sources import fixture


def test_ordinal_is_the_simple_window(spark, sf):
    log = fixture.change_log(spark, sf).withColumn("file", F.floor(F.col("log_seq") / 37).cast("string")).withColumn("file", F.lpad("file", 5, "0"))
    got = ordering.ordinal(log, "n", within=["op"])
    want = got.withColumn("m", F.row_number().over(W.partitionBy("op").orderBy("log_seq")))
    assert want.where("n <> m").count() == 0 and want.count() == log.count()


def test_last_before_crosses_files(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, "b", None), (4, "c", None), (5, "c", "y"), (6, "d", None)], "log_seq bigint, file string, v string")
    got = {r.log_seq: r.p for r in ordering.last_before(df, "p", F.col("v")).collect()}
    assert got == {1: None, 2: None, 3: "x", 4: "x", 5: "x", 6: "y"}


def raw(*records):
    base = {f.name: None for f in RAW_LOG.fields} | {"file": "f.1", "server_id": 1}
    return [tuple((base | {"log_seq": k, "pos": 10 * k} | r)[f.name] for f in RAW_LOG.fields) for k, r in enumerate(records, 1)]


SID = bytes.fromhex("3e11fa4771ca11e19e33c80aa9429562")
UUID = "3e11fa47-71ca-11e1-9e33-c80aa9429562"


def schema(spark, *versions):
    return spark.createDataFrame([("db", t, at, list(c), ["number", *["text"] * (len(c) - 1)], ["id"]) for t, at, c in versions], SCHEMA_VERSION)


def test_tx_order_counts_filtered_rows(spark):
    log = spark.createDataFrame(raw(
        {"kind": "gtid", "sid": SID, "gno": 5}, {"kind": "query", "query": "BEGIN"},
        {"kind": "write", "db": "db", "table": "a", "rows": [["1"], ["2"]]}, {"kind": "write", "db": "db", "table": "b", "rows": [["3"]]}, {"kind": "xid"},
    ), RAW_LOG)
    found = decode.change_events(log, schema(spark, ("b", 0, ["id"])), include=["db.b"]).collect()
    assert [r.id for r in found] == [f"{UUID}:5#3"]
    assert found[0].seq_no == 1 and found[0].source.tx_order == 3 and found[0].position.gtid_set is None


def test_positions_name_the_commit_before(spark):
    write = {"kind": "write", "db": "db", "table": "b", "rows": [["3"]]}
    log = spark.createDataFrame(raw({"kind": "gtid", "sid": SID, "gno": 1}, write, {"kind": "xid"}, {"kind": "gtid", "sid": SID, "gno": 2}, write, {"kind": "xid"}), RAW_LOG)
    found = decode.change_events(log, schema(spark, ("b", 0, ["id"]))).orderBy("seq_no").collect()
    assert [(r.position.gtid_set, r.position.file, r.position.offset) for r in found] == [(None, None, None), (f"{UUID}:1", "f.1", 30)]


def test_without_gtids_ids_are_places(spark):
    log = spark.createDataFrame(raw({"kind": "query", "query": "BEGIN"}, {"kind": "update", "db": "db", "table": "b", "rows": [["1"], ["1"], ["2"], ["2"], ["9"]]}, {"kind": "xid"}), RAW_LOG)
    found = decode.change_events(log, schema(spark, ("b", 0, ["id"]))).orderBy("seq_no").collect()
    assert [r.id for r in found] == ["f.1:20:0", "f.1:20:1"]
    assert [r.key for r in found] == ["db.b|1", "db.b|2"]


def test_added_column_and_width(spark):
    log = spark.createDataFrame(raw(
        {"kind": "write", "db": "db", "table": "b", "rows": [["1", "n"]]}, {"kind": "xid"}, {"kind": "query", "query": "ALTER TABLE b ADD extra"},
        {"kind": "write", "db": "db", "table": "b", "rows": [["2", "n", "e"]]}, {"kind": "xid"},
    ), RAW_LOG)
    versions = schema(spark, ("b", 0, ["id", "name"]), ("b", 4, ["id", "name", "extra"]))
    found = decode.change_events(log, versions).orderBy("seq_no").collect()
    assert [r.after for r in found] == ['{"id":1,"name":"n"}', '{"extra":"e","id":2,"name":"n"}']
    late = schema(spark, ("b", 0, ["id", "name"]), ("b", 100, ["id", "name", "extra"]))  # the change became known late
    assert [r.after for r in decode.change_events(log, late).orderBy("seq_no").collect()][1] == '{"extra":"e","id":2,"name":"n"}'


def test_unknown_table_fails(spark):
    log = spark.createDataFrame(raw({"kind": "write", "db": "db", "table": "nope", "rows": [["1"]]}), RAW_LOG)
    with pytest.raises(Exception, match="table not found: db.nope"):
        decode.change_events(log, schema(spark, ("b", 0, ["id"]))).collect()


def test_empty_log(spark):
    empty = spark.createDataFrame([], RAW_LOG)
    assert decode.sink_records(decode.change_events(empty, schema(spark, ("b", 0, ["id"])))).count() == 0
    assert ordering.log_head(empty).count() == 0


def test_resume_leaves_out_what_was_executed(spark, sf):
    log, versions = fixture.raw_log(spark, sf), fixture.schema_versions(spark)
    every = decode.change_events(log, versions)
    done = gtid_sets.parsed(spark.createDataFrame([(f"{fixture.UUID}:1-100",)], "gtid_set string"))
    rest = decode.change_events(log, versions, executed=done)
    assert rest.count() == 600 and rest.select("id").exceptAll(every.select("id")).count() == 0
    assert rest.agg(F.min("seq_no"), F.max("seq_no")).first() == (1, 600)
    assert decode.change_events(log, versions, after=("binlog.000001", 40_050)).count() == 600


def test_dangling_pair_and_kinds(spark):
    df = spark.createDataFrame([("update", [["1"], ["2"], ["3"]]), ("write", []), ("xid", None)], "kind string, rows array<array<string>>")
    assert [(r.before, r.after) for r in rows.row_images(df).collect()] == [(["1"], ["2"])]


def test_layouts_and_required(spark):
    cols = spark.createDataFrame([("db", "t", "b", 2, "varchar", False, 0), ("db", "t", "a", 1, "int", True, 0)], "db string, table string, name string, ordinal int, data_type string, is_key boolean, valid_from_seq bigint")
    r = schemas.layouts(cols).first()
    assert (r.columns, r.kinds, r.pk) == (["a", "b"], ["number", "text"], ["a"])
    missing = schemas.required(spark.createDataFrame([("db", "t"), ("db", "u")], "db string, table string"), schemas.layouts(cols))
    assert [x.table for x in missing.collect()] == ["u"]


def test_gtid_sets(spark):
    text = lambda *s: gtid_sets.rendered(gtid_sets.merged(gtid_sets.parsed(spark.createDataFrame([(x,) for x in s], "gtid_set string")))).first().gtid_set
    assert text("u:1-3:5", "u:4") == "u:1-5"
    assert text("b:1,A:7-9", "a:3") == "a:3:7-9,b:1"
    assert text("u:1-10:2-3") == "u:1-10"
    assert text("") == ""


@pytest.mark.parametrize("acks,want", [([], 0), ([2], 0), ([1], 1), ([2, 1, 3], 3), ([1, 2, 4, 5], 2), ([1, 1, 2, 2], 2), ([0, -5, 1], 1)])
def test_prefix(spark, acks, want):
    df = spark.createDataFrame([(a,) for a in acks], "seq_no bigint")
    assert checkpoints.prefix(df).first().checkpoint == want
    assert checkpoints.outstanding(df).first().outstanding == len({a for a in acks if a > want})


def test_prefix_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(checkpoints, "BLOCK", 10)
    for gap in (1, 10, 11, 25, 40, 41):
        assert checkpoints.prefix(spark.range(1, 41).where(F.col("id") != gap).withColumnRenamed("id", "seq_no")).first().checkpoint == min(gap - 1, 40)
    acks = spark.range(1, 41).select(F.col("id").alias("seq_no"), F.when(F.col("id") == 15, 9).otherwise(F.floor(F.col("id") / 8)).alias("tick"))
    got = {r.tick: r.checkpoint for r in checkpoints.ticks(acks, "tick").collect()}
    assert got == {0: 7, 1: 14, 9: 40}


def test_upsert_and_resume(spark):
    kind = "flow_id string, gtid_set string, binlog_file string, binlog_pos bigint, seq_no bigint"
    table = spark.createDataFrame([("a", "", "f1", 1, 1), ("b", "", "f1", 1, 1)], kind)
    changes = spark.createDataFrame([("a", "", "f2", 9, 7), ("a", "", "f2", 5, 5), ("c", "", "f3", 1, 1)], kind)
    got = {r.flow_id: r.binlog_pos for r in checkpoints.upserted(table, changes).collect()}
    assert got == {"a": 9, "b": 1, "c": 1}
    head = spark.createDataFrame([("u:1-9", "f9", 90)], "gtid_set string, file string, pos bigint")
    got = {r.flow_id: r.gtid_set for r in checkpoints.resume_from(spark.createDataFrame([("a", "u:1-4", "", 0, 0), ("b", "", "", 0, 3)], kind), head, True).collect()}
    assert got == {"a": "u:1-4", "b": "u:1-9"}
    with pytest.raises(Exception, match="no gtid set"):
        checkpoints.resume_from(spark.createDataFrame([("a", "", "f1", 4, 0)], kind), head, True).collect()


def test_audits(spark):
    df = spark.createDataFrame([("k", 1, 1, "c"), ("k", 2, 3, "u"), ("k", 3, 2, "u"), ("k", 4, 4, "d"), ("k", 5, 5, "u"), ("m", 6, 9, "u")], "key string, arrival bigint, seq_no bigint, op string")
    assert [r.seq_no for r in audits.order_violations(df).collect()] == [2]
    assert len(audits.order_violations(df, step=1).collect()) == 3
    assert {(r.key, r.violation) for r in audits.lifecycle_violations(df).collect()} == {("k", "after_delete"), ("m", "first_not_create")}
    assert [tuple(r) for r in audits.gaps(df, "seq_no").collect()] == [(6, 8)]
    again = spark.createDataFrame([("i", 2, "p"), ("i", 1, "p"), ("j", 3, "q"), ("j", 4, "r")], "id string, arrival bigint, payload string")
    assert {r.id: r.arrival for r in audits.first_of_each(again).collect()} == {"i": 1, "j": 3}
    assert {r.id: r.payloads for r in audits.replays(again).collect()} == {"i": 1, "j": 2}


def test_batches(spark):
    assert batching.drained([3, 3, 4], 4) == [6, 4]
    assert batching.drained([], 4) == []
    q = batching.in_queues(spark.range(100).select((F.col("id") % 7).alias("key"), F.col("id").alias("seq_no")), 4)
    seen = {}
    for part in q.rdd.glom().collect():
        for k in {r.key for r in part}:
            assert k not in seen
            seen[k] = [r.seq_no for r in part if r.key == k]
    assert all(v == sorted(v) for v in seen.values()) and len(seen) == 7


def test_counters(spark):
    df = spark.createDataFrame([("f", 1, 10), ("f", 2, 25), ("f", 3, 5)], "flow string, t int, v bigint")
    assert [r.total for r in counters.deltas(df, "flow", "t", "v").orderBy("t").collect()] == [10, 25, 30]
    r = spark.range(1).select(counters.lag_seconds(F.lit(1000), F.lit(3000)).alias("a"), counters.lag_seconds(F.lit(5000), F.lit(3000)).alias("b"), counters.lag_seconds(F.lit(5000), F.lit(0)).alias("c")).first()
    assert tuple(r) == (0.0, 2.0, None)


def test_whole_texts_are_escaped(spark, sf):
    escaped = lambda t: "\\N" if t is None else t.replace("\\", "\\\\").replace("|", "\\|")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = [(r.doc_id, f"db.t|\\N|{escaped(None if r.text is None else r.text + '|a' + chr(92) + 'b')}|{escaped(r.text)}") for r in docs]
    got = [tuple(r) for r in catalogue.QUERIES["key_escape"](spark, sf).collect()]
    assert sorted(got) == sorted(want) and len(got) == len(docs)


def cut(text, n):
    """The longest run of whole characters in n bytes."""
    if text is None or len(text.encode()) <= n:
        return text
    k = len(text)
    while len(text[:k].encode()) > n:
        k -= 1
    return text[:k] + "..."


def test_texts_are_cut_between_code_points(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r) for r in catalogue.QUERIES["truncated_text"](spark, sf).collect()]
    assert len(got) == len(docs) and sorted(got) == sorted((r.doc_id, cut(r.text, 20)) for r in docs)
    odd = [None, "", "é" * 9, "a" + "é" * 9, "\U0001f600" * 5, "a" + "\U0001f600" * 5, "ab" + "\U0001f600" * 5, "abc" + "\U0001f600" * 5, "퟿" * 5, "a" + "퟿" * 5]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "k int, t string")
    for n in range(12):
        assert [r.v for r in rows.orderBy("k").select(tables.truncated(F.col("t"), n).alias("v")).collect()] == [cut(t, n) for t in odd]


def test_batches_are_whole_micro_batches():
    assert batching.batch_rows(500) == 512 and batching.batch_rows(512) == 512 and batching.batch_rows(1, 7) == 7
    assert batching.drained([256] * 5, 500) == [512, 512, 256]


def test_fnv_of_batches(spark):
    def fnv(data):
        h = 2166136261
        for b in data:
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        return h

    texts = ["", "a", "foobar", "é|ü", "x" * 3000, None, "\U0001f600", "a"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").repartition(2)
    got = {r.k: r.h for r in rows.select("k", keys.fnv1a32(F.col("t")).alias("h")).collect()}
    assert got == {k: None if t is None else fnv(t.encode()) for k, t in enumerate(texts)}


def test_another_serializer(spark, sf):
    class Lines:
        def key(self):
            return F.encode(F.upper("key"), "UTF-8")

        def value(self):
            return F.encode(F.concat_ws(" ", "op", "id"), "UTF-8")

    events = decode.change_events(fixture.raw_log(spark, sf), fixture.schema_versions(spark), ["shop.users"])
    rows = decode.sink_records(events, serializer=Lines()).limit(20).collect()
    assert all(bytes(r.value).decode().split(" ")[1] == r.id and bytes(r.key).startswith(b"SHOP.USERS|") for r in rows)
