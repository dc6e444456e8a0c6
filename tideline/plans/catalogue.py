"""The registered queries and their SQL, by name. Queries take (spark, sf_dir); SQL repeats the fixture's derivation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import envelope, gtids, keys, tables
from tideline.operators import audits, batching, checkpoints, counters, gtid_sets, ordering, rows, schemas
from tideline.plans import decode
from tideline.sources import captured, fixture

INCLUDE, EXCLUDE = ("shop.users", "shop.*_price", "shop.views"), ("shop.tmp_*",)
QUEUES, BATCH = 8, 500

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_LOG = """log as (select event_id + 1 as log_seq, event_id // 4 + 1 as gno, event_id % 4 + 1 as tx_order, '3e11fa47-71ca-11e1-9e33-c80aa9429562' as uuid,
    'binlog.' || lpad(cast(event_id // 2500 + 1 as varchar), 6, '0') as file, (event_id % 2500 + 1) * 100 as pos, 'shop' as db,
    case event_type when 'purchase' then 'item_price' when 'view' then 'views' when 'click' then 'tmp_clicks' else 'users' end as tbl,
    case event_type when 'signup' then 'c' when 'error' then 'd' else 'u' end as op, user_id, event_type, props, epoch_us(ts) // 1000 as ts_ms, value, event_id from events),
  kept as (select *, row_number() over (order by log_seq) as seq_no, 'shop.' || tbl || '|' || user_id as key from log where tbl <> 'tmp_clicks')"""
_JSON = """'{"event_type":"' || event_type || '","props":' || props || ',"user_id":' || user_id || '}'"""
_ENVELOPE = f"""'{{"id":"' || uuid || ':' || gno || '#' || tx_order || '","op":"' || op || '","before":' || case when op = 'c' then 'null' else {_JSON} end || ',"after":' || case when op = 'd' then 'null' else {_JSON} end
    || ',"source":{{"connector":"mysql","server_id":1,"db":"shop","table":"' || tbl || '","gtid":"' || uuid || ':' || gno || '","file":"' || file || '","pos":' || pos || ',"tx_order":' || tx_order || '}},"ts_ms":' || ts_ms || '}}'"""
_FNV = """cast(list_reduce(list_prepend(cast(2166136261 as bigint), list_transform(string_split({k}, ''), lambda c: cast(ord(c) as bigint))), lambda h, b: (xor(h, b) * 16777619) & 4294967295) as bigint)"""


def query(sql: str | None = None):
    """Registers a query with its SQL; {log}, {json}, {envelope} stand for the fixture's parts."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            text = sql.replace("{log}", _LOG).replace("{json}", _JSON).replace("{envelope}", _ENVELOPE)
            ORACLE_SQL[f.__name__] = text.replace("{fnv(key)}", _FNV.format(k="key"))
        return f

    return add


def _events(spark: SparkSession, d: str, include=INCLUDE, exclude=EXCLUDE, **options) -> DataFrame:
    return decode.change_events(fixture.raw_log(spark, d), fixture.schema_versions(spark), include, exclude, queues=QUEUES, **options)


def _tpch(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _identity(log: DataFrame) -> DataFrame:
    return log.withColumn("gtid", F.concat_ws(":", F.lit(fixture.UUID), F.col("gno").cast("string")))


# --- scans ---


@query("""with {log}, parts as (select log_seq, 'gtid' k from log where tx_order = 1 union all select log_seq, case op when 'c' then 'write' when 'd' then 'delete' else 'update' end from log
  union all select log_seq, 'xid' from log where tx_order = 4 union all select log_seq, 'rotate' from log where pos = 250000) select k as kind, count(*) as n from parts group by k""")
def log_scan(spark, d):
    """Records of the raw log by kind."""
    return fixture.raw_log(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""with {log}, parts as (select log_seq, 'gtid' k from log where tx_order = 1 union all select log_seq, case op when 'c' then 'write' when 'd' then 'delete' else 'update' end from log
  union all select log_seq, 'xid' from log where tx_order = 4 union all select log_seq, 'rotate' from log where pos = 250000) select k as kind, count(*) as n from parts group by k""")
def captured_scan(spark, d):
    """The same from a captured log: the records as files of JSON lines, read again by the source."""
    at = captured.shared_folder(spark)
    captured.save(fixture.raw_log(spark, d), at)
    return captured.load(spark, at).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("with {log} select 'cdc.shop.' || tbl as topic, key, {envelope} as value, seq_no from kept")
def captured_records(spark, d):
    """From a captured log to what a sink gets."""
    at = captured.shared_folder(spark)
    captured.save(fixture.raw_log(spark, d), at)
    events = decode.change_events(captured.load(spark, at), fixture.schema_versions(spark), INCLUDE, EXCLUDE, queues=QUEUES)
    r = decode.sink_records(events)
    return r.select("topic", F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"), "seq_no")


@query("with {log} select op, count(*) as n from log group by op")
def op_counts(spark, d):
    return audits.op_counts(fixture.raw_log(spark, d).withColumn("op", gtids.op_of(F.col("kind"))).where("op is not null"))


@query("with {log} select file, pos + case when pos = 250000 then 75 else 50 end as pos from log order by log_seq desc limit 1")
def log_head(spark, d):
    return ordering.log_head(fixture.raw_log(spark, d))


@query("""with {log} select log_seq, case when log_seq % 2500 = 0 then file else 'binlog.' || lpad(cast((log_seq - 1) // 2500 + 1 as varchar), 6, '0') end as current_file from log""")
def rotated_file(spark, d):
    """The file that rotations say a row record lies in."""
    log = ordering.current_file(fixture.raw_log(spark, d))
    return log.where(gtids.op_of(F.col("kind")).isNotNull()).select((F.floor(F.col("log_seq") / 4) + 1).alias("log_seq"), "current_file")


@query("select i as id, 'gen.items|' || i % 101 as key, i // 101 as key_seq, i + 1 as seq_no, i // 64 as micro_batch from range(20000) t(i)")
def gen_events(spark, d):
    return fixture.generated(spark, 20_000, 101)


# --- filters, projections ---


@query(r"""with {log} select tbl as "table", regexp_full_match('shop.' || tbl, 'shop\.users|shop\.[^/]*_price|shop\.views') and not regexp_full_match('shop.' || tbl, 'shop\.tmp_[^/]*|[^/]*\.flow_state') as captured, count(*) as n from log group by all""")
def table_filter(spark, d):
    log = fixture.change_log(spark, d)
    return log.groupBy("table", tables.captured(tables.fqtn(), INCLUDE, EXCLUDE).alias("captured")).agg(F.count(F.lit(1)).alias("n"))


@query("with {log} select log_seq, tx_order from log")
def tx_order(spark, d):
    log = _identity(fixture.change_log(spark, d))
    return ordering.tx_order(log).select("log_seq", "tx_order")


@query("with {log} select log_seq, seq_no, tx_order from kept")
def tx_order_filtered(spark, d):
    """The order in the transaction counts rows that the filter drops; sequence numbers don't."""
    e = _events(spark, d)
    return e.select((F.floor(F.col("log_seq") / 4) + 1).alias("log_seq"), "seq_no", "source.tx_order")


@query("with {log} select log_seq, seq_no from kept")
def seq_no(spark, d):
    log = fixture.change_log(spark, d).where(tables.captured(tables.fqtn(), INCLUDE, EXCLUDE))
    return ordering.ordinal(log, "seq_no").select("log_seq", "seq_no")


@query("""with l as (select o_orderkey, o_custkey, o_orderstatus, row_number() over (order by o_orderkey) - 1 as k from orders)
  select o_orderkey // 10 as batch, o_orderkey % 10 as row_index, cast(o_orderkey as varchar) || '/O' as before, cast(o_orderkey as varchar) || '/' || o_orderstatus as after from l""")
def row_pairs(spark, d):
    """Update records of up to ten orders each, as alternating images; a dangling one, of no order, is ignored."""
    o = _tpch(spark, d, "orders")
    pair = F.array(F.array(F.col("o_orderkey").cast("string"), F.lit("O")), F.array(F.col("o_orderkey").cast("string"), F.col("o_orderstatus")))
    place = F.struct((F.col("o_orderkey") % 10).alias("i"), pair.alias("p"))
    rec = o.groupBy(F.floor(F.col("o_orderkey") / 10).alias("batch")).agg(F.array_sort(F.collect_list(place)).alias("ps"))
    dangling = F.array(F.array(F.lit("0"), F.lit("?")))
    rec = rec.select("batch", F.transform("ps", lambda x: x["i"]).alias("at"), F.concat(F.flatten(F.transform("ps", lambda x: x["p"])), dangling).alias("rows"), F.lit("update").alias("kind"))
    found = rows.row_images(rec)
    return found.select("batch", F.get("at", F.col("row_index")).cast("bigint").alias("row_index"), F.array_join("before", "/").alias("before"), F.array_join("after", "/").alias("after"))


@query("""with {log} select log_seq, case when gno > 1 then 'binlog.' || lpad(cast(((gno - 1) * 4 - 1) // 2500 + 1 as varchar), 6, '0') end as committed_file,
  case when gno > 1 then ((gno - 1) * 4 - 1) % 2500 * 100 + 150 end as committed_pos, case when gno > 1 then gno - 1 end as committed_gno from log""")
def txn_positions(spark, d):
    """Where the last transaction before each row ended."""
    log = ordering.with_transactions(fixture.raw_log(spark, d)).where(gtids.op_of(F.col("kind")).isNotNull())
    return log.select((F.floor(F.col("log_seq") / 4) + 1).alias("log_seq"), "committed_file", "committed_pos", "committed_gno")


@query("with {log} select log_seq, uuid || ':' || gno || '#' || tx_order as id, file || ':' || pos || ':0' as id_by_place from kept")
def event_ids(spark, d):
    e = _events(spark, d)
    place = gtids.event_id(F.lit(None).cast("string"), F.lit(1), F.col("file"), F.col("source.pos"), F.lit(0))
    return e.select((F.floor(F.col("log_seq") / 4) + 1).alias("log_seq"), "id", place.alias("id_by_place"))


@query("with {log} select distinct uuid || ':' || gno as gtid from log")
def gtid_format(spark, d):
    raw = fixture.raw_log(spark, d).where("kind = 'gtid'")
    return raw.select(gtids.gtid(F.col("sid"), F.col("gno")).alias("gtid"))


@query("""with {log} select log_seq, case when op = 'd' then {json} else {json} end as image from kept""")
def current_image(spark, d):
    e = _events(spark, d)
    return e.select((F.floor(F.col("log_seq") / 4) + 1).alias("log_seq"), rows.current_image(F.col("op"), F.col("before"), F.col("after")).alias("image"))


# --- GTID sets ---


@query("""with g as (select distinct event_id // 4 + 1 as gno from events where (event_id // 4) % 100 < 90), r as (select gno, gno - row_number() over (order by gno) as k from g),
  i as (select min(gno) a, max(gno) b from r group by k) select '3e11fa47-71ca-11e1-9e33-c80aa9429562:' || string_agg(case when a = b then a::varchar else a || '-' || b end, ':' order by a) as gtid_set from i""")
def gtid_set(spark, d):
    """The set of the transactions but each hundred's last ten."""
    g = fixture.change_log(spark, d).where((F.col("gno") - 1) % 100 < 90).select(F.lit(fixture.UUID).alias("uuid"), "gno")
    return gtid_sets.rendered(gtid_sets.intervals(g))


_SETS = ("3e11fa47-71ca-11e1-9e33-c80aa9429562:1-100:201-300:400", "3E11FA47-71CA-11E1-9E33-C80AA9429562:90-150, 00000000-0000-0000-0000-000000000001:7", "")


def _sets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_SETS)), "set_id bigint, gtid_set string")


@query("""select * from (values (0, '3e11fa47-71ca-11e1-9e33-c80aa9429562', 1, 100), (0, '3e11fa47-71ca-11e1-9e33-c80aa9429562', 201, 300), (0, '3e11fa47-71ca-11e1-9e33-c80aa9429562', 400, 400),
  (1, '3e11fa47-71ca-11e1-9e33-c80aa9429562', 90, 150), (1, '00000000-0000-0000-0000-000000000001', 7, 7)) t(set_id, uuid, first, last)""")
def gtid_parse(spark, d):
    return gtid_sets.parsed(_sets(spark)).select("set_id", "uuid", "first", "last")


@query("""select '00000000-0000-0000-0000-000000000001:7,3e11fa47-71ca-11e1-9e33-c80aa9429562:1-150:201-300:400' as gtid_set""")
def gtid_union(spark, d):
    p = gtid_sets.parsed(_sets(spark))
    return gtid_sets.rendered(gtid_sets.union(p.where("set_id = 0"), p.where("set_id = 1")))


@query("with {log} select log_seq, gno from log where not (gno between 1 and 150 or gno between 201 and 300 or gno = 400)")
def gtid_resume(spark, d):
    """What a flow that has executed the sets gets."""
    log = fixture.change_log(spark, d).withColumn("uuid", F.lit(fixture.UUID))
    return gtid_sets.not_executed(log, gtid_sets.parsed(_sets(spark))).select("log_seq", "gno")


# --- layouts ---


def _columns(spark: SparkSession) -> DataFrame:
    listed = [("shop", t, n, k, kind, k == 1, 0) for t in fixture.TABLES for k, (n, kind) in enumerate((("user_id", "int"), ("event_type", "varchar"), ("props", "json"), ("raw", "varbinary")), 1)]
    return spark.createDataFrame(listed[::-1], "db string, table string, name string, ordinal int, data_type string, is_key boolean, valid_from_seq bigint")


@query("""select 'shop' as db, t as "table", 'user_id,event_type,props,raw' as columns, 'number,text,json,binary' as kinds, 'user_id' as pk from (values ('users'), ('item_price'), ('views'), ('tmp_clicks')) v(t)""")
def schema_layout(spark, d):
    found = schemas.layouts(_columns(spark))
    return found.select("db", "table", *(F.array_join(c, ",").alias(c) for c in ("columns", "kinds", "pk")))


@query("""select t as data_type, k as kind from (values ('json', 'json'), ('blob', 'binary'), ('bit', 'binary'), ('vector', 'binary'), ('varchar', 'text'), ('int', 'text'), ('decimal', 'text')) v(t, k)""")
def column_kinds(spark, d):
    types = spark.createDataFrame([(t,) for t in ("json", "blob", "bit", "vector", "varchar", "int", "decimal")], "data_type string")
    return types.select("data_type", tables.column_kind(F.col("data_type")).alias("kind"))


@query("""with {log}, v as (select * from (values (0, 3), (8000, 4), (20000, 5)) t(from_seq, width)) select log.log_seq, v.width from log asof join v on (log.log_seq - 1) * 4 + 1 >= v.from_seq""")
def schema_asof(spark, d):
    log = fixture.raw_log(spark, d).where(gtids.op_of(F.col("kind")).isNotNull())
    found = schemas.asof(log, fixture.schema_versions(spark, (8000, 20000)))
    return found.select((F.floor(F.col("log_seq") / 4) + 1).alias("log_seq"), F.size("schema.columns").cast("bigint").alias("width"))


@query("""select 8001 as valid_from_seq union all select 20001""")
def ddl_versions(spark, d):
    queries = spark.createDataFrame([(100, "query", "BEGIN"), (8000, "query", "ALTER TABLE users ADD v1 int"), (9000, "query", " begin "), (20000, "query", "alter table users add v2 int"), (20004, "xid", None)], "log_seq bigint, kind string, query string")
    return schemas.versions_of(queries).select("valid_from_seq")


@query("with {log} select log_seq, 3 as n_values, 4 as n_columns from log where (log_seq - 1) * 4 + 1 >= 8000")
def width_mismatch(spark, d):
    """Rows of three values where the layout has four columns."""
    log = rows.row_images(fixture.raw_log(spark, d)).withColumn("current", rows.current_image(F.col("op"), F.col("before"), F.col("after")))
    found = schemas.width_mismatch(schemas.asof(log, fixture.schema_versions(spark, (8000,))), "current")
    return found.select((F.floor(F.col("log_seq") / 4) + 1).alias("log_seq"), F.size("current").cast("bigint").alias("n_values"), F.size("schema.columns").cast("bigint").alias("n_columns"))


@query("with {log} select log_seq, cast(user_id as varchar) as user_id, event_type, props, 3 as n from log")
def map_row(spark, d):
    """Named rows; under the wider layout a row is cut to its values."""
    log = rows.row_images(fixture.raw_log(spark, d)).withColumn("current", rows.current_image(F.col("op"), F.col("before"), F.col("after")))
    named = schemas.asof(log, fixture.schema_versions(spark, (8000,))).withColumn("row", schemas.named_row(F.col("current"), F.col("schema.columns")))
    return named.select((F.floor(F.col("log_seq") / 4) + 1).alias("log_seq"), *(F.col("row").getItem(c).alias(c) for c in fixture.COLUMNS), F.size("row").cast("bigint").alias("n"))


# --- keys and queues ---


@query("with {log} select log_seq, key from kept")
def entity_key(spark, d):
    return _events(spark, d).select((F.floor(F.col("log_seq") / 4) + 1).alias("log_seq"), "key")


@query(r"""with d as (select doc_id, replace(replace(text, '\', '\\'), '|', '\|') as v from documents) select doc_id, 'db.t|\N|' || coalesce(v || '\|a\\b', '\N') || '|' || coalesce(v, '\N') as key from d""")
def key_escape(spark, d):
    """Every document by its whole text, by the text with a bar and a backslash after it, and by a null."""
    docs = _tpch(spark, d, "documents").select("doc_id", F.col("text").alias("v"), F.concat("text", F.lit("|a\\b")).alias("suffixed"), F.lit(None).cast("string").alias("none"))
    return docs.select("doc_id", keys.key_of_row(docs.schema, F.lit("db.t"), ["none", "suffixed", "v"]).alias("key"))


@query("""select o_orderkey, 'shop.orders|' || o_custkey || '|' || o_orderkey as key, 'shop.orders|' || o_orderkey || '|\\N' as key_missing from orders""".replace("\\\\N", "\\N"))
def key_override(spark, d):
    o = _tpch(spark, d, "orders")
    fqtn = F.lit("shop.orders")
    own = keys.key_of_row(o.schema, fqtn, ["o_orderkey"])
    overridden = keys.resolve(fqtn, own, {"shop.orders": keys.key_of_row(o.schema, fqtn, ["o_custkey", "o_orderkey"])})
    return o.select("o_orderkey", overridden.alias("key"), keys.key_of_row(o.schema, fqtn, ["o_orderkey", "nope"]).alias("key_missing"))


_PLAIN = lambda c: f"regexp_replace({c}::varchar, '[.]0$', '')"


@query(f"""select 'shop.lines|' || {_PLAIN('l_discount')} || '|' || {_PLAIN('l_extendedprice')} || '|' || l_linenumber || '|' || l_linestatus || '|' || l_orderkey || '|' || l_partkey || '|' || {_PLAIN('l_quantity')} || '|' || l_returnflag
  || '|' || l_shipdate::date || '|' || l_suppkey || '|' || {_PLAIN('l_tax')} as key, count(*) as n from lineitem group by 1""")
def keyless_key(spark, d):
    """A table without a primary key: all columns, by name."""
    li = _tpch(spark, d, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("date"))
    return li.select(keys.key_of_row(li.schema, F.lit("shop.lines")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("with {log}, k as (select key, count(*) as n from kept group by key) select key, cast({fnv(key)} % 8 as integer) as queue, n from k")
def queue_id(spark, d):
    e = _events(spark, d).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return e.select("key", keys.queue_of(F.col("key"), QUEUES).alias("queue"), "n")


_QUEUED = "q as (select kept.*, k.queue from kept join (select key, cast({fnv(key)} % 8 as integer) as queue from (select distinct key from kept)) k using (key))"


@query("with {log}, " + _QUEUED + " select queue, count(*) as depth from q group by queue")
def queue_depths(spark, d):
    return batching.queue_depths(_events(spark, d))


@query("with {log}, " + _QUEUED + " select count(distinct queue) as queues from q")
def queue_spread(spark, d):
    return audits.queue_spread(_events(spark, d))


@query("with {log}, " + _QUEUED + " select queue, seq_no, row_number() over (partition by queue order by seq_no) as place from q")
def queue_order(spark, d):
    return ordering.ordinal(_events(spark, d), "place", "seq_no", ["queue"]).select("queue", "seq_no", "place")


@query("with {log}, " + _QUEUED + ", n as (select *, row_number() over (partition by queue order by seq_no) as k from q) select queue, (k - 1) // 512 as batch, count(*) as n, min(seq_no) as first_seq, max(seq_no) as last_seq from n group by 1, 2")
def publish_batches(spark, d):
    """Whole micro-batches of 256 rows, drained until a batch has 500 or more."""
    counted = decode.queued(fixture.raw_log(spark, d), fixture.schema_versions(spark), INCLUDE, EXCLUDE, queues=QUEUES)
    b = batching.publish_batches(_events(spark, d), BATCH, counted=counted)
    return b.groupBy("queue", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("seq_no").alias("first_seq"), F.max("seq_no").alias("last_seq"))


@query("with {log} select max(ts_ms) as newest_ms from log where ts_ms > 0")
def newest_event(spark, d):
    return batching.newest_event(fixture.change_log(spark, d))


# --- envelopes and sinks ---


@query(r"""select doc_id, '{"doc_id":' || doc_id || ',"lang":' || to_json(lang) || ',"n_chars":' || n_chars || ',"nothing":null,"text":' || to_json(text) || '}' as row_json from documents""")
def row_json(spark, d):
    docs = _tpch(spark, d, "documents").select("doc_id", "text", "lang", "n_chars", F.lit(None).cast("string").alias("nothing"))
    return docs.select("doc_id", envelope.row_object(docs.schema).alias("row_json"))


@query(f"""select event_id, '{{"large":' || {_PLAIN('(value * 1e6)')} || ',"negative":' || {_PLAIN('(-value)')} || ',"value":' || {_PLAIN('value')} || ',"whole":' || {_PLAIN('round(value)')} || '}}' as row_json from events""")
def float_json(spark, d):
    """Numbers with a fraction, in the fewest digits and without an exponent; whole ones without a point."""
    e = fixture.events(spark, d).select("event_id", (F.col("value") * 1e6).alias("large"), (-F.col("value")).alias("negative"), "value", F.round("value").alias("whole"))
    return e.select("event_id", envelope.row_object(e.drop("event_id").schema).alias("row_json"))


@query(r"""with {log} select log_seq, '{"connector":"mysql"' || case when log_seq % 2 = 0 then ',"server_id":1' else '' end || ',"db":"shop","table":"' || tbl || '"' || case when log_seq % 3 = 0 then ',"gtid":"' || uuid || ':' || gno || '"' else '' end || ',"file":"' || file || '"' || case when log_seq % 5 = 0 then ',"pos":' || pos else '' end || ',"tx_order":' || tx_order || '}' as source_json from log""")
def source_json(spark, d):
    """Parts that are zero or empty are left out."""
    log = ordering.tx_order(_identity(fixture.change_log(spark, d)))
    unless = lambda n, c, zero: F.when(F.col("log_seq") % n == 0, c).otherwise(F.lit(zero))
    source = F.struct(
        F.lit("mysql").alias("connector"), unless(2, F.lit(1), 0).cast("bigint").alias("server_id"), "db", "table",
        unless(3, F.col("gtid"), "").alias("gtid"), "file", unless(5, F.col("pos"), 0).cast("bigint").alias("pos"), "tx_order",
    )
    return log.select("log_seq", source.alias("source")).select("log_seq", envelope.source_object().alias("source_json"))


@query("with {log} select uuid || ':' || gno || '#' || tx_order as id, {envelope} as payload from kept")
def envelope_json(spark, d):
    return decode.payloads(_events(spark, d)).select("id", "payload")


@query("with {log} select tbl as \"table\", count(*) as n, sum(cast(('0x' || substr(md5({envelope}), 1, 8)) as bigint))::bigint as digest from kept group by tbl")
def payload_digest(spark, d):
    """A digest of all payloads of a table: equal events give equal bytes."""
    p = decode.payloads(_events(spark, d))
    part = F.conv(F.substring(F.md5("payload"), 1, 8), 16, 10).cast("bigint")
    return p.groupBy(F.col("source.table").alias("table")).agg(F.count(F.lit(1)).alias("n"), F.sum(part).alias("digest"))


@query("""with {log} select distinct tbl as "table", case tbl when 'views' then 'views-firehose' else 'cdc.shop.' || tbl end as topic, 'x-' || tbl || '.shop' as templated from log""")
def topic_route(spark, d):
    log = fixture.change_log(spark, d).select("db", "table").distinct()
    return log.select("table", tables.topic(F.col("db"), F.col("table"), overrides={"shop.views": "views-firehose"}).alias("topic"), tables.topic(F.col("db"), F.col("table"), "x-{table}.{database}").alias("templated"))


@query("with {log} select 'cdc.shop.' || tbl as topic, key, {envelope} as value, seq_no from kept")
def sink_records(spark, d):
    """The flagship: from the raw log to what a sink gets."""
    r = decode.sink_records(_events(spark, d))
    return r.select("topic", F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"), "seq_no")


# --- checkpoints and state ---


def _acks(spark: SparkSession, d: str) -> DataFrame:
    """Acknowledged numbers with the tick of each: every tick acknowledges what it has published late; 777, 1554.. come last or never."""
    log = fixture.change_log(spark, d)
    s = F.col("log_seq")
    tick = F.floor((s - 1) / 100) + F.when(s % 7 == 0, 3).otherwise(0)
    return log.where(s % 7770 != 0).select(s.alias("seq_no"), F.when(s % 777 == 0, tick + 20).otherwise(tick).alias("tick"), (s % 4).alias("lane"))


_ACKS = "acks as (select event_id + 1 as s, event_id // 100 + case when (event_id + 1) % 7 = 0 then 3 else 0 end + case when (event_id + 1) % 777 = 0 then 20 else 0 end as tick, (event_id + 1) % 4 as lane from events where (event_id + 1) % 7770 <> 0)"


@query("with " + _ACKS + ", r as (select s, row_number() over (order by s) as k from acks) select coalesce(max(s), 0) as checkpoint from r where s = k")
def ckpt_prefix(spark, d):
    return checkpoints.prefix(_acks(spark, d))


@query("with " + _ACKS + ", r as (select s, row_number() over (order by s) as k from acks) select count(*) filter (s <> k) as outstanding from r")
def ckpt_outstanding(spark, d):
    return checkpoints.outstanding(_acks(spark, d))


@query("with " + _ACKS + ", r as (select s, row_number() over (order by s) as k, max(tick) over (order by s) as reached from acks) select reached as tick, max(s) as checkpoint from r where s = k group by reached")
def ckpt_ticks(spark, d):
    return checkpoints.ticks(_acks(spark, d), "tick")


@query("with " + _ACKS + " select lane, max(s) as last_seq, count(*) as acked from acks group by lane")
def lane_progress(spark, d):
    return checkpoints.lanes(_acks(spark, d), "lane")


@query("""with c as (select 'flow-' || c_custkey % 100 as flow_id, 'binlog.1' as binlog_file, cast(c_custkey as bigint) as binlog_pos, cast(c_custkey as bigint) as seq_no from customer),
  t as (select 'flow-' || i as flow_id, 'binlog.0' as binlog_file, 0::bigint as binlog_pos, 0::bigint as seq_no from range(50, 120) r(i)), n as (select flow_id, max(seq_no) as seq_no from c group by flow_id)
  select flow_id, binlog_file, binlog_pos, seq_no from c join n using (flow_id, seq_no) union all select * from t where flow_id not in (select flow_id from c)""")
def state_upsert(spark, d):
    changes = _tpch(spark, d, "customer").select(F.concat(F.lit("flow-"), (F.col("c_custkey") % 100).cast("string")).alias("flow_id"), F.lit("binlog.1").alias("binlog_file"), F.col("c_custkey").cast("bigint").alias("binlog_pos"), F.col("c_custkey").cast("bigint").alias("seq_no"))
    table = spark.range(50, 120).select(F.concat(F.lit("flow-"), F.col("id").cast("string")).alias("flow_id"), F.lit("binlog.0").alias("binlog_file"), F.lit(0).cast("bigint").alias("binlog_pos"), F.lit(0).cast("bigint").alias("seq_no"))
    return checkpoints.upserted(table, changes)


@query("""with {log}, h as (select file, pos + case when pos = 250000 then 75 else 50 end as pos from log order by log_seq desc limit 1)
  select 'a' as flow_id, 'binlog.000001' as file, 150 as pos union all select 'b', file, pos from h union all select 'c', file, pos from h""")
def resume_from(spark, d):
    """File mode: a saved file wins, else the head; a saved number alone says nothing."""
    saved = spark.createDataFrame([("a", None, "binlog.000001", 150, 9), ("b", None, None, None, 5), ("c", "", "", 0, 0)], "flow_id string, gtid_set string, binlog_file string, binlog_pos bigint, seq_no bigint")
    head = ordering.log_head(fixture.raw_log(spark, d)).withColumn("gtid_set", F.lit("g:1-5"))
    return checkpoints.resume_from(saved, head, gtid=False).select("flow_id", "file", "pos")


# --- audits ---


def _delivered(spark: SparkSession, d: str) -> DataFrame:
    """Arrivals with replays: a delivery of all, then of the last transactions of each thousand again."""
    log = ordering.ordinal(_identity(fixture.change_log(spark, d)), "seq_no")
    log = ordering.tx_order(log).withColumn("id", gtids.event_id(F.col("gtid"), F.col("tx_order"), F.col("file"), F.col("pos"), F.lit(0)))
    log = log.withColumn("key", F.concat(F.lit("shop|"), F.col("user_id").cast("string"))).select("id", "key", "seq_no", "op", "props")
    again = F.when(F.col("seq_no") % 1000 >= 990, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return log.select("*", F.explode(again).alias("copy")).withColumn("arrival", F.col("seq_no") * 2 + F.col("copy") * 41)


_DELIVERED = "d as (select uuid || ':' || gno || '#' || tx_order as id, 'shop|' || user_id as key, log_seq as seq_no, op, props, copy, log_seq * 2 + copy * 41 as arrival from log, (values (0), (1)) c(copy) where copy = 0 or log_seq % 1000 >= 990)"


@query("with {log}, " + _DELIVERED + " select id, min(seq_no) as seq_no, min(arrival) as arrival from d group by id")
def dedupe_by_id(spark, d):
    return audits.first_of_each(_delivered(spark, d)).select("id", "seq_no", "arrival")


@query("with {log}, " + _DELIVERED + ", p as (select *, lag(seq_no) over (partition by key order by arrival) as previous_seq from d) select key, arrival, seq_no, previous_seq from p where seq_no <= previous_seq")
def order_audit(spark, d):
    return audits.order_violations(_delivered(spark, d)).select("key", "arrival", "seq_no", "previous_seq")


@query("""with {log}, p as (select *, lag(op) over (partition by user_id order by log_seq) as previous_op from log), v as (select case when previous_op is null and op <> 'c' then 'first_not_create' when previous_op = 'd' then 'after_delete' when previous_op is not null and op = 'c' then 'create_again' end as violation from p)
  select violation, count(*) as n from v where violation is not null group by violation""")
def lifecycle_audit(spark, d):
    found = audits.lifecycle_violations(fixture.change_log(spark, d), "user_id", "log_seq")
    return found.groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@query("with c as (select conv_id * 100 + turn as s from conversations group by all), p as (select s, lag(s, 1, 0) over (order by s) as p from c where s >= 1) select p + 1 as gap_first, s - 1 as gap_last from p where s > p + 1")
def gap_audit(spark, d):
    turns = _tpch(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("s"))
    return audits.gaps(turns, "s")


@query("with {log}, " + _DELIVERED + " select id from (select uuid || ':' || gno || '#' || tx_order as id from log) e where id not in (select id from d where seq_no % 500 <> 0)")
def absent_ids(spark, d):
    got = _delivered(spark, d)
    return audits.absent(got.select("id").distinct(), got.where("seq_no % 500 <> 0"))


@query("with {log}, " + _DELIVERED + " select id, count(*) as copies, count(distinct props) as payloads from d group by id having count(*) > 1")
def replay_audit(spark, d):
    return audits.replays(_delivered(spark, d), payload="props")


@query("with {log} select log_seq, op from log where (op = 'c' and log_seq % 10 = 0) or (op = 'd' and log_seq % 15 = 0) or (op = 'u' and log_seq % 35 = 0)")
def image_audit(spark, d):
    """Images damaged here: creations given a before, deletions an after, updates robbed of theirs."""
    log = fixture.change_log(spark, d)
    s, op = F.col("log_seq"), F.col("op")
    damaged = log.withColumn("before", F.when((op == "c") & (s % 10 == 0), F.col("after")).when((op == "u") & (s % 35 == 0), F.lit(None)).otherwise(F.col("before")))
    damaged = damaged.withColumn("after", F.when((op == "d") & (s % 15 == 0), F.col("before")).otherwise(F.col("after")))
    return audits.image_violations(damaged).select("log_seq", "op")


# --- counters ---


@query("""with s as (select user_id as flow, event_id as t, event_id % 977 as v from events), p as (select *, lag(v, 1, 0) over (partition by flow order by t) as b from s), g as (select flow, t, v as "value", case when v < b then v else v - b end as delta from p)
  select *, cast(sum(delta) over (partition by flow order by t rows unbounded preceding) as bigint) as total from g""")
def counter_delta(spark, d):
    e = fixture.events(spark, d).select(F.col("user_id").alias("flow"), F.col("event_id").alias("t"), (F.col("event_id") % 977).alias("value"))
    return counters.deltas(e, "flow", "t", "value")


@query("select i as attempt, cast(least(60, 2 ** i) as bigint) as seconds from range(10) t(i)")
def backoff_schedule(spark, d):
    return spark.range(10).select(F.col("id").alias("attempt"), counters.backoff(F.col("id")).alias("seconds"))


@query("select * from (values ('created', 0), ('starting', 1), ('running', 2), ('stopping', 3), ('stopped', 4), ('failed', 5)) t(state, number)")
def flow_states(spark, d):
    states = spark.createDataFrame([(s,) for s in counters.STATES], "state string")
    return states.select("state", counters.state_number(F.col("state")).alias("number"))


@query("with {log}, m as (select max(ts_ms) as now from log) select log_seq, greatest(0.0, (now - 60000 - ts_ms) / 1000) as lag_seconds from log, m")
def source_lag(spark, d):
    """Age of each event a minute before the newest; never below 0."""
    log = fixture.change_log(spark, d)
    now = log.agg((F.max(F.unix_millis("occurred_at")) - 60000).alias("now"))
    return log.crossJoin(F.broadcast(now)).select("log_seq", counters.lag_seconds(F.col("now"), F.unix_millis("occurred_at")).alias("lag_seconds"))


@query("""select doc_id, case when strlen(text) > 20 then left(text, list_max(list_filter(range(0, 21), lambda k: strlen(left(text, k)) <= 20))) || '...' else text end as line from documents""")
def truncated_text(spark, d):
    """Every document, of any language, cut to 20 bytes between code points."""
    return _tpch(spark, d, "documents").select("doc_id", tables.truncated(F.col("text"), 20).alias("line"))
