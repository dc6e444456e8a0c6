"""Keys, names, envelopes: fixed vectors and comparison with Python's json."""

import base64
import json
import random
from datetime import datetime, timezone
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions import envelope, gtids, keys, tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def key(spark, schema, row, columns=None, fqtn="db.t"):
    df = spark.createDataFrame([row], schema)
    return df.select(keys.key_of_row(df.schema, F.lit(fqtn), columns).alias("x")).first().x


def test_key_vectors(spark):
    assert key(spark, "id int, name string", (5, "x"), ["id"]) == "db.t|5"
    assert key(spark, "seller int, id int", (42, 1), ["seller"]) == "db.t|42"
    assert key(spark, "x string, y string", ("a|b", "c")) != key(spark, "x string, y string", ("a", "b|c"))
    kinds = {key(spark, "x string", (v,)) for v in (None, "", "\\N")}
    assert len(kinds) == 3 and "db.t|\\N" in kinds
    assert key(spark, "b string, a int, c boolean", ("z", 1, True)) == "db.t|1|z|true"
    assert key(spark, "a int", (1,), ["a", "missing"]) == "db.t|1|\\N"


@pytest.mark.parametrize("value,text", [(1.0, "1"), (0.0, "0"), (-0.0, "-0"), (1.5, "1.5"), (100000.0, "100000"), (1e6, "1e+06"), (123456789.0, "1.23456789e+08"), (1e-4, "0.0001"), (1e-5, "1e-05"), (-2.5e-7, "-2.5e-07"), (1e100, "1e+100"), (123.456, "123.456"), (0.1, "0.1"), (999999.5, "999999.5"), (float("inf"), "+Inf"), (float("-inf"), "-Inf"), (float("nan"), "NaN")])
def test_floats_in_keys(spark, value, text):
    assert key(spark, "x double", (value,)) == f"db.t|{text}"


def test_floats_of_single_precision(spark):
    assert key(spark, "x float", (0.1,)) == "db.t|0.1"


def test_fnv(spark):
    for text, h in (("db.t|1", 3784677514), ("a", 3826002220), ("é", 513665217), ("", 2166136261)):
        assert one(spark, keys.fnv1a32(F.lit(text))) == h
    assert one(spark, keys.queue_of(F.lit("db.t|1"), 8)) == 2


def test_thousand_keys_reach_all_queues(spark):
    rows = spark.range(1000).select(keys.queue_of(F.concat(F.lit("db.t|"), F.col("id").cast("string")), 8).alias("q"))
    assert rows.distinct().count() == 8


def test_override_resolution(spark):
    df = spark.createDataFrame([("db.t", "own"), ("db.u", ""), ("db.v", None), ("db.o", "own")], "f string, k string")
    got = [r.x for r in df.select(keys.resolve(F.col("f"), F.col("k"), {"db.o": F.lit("other")}).alias("x")).collect()]
    assert got == ["own", "db.u", "db.v", "other"]


@pytest.mark.parametrize("include,exclude,name,want", [
    ([], [], "any.table", True), (["catalog.deals"], [], "catalog.deals", True), (["catalog.deals"], [], "catalog.products", False),
    (["catalog.*"], [], "catalog.products", True), (["catalog.*_price"], [], "catalog.seller_price", True), (["catalog.*_price"], [], "catalog.price", False),
    (["catalog.*"], ["catalog.tmp_*"], "catalog.tmp_x", False), ([], ["own.*"], "own.user", False), ([], [], "mysql.user", False), ([], [], "app.flow_state", False),
    (["c.t?"], [], "c.t1", True), (["c.t[0-4]"], [], "c.t5", False), (["c.t[^0-4]"], [], "c.t5", True), (["c.*"], [], "c.a.b", True), (["c.*"], [], "c.a/b", False), (["c\\*"], [], "c*", True), (["c\\*"], [], "cx", False),
])
def test_table_filter(spark, include, exclude, name, want):
    assert one(spark, tables.captured(F.lit(name), include, exclude)) is want


@pytest.mark.parametrize("pattern", ["a[b", "a\\", "[]"])
def test_malformed_patterns_are_refused(pattern):
    with pytest.raises(ValueError):
        tables.glob_regex(pattern)


def test_topics(spark):
    db, table = F.lit("catalog"), F.lit("deals")
    assert one(spark, tables.topic(db, table)) == "cdc.catalog.deals"
    assert one(spark, tables.topic(db, table, "x-{table}")) == "x-deals"
    assert one(spark, tables.topic(db, table, overrides={"catalog.deals": "firehose"})) == "firehose"
    assert one(spark, tables.topic(db, F.lit("other"), overrides={"catalog.deals": "firehose"})) == "cdc.catalog.other"


def test_gtids(spark):
    sid = F.unhex(F.lit("3e11fa4771ca11e19e33c80aa9429562"))
    assert one(spark, gtids.format_sid(sid)) == "3e11fa47-71ca-11e1-9e33-c80aa9429562"
    assert one(spark, gtids.format_sid(F.unhex(F.lit("AB01")))) == "ab01"
    assert one(spark, gtids.gtid(sid, F.lit(7))).endswith("9562:7")
    assert one(spark, gtids.gtid(F.unhex(F.lit("00" * 16)), F.lit(7))) is None
    assert one(spark, gtids.gtid(sid, F.lit(0))) is None
    place = (F.lit("f.1"), F.lit(120), F.lit(2))
    assert one(spark, gtids.event_id(F.lit("u:5"), F.lit(3), *place)) == "u:5#3"
    assert one(spark, gtids.event_id(F.lit(None).cast("string"), F.lit(3), *place)) == "f.1:120:2"


@pytest.mark.parametrize("kind,op", [("write", "c"), ("update", "u"), ("delete", "d"), ("WRITE_ROWS_EVENTv2", "c"), ("update_rows_event_v1", "u"), ("delete_rows_v0", "d"), ("xid", None), ("rotate", None)])
def test_op_of(spark, kind, op):
    assert one(spark, gtids.op_of(F.lit(kind))) == op


def test_ddl(spark):
    assert one(spark, gtids.is_ddl(F.lit(" begin "))) is False
    assert one(spark, gtids.is_ddl(F.lit("ALTER TABLE t"))) is True


KINDS = [T.LongType(), T.IntegerType(), T.DecimalType(20, 0), T.DoubleType(), T.BooleanType(), T.StringType(), T.BinaryType(), T.FloatType()]


def value(rng, kind):
    if rng.random() < 0.15:
        return None
    if isinstance(kind, T.LongType):
        return rng.randrange(-(2**63), 2**63)
    if isinstance(kind, T.IntegerType):
        return rng.randrange(-(2**31), 2**31)
    if isinstance(kind, T.DecimalType):
        from decimal import Decimal

        return Decimal(rng.randrange(2**64))
    if isinstance(kind, T.DoubleType):
        return rng.choice([rng.uniform(-1e6, 1e6), rng.random() * 10 ** rng.randint(-300, 300), 0.0, 1e21, 1e-7])
    if isinstance(kind, T.FloatType):
        return float(rng.randint(-1000, 1000)) / 4
    if isinstance(kind, T.BooleanType):
        return rng.random() < 0.5
    text = "".join(rng.choice('ab "\\\n\r\t\b\f\x01\x1fé漢🙂</&') for _ in range(rng.randrange(12)))
    return text.encode() if isinstance(kind, T.BinaryType) else text


def test_rows_equal_json_after_decoding(spark):
    rng = random.Random(42)
    for _ in range(6):
        fields = [T.StructField(f"c{rng.randrange(10**6)}_{k}", rng.choice(KINDS)) for k in range(rng.randrange(1, 24))]
        rows = [tuple(value(rng, f.dataType) for f in fields) for _ in range(60)]
        schema = T.StructType(fields)
        got = [r.j for r in spark.createDataFrame(rows, schema).select(envelope.row_object(schema).alias("j")).collect()]
        for row, text in zip(rows, got, strict=True):
            want = {f.name: base64.b64encode(v).decode() if isinstance(v, bytes) else int(v) if isinstance(f.dataType, T.DecimalType) and v is not None else v for f, v in zip(fields, row, strict=True)}
            read = json.loads(text)  # a whole double has no point
            assert {f.name: float(v) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and (v := read[f.name]) is not None else read[f.name] for f in fields} == want and len(read) == len(want)
            assert list(json.loads(text)) == sorted(want)


def test_json_columns_are_embedded(spark):
    schema = T.StructType.fromDDL("id int, doc string, txt string")
    df = spark.createDataFrame([(1, '{"k": 1.50, "a": [null]}', '{"k": 1}'), (2, None, None), (3, "", "")], schema)
    got = [r.j for r in df.select(envelope.row_object(schema, json_columns=frozenset({"doc"})).alias("j")).collect()]
    assert got[0] == '{"doc":{"k": 1.50, "a": [null]},"id":1,"txt":"{\\"k\\": 1}"}'
    assert json.loads(got[1]) == {"doc": None, "id": 2, "txt": None}
    assert json.loads(got[2]) == {"doc": None, "id": 3, "txt": ""}


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf")])
def test_floats_that_json_lacks_are_errors(spark, bad):
    schema = T.StructType.fromDDL("x double")
    with pytest.raises(Exception, match="unsupported float value"):
        spark.createDataFrame([(bad,)], schema).select(envelope.row_object(schema)).collect()


def test_typed_fragments(spark):
    names, kinds, values = (F.array(*map(F.lit, x)) for x in (["n", "t", "b", "j", "x"], ["number", "text", "bool", "json", "binary"], ["5", 'a"b', "true", '{"q": [1]}', "deadbeef"]))
    assert one(spark, envelope.object_of_arrays(names, kinds, values)) == '{"b":true,"j":{"q": [1]},"n":5,"t":"a\\"b","x":"3q2+7w=="}'
    assert json.loads(one(spark, envelope.object_of_arrays(names, kinds, F.slice(values, 1, 2)))) == {"n": 5, "t": 'a"b'}
    assert one(spark, envelope.object_of_arrays(names, kinds, F.lit(None).cast("array<string>"))) is None


def test_envelope_members(spark):
    df = spark.createDataFrame([("u:1#1", "c", None, '{"id":1}', ("mysql", 0, "db", "t", "", "f", 0, 1), datetime(2024, 1, 1, 0, 0, 0, 999_999, timezone.utc))], "id string, op string, before string, after string, source struct<connector:string,server_id:bigint,db:string,`table`:string,gtid:string,file:string,pos:bigint,tx_order:int>, at timestamp")
    text = df.select(envelope.envelope(F.col("id"), F.col("op"), F.col("before"), F.col("after"), envelope.source_object(), F.col("at")).alias("x")).first().x
    assert text == '{"id":"u:1#1","op":"c","before":null,"after":{"id":1},"source":{"connector":"mysql","db":"db","table":"t","file":"f","tx_order":1},"ts_ms":1704067200999}'


def test_kinds_and_truncation(spark):
    assert one(spark, tables.column_kind(F.lit("longblob"))) == "binary"
    assert one(spark, tables.wire_kind(F.lit("int"))) == "number"
    assert one(spark, tables.truncated(F.lit("abcdef"), 3)) == "abc..."
    assert one(spark, tables.truncated(F.lit("abc"), 3)) == "abc"


def go_number(x, single=False):
    """The shortest digits by Python's repr (of a single: by trying widths), spelled without an exponent from 1e-6 to 1e21."""
    digits = next(t for n in range(1, 10) if np.float32(t := f"{x:.{n}g}") == np.float32(x)) if single else repr(x)
    if x and not 1e-6 <= abs(x) < 1e21:
        sign, ds, exp = Decimal(digits).as_tuple()
        ds = "".join(map(str, ds)).rstrip("0")
        power = len(Decimal(digits).as_tuple().digits) + exp - 1
        return ("-" if sign else "") + ds[0] + ("." + ds[1:] if len(ds) > 1 else "") + f"e{power:+03d}"
    text = f"{Decimal(digits):f}"
    return text.rstrip("0").rstrip(".") if "." in text else text


def test_floats_in_json(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 5.0, 1e7, 1e20, 1e21, 1.5e21, 1e-6, 9.9e-7, 1e-7, 123456.789, 0.1, 100.0, 1e300, 5e-324, 1.7976931348623157e308, -2.5e-9]
    values += [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randint(-12, 25) for _ in range(400)]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    got = [r.t for r in rows.orderBy("k").select(envelope.fragment(F.col("v"), T.DoubleType()).alias("t")).collect()]
    wrong = [(v, g, go_number(v)) for v, g in zip(values, got, strict=True) if g != go_number(v)]
    assert [(v, g) for v, g, _ in wrong] == [(5e-324, "4.9e-324")], wrong  # less than 15 digits are sought for no subnormal number
    singles = [float(np.float32(v)) for v in (0.1, 5.0, 1e7, 16777216.0, 3.4e38, 1.17e-38, 0.3, 1e-6, 2.5)]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(singles)], "k int, v float")
    got = [r.t for r in rows.orderBy("k").select(envelope.fragment(F.col("v"), T.FloatType()).alias("t")).collect()]
    assert got == [go_number(v, True) for v in singles]
    for bad in (float("nan"), float("inf"), float("-inf")):
        with pytest.raises(Exception, match="unsupported float"):
            spark.createDataFrame([(bad,)], "v double").select(envelope.fragment(F.col("v"), T.DoubleType())).collect()
