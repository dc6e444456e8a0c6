"""Record types of the change-data-capture engine."""

from __future__ import annotations

from pyspark.sql import types as T

CREATE, UPDATE, DELETE = "c", "u", "d"
OPS = (CREATE, UPDATE, DELETE)

_STRING, _LONG, _INT, _TIME = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType()
_STRINGS = T.ArrayType(_STRING)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SOURCE = _struct(connector=_STRING, server_id=_LONG, db=_STRING, table=_STRING, gtid=_STRING, file=_STRING, pos=_LONG, tx_order=_INT)
POSITION = _struct(gtid_set=_STRING, file=_STRING, offset=_LONG, seq_no=_LONG)

#: One record of a captured log. `pos` is the end of the record; rows of an update alternate before and after.
RAW_LOG = _struct(
    log_seq=_LONG, file=_STRING, pos=_LONG, server_id=_LONG, ts=_TIME, kind=_STRING, next_file=_STRING,
    sid=T.BinaryType(), gno=_LONG, query=_STRING, db=_STRING, table=_STRING, rows=T.ArrayType(_STRINGS),
)

#: A change, with its images as JSON texts.
CHANGE_EVENT = _struct(id=_STRING, op=_STRING, before=_STRING, after=_STRING, source=SOURCE, occurred_at=_TIME, key=_STRING, position=POSITION)

#: One version of a table's layout, valid from a place in the log. Kinds: text, number, bool, binary, json.
SCHEMA_VERSION = _struct(db=_STRING, table=_STRING, valid_from_seq=_LONG, columns=_STRINGS, kinds=_STRINGS, pk=_STRINGS)

#: The state table of the flows, which a flow never captures (see functions.tables.BUILT_IN_EXCLUDES).
FLOW_STATE = _struct(flow_id=_STRING, gtid_set=_STRING, binlog_file=_STRING, binlog_pos=_LONG, seq_no=_LONG, updated_at=_TIME)

SINK_RECORD = _struct(topic=_STRING, key=T.BinaryType(), value=T.BinaryType())
