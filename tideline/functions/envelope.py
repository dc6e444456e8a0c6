"""The JSON change envelope. Built as text, so that JSON columns are embedded as they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.keys import shortest


def quoted(text: Column) -> Column:
    """A JSON string."""
    inside = F.to_json(F.array(text))
    return F.substr(inside, F.lit(2), F.length(inside) - 2)


def _finite(number: Column) -> Column:
    bad = F.isnan(number) | (F.abs(number) == float("inf"))
    return F.when(bad, F.raise_error(F.concat(F.lit("unsupported float value "), number.cast("string"))).cast("double")).otherwise(number)


def json_number(value: Column, single: bool = False) -> Column:
    """A double (or a single, in the fewest digits of its own width) without an exponent from 1e-6 to 1e21; NaN and infinities are errors."""
    if not single:
        return shortest(_finite(value), -6, 21)
    text = shortest(_finite(value.cast("string").cast("double")), -6, 21)
    below = F.abs(value.cast("double")) < 1e-6  # as is the single that is spelled 1e-6
    return F.when(below, F.replace(text, F.lit("0.000001"), F.lit("1e-06"))).otherwise(text)


def fragment(value: Column, kind: T.DataType, is_json: bool = False) -> Column:
    """A value as JSON text; never null."""
    if is_json:
        text = F.nullif(value.cast("string"), F.lit(""))
    elif isinstance(kind, T.BinaryType):
        text = F.concat(F.lit('"'), F.base64(value), F.lit('"'))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        text = F.when(value.isNotNull(), json_number(value, isinstance(kind, T.FloatType)))
    elif isinstance(kind, (T.IntegralType, T.DecimalType, T.BooleanType)):
        text = value.cast("string")
    elif isinstance(kind, T.TimestampType):
        text = F.concat(F.lit('"'), F.regexp_replace(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0*$", ""), F.lit('Z"'))
    elif isinstance(kind, (T.StringType, T.DateType)):
        text = F.when(value.isNotNull(), quoted(value.cast("string")))
    else:
        text = F.when(value.isNotNull(), F.to_json(value))
    return F.coalesce(text, F.lit("null"))


def row_object(schema: T.StructType, prefix: str = "", json_columns: frozenset[str] = frozenset()) -> Column:
    """The row of these columns as a JSON object: keys sorted, NULLs kept. `prefix` leads to a struct that holds them."""
    parts = []
    for f in sorted(schema.fields, key=lambda f: f.name.encode()):
        name = F.lit(("," if parts else "{"))
        parts.append(F.concat(name, quoted(F.lit(f.name)), F.lit(":"), fragment(F.col(f"{prefix}`{f.name}`"), f.dataType, f.name in json_columns)))
    return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")


def typed_fragment(value: Column, kind: Column) -> Column:
    """As fragment(), for a textual value whose kind is a column: text, number, bool, binary (hex digits) or json."""
    text = (
        F.when(kind == "json", F.nullif(value, F.lit("")))
        .when(kind.isin("number", "bool"), value)
        .when(kind == "binary", F.concat(F.lit('"'), F.base64(F.unhex(value)), F.lit('"')))
        .otherwise(F.when(value.isNotNull(), quoted(value)))
    )
    return F.coalesce(text, F.lit("null"))


def object_of_arrays(names: Column, kinds: Column, values: Column) -> Column:
    """A positional row as a JSON object, cut to the shorter of names and values; null where there are no values."""
    width = F.least(F.size(names), F.size(values))
    zipped = F.arrays_zip(F.slice(names, 1, width).alias("n"), F.slice(kinds, 1, width).alias("k"), F.slice(values, 1, width).alias("v"))
    member = lambda x: F.concat(quoted(x["n"]), F.lit(":"), typed_fragment(x["v"], x["k"]))
    text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(zipped), member), ","), F.lit("}"))
    return F.when(values.isNotNull(), text)


def source_object(source: str = "source") -> Column:
    """The origin as a JSON object; server_id, gtid, file, pos and tx_order are left out where they are zero or empty."""
    col = lambda n: F.col(f"{source}.`{n}`")
    return F.to_json(F.struct(
        col("connector").alias("connector"), F.nullif(col("server_id"), F.lit(0).cast("bigint")).alias("server_id"),
        col("db").alias("db"), col("table").alias("table"), F.nullif(col("gtid"), F.lit("")).alias("gtid"),
        F.nullif(col("file"), F.lit("")).alias("file"), F.nullif(col("pos"), F.lit(0).cast("bigint")).alias("pos"),
        F.nullif(col("tx_order"), F.lit(0)).alias("tx_order"),
    ))


def envelope(identifier: Column, op: Column, before: Column, after: Column, source: Column, occurred_at: Column) -> Column:
    """before, after and source are JSON texts, null where absent; members stand in a fixed order."""
    return F.concat(
        F.lit('{"id":'), quoted(identifier), F.lit(',"op":'), quoted(op), F.lit(',"before":'), F.coalesce(before, F.lit("null")),
        F.lit(',"after":'), F.coalesce(after, F.lit("null")), F.lit(',"source":'), source,
        F.lit(',"ts_ms":'), F.unix_millis(occurred_at).cast("string"), F.lit("}"),
    )
