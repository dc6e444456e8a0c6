"""Entity keys, and the queues that they are dealt to."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What stands for NULL in a key; no escaped value can be this.
NULL = "\\N"


def escape(text: Column) -> Column:
    """Doubles each backslash and sets one before each bar."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shortest(number: Column, low: int = -4, high: int = 6) -> Column:
    """A double in the fewest digits that name it, with an exponent of two digits at least below 10**low and from 10**high on."""
    text = number.cast("string")
    usual = (F.abs(number) >= 1e-3) & (F.abs(number) < 10.0 ** min(high, 7))  # of which Java's text has no exponent
    cut = F.when(text.endswith(".0"), F.left(text, F.length(text) - 2)).otherwise(text)
    return F.when(usual, cut).when(text == "0.0", "0").otherwise(_spelled(number, low, high))


def _spelled(number: Column, low: int, high: int) -> Column:
    """The general case, from the shortest of 15, 16 and 17 digits that is read as the same double."""

    def parts(t: Column) -> Column:
        mantissa, power = F.split_part(t, F.lit("e"), F.lit(1)), F.split_part(t, F.lit("e"), F.lit(2))
        return F.struct(F.split_part(mantissa, F.lit("."), F.lit(1)).alias("whole"), F.replace(mantissa, F.lit("."), F.lit("")).alias("raw"), F.coalesce(F.nullif(power, F.lit("")).cast("int"), F.lit(0)).alias("power"))

    def digits(p: Column) -> Column:
        stripped = F.regexp_replace(p["raw"], "^0+", "")
        exponent = F.length(p["whole"]) + p["power"] - (F.length(p["raw"]) - F.length(stripped)) - 1
        return F.struct(F.regexp_replace(stripped, "0+$", "").alias("digits"), exponent.alias("exponent"))

    def spelled(d: Column) -> Column:
        ds, exponent = d["digits"], d["exponent"]
        n, size = F.length(ds), F.abs(exponent).cast("string")
        scientific = F.concat(
            F.substring(ds, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substr(ds, F.lit(2)))).otherwise(""),
            F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.when(F.length(size) < 2, F.concat(F.lit("0"), size)).otherwise(size),
        )
        plain = (
            F.when(exponent >= n - 1, F.concat(ds, F.repeat(F.lit("0"), exponent - n + 1)))
            .when(exponent >= 0, F.concat(F.substr(ds, F.lit(1), exponent + 1), F.lit("."), F.substr(ds, exponent + 2)))
            .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), ds))
        )
        return F.when(n == 0, "0").when((exponent < low) | (exponent >= high), scientific).otherwise(plain)

    def signed(x: Column) -> Column:
        t = x.cast("string")
        sign = F.when(t.startswith("-"), "-").otherwise("")  # a zero may have one too
        written = [F.format_string(f"%.{k}e", F.abs(x)) for k in (14, 15, 16)]
        down = F.concat(F.left(written[2], F.lit(17)), F.substr(written[2], F.lit(19)))  # Java rounds its own digits, which may be rounded up already
        same = [w.cast("double") == F.abs(x) for w in (*written, down)]
        exact = F.when(same[0], written[0]).when(same[1], written[1]).when(same[3], down).otherwise(written[2])
        finite = F.concat(sign, _let(_let(_let(exact, parts), digits), spelled))
        return F.when(t == "NaN", "NaN").when(t == "Infinity", "+Inf").when(t == "-Infinity", "-Inf").otherwise(finite)

    return F.when(number.isNotNull(), _let(number, signed))


def render(value: Column, kind: T.DataType) -> Column:
    """A value as part of a key; never null."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.BooleanType)):
        text = value.cast("string")
    elif isinstance(kind, T.DoubleType):
        text = shortest(value)
    elif isinstance(kind, T.FloatType):
        text = shortest(value.cast("string").cast("double"))
    else:
        text = escape(value.cast("string"))
    return F.coalesce(text, F.lit(NULL))


def entity_key(fqtn: Column, values: Sequence[tuple[Column, T.DataType]]) -> Column:
    """The table's full name and its key values, with bars between."""
    return F.concat_ws("|", fqtn, *(render(v, k) for v, k in values))


def key_of_row(schema: T.StructType, fqtn: Column, columns: Sequence[str] | None = None) -> Column:
    """The key of a row with this schema; columns that it lacks count as NULL, no columns mean all, by name."""
    kinds = {f.name: f.dataType for f in schema.fields}
    named = columns if columns else sorted(kinds)
    return entity_key(fqtn, [(F.col(f"`{c}`"), kinds[c]) if c in kinds else (F.lit(None), T.StringType()) for c in named])


def rendered(value: Column, kind: Column) -> Column:
    """As render(), for a textual value whose kind is a column: numbers and booleans hold nothing to escape."""
    return F.coalesce(F.when(kind.isin("number", "bool"), value).otherwise(escape(value)), F.lit(NULL))


def key_of_arrays(fqtn: Column, names: Column, kinds: Column, values: Column, wanted: Column) -> Column:
    """The key from positional values; `wanted` is an array of column names, empty or null for all, by name."""
    every = F.array_sort(F.slice(names, 1, F.least(F.size(names), F.size(values))))
    chosen = F.when(F.size(wanted) > 0, wanted).otherwise(every)
    at = lambda name: F.array_position(names, name).cast("int")
    one = lambda name: F.coalesce(rendered(F.get(values, at(name) - 1), F.get(kinds, at(name) - 1)), F.lit(NULL))
    return F.array_join(F.concat(F.array(fqtn), F.transform(chosen, one)), "|")


def resolve(fqtn: Column, own: Column, overrides: Mapping[str, Column]) -> Column:
    """The override of the table, else the key that came with the event, else the table's name."""
    key = F.coalesce(F.nullif(own, F.lit("")), fqtn)
    for table, other in overrides.items():
        key = F.when(fqtn == table, other).otherwise(key)
    return key


@F.arrow_udf(T.LongType())
def _fnv1a32(texts: pa.Array) -> pa.Array:
    """By byte position over a whole batch: the texts still that long go on, longest first."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = offsets[:-1][order], lengths[order]
    h = np.full(len(order), 2166136261, np.uint32)
    there = len(order)
    for k in range(int(lengths[0]) if len(lengths) else 0):
        there = int(np.searchsorted(-lengths[:there], -k, "left"))
        h[:there] = (h[:there] ^ data[starts[:there] + k]) * np.uint32(16777619)
    out = np.empty(len(order), np.int64)
    out[order] = h
    return pa.array(out, mask=texts.is_null().to_numpy(zero_copy_only=False))


def fnv1a32(text: Column) -> Column:
    """FNV-1a, 32 bits, of the UTF-8 bytes. An Arrow function: Spark has no loop over bytes that it compiles."""
    return _fnv1a32(text)


def queue_of(key: Column, queues: int) -> Column:
    return (fnv1a32(key) % queues).cast("int")
