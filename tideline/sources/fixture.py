"""A change log, its raw records and its layouts, derived from the `events` test table.

Four rows a transaction, 2500 a file; sign-ups create, errors delete, the rest update. See FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UUID = "3e11fa47-71ca-11e1-9e33-c80aa9429562"
SERVER_ID = 1
PER_TRANSACTION, PER_FILE = 4, 2500
COLUMNS, KINDS, KEY = ("user_id", "event_type", "props"), ("number", "text", "json"), ("user_id",)
TABLES = ("users", "item_price", "views", "tmp_clicks")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a change: log_seq, gno, file, pos, db, table, op, before, after (structs), occurred_at, value."""
    e = events(spark, sf_dir)
    row = F.struct(*COLUMNS)
    op = F.when(F.col("event_type") == "signup", "c").when(F.col("event_type") == "error", "d").otherwise("u")
    table = F.when(F.col("event_type") == "purchase", "item_price").when(F.col("event_type") == "view", "views").when(F.col("event_type") == "click", "tmp_clicks").otherwise("users")
    number = F.col("event_id")
    return e.select(
        (number + 1).alias("log_seq"), (F.floor(number / PER_TRANSACTION) + 1).alias("gno"),
        F.concat(F.lit("binlog."), F.lpad((F.floor(number / PER_FILE) + 1).cast("string"), 6, "0")).alias("file"),
        ((number % PER_FILE + 1) * 100).alias("pos"), F.lit("shop").alias("db"), table.alias("table"), op.alias("op"),
        F.when(op != "c", row).alias("before"), F.when(op != "d", row).alias("after"),
        F.col("ts").alias("occurred_at"), "value", "user_id", "event_type", "props",
    )


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that a server would write: gtid, row records, xid, and a rotation at the end of a file. log_seq is 4 per row here."""
    log = change_log(spark, sf_dir)
    values = F.array(F.col("user_id").cast("string"), "event_type", "props")
    kind = F.when(F.col("op") == "c", "write").when(F.col("op") == "d", "delete").otherwise("update")
    rows = F.when(F.col("op") == "u", F.array(values, values)).otherwise(F.array(values))
    n = F.col("log_seq") - 1

    def record(slot: int, shift: int, kind, **fields):
        of = lambda name, t: fields.get(name, F.lit(None).cast(t)).alias(name)
        return F.struct(
            (n * 4 + slot).alias("log_seq"), (F.col("pos") + shift).alias("pos"), kind.alias("kind"), of("next_file", "string"), of("sid", "binary"),
            of("gno", "bigint"), of("query", "string"), of("db", "string"), of("table", "string"), of("rows", "array<array<string>>"),
        )

    following = F.concat(F.lit("binlog."), F.lpad((F.floor(n / PER_FILE) + 2).cast("string"), 6, "0"))
    records = F.array_compact(F.array(
        F.when(n % PER_TRANSACTION == 0, record(0, -50, F.lit("gtid"), sid=F.unhex(F.lit(UUID.replace("-", ""))), gno=F.col("gno"))),
        record(1, 0, kind, db=F.col("db"), table=F.col("table"), rows=rows),
        F.when(n % PER_TRANSACTION == PER_TRANSACTION - 1, record(2, 50, F.lit("xid"))),
        F.when(n % PER_FILE == PER_FILE - 1, record(3, 75, F.lit("rotate"), next_file=following)),
    ))
    found = log.select("file", F.lit(SERVER_ID).cast("bigint").alias("server_id"), F.col("occurred_at").alias("ts"), F.explode(records).alias("r"))
    return found.select("r.log_seq", "file", "r.pos", "server_id", "ts", "r.kind", "r.next_file", "r.sid", "r.gno", "r.query", "r.db", "r.table", "r.rows")


def schema_versions(spark: SparkSession, changes: tuple[int, ...] = ()) -> DataFrame:
    """The layout of each table from the start, and after each of `changes` one with a column `v<k>` more."""
    from tideline.model import SCHEMA_VERSION

    rows = [("shop", t, at, [*COLUMNS, *(f"v{j}" for j in range(1, k + 1))], [*KINDS, *["text"] * k], list(KEY)) for t in TABLES for k, at in enumerate((0, *changes))]
    return spark.createDataFrame(rows, SCHEMA_VERSION)


def generated(spark: SparkSession, n: int, keys: int) -> DataFrame:
    """A finite stream of n creations over `keys` keys: id, key, key_seq, seq_no, micro_batch."""
    i = F.col("id")
    return spark.range(n).select(i, F.concat(F.lit("gen.items|"), (i % keys).cast("string")).alias("key"), F.floor(i / keys).alias("key_seq"), (i + 1).alias("seq_no"), F.floor(i / 64).alias("micro_batch"))
