"""Exact deduplication with disk-backed keyed state that never expires. DataFrame operations only.

Rows are equal when their texts are, once ASCII white space is deleted. A stream of narrow rows
(digest, length, identifier, content locator) runs through a streaming aggregation whose state lives in
RocksDB and is checkpointed in the shared folder: per digest it holds the number of rows and the row that
stays, with its locator: the file that holds the text, and the row in it. Map-side partial aggregation makes one row a task of a hot digest.
Texts of a digest that was hit are then read again through their locators and compared by their full bytes; texts that
differ under one digest are separated by the texts themselves.

With a `state` folder the state stays: a later call takes up its own rows only, and its rows meet those of earlier calls, whose
texts are read where their locators say, for as long as those files are there.

Cases: a null text is the empty text; a null doc_id sorts after every other and stays null in keep_id;
identical repeated rows count each, and exactly one is kept; an empty table gives an empty result; columns
of other names are ignored; rows that lie in no file are written to one first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import normalised, removed, sized, text_of, work_dir, written

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition's empty logs take megabytes ahead
}


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


_KEEPER = "struct<shorter:bigint,unnamed:boolean,doc_id:bigint,located_in:string,row_no:bigint>"


def _keeper() -> Column:
    """Least is best: most code points, then a known and smallest doc_id, then the first of identical rows."""
    return F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "located_in", "row_no")


def located(docs: DataFrame, at: str) -> DataFrame:
    """docs with the locator of each row: _file, and _row in it; and _place, a hash of both. Rows of no single file are written to a table first."""
    if "_metadata" not in docs.columns:
        try:
            found = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
            return found.withColumn("_place", F.xxhash64("_file", "_row"))
        except AnalysisException:
            pass
    hidden = {"_metadata": "_metadata_"} if "_metadata" in docs.columns else {}
    return located(written(docs.withColumnsRenamed(hidden), f"{at}/rows"), at).withColumnsRenamed({new: old for old, new in hidden.items()})


def feed_of(rows: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The narrow rows that the state sees, of located rows."""
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        digest(normalised()).alias("digest"),
        F.length(text_of()).cast("long").alias("n_chars"),
        F.col("_file").alias("located_in"),
        F.col("_row").alias("row_no"),
        F.col("_place").alias("place"),
    )


def run_state(spark: SparkSession, feed_path: str, schema, out: str, checkpoint: str, files_per_batch: int = 10_000) -> DataFrame:
    """Streams the feed through the keyed state to its end; a later call with the same folders takes up new files only.

    Each micro-batch writes the state of the digests that it touched; the largest count of a digest is its last state.
    """
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        state = (
            spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(feed_path)
            .groupBy("digest").agg(F.min(_keeper()).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
        )
        query = (
            state.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kind = f"digest string, keeper {_KEEPER}, group_size bigint"
    seen = spark.read.schema(f"{kind}, batch int").option("basePath", out).parquet(f"{out}/*") if _exists(spark, out) else spark.createDataFrame([], kind)
    return seen.groupBy("digest").agg(F.max_by("keeper", "group_size").alias("keeper"), F.max("group_size").alias("group_size"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, state: str | None = None) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256, located_in, row_no, place.

    `digest` may be replaced, as in tests of collisions. With `state`, rows of earlier calls with the same folder count too,
    and the row that stays may be one of them.
    """
    at = work_dir(docs.sparkSession)
    return _dedup(located(docs, at), at, digest, state)


def _dedup(rows: DataFrame, at: str, digest: Callable[[Column], Column] = sha256, state: str | None = None) -> DataFrame:
    spark = rows.sparkSession
    feed = written(feed_of(rows, digest), f"{at}/feed")
    if state is not None:
        feed.write.mode("append").parquet(f"{state}/feed")
    kept_in = state or at
    groups = run_state(spark, f"{kept_in}/feed", feed.schema, f"{kept_in}/updates", f"{kept_in}/state")
    if state is not None:
        groups = groups.join(feed.select("digest").distinct(), "digest", "left_semi")
    groups = written(groups, f"{at}/groups")
    if state is None:
        for gone in ("updates", "state"):
            removed(spark, f"{at}/{gone}")
    collided = _collided(rows, feed, groups, at, state is not None)
    groups = groups.select("digest", F.col("keeper.doc_id").alias("keep_id"), "group_size", F.col("keeper.located_in").alias("_file"), F.col("keeper.row_no").alias("_row"))
    found = feed.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", ((F.col("row_no") == F.col("_row")) & (F.col("located_in") == F.col("_file"))).alias("kept"),
        F.col("digest").alias("text_sha256"), "located_in", "row_no", "place",
    )
    if collided.isEmpty():
        return found
    same = found.join(collided, found.text_sha256 == collided.digest, "left_anti")
    return same.unionByName(_by_bytes(rows, collided, digest, f"{state}/feed" if state else None))


def _collided(rows: DataFrame, feed: DataFrame, groups: DataFrame, at: str, earlier: bool) -> DataFrame:
    """The digests whose rows, read again through their locators, are not all of the same bytes."""
    spark = rows.sparkSession
    named = F.xxhash64("digest").alias("hit")
    hits = groups.where("group_size > 1").select("digest", "keeper.located_in", F.xxhash64("keeper.located_in", "keeper.row_no").alias("place"))
    hits = written(hits.select("digest", "located_in", "place"), f"{at}/hits")
    places = written(feed.join(sized(hits.select("digest")), "digest", "left_semi").select(F.col("place").alias("_place"), named), f"{at}/places")
    bodies = rows.join(sized(places), "_place").select("hit", normalised().alias("body"))
    if earlier:  # rows that stayed in earlier calls lie in files of their own; there are no more names than files
        old = hits.join(feed.select("place"), "place", "left_anti").select(named, F.col("place").alias("_place"), "located_in")
        files = [r[0] for r in old.select("located_in").distinct().collect()]
        if files:
            again = located(spark.read.parquet(*files), at).join(sized(written(old, f"{at}/old")), "_place")
            bodies = bodies.unionByName(again.select("hit", normalised().alias("body")))
    bounds = bodies.groupBy("hit").agg(F.min("body").alias("least"), F.max("body").alias("most"))
    differing = written(bounds.where("least <> most").select("hit"), f"{at}/differing")
    return written(hits.select("digest", named).join(sized(differing), "hit", "left_semi").select("digest"), f"{at}/collided")


def _by_bytes(rows: DataFrame, collided: DataFrame, digest: Callable[[Column], Column], earlier: str | None) -> DataFrame:
    """The same columns for the rows whose digest holds different texts: here the text itself is the key."""
    spark = rows.sparkSession

    def texts(of: DataFrame) -> DataFrame:
        found = feed_of(of, digest).join(sized(collided), "digest", "left_semi")
        return found.join(of.select(F.col("_place").alias("place"), normalised().alias("body")), "place")

    own = texts(rows)
    every = own
    if earlier is not None:
        seen = spark.read.parquet(earlier).join(sized(collided), "digest", "left_semi").join(own.select("place"), "place", "left_anti")
        files = [r[0] for r in seen.select("located_in").distinct().collect()]
        if files:
            old = located(spark.read.parquet(*files), work_dir(spark)).join(seen.select(F.col("place").alias("_place")), "_place", "left_semi")
            every = own.unionByName(texts(old))
    groups = every.groupBy("body").agg(F.min(_keeper()).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
    same = (F.col("row_no") == F.col("keeper.row_no")) & (F.col("located_in") == F.col("keeper.located_in"))
    return own.join(groups, "body").select("doc_id", F.col("keeper.doc_id").alias("keep_id"), "group_size", same.alias("kept"), F.col("digest").alias("text_sha256"), "located_in", "row_no", "place")


def deduplicated(docs: DataFrame, state: str | None = None) -> DataFrame:
    """The rows of docs that stay, with the columns of docs; of identical rows, one stays."""
    at = work_dir(docs.sparkSession)
    rows = located(docs, at)
    dropped = written(_dedup(rows, at, state=state).where("not kept").select(F.col("place").alias("_place")), f"{at}/dropped")
    return rows.join(sized(dropped), "_place", "left_anti").select(*docs.columns)
