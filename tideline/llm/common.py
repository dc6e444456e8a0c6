"""What the operators of this package share: the shared work folder, written tables, sized joins."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The word of every size and shingle: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The characters that exact comparison deletes.
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of values, with ROW_BYTES for each row, up to which a side may be broadcast; larger sides are shuffled.
BROADCAST_BYTES, ROW_BYTES = 48 << 20, 24

_fallback: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    A local session may do without that setting and gets a temporary folder of its machine; on a cluster its lack is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _fallback:
            _fallback.append(tempfile.mkdtemp(prefix="tideline-"))
        root = f"file://{_fallback[0]}"
    return f"{root.rstrip('/')}/tideline-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, **options) -> DataFrame:
    """The rows of df, written as Parquet and read again: lineage ends here, lost executors cost nothing before it."""
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a written table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def released(spark: SparkSession) -> None:
    """Frees the shuffle files of stages whose results are written: Spark deletes them once the driver has dropped its last reference.

    What Python lets go of reaches the JVM with a later call, and Spark's cleaner works beside, so that one call could come too early.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def _bytes_of(column: Column, kind: T.DataType) -> Column:
    """Size of a column's value: 8 bytes a number, strings and binaries by length, arrays and structures by their parts."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(column).cast("long")
    elif isinstance(kind, T.ArrayType):
        size = F.aggregate(column, F.lit(0).cast("long"), lambda n, x: n + _bytes_of(x, kind.elementType))
    elif isinstance(kind, T.StructType):
        size = sum((_bytes_of(column.getField(f.name), f.dataType) for f in kind.fields), F.lit(0).cast("long"))
    else:
        return F.lit(8).cast("long")
    return F.coalesce(size, F.lit(0).cast("long"))


def sized(small: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """small with a broadcast hint if a sum over it shows that its values take at most `limit` bytes, else as it is.

    `small` should be a written table, so that measuring it is cheap and its exchange can be split where keys are skewed.
    """
    each = sum((_bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in small.schema.fields), F.lit(ROW_BYTES).cast("long"))
    return F.broadcast(small) if (small.agg(F.sum(each)).first()[0] or 0) <= limit else small


def least(keys: DataFrame, key: str, most: int) -> DataFrame:
    """The `most` least distinct values of a column of 64-bit hashes.

    Only hashes below a bound that leaves some times `most` rows are sorted; where repeated ones leave too few, all are.
    """
    rows, width = keys.count(), 2**63
    below = -width + 2 * width * min(1.0, 8 * most / max(rows, 1))
    if below < width * 0.99:
        found = keys.where(F.col(key) < int(below)).select(key).distinct()
        if found.limit(most).count() == most:
            return found.orderBy(key).limit(most)
    return keys.select(key).distinct().orderBy(key).limit(most)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays, compressed by planes of bytes: the upper bytes of most numbers here are 0."""
    flat = b"".join(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays)
    return np.array([len(flat), *(a.nbytes for a in arrays)], np.int64).tobytes() + pa.compress(flat, "zstd", asbytes=True)


def unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    head = 8 * (len(kinds) + 1)
    size, *lengths = np.frombuffer(data, np.int64, len(kinds) + 1).tolist()
    flat = np.frombuffer(pa.decompress(data[head:], size, "zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for n, kind in zip(lengths, map(np.dtype, kinds), strict=True):
        out.append(np.ascontiguousarray(flat[at : at + n].reshape(kind.itemsize, -1).T).view(kind).ravel())
        at += n
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def n_words(column: str = "text") -> Column:
    """Number of words of a text; null counts as empty."""
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def body(column: str = "text") -> Column:
    """48 bits of a text's MD5 as 12 hex digits: with the id, what tells rows apart."""
    return F.substring(F.md5(F.encode(text_of(column), "UTF-8")), 1, 12)


def each_row(rows: DataFrame) -> DataFrame:
    """rows with `copy`: 0, 1, .. among equal ones. Equal rows are counted before they meet, so that no task holds many."""
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_times"))
    return counted.select(*rows.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1)).alias("copy"))


def uniform(doc_id: Column, body: Column, copy: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the row (see body, each_row) and the seed alone."""
    named = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), body, copy.cast("string"), F.lit(seed))
    return (F.conv(F.substring(F.md5(named), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def normalised(column: str = "text") -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(text_of(column), SPACES, "")
