"""The captured log, in batches and as a stream.

A captured log is a folder of files *.jsonl, in the order of their names, with one raw record (model.RAW_LOG) a
line as JSON; sid as hex digits, ts as ISO text or microseconds. In batches it is read by Spark's JSON reader (load), from any
storage, in splits. The stream is a data source of its own: its offsets are (file, bytes); an end is
always a commit, so that no micro-batch parts a transaction, and at most `maxEvents` records (and the rest of
their transaction) are admitted at a time. Files are read in slices of about SLICE bytes. The driver looks for
ends of transactions only, by their kind, and reads each byte of the log once; executors parse.

Options: path; maxEvents (50000); startFile and startBytes, where a new stream begins; plannedFile and plannedBytes,
up to where an earlier run of a restarted stream had planned its batches. The folder's _server.json, if there is one,
must name binlog_format ROW and binlog_row_image FULL (or nothing), and with the option gtid also gtid_mode ON.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tideline.model import RAW_LOG

DEFAULT_MAX_EVENTS = 50_000
SLICE = 8 << 20

_ENDS = re.compile(rb'"kind"\s*:\s*"(?:xid|rotate|(query))"')


def load(spark: SparkSession, path: str) -> DataFrame:
    """The records of a captured log, as model.RAW_LOG."""
    kinds = ", ".join(f"`{f.name}` {'string' if f.name in ('sid', 'ts') else f.dataType.simpleString()}" for f in RAW_LOG.fields)
    text = spark.read.schema(kinds).option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").option("mode", "FAILFAST").json(path)
    ts = F.coalesce(F.timestamp_micros(F.col("ts").try_cast("bigint")), F.col("ts").cast("timestamp"))
    return text.withColumn("sid", F.unhex(F.replace("sid", F.lit("-"), F.lit("")))).withColumn("ts", ts)


def save(log: DataFrame, path: str) -> None:
    """Writes raw records as files of JSON lines, a file of the log at a time in order of its name, by executors."""
    fields = [F.lower(F.hex("sid")).alias("sid") if f.name == "sid" else F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts") if f.name == "ts" else F.col(f"`{f.name}`") for f in RAW_LOG.fields]
    lines = log.select("file", "log_seq", F.to_json(F.struct(*fields)).alias("value"))
    placed = lines.repartition("file").sortWithinPartitions("file", "log_seq").withColumnRenamed("file", "log_file")
    placed.select("value", "log_file").write.mode("overwrite").partitionBy("log_file").format("text").save(f"{path}/parts")
    _as_jsonl(log.sparkSession, f"{path}/parts")


def _as_jsonl(spark: SparkSession, path: str) -> None:
    """Gives the text files of a written table the name of a captured log's."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files, found = fs.listFiles(p(path), True), []
    while files.hasNext():
        found.append(files.next().getPath())
    for at in found:
        if at.getName().endswith(".txt"):
            fs.rename(at, p(at.getParent(), at.getName().removesuffix(".txt") + ".jsonl"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors see: under spark.checkpoint.dir, or of this machine for a local session without one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(root or 'file://' + tempfile.gettempdir()).rstrip('/')}/captured-{uuid.uuid4().hex}"


def record(line: str) -> tuple:
    """A line as a row of RAW_LOG."""
    r = json.loads(line)
    ts = r.get("ts")
    if isinstance(ts, (int, float)):
        ts = datetime.fromtimestamp(ts / 1e6, timezone.utc)
    elif ts is not None:
        ts = datetime.fromisoformat(ts)
    sid = r.get("sid")
    values = {**r, "ts": ts, "sid": bytes.fromhex(sid.replace("-", "")) if sid else None}
    return tuple(values.get(f.name) for f in RAW_LOG.fields)


def ends_transaction(line: bytes) -> bool:
    """Whether a line is of xid, rotate or a query other than BEGIN; only a line that may be is parsed."""
    if not _ENDS.search(line):
        return False
    r = json.loads(line)
    return r["kind"] in ("xid", "rotate") or r["kind"] == "query" and (r.get("query") or "").strip().upper() != "BEGIN"


def validate(settings: dict, gtid: bool = False) -> None:
    """Refuses a server whose log would silently give wrong rows."""
    if (form := settings.get("binlog_format", "")).upper() != "ROW":
        raise ValueError(f"binlog_format is {form!r}, need ROW")
    if (image := settings.get("binlog_row_image", "")) and image.upper() != "FULL":
        raise ValueError(f"binlog_row_image is {image!r}, need FULL")
    if gtid and (mode := settings.get("gtid_mode", "")).upper() != "ON":
        raise ValueError(f"gtid mode was asked for, but gtid_mode is {mode!r}")


class Slice(InputPartition):
    """The lines of a file that begin from `first` on and before `last`."""

    def __init__(self, path: str, first: int, last: int, whole: bool = True):
        self.path, self.first, self.last, self.whole = path, first, last, whole


def slices(path: str, first: int, last: int) -> list[Slice]:
    """The part of a file between two ends of lines, cut anywhere."""
    cuts = [*range(first, last, SLICE), last]
    return [Slice(path, a, b, a == first) for a, b in zip(cuts, cuts[1:], strict=False)]


def _lines(part: Slice) -> Iterator[tuple]:
    with open(part.path, "rb") as file:
        at = part.first
        if part.whole:
            file.seek(at)
        else:  # the line across the cut is of the slice before
            file.seek(at - 1)
            at += len(file.readline()) - 1
        for line in file:
            if at >= part.last or not line.endswith(b"\n"):
                return
            at += len(line)
            if line.strip():
                yield record(line.decode())


class _Folder:
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("the option path is required")
        self.path = options["path"].removeprefix("file://")
        settings = os.path.join(self.path, "_server.json")
        if os.path.exists(settings):
            with open(settings) as file:
                validate(json.load(file), options.get("gtid", "false").lower() == "true")

    def files(self) -> list[str]:
        return sorted(f for f in os.listdir(self.path) if f.endswith(".jsonl"))

    def at(self, name: str) -> str:
        return os.path.join(self.path, name)


class CapturedLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captured_log"

    def schema(self):
        return RAW_LOG

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = _Folder(options)

    def partitions(self):
        return [s for f in self.folder.files() for s in slices(self.folder.at(f), 0, os.path.getsize(self.folder.at(f)))]

    def read(self, partition):
        return _lines(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.most = _Folder(options), int(options.get("maxevents", options.get("maxEvents", DEFAULT_MAX_EVENTS)))
        if self.most < 1:
            raise ValueError("maxEvents must be positive")
        low = {k.lower(): v for k, v in options.items()}
        self.start = {"file": low.get("startfile", ""), "bytes": int(low.get("startbytes", 0))}
        self.reached = {"file": low["plannedfile"], "bytes": int(low.get("plannedbytes", 0))} if "plannedfile" in low else None

    def initialOffset(self) -> dict:
        return dict(self.start)

    def _after(self, start: dict) -> dict:
        """The last commit at or after `most` records from start, or the last one that is there."""
        end, n = dict(start), 0
        for name in self.folder.files():
            if name < start["file"]:
                continue
            at = start["bytes"] if name == start["file"] else 0
            with open(self.folder.at(name), "rb") as file:
                file.seek(at)
                for line in file:
                    if not line.endswith(b"\n"):
                        return end
                    at += len(line)
                    n += 1
                    if ends_transaction(line):
                        end = {"file": name, "bytes": at}
                        if n >= self.most:
                            return end
        return end

    def latestOffset(self) -> dict:
        self.reached = self._after(self.reached or self.start)
        return dict(self.reached)

    def partitions(self, start: dict, end: dict):
        if self.reached is None or (end["file"], end["bytes"]) > (self.reached["file"], self.reached["bytes"]):
            self.reached = dict(end)  # after a restart the engine tells where it was
        parts = []
        for name in self.folder.files():
            if start["file"] <= name <= end["file"]:
                first = start["bytes"] if name == start["file"] else 0
                last = end["bytes"] if name == end["file"] else os.path.getsize(self.folder.at(name))
                parts += slices(self.folder.at(name), first, last) if last > first else []
        return parts

    def read(self, partition):
        return _lines(partition)

    def commit(self, end: dict) -> None:
        self.reached = dict(end) if self.reached is None else self.reached


def register(spark) -> None:
    spark.dataSource.register(CapturedLog)


def write_captured(log, folder: str) -> None:
    """Writes raw records of a DataFrame as a captured log, for tests and examples: one file a log file, rows streamed one at a time."""
    os.makedirs(folder, exist_ok=True)
    file, name = None, None
    for row in log.orderBy("file", "log_seq").toLocalIterator():
        r = row.asDict(recursive=True)
        r["sid"] = bytes(r["sid"]).hex() if r["sid"] else None
        r["ts"] = r["ts"].isoformat() if r["ts"] else None
        if r["file"] != name:
            if file:
                file.close()
            name = r["file"]
            file = open(os.path.join(folder, f"{name}.jsonl"), "w")  # noqa: SIM115
        file.write(json.dumps({k: v for k, v in r.items() if v is not None}, ensure_ascii=False) + "\n")
    if file:
        file.close()
