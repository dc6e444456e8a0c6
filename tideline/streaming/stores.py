"""Where flows keep their positions."""

from __future__ import annotations

import json
import os
import re
import threading
from dataclasses import asdict, dataclass
from typing import Protocol

from pyspark.sql import SparkSession

from tideline.model import FLOW_STATE


@dataclass(frozen=True)
class Position:
    """A resume coordinate; seq_no orders acknowledgements within a run and says nothing across runs."""

    gtid_set: str = ""
    file: str = ""
    offset: int = 0
    seq_no: int = 0

    @property
    def is_zero(self) -> bool:
        return not self.gtid_set and not self.file and not self.offset


class Store(Protocol):
    def load(self, flow_id: str) -> Position: ...

    def save(self, flow_id: str, position: Position) -> None: ...


def _safe(flow_id: str) -> str:
    if not re.fullmatch(r"[\w.-]+", flow_id) or flow_id.startswith("."):
        raise ValueError(f"not a flow id: {flow_id!r}")
    return flow_id


class FileStore:
    """A JSON file a flow, replaced in one step."""

    def __init__(self, folder: str):
        if not folder:
            raise ValueError("the file store needs a folder")
        os.makedirs(folder, exist_ok=True)
        self.folder, self.lock = folder, threading.Lock()

    def _path(self, flow_id: str) -> str:
        return os.path.join(self.folder, f"{_safe(flow_id)}.json")

    def load(self, flow_id: str) -> Position:
        with self.lock:
            try:
                with open(self._path(flow_id)) as file:
                    return Position(**json.load(file))
            except FileNotFoundError:
                return Position()

    def save(self, flow_id: str, position: Position) -> None:
        with self.lock:
            path = self._path(flow_id)
            with open(f"{path}.tmp", "w") as file:
                json.dump(asdict(position), file)
                file.flush()
                os.fsync(file.fileno())
            os.replace(f"{path}.tmp", path)


class TableStore:
    """The flow_state table on any storage that Spark writes, a partition a flow: a save puts the next version there and then removes older ones."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.lock = spark, path.rstrip("/"), threading.Lock()
        self.next: dict[str, int] = {}

    def _at(self, flow_id: str) -> str:
        return f"{self.path}/flow_id={_safe(flow_id)}"

    def _versions(self, flow_id: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self._at(flow_id))
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        done = [f.getPath() for f in fs.listStatus(at) if fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done)

    def load(self, flow_id: str) -> Position:
        with self.lock:
            versions = self._versions(flow_id)
            if not versions:
                return Position()
            row = self.spark.read.schema(FLOW_STATE).parquet(f"{self._at(flow_id)}/version={versions[-1]}").first()
            return Position(row.gtid_set or "", row.binlog_file or "", row.binlog_pos or 0, row.seq_no or 0)

    def save(self, flow_id: str, position: Position) -> None:
        from datetime import datetime, timezone

        with self.lock:
            if flow_id not in self.next:
                self.next[flow_id] = (self._versions(flow_id) or [0])[-1] + 1
            version = self.next[flow_id]
            row = (flow_id, position.gtid_set, position.file, position.offset, position.seq_no, datetime.now(timezone.utc))
            self.spark.createDataFrame([row], FLOW_STATE).coalesce(1).write.mode("overwrite").parquet(f"{self._at(flow_id)}/version={version}")
            self.next[flow_id] = version + 1
            jvm = self.spark.sparkContext._jvm
            for old in self._versions(flow_id)[:-1]:
                at = jvm.org.apache.hadoop.fs.Path(f"{self._at(flow_id)}/version={old}")
                at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
