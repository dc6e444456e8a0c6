"""Flows from configuration: YAML (or JSON) files with ${VARIABLE} in them.

    listen: ":8080"
    flows:
      - id: shop
        source: {log: {path: /data/log, gtid: true, include: ["shop.*"], exclude: ["shop.tmp_*"], schemas: /data/schemas.json}}
        pipeline: {queues: 8, queueCapacity: 4096, batch: {maxSize: 500, maxWaitMs: 20}, keyOverrides: {shop.orders: [cust, id]}}
        sink: {kafka: {brokers: ["k:9092"], topicTemplate: "cdc.{database}.{table}", compression: lz4}}   # or file: {path: ..}
        state: {store: file, dir: /data/state, commitIntervalMs: 1000}                                    # or store: table, path: ..
        shutdownTimeoutSec: 30
"""

from __future__ import annotations

import json
import os
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tideline.model import SCHEMA_VERSION
from tideline.streaming.flow import Flow, FlowSpec
from tideline.streaming.sinks import FileSink, KafkaSink
from tideline.streaming.stores import FileStore, TableStore

DEFAULT_LISTEN = ":8080"
_VARIABLE = re.compile(r"\$(?:\{(\w+)\}|(\w+))")


class ConfigError(ValueError):
    pass


def expanded(text: str, variables: dict[str, str] | None = None) -> str:
    """The text with its variables in place; all that are undefined are named in one error."""
    known = os.environ if variables is None else variables
    missing = [n for m in _VARIABLE.finditer(text) if (n := m[1] or m[2]) not in known]
    if missing:
        raise ConfigError(f"undefined environment variable(s): {', '.join(missing)}")
    return _VARIABLE.sub(lambda m: known[m[1] or m[2]], text)


def load(path: str) -> dict[str, Any]:
    with open(path) as file:
        text = expanded(file.read())
    try:
        import yaml
    except ImportError:
        found = json.loads(text)
    else:
        found = yaml.safe_load(text)
    found = found or {}
    if not isinstance(found, dict):
        raise ConfigError("the configuration is no mapping")
    return {"listen": found.get("listen") or DEFAULT_LISTEN, "flows": found.get("flows") or []}


def auto_start(definition: dict[str, Any]) -> bool:
    return _get(definition, "autoStart") is not False


def _get(d: Any, name: str, default: Any = None) -> Any:
    """A member by name, in any case."""
    if not isinstance(d, dict):
        return default
    found = next((v for k, v in d.items() if k.lower() == name.lower()), None)
    return default if found is None else found


def _versions(path: str):
    def read(spark: SparkSession) -> DataFrame:
        return spark.read.schema(SCHEMA_VERSION).json(path)

    return read


def build(spark: SparkSession, definition: dict[str, Any], checkpoint_dir: str) -> Flow:
    """A flow from its definition; errors say what is missing."""
    name = _get(definition, "id")
    if not name:
        raise ConfigError("a flow id is required")
    source = _get(_get(definition, "source"), "log")
    if not source:
        raise ConfigError(f"flow {name}: source.log is required")
    sink_of = _get(definition, "sink", {})
    kafka, files = _get(sink_of, "kafka"), _get(sink_of, "file")
    if not kafka and not files:
        raise ConfigError(f"flow {name}: sink.kafka or sink.file is required")
    pipeline, state = _get(definition, "pipeline", {}), _get(definition, "state", {})
    batch, target = _get(pipeline, "batch", {}), kafka or files
    try:
        codec = _get(target, "compression", "")
        sink = KafkaSink(_get(target, "brokers", []), codec, max_inflight=_get(target, "maxInflightBatches", 0)) if kafka else FileSink(_get(target, "path", ""), codec)
        kind = _get(state, "store", "table")
        if kind == "file":
            store = FileStore(_get(state, "dir", ""))
        elif kind == "table":
            if not _get(state, "path"):
                raise ConfigError(f"flow {name}: state.path is required for the table store")
            store = TableStore(spark, _get(state, "path"))
        else:
            raise ConfigError(f"flow {name}: unknown state store {kind!r}")
        spec = FlowSpec(
            id=name, path=_get(source, "path", ""), versions=_versions(_get(source, "schemas", "")), checkpoint_dir=checkpoint_dir,
            include=_get(source, "include", ()), exclude=_get(source, "exclude", ()), gtid=bool(_get(source, "gtid", True)),
            key_overrides=_get(pipeline, "keyOverrides", {}), topic_template=_get(target, "topicTemplate", "cdc.{database}.{table}"),
            topic_overrides=_get(target, "topicOverrides", {}), queues=_get(pipeline, "queues", 0), queue_capacity=_get(pipeline, "queueCapacity", 0),
            batch_max_size=_get(batch, "maxSize", 0), batch_max_wait_ms=_get(batch, "maxWaitMs", 0),
            commit_interval_ms=_get(state, "commitIntervalMs", 0), shutdown_timeout_s=_get(definition, "shutdownTimeoutSec", 0),
        )
    except ConfigError:
        raise
    except ValueError as e:
        raise ConfigError(f"flow {name}: {e}") from e
    from tideline.functions.tables import glob_regex

    for pattern in (*spec.include, *spec.exclude):
        try:
            re.compile(glob_regex(pattern))
        except (ValueError, re.error) as e:
            raise ConfigError(f"flow {name}: {e}") from e
    return Flow(spark, spec, sink, store)
