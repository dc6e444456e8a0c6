"""Metrics of flows, in the text format of Prometheus."""

from __future__ import annotations

import threading
import time

from tideline.operators.counters import STATES

#: name, type, help
COLLECTORS = (
    ("cdc_publish_events_total", "counter", "Events that the sink has acknowledged."),
    ("cdc_checkpoint_seq", "gauge", "Sequence number up to which all events are acknowledged."),
    ("cdc_persisted_checkpoint_seq", "gauge", "Sequence number that the state store holds."),
    ("cdc_flow_state", "gauge", "0 created, 1 starting, 2 running, 3 stopping, 4 stopped, 5 failed."),
    ("cdc_queue_depth", "gauge", "Events waiting in a queue, about."),
    ("cdc_source_lag_seconds", "gauge", "Age of the newest acknowledged event; grows while the source is idle."),
    ("cdc_last_published_event_timestamp_seconds", "gauge", "Time of the newest acknowledged event."),
    ("cdc_state_save_failures_total", "counter", "Saves of a position that failed."),
)


class Metrics:
    def __init__(self, clock=time.time):
        self._lock, self._clock, self._last, self._values = threading.Lock(), clock, {}, {}

    def _delta(self, name: str, flow: str, now: int) -> int:
        before = self._last.get((name, flow), 0)
        self._last[name, flow] = now
        return now if now < before else now - before

    def observe(self, status: dict) -> None:
        flow = status["id"]
        with self._lock:
            put = lambda name, value, **labels: self._values.__setitem__((name, (("flow", flow), *labels.items())), float(value))
            put("cdc_checkpoint_seq", status["checkpoint"]["seq_no"])
            put("cdc_persisted_checkpoint_seq", status["persisted_checkpoint"]["seq_no"])
            put("cdc_flow_state", STATES[status["status"]])
            for k, depth in enumerate(status.get("queue_depths", [])):
                put("cdc_queue_depth", depth, queue=str(k))
            if (ms := status.get("last_event_unix_ms", 0)) > 0:
                put("cdc_source_lag_seconds", max(0.0, self._clock() - ms / 1000))
                put("cdc_last_published_event_timestamp_seconds", ms / 1000)
            for name, now in (("cdc_publish_events_total", status["published_events"]), ("cdc_state_save_failures_total", status.get("state_save_failures", 0))):
                key = (name, (("flow", flow),))
                self._values[key] = self._values.get(key, 0.0) + self._delta(name, flow, now)

    def text(self) -> str:
        out = []
        with self._lock:
            for name, kind, said in COLLECTORS:
                rows = sorted((labels, v) for (n, labels), v in self._values.items() if n == name)
                if rows:
                    out += [f"# HELP {name} {said}", f"# TYPE {name} {kind}"]
                    out += [f"{name}{{{','.join(f'{k}={_quoted(x)}' for k, x in labels)}}} {v:g}" for labels, v in rows]
        return "\n".join(out) + "\n"


def _quoted(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    return f'"{escaped}"'
