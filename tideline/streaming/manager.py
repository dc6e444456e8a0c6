"""Many flows on one driver: registration, starts and stops, restarts with backoff, and an HTTP control plane.

    GET /healthz, /readyz, /metrics, /v1/flows, /v1/flows/{id}    POST /v1/flows, /v1/flows/{id}/start, /v1/flows/{id}/stop
"""

from __future__ import annotations

import json
import logging
import threading
import time
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from tideline.streaming.flow import FAILED, Flow
from tideline.streaming.metrics import Metrics

log = logging.getLogger(__name__)


class _Managed:
    def __init__(self, flow: Flow):
        self.flow, self.lock, self.thread, self.stopping = flow, threading.Lock(), None, threading.Event()


class Manager:
    """A flow that fails is started again after a pause that doubles, up to a minute, `max_restarts` times; one that ends or was stopped is not."""

    def __init__(self, max_restarts: int = 5, restart_backoff_s: float = 1.0, most_backoff_s: float = 60.0):
        self.max_restarts, self.restart_backoff_s, self.most_backoff_s = max_restarts, restart_backoff_s, most_backoff_s
        self._lock, self._flows = threading.Lock(), {}

    def register(self, flow: Flow) -> None:
        with self._lock:
            if flow.id in self._flows:
                raise KeyError(f"flow {flow.id!r} already exists")
            self._flows[flow.id] = _Managed(flow)

    def get(self, name: str) -> Flow | None:
        with self._lock:
            found = self._flows.get(name)
        return found.flow if found else None

    def _managed(self, name: str) -> _Managed:
        with self._lock:
            if name not in self._flows:
                raise KeyError(f"flow {name!r} not found")
            return self._flows[name]

    def start(self, name: str) -> None:
        """Starts a flow; does nothing if it runs."""
        m = self._managed(name)
        with m.lock:
            if m.thread and m.thread.is_alive():
                return
            m.stopping = threading.Event()
            m.thread = threading.Thread(target=self._supervise, args=(m, m.stopping), daemon=True, name=f"flow-{name}")
            m.thread.start()

    def _supervise(self, m: _Managed, stopping: threading.Event) -> None:
        pause = self.restart_backoff_s
        for attempt in range(self.max_restarts + 1):
            try:
                m.flow.run()
                return
            except Exception as e:
                if stopping.is_set():
                    return
                if attempt == self.max_restarts:
                    log.error("flow %s failed %d times, and is not started again: %s", m.flow.id, attempt + 1, e)
                    return
                log.warning("flow %s failed, and is started again in %g s: %s", m.flow.id, pause, e)
            if stopping.wait(pause):
                return
            pause = min(self.most_backoff_s, 2 * pause)

    def stop(self, name: str, timeout_s: float = 60.0) -> None:
        m = self._managed(name)
        with m.lock:
            thread, stopping = m.thread, m.stopping
        if thread is None:
            return
        stopping.set()
        until = time.monotonic() + timeout_s
        while thread.is_alive() and time.monotonic() < until:
            m.flow.stop()  # again and again, as a run that is just starting clears the request
            thread.join(0.2)
        if thread.is_alive():
            raise TimeoutError(f"flow {name!r} did not stop in time")

    def stop_all(self, timeout_s: float = 60.0) -> None:
        with self._lock:
            names = list(self._flows)

        def one(name: str) -> None:
            try:
                self.stop(name, timeout_s)
            except Exception as e:
                log.error("stopping flow %s: %s", name, e)

        threads = [threading.Thread(target=one, args=(n,)) for n in names]
        for t in threads:
            t.start()
        for t in threads:
            t.join()

    def statuses(self) -> list[dict]:
        with self._lock:
            flows = [m.flow for m in self._flows.values()]
        return [f.status() for f in flows]

    def poll_metrics(self, metrics: Metrics, interval_s: float = 5.0) -> Callable[[], None]:
        """Observes all flows now and then; returns what ends that."""
        ended = threading.Event()

        def run() -> None:
            while not ended.wait(interval_s if interval_s > 0 else 5.0):
                for s in self.statuses():
                    metrics.observe(s)

        threading.Thread(target=run, daemon=True).start()
        return ended.set

    def server(self, listen: str, build: Callable[[dict], Flow], metrics: Metrics) -> ThreadingHTTPServer:
        """A server for host:port (port 0: any); serve_forever() runs it. build makes a flow of a posted definition."""
        host, _, port = listen.rpartition(":")
        manager = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *args) -> None:
                pass

            def _send(self, code: int, body, kind: str = "application/json") -> None:
                data = body.encode() if isinstance(body, str) else json.dumps(body).encode()
                self.send_response(code)
                self.send_header("Content-Type", kind)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def _error(self, code: int, e: Exception) -> None:
                self._send(code, {"error": str(e.args[0]) if e.args else str(e)})

            def do_GET(self) -> None:
                parts = self.path.split("?")[0].strip("/").split("/")
                if parts == ["healthz"]:
                    self._send(200, "ok", "text/plain")
                elif parts == ["readyz"]:
                    failed = [s["id"] for s in manager.statuses() if s["status"] == FAILED]
                    self._send(503, {"ready": False, "failed_flows": failed}) if failed else self._send(200, "ok", "text/plain")
                elif parts == ["metrics"]:
                    self._send(200, metrics.text(), "text/plain; version=0.0.4")
                elif parts == ["v1", "flows"]:
                    self._send(200, manager.statuses())
                elif parts[:2] == ["v1", "flows"] and len(parts) == 3 and (flow := manager.get(parts[2])):
                    self._send(200, flow.status())
                else:
                    self._send(404, {"error": "not found"})

            def do_POST(self) -> None:
                parts = self.path.split("?")[0].strip("/").split("/")
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                if parts == ["v1", "flows"]:
                    try:
                        flow = build(json.loads(body))
                    except Exception as e:
                        return self._error(400, e)
                    try:
                        manager.register(flow)
                    except KeyError as e:
                        return self._error(409, e)
                    return self._send(201, flow.status())
                if parts[:2] == ["v1", "flows"] and len(parts) == 4 and parts[3] in ("start", "stop"):
                    try:
                        manager.start(parts[2]) if parts[3] == "start" else manager.stop(parts[2])
                    except Exception as e:
                        return self._error(404 if parts[3] == "start" else 500, e)
                    return self._send(200, manager.get(parts[2]).status())
                return self._send(404, {"error": "not found"})

        return ThreadingHTTPServer((host or "0.0.0.0", int(port)), Handler)
