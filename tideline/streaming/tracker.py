"""The checkpoint tracker: which of 1..N are acknowledged, without gaps. On the driver, and as a stateful stream operator."""

from __future__ import annotations

import threading
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tideline.streaming.stores import Position


class Tracker:
    """Acknowledgements come in any order; the checkpoint is the position of the highest N with 1..N acknowledged."""

    def __init__(self):
        self._lock, self._pending, self._next = threading.Lock(), {}, 1
        self._position, self._dirty = None, False

    def done(self, *positions: Position) -> None:
        with self._lock:
            for p in positions:
                if p.seq_no >= self._next:  # an acknowledgement that comes again is dropped
                    self._pending[p.seq_no] = p
            while (p := self._pending.pop(self._next, None)) is not None:
                self._position, self._dirty, self._next = p, True, self._next + 1

    def done_through(self, position: Position) -> None:
        """All up to a number at once, as a micro-batch that is committed as a whole gives."""
        with self._lock:
            if position.seq_no >= self._next:
                self._position, self._dirty, self._next = position, True, position.seq_no + 1
                self._pending = {s: p for s, p in self._pending.items() if s >= self._next}

    def checkpoint(self) -> Position | None:
        with self._lock:
            return self._position

    def take_dirty(self) -> Position | None:
        """The checkpoint if it has moved since it was last taken."""
        with self._lock:
            moved, self._dirty = self._dirty, False
            return self._position if moved else None

    def redirty(self) -> None:
        """The save of what was taken failed."""
        with self._lock:
            self._dirty = self._position is not None

    def outstanding(self) -> int:
        with self._lock:
            return len(self._pending)


class PrefixProcessor(StatefulProcessor):
    """State of a flow: the prefix, and the acknowledged numbers beyond it as runs (first: last), which stay few."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.prefix = handle.getValueState("prefix", "n bigint")
        self.runs = handle.getMapState("runs", "first bigint", "last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        prefix = self.prefix.get()[0] if self.prefix.exists() else 0
        runs = {k[0]: v[0] for k, v in self.runs.iterator()}
        numbers: set[int] = set()
        for part in rows:
            numbers.update(int(s) for s in part["seq_no"] if s > prefix)
        merged = merge(runs.items(), numbers)
        before = prefix
        if merged and merged[0][0] <= prefix + 1:
            prefix = max(prefix, merged.pop(0)[1])
        kept = dict(merged)
        for first in runs.keys() - kept.keys():
            self.runs.removeKey((first,))
        for first, last in kept.items():
            if runs.get(first) != last:
                self.runs.updateValue((first,), (last,))
        self.prefix.update((prefix,))
        if prefix != before:
            yield pd.DataFrame({"flow_id": [key[0]], "checkpoint": [prefix], "outstanding": [sum(b - a + 1 for a, b in merged)]})

    def close(self) -> None:
        pass


def merge(runs: Iterable[tuple[int, int]], numbers: Iterable[int]) -> list[tuple[int, int]]:
    """Runs and single numbers as ascending runs, none touching another."""
    out: list[tuple[int, int]] = []
    for a, b in sorted([*runs, *((n, n) for n in numbers)]):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def prefixes(acks: DataFrame) -> DataFrame:
    """A stream of (flow_id, seq_no) as a stream of (flow_id, checkpoint, outstanding), a row whenever a prefix moves."""
    return acks.groupBy("flow_id").transformWithStateInPandas(PrefixProcessor(), "flow_id string, checkpoint bigint, outstanding bigint", "Update", "None")
