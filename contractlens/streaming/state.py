"""Keyed state of edit sessions: processors for transformWithStateInPandas, whose state lives in the RocksDB state store.

A processor folds the events of a key in order of `event_id`. With a gap an event first waits that long (processing time),
and what has waited is folded together with all that comes before it, so that events of one key may arrive in any order
within the gap. An event that comes later than that is folded when it arrives. Entries of the state go one by one when
they are older than `ttl_ms` of processing time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

TTL_MS = 24 * 3600 * 1000


class Ordered(StatefulProcessor):
    """Subclasses name the event's columns (`event_id` first, EVENT), the output (OUT) and the fold of ordered events."""

    EVENT = OUT = ""

    def __init__(self, gap_ms: int, ttl_ms: int) -> None:
        if not 0 <= gap_ms < ttl_ms:
            raise ValueError(f"gap of {gap_ms} ms does not fit a time to live of {ttl_ms} ms")
        self.gap, self.ttl = gap_ms, ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"{self.EVENT}, arrived long", self.ttl)
        self.open()

    def open(self) -> None:
        raise NotImplementedError

    def fold(self, key: tuple, events: Iterable[tuple]) -> list[tuple]:
        raise NotImplementedError

    def place(self, event: tuple) -> tuple:
        return (event[0],)

    def _frame(self, key: tuple, events: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *row) for row in self.fold(key, sorted(events, key=self.place))], columns=[c.split()[0] for c in self.OUT.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = [c.split()[0] for c in self.EVENT.split(", ")]
        events = [e for batch in rows for e in batch[names].itertuples(index=False, name=None)]
        if not self.gap:
            yield self._frame(key, events)
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        self.waiting.appendList([(*e, now) for e in events])
        self.handle.registerTimer(now + self.gap)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        since = expiredTimerInfo.getExpiryTimeInMs() - self.gap
        events = list(self.waiting.get())
        due = [self.place(e) for e in events if e[-1] <= since]
        if not due:
            return
        ready, left = [], []
        for e in events:
            (ready if self.place(e) <= max(due) else left).append(e)
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        yield self._frame(key, [e[:-1] for e in ready])

    def close(self) -> None:
        pass


class Calls(Ordered):
    """One call's events: a Pre waits for its Post."""

    EVENT = "event_id long, stage string, path string, content string"
    OUT = "session_id string, turn_id string, tool_use_id string, event_id long, changed boolean, path string"

    def open(self) -> None:
        self.pre = self.handle.getValueState("pre", "path string, content string", self.ttl)

    def fold(self, key, events):
        had = tuple(self.pre.get()) if self.pre.exists() else None
        pre, out = had, []
        for event_id, stage, path, content in events:
            if stage == "PreToolUse":
                pre, had = (path, content), None
            elif pre is not None:
                out.append((event_id, (path, content) != pre, path))
                pre = None
        if pre is None:
            self.pre.clear()
        elif had is None:
            self.pre.update(pre)
        return out


def decide(status: str, repeated: bool) -> str:
    """What a Stop with changed files answers: the status of its checks (`none`: there are none), and whether the turn was
    continued before."""
    if status == "failed":
        return "message" if repeated else "block"
    return "message" if status in ("warning", "none") else "silent"


def close_fold(events: Iterable[tuple], paths: set, blocked: bool) -> tuple[list[tuple], set, set, bool]:
    """Changed files and stops in order: decisions, the files that are left, those of them that came now, and the block."""
    out, new = [], set()
    for event_id, stop, path, status, continued in events:
        if not stop:
            paths.add(path)
            new.add(path)
            continue
        decision = decide(status, blocked or continued) if paths else "silent"
        out.append((event_id, len(paths), decision))
        blocked = decision == "block"
        if not blocked:
            paths, new = set(), set()
    return out, paths, new, blocked


class Turns(Ordered):
    """One turn's changed files and stops: files wait until a stop clears them."""

    EVENT = "event_id long, stop boolean, path string, status string, continued boolean"
    OUT = "session_id string, turn_id string, stop_id long, files long, decision string"

    def open(self) -> None:
        self.paths = self.handle.getMapState("paths", "path string", "known boolean", self.ttl)
        self.blocked = self.handle.getValueState("blocked", "blocked boolean", self.ttl)

    def place(self, event):
        return (event[0], event[1])

    def fold(self, key, events):
        had = {path for (path,) in self.paths.keys()}
        out, left, new, blocked = close_fold(events, set(had), self.blocked.exists())
        for path in had - left:
            self.paths.removeKey((path,))
        for path in new:
            self.paths.updateValue((path,), (True,))
        if not blocked:
            self.blocked.clear()
        elif out:
            self.blocked.update((True,))
        return out


def follow_step(event: tuple, pre: dict, changed: dict) -> tuple | None:
    """One event of a turn against its open calls (call -> path, content) and its records (call -> path), which it changes.
    A Stop gives its number, the changed files in order and the decision."""
    event_id, stage, tool, path, content, status, continued = event
    if stage == "PreToolUse" and tool is not None and path is not None:
        changed.pop(tool, None)
        pre[tool] = (path, content)
    elif stage == "PostToolUse" and tool in pre:
        was = pre.pop(tool)
        changed.pop(tool, None)
        if was != (path, content):
            changed[tool] = (path,)
    elif stage == "Stop":
        files = sorted({p for (p,) in changed.values() if p is not None})
        decision = decide(status, continued) if files else "silent"
        if decision != "block":
            pre.clear()
            changed.clear()
        return event_id, ",".join(files), decision
    return None


class _Touched(dict):
    """A dictionary that knows which of its keys were set anew."""

    def __init__(self, items) -> None:
        super().__init__(items)
        self.had, self.new = set(self), set()

    def __setitem__(self, key, value) -> None:
        super().__setitem__(key, value)
        self.new.add(key)

    def save(self, state) -> None:
        for key in self.had - set(self):
            state.removeKey((key,))
        for key in self.new & set(self):
            state.updateValue((key,), self[key])


class Sessions(Ordered):
    """One turn's raw events: open calls and records of changed files, each with a time to live of its own."""

    EVENT = "event_id long, stage string, tool_use_id string, path string, content string, status string, continued boolean"
    OUT = "session_id string, turn_id string, stop_id long, files string, decision string"

    def open(self) -> None:
        self.pre = self.handle.getMapState("pre", "tool string", "path string, content string", self.ttl)
        self.changed = self.handle.getMapState("changed", "tool string", "path string", self.ttl)

    def fold(self, key, events):
        pre, changed = (_Touched({k[0]: tuple(v) for k, v in state.iterator()}) for state in (self.pre, self.changed))
        out = [row for e in events if (row := follow_step(e, pre, changed))]
        pre.save(self.pre)
        changed.save(self.changed)
        return out


def keyed(events: DataFrame, keys: list[str], processor: Ordered) -> DataFrame:
    return events.groupBy(*keys).transformWithStateInPandas(processor, processor.OUT, "append", "processingTime")
