"""Edit sessions: events of tool calls paired by key, closed by a stop event. Each operator has a batch twin."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contractlens.streaming.state import TTL_MS, Calls, Sessions, Turns, close_fold, follow_step, keyed

KEY = ["session_id", "turn_id", "tool_use_id"]


def route_bad_events(events: DataFrame) -> DataFrame:
    """T4: the status of each event; bad ones never fail a query."""
    status = F.when(F.col("stage").isNull(), "wrong-stage").when(F.col("session_id").isNull() | F.col("turn_id").isNull(), "no-identity").when(F.col("tool_use_id").isNull() & (F.col("stage") != "Stop"), "no-tool").otherwise("ok")
    return events.withColumn("status", status)


def event_log(events: DataFrame, duration: str | None = None) -> DataFrame:
    """T5: one log line of each event, with its duration in ms from the named column if there is one."""
    took = [F.concat(F.col(duration).cast("string"), F.lit("ms"))] if duration else []
    return events.select("event_id", F.concat_ws(" ", F.coalesce("stage", F.lit("-")), F.concat_ws("/", "session_id", "turn_id", F.coalesce(F.col("tool_use_id").cast("string"), F.lit("-"))), *took).alias("line"))


def _micros(at: str | None) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp")) if at else F.lit(0).cast("long")


def track_edits_batch(events: DataFrame, at: str | None = None, ttl_ms: int = TTL_MS) -> DataFrame:
    """T1, batch twin: each Post whose last event of the same call is a Pre, and whether path or content changed. With the
    time of arrival in a column, a Pre that is older than ttl_ms by then is forgotten (T3)."""
    w = Window.partitionBy(*KEY).orderBy("event_id")
    e = events.where("stage in ('PreToolUse', 'PostToolUse')").withColumn("was", F.lag(F.struct("stage", "path", "content", _micros(at).alias("at"))).over(w))
    e = e.where("stage = 'PostToolUse' and was.stage = 'PreToolUse'").where(_micros(at) - F.col("was.at") <= ttl_ms * 1000)
    return e.select(*KEY, "event_id", (~(F.col("path").eqNullSafe(F.col("was.path")) & F.col("content").eqNullSafe(F.col("was.content")))).alias("changed"), "path")


def _texts(*names: str) -> list[Column]:
    return [F.col(n).cast("string").alias(n) for n in names]


def track_edits(events: DataFrame, gap_ms: int = 0, ttl_ms: int = TTL_MS) -> DataFrame:
    """T1 and T3 over a stream: what a Pre saw is kept for its call until the Post, at most for ttl_ms of processing time.
    Events of a call are taken in order of event_id, if those that come late do so within the gap. The state needs the
    RocksDB store (spark.sql.streaming.stateStore.providerClass)."""
    e = events.where("stage in ('PreToolUse', 'PostToolUse') and event_id is not null").select(*_texts(*KEY), "event_id", *_texts("stage", "path", "content"))
    return keyed(e, KEY, Calls(gap_ms, ttl_ms))


def turn_files(edits: DataFrame) -> DataFrame:
    """U4: distinct changed files of each turn, sorted."""
    return edits.where("changed").groupBy("session_id", "turn_id").agg(F.array_join(F.array_sort(F.collect_set("path")), ",").alias("files"))


TURN = ["session_id", "turn_id"]
def turn_events(edits: DataFrame, stops: DataFrame) -> DataFrame:
    """Changed files (session_id, turn_id, event_id, path) and stops (session_id, turn_id, event_id, status of the checks
    or `none` without any, continued) as one table of events."""
    e = edits.where("changed").select(*TURN, "event_id", F.lit(False).alias("stop"), "path", F.lit(None).cast("string").alias("status"), F.lit(False).alias("continued"))
    s = stops.select(*TURN, "event_id", F.lit(True).alias("stop"), F.lit(None).cast("string").alias("path"), "status", F.coalesce("continued", F.lit(False)).alias("continued"))
    return e.unionByName(s)


def close_turns(events: DataFrame) -> DataFrame:
    """T2, batch twin: at each stop of turn_events, the turn's changed files since the last stop that cleared them, and
    the decision: none silent, passed silent, warning or no checks a message; failed a block that keeps the files, and
    a message that clears them if the turn was continued before. Turns are read as sorted rows, of which only the open
    files of one turn are held, so that many small turns cost no more than their rows."""
    names = [c.split()[0] for c in Turns.EVENT.split(", ")]
    schema = pa.schema([("session_id", pa.string()), ("turn_id", pa.string()), ("stop_id", pa.int64()), ("files", pa.int64()), ("decision", pa.string())])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, paths, blocked = None, set(), False
        for batch in batches:
            out = []
            rows = zip(*(batch.column(n).to_pylist() for n in TURN + names), strict=True)
            for key, some in groupby(rows, lambda row: row[:2]):
                if key != turn:
                    turn, paths, blocked = key, set(), False
                told, paths, _, blocked = close_fold((row[2:] for row in some), paths, blocked)
                out += [(*turn, *row) for row in told]
            yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in out], f.type) for i, f in enumerate(schema)], schema=schema)

    e = events.select(*_texts(*TURN), *names).repartition(*TURN).sortWithinPartitions(*TURN, F.asc_nulls_last("event_id"), "stop")
    return e.mapInArrow(close, Turns.OUT)


def close_turns_stream(events: DataFrame, gap_ms: int = 0, ttl_ms: int = TTL_MS) -> DataFrame:
    """T2 over a stream of turn_events: a turn's files wait in its state until a stop clears them, each at most for ttl_ms
    of processing time. Order and state store: as in track_edits."""
    e = events.where("event_id is not null").select(*_texts(*TURN), "event_id", "stop", *_texts("path", "status"), F.coalesce("continued", F.lit(False)).alias("continued"))
    return keyed(e, TURN, Turns(gap_ms, ttl_ms))


def _session_events(events: DataFrame) -> DataFrame:
    """Events with identity and number. Where columns status and continued are lacking, a Stop has no checks."""
    status = F.col("status").cast("string") if "status" in events.columns else F.lit("none")
    continued = F.col("continued") if "continued" in events.columns else F.lit(False)
    e = events.where("session_id is not null and turn_id is not null and event_id is not null and stage in ('PreToolUse', 'PostToolUse', 'Stop')")
    return e.withColumns({"status": F.coalesce(status, F.lit("none")), "continued": F.coalesce(continued, F.lit(False))})


def follow_turns(events: DataFrame, gap_ms: int = 0, ttl_ms: int = TTL_MS) -> DataFrame:
    """T1 to T3 in one state for each turn, over a stream of raw events (stage, session, turn, tool call, path, content; of
    a Stop the status of its checks and whether the turn was continued before).

    A Pre remembers its file and forgets what its call had changed before; a Post with a Pre records the file if it
    changed, and forgets the record if not; one without is left out. A Stop gives the recorded files and its decision
    and, unless it blocks, clears open calls and records. Calls and records go one by one when they are older than ttl_ms.
    Events without identity, number or path, and a Pre without a call, change nothing. Order and state store: as in track_edits."""
    e = _session_events(events).select(*_texts(*TURN), "event_id", *_texts("stage", "tool_use_id", "path", "content", "status"), "continued")
    return keyed(e, TURN, Sessions(gap_ms, ttl_ms))


class _Dated(dict):
    """A dictionary whose entries know when they were set."""

    def __init__(self) -> None:
        super().__init__()
        self.now, self.at = 0, {}

    def __setitem__(self, key, value) -> None:
        super().__setitem__(key, value)
        self.at[key] = self.now

    def move_to(self, now: int, ttl: int) -> None:
        self.now = now
        for key in [k for k in self if self.at[k] < now - ttl]:
            del self[key]


def follow_turns_batch(events: DataFrame, at: str | None = None, ttl_ms: int = TTL_MS) -> DataFrame:
    """follow_turns over a table, with the time of arrival in a column if entries are to expire. Turns are read as sorted
    rows, of which only the open calls and records of one turn are held."""
    e = _session_events(events).select(*_texts(*TURN), "event_id", *_texts("stage", "tool_use_id", "path", "content", "status"), "continued", _micros(at).alias("at"))

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn, pre, changed = None, _Dated(), _Dated()
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                if row[:2] != turn:
                    turn, pre, changed = row[:2], _Dated(), _Dated()
                for state in (pre, changed):
                    state.move_to(row[-1], ttl_ms * 1000)
                stop = follow_step(row[2:-1], pre, changed)
                if stop:
                    out.append((*turn, *stop))
            yield pd.DataFrame(out, columns=[*TURN, "stop_id", "files", "decision"])

    return e.repartition(*TURN).sortWithinPartitions(*TURN, "event_id").mapInPandas(follow, Sessions.OUT)
