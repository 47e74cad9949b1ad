"""Edit sessions over streams that lose the order of events, and entries that grow old."""

import time

import pytest

from contractlens.streaming import edits as E

EVENT = "event_id long, session_id string, turn_id string, tool_use_id string, stage string, path string, content string, status string, continued boolean"
PRE, POST, STOP = "PreToolUse", "PostToolUse", "Stop"


def event(n, stage, tool=None, path=None, content=None, status=None, continued=None, turn="t"):
    return (n, "s", turn, tool, stage, path, content, status, continued)


EVENTS = [
    event(0, PRE, "a", "x", "1"),
    event(1, POST, "a", "x", "2"),  # changed
    event(2, PRE, "b", "y", "1"),
    event(3, POST, "b", "y", "1"),  # the same
    event(4, POST, "c", "z", "1"),  # no Pre
    event(5, STOP, status="failed"),  # blocks and keeps x
    event(6, PRE, "d", "z", None),
    event(7, POST, "d", "z", "1"),
    event(8, STOP, status="failed", continued=True),  # x and z, cleared
    event(9, STOP, status="failed"),  # nothing left
    event(10, PRE, "a", "x", "1"),
    event(11, STOP, status="passed"),  # forgets the open call as well
    event(12, POST, "a", "x", "2"),
    event(13, PRE, "a", "x", "1"),
    event(14, POST, "a", "x", "2"),
    event(15, PRE, "a", "x", "2"),  # forgets what the call changed
    event(16, STOP, status="warning"),
    event(17, PRE, "a", "x", "2"),
    event(18, POST, "a", None, "2"),
    event(19, PRE, None, "x", "2"),
    event(20, POST, None, "x", "3"),
    event(21, STOP),
    event(22, PRE, "e", "w", "1", turn="u"),
    event(23, POST, "e", "w", "2", turn="u"),
    event(24, STOP, turn="u"),
    event(25, STOP, turn=None),
]
DECISIONS = [(5, "x", "block"), (8, "x,z", "message"), (9, "", "silent"), (11, "", "silent"), (16, "", "silent"), (21, "", "silent"), (24, "w", "message")]


@pytest.fixture
def one_partition(spark):
    """Few tasks, and batches without data, in which timers go off."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.streaming.noDataMicroBatches.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    yield spark
    for k, v in was.items():
        spark.conf.set(k, v)


def rows_of(spark, name, order="stop_id"):
    return [tuple(r)[2:] for r in spark.table(name).orderBy(order).collect()]


def started(df, name, tmp_path, once=False):
    w = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{name}"))
    return (w.trigger(availableNow=True) if once else w).start()


def wait_for(spark, name, n, seconds=90):
    end = time.time() + seconds
    while spark.table(name).count() < n and time.time() < end:
        time.sleep(0.5)


def test_turns_of_a_table(spark):
    df = spark.createDataFrame(EVENTS, EVENT)
    got = sorted(tuple(r)[2:] for r in E.follow_turns_batch(df).collect())
    assert got == DECISIONS
    assert sorted(tuple(r)[2:] for r in E.follow_turns_batch(df.repartition(7)).collect()) == DECISIONS
    assert E.follow_turns_batch(df.where("false")).count() == 0
    assert E.follow_turns_batch(df.drop("status", "continued").where("event_id < 6")).collect()[0]["decision"] == "message"


def test_entries_of_a_table_grow_old(spark):
    rows = [(0, "a", PRE, "1", 0), (1, "a", POST, "2", 10), (2, "b", PRE, "1", 20), (3, "c", PRE, "1", 21), (4, "c", POST, "2", 25), (5, "b", POST, "2", 31), (6, None, STOP, None, 31), (7, "d", PRE, "1", 40), (8, "d", POST, "1", 51)]
    df = spark.createDataFrame([(n, "s", "t", tool, stage, tool, content, at) for n, tool, stage, content, at in rows], "event_id long, session_id string, turn_id string, tool_use_id string, stage string, path string, content string, second long")
    df = df.selectExpr("*", "timestamp_seconds(second) AS seen")
    # at 31 the record of a (10) and the open call b (20) are over ten seconds old, c's record (25) is not
    assert [tuple(r)[2:] for r in E.follow_turns_batch(df, "seen", 10_000).collect()] == [(6, "c", "message")]
    assert [tuple(r)[2:] for r in E.follow_turns_batch(df, "seen", 60_000).collect()] == [(6, "a,b,c", "message")]
    assert sorted(r["event_id"] for r in E.track_edits_batch(df, "seen", 10_000).collect()) == [1, 4]
    assert sorted(r["event_id"] for r in E.track_edits_batch(df).collect()) == [1, 4, 5, 8]


def test_late_events_are_taken_in_order(one_partition, tmp_path):
    spark = one_partition
    df = spark.createDataFrame(EVENTS, EVENT)
    for part in (2, 0, 1):  # each micro-batch holds every third event, in no order
        df.where(f"event_id % 3 = {part}").orderBy("content", "event_id").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = started(E.follow_turns(stream, gap_ms=25_000), "late", tmp_path)
    try:
        wait_for(spark, "late", len(DECISIONS))
        batches = {p["batchId"] for p in q.recentProgress if p["numInputRows"]}
    finally:
        q.stop()
    assert len(batches) == 3 and rows_of(spark, "late") == DECISIONS


def test_state_lives_from_batch_to_batch(one_partition, tmp_path):
    """Without a gap, in order, a file at a time and with a restart: open calls, records and blocks are found again."""
    spark = one_partition
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    df = spark.createDataFrame(EVENTS, EVENT)
    for low, high in ((0, 6), (7, 10), (11, 25)):
        df.where(f"event_id between {low} and {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = E.follow_turns(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        try:
            assert q.awaitTermination(90)
        finally:
            q.stop()
    assert [tuple(r)[2:] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("stop_id").collect()] == DECISIONS


@pytest.mark.parametrize("ttl,left", [(4_000, []), (600_000, [(1, True, "x")])])
def test_entries_of_a_stream_grow_old(one_partition, tmp_path, ttl, left):
    spark, name = one_partition, f"ttl{ttl}"
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    df = spark.createDataFrame(EVENTS, EVENT)
    df.where("event_id = 0").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
    q = started(E.track_edits(stream, ttl_ms=ttl), name, tmp_path)
    try:
        q.processAllAvailable()
        time.sleep(6)
        df.where("event_id = 1").write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    finally:
        q.stop()
    assert [tuple(r)[3:] for r in spark.table(name).collect()] == left


def test_gap_fits_the_time_to_live(spark):
    for gap, ttl in ((-1, 10), (10, 10)):
        with pytest.raises(ValueError, match="does not fit"):
            E.Turns(gap, ttl)
