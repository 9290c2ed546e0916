"""Tables that change by version, and streams in parts."""

from datetime import datetime

from pyspark.sql import functions as F

from lumenscan.sources import warehouse as W
from lumenscan.streaming import events as E
from lumenscan.streaming import progress as P


def test_warehouse(spark):
    path = W.scratch(spark, "t")
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "c")], "k long, note string")
    W.insert(rows, path)
    first = W.read(spark, path).collect()
    assert len({r.row_id for r in first}) == 4 and all(r.inserted_at for r in first)
    W.update(spark, path, spark.createDataFrame([(1, "new"), (2, None), (7, "none")], "k long, note string"), "k")
    W.insert(rows.limit(0), path)
    now = W.read(spark, path).collect()
    assert sorted((str(r.k), str(r.note)) for r in now) == [("1", "new"), ("1", "new"), ("2", "None"), ("None", "c")]
    assert {r.row_id for r in now} == {r.row_id for r in first}
    W.delete(spark, path, F.col("note") == "new")
    assert sorted(str(r.k) for r in W.read(spark, path).collect()) == ["2", "None"]


def test_stream_goes_on_where_it_stopped(spark):
    path = W.scratch(spark, "s")
    schema = "event_id long, ts timestamp_ntz, event_type string, value double"
    parts = [[(1, datetime(2024, 1, 1, 0, 10), "a", 1.0), (2, datetime(2024, 1, 1, 0, 50), "a", None)], [(3, datetime(2024, 1, 1, 1, 0), "b", 2.0), (4, datetime(2024, 1, 1, 0, 59), "a", 5.0)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = E.read_events(spark, f"{path}/in", spark.createDataFrame([], schema).schema)
        E.keep_up(E.windows(stream), f"{path}/out", f"{path}/state")
    got = {(r.window_start, r.event_type, r.n, r.top) for r in spark.read.parquet(f"{path}/out").collect()}
    assert got == {(datetime(2024, 1, 1, 0), "a", 3, 5.0), (datetime(2024, 1, 1, 1), "b", 1, 2.0)}
    table = E.windows(spark.read.parquet(f"{path}/in")).collect()
    assert {tuple(r) for r in table} == got


def test_progress_over_restarts(spark):
    """Replay, live, pings in silence, and nothing after the end, in three runs from one checkpoint."""
    path, schema = W.scratch(spark, "p"), "job_id long, seq long, kind string"
    parts = [[(1, 2, "view"), (1, 1, "start"), (2, 5, "start"), (3, 1, "complete"), (3, 2, "view"), (None, 1, "x"), (4, None, "x")], [(1, 3, "error"), (1, 4, "view"), (5, 1, "start")], [(1, 6, "view"), (5, 2, "view")]]
    stored = spark.createDataFrame([], schema).schema
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        P.write(P.messages(spark.readStream.schema(stored).parquet(f"{path}/in"), ping_ms=1), f"{path}/out", f"{path}/state")
    rows = spark.read.schema(P.OUT).parquet(f"{path}/out").collect()
    told = sorted((r.job_id, r.seq, r.message) for r in rows if r.seq is not None)
    want = [(1, 1, "start"), (1, 2, "view"), (1, 3, "error"), (2, 5, "start"), (3, 1, "complete"), (5, 1, "start"), (5, 2, "view")]
    assert told == [(j, s, f'data: {{"type": "{k}"}}\n\n') for j, s, k in want]
    pings = [r.job_id for r in rows if r.seq is None]
    assert 2 in pings and not {3, 4} & set(pings) and {r.message for r in rows if r.seq is None} == {'data: {"type": "ping"}\n\n'}
