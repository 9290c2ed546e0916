"""Progress of jobs as server-sent messages: what has come is replayed, what comes is passed on, silence is filled with pings, and
a job that is complete or failed says nothing more.

Per job the state is one flag. Events of a job are told in the order of their number within what one batch brings."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "job_id long, seq long, message string"
ENDING = ("complete", "error")
PING_MS = 30_000


def message(event: dict[str, Any]) -> str:
    return f"data: {json.dumps(event)}\n\n"


def tell(key: tuple[Any], frames: Iterator[pd.DataFrame], state: GroupState, ping_ms: int = PING_MS) -> Iterator[pd.DataFrame]:
    """Messages of one job for what has come; a ping where nothing has come for `ping_ms`. State: whether the job has ended."""
    over = state.exists and state.get[0]
    rows: list[tuple[Any, int | None, str]] = []
    if state.hasTimedOut:
        if not over:
            rows.append((key[0], None, message({"type": "ping"})))
    else:
        for seq, kind in sorted((int(s), k) for f in frames for s, k in zip(f["seq"], f["kind"])):
            if over:
                break
            rows.append((key[0], seq, message({"type": kind})))
            over = kind in ENDING
    state.update((bool(over),))
    if not over:
        state.setTimeoutDuration(ping_ms)
    out = pd.DataFrame(rows, columns=["job_id", "seq", "message"])
    yield out.astype({"job_id": "Int64", "seq": "Int64"})


def messages(events: DataFrame, ping_ms: int = PING_MS) -> DataFrame:
    """A stream of (job_id, seq, message) from a stream of events with job_id, seq and kind. seq is null for pings; events without a
    job, a number or a kind are dropped."""
    known = events.select("job_id", "seq", "kind").dropna()

    def run(key, frames, state):
        yield from tell(key, frames, state, ping_ms)

    return known.groupBy("job_id").applyInPandasWithState(run, OUT, "over boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def write(told: DataFrame, path: str, checkpoint: str) -> None:
    """Takes in all that has come as one batch and appends the messages at `path`, each once; a later call goes on from the
    checkpoint. (`availableNow` would not end: where timers run on the clock, Spark always asks for one more batch.)"""
    told.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(once=True).start().awaitTermination()
