"""Streams of events: duplicates, windowed counts, rate limits and the life of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.workflow import TRANSITIONS


def unique_uploads(uploads: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first upload of each (case_id, sha256) within the watermark."""
    return uploads.withWatermark("ts", late).dropDuplicatesWithinWatermark(["case_id", "sha256"])


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and window; a window is given out once the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def admitted(events: DataFrame, most: int, seconds: int, late: str = "1 day") -> DataFrame:
    """event_id, user_id, allowed: at most so many admitted events of a user in a sliding window; refused ones don't count.

    The times that a user's state holds are those of one window, most at the most; once the watermark has passed it, the
    state is dropped, so idle users cost nothing. Within a batch, events are taken in order of time.
    """

    def limit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        allowed = []
        for at in rows["ts"].map(lambda t: int(t.timestamp())):
            held = [t for t in held if t > at - seconds]
            allowed.append(len(held) < most)
            if allowed[-1]:
                held.append(at)
        ends = (held[-1] + seconds) * 1000 if held else 0
        if ends > state.getCurrentWatermarkMs():
            state.update((held,))
            state.setTimeoutTimestamp(ends)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "allowed": allowed})

    timed = events.withWatermark("ts", late)
    return timed.groupBy("user_id").applyInPandasWithState(limit, "event_id long, user_id long, allowed boolean", "held array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def document_states(changes: DataFrame) -> DataFrame:
    """doc_id, seq, state, accepted: each change asked for, and whether the state of the document allowed it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else "uploaded"
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, wanted in zip(rows["seq"], rows["wanted"]):
            ok = wanted in TRANSITIONS.get(now, [])
            now = wanted if ok else now
            out.append((key[0], int(seq), now, ok))
        state.update((now,))
        yield pd.DataFrame(out, columns=["doc_id", "seq", "state", "accepted"])

    return changes.groupBy("doc_id").applyInPandasWithState(step, "doc_id long, seq long, state string, accepted boolean", "state string", "append", GroupStateTimeout.NoTimeout)
