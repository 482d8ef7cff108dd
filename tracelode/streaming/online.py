"""The replay checks on a stream of turns, and windowed counts of its events."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import replay

UPDATES = "key string, " + replay.VERDICT_ROW


def online_verdicts(turns: DataFrame, idle: str = "1 hour") -> DataFrame:
    """Verdict updates of turns(key, pos, + turn columns) as they arrive, in update mode.

    A session's state is the fold's store. Turns of a micro-batch are put in order of pos;
    late stamps are evidence, so no watermark drops rows. A later output may
    change an earlier call's verdict, so a row is an update of (key, call_id). State
    goes when a session has been idle for long enough.
    """
    millis = int(pd.Timedelta(idle).total_seconds() * 1000)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        store, open_calls, started = pickle.loads(state.get[0]) if state.exists else (replay.Store(), {}, False)
        before = {c: (v.verdict, v.reason) for c, v in store.verdicts.items()}
        rows = pd.concat(list(frames)).sort_values("pos")
        rows = rows.astype(object).where(rows.notna(), None)
        for t in rows.to_dict("records"):
            replay.step(store, open_calls, t, started)
            started = started or t.get("role") == "user"
        state.update((pickle.dumps((store, open_calls, started)),))
        state.setTimeoutDuration(millis)
        new = [(key[0], c, v.verdict, v.reason, v.confidence, v.localized, v.partners) for c, v in store.verdicts.items() if before.get(c) != (v.verdict, v.reason)]
        yield pd.DataFrame(new, columns=["key", "call_id", "verdict", "reason", "confidence", "localized", "partners"])

    own = turns.where(F.col("role").isin("user", "tool_use", "tool_result")).select(F.col("key").cast("string").alias("key"), "pos", *replay.NEEDED)
    return own.groupBy("key").applyInPandasWithState(fold, UPDATES, "store binary", "update", "ProcessingTimeTimeout")


def latest(updates: DataFrame, order: str) -> DataFrame:
    """The last update of each call."""
    cols = [c for c in updates.columns if c not in ("key", "call_id", order)]
    return updates.groupBy("key", "call_id").agg(F.max_by(F.struct(*cols), order).alias("v")).select("key", "call_id", "v.*")


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their value sums per tumbling window and kind, late ones within the watermark included."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")
