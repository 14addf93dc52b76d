"""Streams: the folded state of sessions, idempotent appends, and the repair of mentions whose entity comes late."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.graph import repaired
from millrace.sources.tables import append_new

STATE = "last_value double, any_flag boolean, n long"


def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What is known of a session: the last value that isn't null (by place), whether any flag was set, and the events.
    A session that hears nothing for the timeout is forgotten."""
    if state.hasTimedOut:
        state.remove()
        return
    value, flag, n = state.get if state.exists else (None, False, 0)
    for pdf in batches:
        pdf = pdf.sort_values("place")
        known = pdf["value"].dropna()
        value = float(known.iloc[-1]) if len(known) else value
        flag, n = bool(flag or pdf["flag"].fillna(False).any()), n + len(pdf)
    state.update((value, flag, n))
    state.setTimeoutDuration(SESSION_MS)
    yield pd.DataFrame({"session": [key[0]], "last_value": [value], "any_flag": [flag], "n": [n]})


SESSION_MS = 300_000


def session_states(events: DataFrame) -> DataFrame:
    """session, last_value, any_flag, n after every batch of events (session, place, value, flag)."""
    kind = events.schema["session"].dataType.simpleString()
    return events.groupBy("session").applyInPandasWithState(fold, f"session {kind}, {STATE}", STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """window, event_type, n: counts by event time; events later than the watermark are dropped by Spark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def ingest(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows whose key isn't in the table at path yet are appended; a batch that runs again adds none."""
    return lambda batch, _: append_new(batch, path, key) and None


def repair(read: Callable[[], tuple[DataFrame, DataFrame]], write: Callable[[DataFrame, DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over new entities (name, entity): read gives mentions and edges, write takes them as they are to be
    afterwards."""

    def run(batch: DataFrame, _: int) -> None:
        mentions, edges = read()
        write(*repaired(mentions, edges, batch))

    return run
