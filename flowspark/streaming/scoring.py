"""Streams of turns: incremental flow distances and windowed activity. An extension: the batch operators give the reference results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowspark.operators.kernel import DELETION, IMPOSSIBLE, INSERTION, Flow


def activity(events: DataFrame, key: str, at: str, late: str = "1 hour", window: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events per key and (sliding) window; rows later than the watermark are dropped by a stream and counted by a batch."""
    w = F.window(at, window, slide) if slide else F.window(at, window)
    g = events.withWatermark(at, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Stretches of a key's events without a pause of `gap`."""
    g = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def next_column(flow: Flow, column: np.ndarray | None, sub: np.ndarray | None) -> np.ndarray:
    """The dynamic programme's column after one more turn: one number per node, and the root's last.

    column None starts an empty conversation; sub has the turn's substitution cost by bucket. A column depends only on the one
    before, so the state of a conversation is as large as the flow, however long the conversation.
    """
    n = len(flow.level)
    new = np.full(n + 1, np.inf)
    new[n] = 0.0 if column is None else column[n] + INSERTION
    for edges in flow.rows[1:]:
        for p, v in edges:  # parents come before their children
            up = n if p < 0 else p
            best = new[up] + DELETION
            if column is not None:
                cost = sub[flow.bucket[v]] if flow.bucket[v] >= 0 else IMPOSSIBLE
                best = min(best, column[up] + cost)
            new[v] = min(new[v], best)
        if column is not None:
            for v in {v for _, v in edges}:
                new[v] = min(new[v], column[v] + INSERTION)
    return new


def incremental_scores(turns: DataFrame, flow: Flow, timeout: str = "1 hour") -> DataFrame:
    """A stream of (dialogue_id, turn, actor, vector, spoken_at) to (dialogue_id, n_turns, distance) after every batch.

    Turns must arrive in order within a conversation; the state is dropped when it has been idle for `timeout`.
    """
    dim = flow.c.shape[1]

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, column = state.get if state.exists else (0, next_column(flow, None, None).tolist())
        column = np.array(column)
        for b in batches:
            for _, t in b.sort_values("turn").iterrows():
                x = np.array([t["vector"] if t["vector"] is not None else np.zeros(dim)], np.float64)
                column = next_column(flow, column, flow.substitution(np.array([t["actor"]], dtype=object), x)[:, 0])
                n += 1
        state.update((n, column.tolist()))
        state.setTimeoutDuration(_millis(timeout))
        yield pd.DataFrame({"dialogue_id": [key[0]], "n_turns": [n], "distance": [float(column[flow.leaves].min()) if len(flow.leaves) else float(n)]})

    return turns.groupBy("dialogue_id").applyInPandasWithState(run, "dialogue_id long, n_turns long, distance double", "n long, c array<double>", "update", GroupStateTimeout.ProcessingTimeTimeout)


def _millis(text: str) -> int:
    k, unit = text.split()
    return int(float(k) * {"second": 1e3, "minute": 6e4, "hour": 3.6e6, "day": 8.64e7}[unit.rstrip("s")])
