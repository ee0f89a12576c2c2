"""Escalations on a stream: an id is raised once while it is open; one that was closed may be opened again.

Reports of one micro-batch are taken in order of their numbers; a report that comes in a later batch than those after it changes
the state as it is then.  State of closed ids ends after `ttl` without reports, so it does not grow with all ids there ever were.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Milliseconds without reports after which a closed id is forgotten.
TTL = 7 * 24 * 3600 * 1000


def step(status: str, action: str) -> tuple[str, bool]:
    """The status after an action (raise, resolve), and whether the action counts: raising what is open and resolving what isn't do not."""
    if action == "raise" and status != "OPEN":
        return "OPEN", True
    if action == "resolve" and status == "OPEN":
        return "RESOLVED", True
    return status, False


def escalations(events: DataFrame, ttl: int | None = TTL) -> DataFrame:
    """id, at, status of the events(id, at, action) that count.

    ttl: milliseconds; None keeps all state, which a run over what is there (trigger availableNow) needs to come to an end.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            if state.exists and state.get[0] == "OPEN":
                state.setTimeoutDuration(ttl)
            else:
                state.remove()
            return
        status = state.get[0] if state.exists else ""
        rows = []
        for frame in frames:
            for at, action in sorted(zip(frame["at"].tolist(), frame["action"].tolist(), strict=True)):
                status, counts = step(status, action)
                if counts:
                    rows.append((key[0], at, status))
        state.update((status,))
        if ttl is not None:
            state.setTimeoutDuration(ttl)
        if rows:
            yield pd.DataFrame(rows, columns=["id", "at", "status"])

    return events.groupBy("id").applyInPandasWithState(run, "id string, at long, status string", "status string", "append", GroupStateTimeout.NoTimeout if ttl is None else GroupStateTimeout.ProcessingTimeTimeout)
