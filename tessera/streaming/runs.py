"""A node state machine over a stream of reports: retry ceiling and the last five verdicts are state.

Reports of one micro-batch are taken in order of their times; a report that comes in a later batch than younger ones counts when it comes.
A node's state is as small as its last five verdicts and stays while its plan lives: nodes are as many as the plan has, whatever the number of reports.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CEILING, KEPT = 3, 5
_STATE = "attempts long, series string, status string"
_OUT = "node string, status string, attempts long, series string"


def step(attempts: int, series: str, status: str, passed: bool) -> tuple[int, str, str]:
    """One report: a pass completes, the third failure parks; the series keeps the last five verdicts."""
    series = (series + ("P" if passed else "F"))[-KEPT:]
    if status in ("COMPLETE", "PARKED"):
        return attempts, series, status
    attempts += not passed
    return attempts, series, "COMPLETE" if passed else "PARKED" if attempts >= CEILING else "PENDING"


def node_states(reports: DataFrame) -> DataFrame:
    """node, status, attempts, series after each batch of reports (node, at, passed)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (0, "", "PENDING")
        for row in pd.concat(list(batches)).sort_values("at").itertuples():
            now = step(*now, bool(row.passed))
        state.update(now)
        yield pd.DataFrame({"node": [key[0]], "status": [now[2]], "attempts": [now[0]], "series": [now[1]]})

    return reports.groupBy("node").applyInPandasWithState(run, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)
