"""The run reducer: every event of a run is answered from the run's state, on a stream with `transformWithState` or over finite events.

A run has nodes with a status each, locks that nodes share, and a register of signed decisions.  An event is a verb on a node:

* `plan` (indegree, frees, lock, disposition, plan_hash): adds a node with the number of nodes it waits for and those that wait for it;
* `dispatch`: PENDING to GROUNDED, once nothing is waited for; sealed nodes and unratified architecture are refused;
* `ratify`: the architecture of the node is signed;
* `progress` (status): a step that isn't an end; entering GENERATED voids the verdict, from a gate it also uses up one of CEILING retries;
* `verdict` (passed): recorded at a gate;
* `acquire`, `release`: the node's lock, which is held by one node at most;
* `outcome` (status, reason, signed_by, justification): an end. GREEN needs a passed verdict; GREEN, RETIRED and REBUILT_HANDOFF free the nodes that wait; every end frees the lock.

An event that isn't allowed changes nothing and is answered with the reason.  Events of another plan than the run's are refused, so no old stream drives a new plan.
Events of one run and micro-batch are taken in order of `at`; one that comes in a later batch is answered by the state as it is then.  Null runs are a run of their own.
State is small: a node is one row of a map, so an event costs the rows it touches, whatever the size of the run.  A complete run is dropped after `keep` milliseconds.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.plans.schedule import GATED
from tessera.plans.verdicts import CEILING, IN_FLIGHT, RETRIED_FROM, STEPS

#: Statuses that end a node, those that free the nodes that wait, those that need a signature and their dispositions.
FREEING = ("GREEN", "RETIRED", "REBUILT_HANDOFF")
ENDS = (*FREEING, "BLOCK", "PARK", "NEEDS_MANUAL_SEAM")
SIGNED = {"RETIRED": "retire", "REBUILT_HANDOFF": "rebuild"}
NOT_BUILT = ("retire", "seal")
NO_SUCCESSOR = "NO_RELEASED_SUCCESSOR"
#: Milliseconds for which a complete run is kept.
KEEP = 7 * 24 * 3600 * 1000

EVENTS = "run string, at long, plan_hash string, verb string, node string, status string, reason string, signed_by string, justification string, passed boolean, lock string, disposition string, indegree long, frees array<string>"
ANSWERS = "run string, at long, verb string, node string, status string, cycle long, answer string, complete boolean"
NAMES = [c.split()[0] for c in ANSWERS.split(", ")]


class Node(NamedTuple):
    status: str
    indegree: int
    cycle: int
    green: bool
    ratified: bool
    disposition: str
    lock: str
    frees: list[str]


class Run(NamedTuple):
    plan_hash: str | None
    nodes: int
    ended: int


class Memory:
    """State of one run in dictionaries; `Stored` is the same over Spark's state."""

    def __init__(self) -> None:
        self.nodes: dict[str, Node] = {}
        self.locks: dict[str, str] = {}
        self.signed: list[tuple[str, ...]] = []
        self.run: Run | None = None

    def node(self, name: str) -> Node | None:
        return self.nodes.get(name)

    def put(self, name: str, node: Node) -> None:
        self.nodes[name] = node

    def owner(self, lock: str) -> str | None:
        return self.locks.get(lock)

    def hold(self, lock: str, name: str | None) -> None:
        if name is None:
            self.locks.pop(lock, None)
        else:
            self.locks[lock] = name

    def sign(self, *entry: str) -> None:
        self.signed.append(entry)

    def head(self) -> Run | None:
        return self.run

    def set_head(self, run: Run) -> None:
        self.run = run


def legal(before: str, after: str, cycle: int, reason: str | None) -> bool:
    """D11 of one step; `verdicts.may_step` is the same over columns."""
    if after in ("BLOCK", "NEEDS_MANUAL_SEAM"):
        return before in IN_FLIGHT
    if after == "GENERATED" and before in RETRIED_FROM:
        return cycle < CEILING
    if after == "PARK":
        return before == "BLOCK" and reason == NO_SUCCESSOR
    return after in STEPS.get(before, ())


def step(state: Any, e: Any) -> str:
    """Applies an event; 'ok', or why it was refused."""
    name = e.node or ""
    node, head = state.node(name), state.head()
    if head and e.plan_hash != head.plan_hash:
        return "another plan"
    if e.verb == "plan":
        if node:
            return "known node"
        head = head or Run(e.plan_hash, 0, 0)
        state.set_head(head._replace(nodes=head.nodes + 1))
        state.put(name, Node("PENDING", int(e.indegree or 0), 0, False, False, e.disposition or "refactor", e.lock or name, list(e.frees) if e.frees is not None else []))
        return "ok"
    if not node:
        return "unknown node"
    if e.verb == "acquire":
        owner = state.owner(node.lock)
        if owner is None:
            state.hold(node.lock, name)
        return "ok" if owner in (None, name) else f"held by {owner}"
    if e.verb == "release":
        if state.owner(node.lock) == name:
            state.hold(node.lock, None)
        return "ok"
    if e.verb == "ratify":
        if not e.signed_by:
            return "no signature"
        state.put(name, node._replace(ratified=True))
        state.sign(name, "RATIFIED", e.signed_by, e.justification or "")
        return "ok"
    if e.verb == "verdict":
        if node.status not in ("GATED", "PROVISIONAL_GATED"):
            return "not at a gate"
        state.put(name, node._replace(green=bool(e.passed) and node.status == "GATED"))
        return "ok"
    unratified = node.disposition in GATED and not node.ratified
    if e.verb == "dispatch":
        why = "not ready" if node.indegree else "sealed" if node.disposition == "seal" else "not ratified" if unratified else "" if node.status == "PENDING" else f"not allowed from {node.status}"
        if not why:
            state.put(name, node._replace(status="GROUNDED"))
        return why or "ok"
    if e.verb == "progress":
        if e.status in ENDS or e.status == "GROUNDED":
            return f"{e.status} is no progress"
        if e.status != "PENDING" and (node.disposition in NOT_BUILT or unratified):
            return "not built" if node.disposition in NOT_BUILT else "not ratified"
        if not legal(node.status, e.status or "", node.cycle, e.reason):
            return f"not allowed from {node.status}"
        retry = e.status == "GENERATED" and node.status in RETRIED_FROM
        state.put(name, node._replace(status=e.status, cycle=node.cycle + retry, green=node.green and e.status not in ("GENERATED", "PENDING")))
        return "ok"
    if e.verb == "outcome":
        return _outcome(state, e, name, node)
    return "unknown verb"


def _outcome(state: Any, e: Any, name: str, node: Node) -> str:
    if e.status not in ENDS:
        return f"{e.status} is no outcome"
    if not legal(node.status, e.status, node.cycle, e.reason):
        return f"not allowed from {node.status}"
    if e.status == "GREEN" and not node.green:
        return "no passed verdict"
    if e.status in SIGNED and node.disposition != SIGNED[e.status]:
        return "not its disposition"
    if e.status in (*SIGNED, "PARK"):
        if not e.signed_by or not e.justification:
            return "no signature"
        state.sign(name, e.status, e.signed_by, e.justification)
    state.put(name, node._replace(status=e.status))
    if e.status in FREEING:
        head = state.head()
        state.set_head(head._replace(ended=head.ended + 1))
        for other in node.frees:
            waits = state.node(other)
            if waits:
                state.put(other, waits._replace(indegree=max(0, waits.indegree - 1)))
    if state.owner(node.lock) == name:
        state.hold(node.lock, None)
    return "ok"


def answered(state: Any, e: Any) -> tuple:
    """The row of ANSWERS for an event."""
    answer = step(state, e)
    node, head = state.node(e.node or ""), state.head()
    return e.run, e.at, e.verb, e.node, node.status if node else None, node.cycle if node else None, answer, bool(head and head.nodes == head.ended)


class Stored(StatefulProcessor):
    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.nodes = handle.getMapState("nodes", "node string", "status string, indegree long, cycle long, green boolean, ratified boolean, disposition string, lock string, frees array<string>")
        self.locks = handle.getMapState("locks", "lock string", "owner string")
        self.signed = handle.getListState("signed", "node string, status string, signed_by string, justification string")
        self.run = handle.getValueState("run", "plan_hash string, nodes long, ended long")

    def node(self, name: str) -> Node | None:
        v = self.nodes.getValue((name,))
        return Node(*v) if v is not None else None

    def put(self, name: str, node: Node) -> None:
        self.nodes.updateValue((name,), tuple(node))

    def owner(self, lock: str) -> str | None:
        v = self.locks.getValue((lock,))
        return v[0] if v is not None else None

    def hold(self, lock: str, name: str | None) -> None:
        if name is None:
            self.locks.removeKey((lock,))
        else:
            self.locks.updateValue((lock,), (name,))

    def sign(self, *entry: str) -> None:
        self.signed.appendValue(entry)

    def head(self) -> Run | None:
        v = self.run.get()
        return Run(*v) if v is not None else None

    def set_head(self, run: Run) -> None:
        self.run.update(tuple(run))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        done = False
        for e in sorted(rows, key=lambda r: (r.at is None, r.at or 0)):
            out = answered(self, e)
            done = out[-1]
            yield Row(**dict(zip(NAMES, out, strict=True)))
        if self.keep is None:
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if done:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        for state in (self.nodes, self.locks, self.signed, self.run):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def reduced(events: DataFrame, keep: int | None = KEEP) -> DataFrame:
    """ANSWERS of a stream of EVENTS.  keep: None keeps complete runs for good, which a run over what is there (trigger availableNow) needs to come to an end.

    Needs the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`).
    """
    return events.groupBy("run").transformWithState(Stored(keep), ANSWERS, "append", "None" if keep is None else "ProcessingTime")


def folded(events: DataFrame) -> DataFrame:
    """ANSWERS of finite EVENTS: the same steps over rows sorted by run and `at`; a task holds the state of one run, not its events."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), Memory()
        for frame in frames:
            out = []
            for e in frame.astype(object).where(frame.notna(), None).itertuples(index=False):
                if e.run != now:
                    now, state = e.run, Memory()
                out.append(answered(state, e))
            yield pd.DataFrame(out, columns=NAMES)

    return events.repartition("run").sortWithinPartitions("run", "at").mapInPandas(run, ANSWERS)


def planned(nodes: DataFrame, links: DataFrame, at: int = 0) -> DataFrame:
    """The `plan` events of nodes (run, node, lock, disposition, plan_hash) and links (run, source, target: the target waits)."""
    each = links.where("source <> target").distinct()
    waits = each.groupBy("run", F.col("target").alias("node")).agg(F.count("*").alias("indegree"))
    frees = each.groupBy("run", F.col("source").alias("node")).agg(F.array_sort(F.collect_list("target")).alias("frees"))
    all_ = nodes.join(waits, ["run", "node"], "left").join(frees, ["run", "node"], "left").withColumns({"at": F.lit(at), "verb": F.lit("plan"), "indegree": F.coalesce("indegree", F.lit(0))})
    return shaped(all_)


def shaped(events: DataFrame) -> DataFrame:
    """Events with all columns of EVENTS; those that are missing are null."""
    fields = [f.split() for f in EVENTS.split(", ")]
    return events.select(*[(F.col(n) if n in events.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])
