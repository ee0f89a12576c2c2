"""The run reducer: stream against fold, locks, restarts, refusals."""

import random
import time

import pytest
from tessera.streaming import reducer as R

FIELDS = [f.split()[0] for f in R.EVENTS.split(", ")]
STATUSES = ("GENERATED", "SYNTAX_OK", "PUSHED", "ACTIVATED", "GATED", "PROVISIONAL_GATED", "PENDING", "GROUNDED")


def event(run, at, verb, node, **more):
    return tuple({"run": run, "at": at, "verb": verb, "node": node, "plan_hash": "p", **more}.get(f) for f in FIELDS)


def story(run, seed):
    """A plan and random events on it, most of them in a sensible order."""
    rng = random.Random(seed)
    n = 6
    ups = {i: sorted(rng.sample(range(i), min(i, rng.randint(0, 2)))) for i in range(n)}
    out = [event(run, i, "plan", f"n{i}", indegree=len(ups[i]), frees=[f"n{j}" for j in ups if i in ups[j]], lock=f"t{i % 2}", disposition=rng.choice(["refactor", "refactor", "retire", "rebuild", "seal"])) for i in range(n)]
    for at in range(n, 150):
        node = f"n{rng.randrange(n + 1)}"
        verb = rng.choice(["dispatch", "progress", "progress", "progress", "verdict", "acquire", "acquire", "release", "outcome", "ratify", "nothing"])
        status = rng.choice(STATUSES if verb == "progress" else R.ENDS)
        sign = {"signed_by": rng.choice([None, "someone"]), "justification": rng.choice(["", "known"])}
        out.append(event(run, at, verb, node, status=status, reason=rng.choice([None, R.NO_SUCCESSOR]), passed=rng.random() < 0.8, plan_hash=rng.choice(["p"] * 20 + ["other", None]), **sign))
    return out


def fold(events):
    states, out = {}, []
    for e in sorted((R_(e) for e in events), key=lambda e: e.at):
        out.append(R.answered(states.setdefault(e.run, R.Memory()), e))
    return out


class R_:  # noqa: N801
    def __init__(self, values):
        self.__dict__.update(zip(FIELDS, values, strict=True))


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def play(spark, tmp_path, batches, keep=None):
    """Each batch is a run of its own from the same checkpoint, as after a restart."""
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, R.EVENTS).coalesce(1).write.mode("append").parquet(str(src))
        q = R.reduced(spark.readStream.schema(R.EVENTS).parquet(str(src)), keep).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(180) and q.exception() is None, i
    return sorted(map(tuple, spark.read.schema(R.ANSWERS).parquet(out).collect()))


def test_stream_equals_fold_over_restarts(spark, rocks, tmp_path):
    runs = [story(f"r{i}", i) for i in range(8)]
    batches = [[e for r in runs for e in r[a:b]] for a, b in ((0, 40), (40, 41), (41, 150))]
    want = sorted(fold([e for r in runs for e in r]))
    assert play(spark, tmp_path, batches) == want
    assert {"ok", "not ready", "another plan", "unknown node", "unknown verb", "no signature", "sealed"} <= {w[6] for w in want}
    assert any(w[6].startswith("held by") for w in want)
    got = R.folded(spark.createDataFrame([e for r in runs for e in r], R.EVENTS))
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("seed", range(30))
def test_a_lock_has_one_holder(seed):
    state, held = R.Memory(), {}
    for e in story("r", seed):
        e = R_(e)
        answer = R.step(state, e)
        if e.verb == "acquire" and answer == "ok":
            assert held.setdefault(state.nodes[e.node].lock, e.node) == e.node
        if e.verb in ("release", "outcome") and answer == "ok" and held.get(state.nodes[e.node].lock) == e.node:
            del held[state.nodes[e.node].lock]
        assert held == state.locks
        waits = {n: sum(n in v.frees and v.status not in R.FREEING for v in state.nodes.values()) for n in state.nodes}
        assert len(state.nodes) < 6 or waits == {n: v.indegree for n, v in state.nodes.items()}


def test_retries_end_at_the_ceiling_and_a_run_completes():
    rows = [("plan", {}), ("dispatch", {})]
    loop = [("progress", {"status": s}) for s in ("GENERATED", "SYNTAX_OK")]
    state = R.Memory()
    answers = [R.answered(state, R_(event("r", i, v, "a", **m))) for i, (v, m) in enumerate([*rows, *loop * 5])]
    assert [a[6] for a in answers] == ["ok"] * 10 + ["not allowed from SYNTAX_OK", "not allowed from SYNTAX_OK"] and answers[-1][5] == 3
    walk = [("progress", {"status": s}) for s in ("PUSHED", "ACTIVATED", "GATED")]
    more = [R.answered(state, R_(event("r", 20 + i, v, "a", **m))) for i, (v, m) in enumerate([*walk, ("outcome", {"status": "GREEN"}), ("verdict", {"passed": True}), ("outcome", {"status": "GREEN"})])]
    assert [a[6] for a in more] == ["ok", "ok", "ok", "no passed verdict", "ok", "ok"] and [a[7] for a in more] == [False] * 5 + [True]


def test_a_complete_run_is_forgotten(spark, rocks, tmp_path):
    """With keep at nothing, the timer of a complete run drops it soon after, and its plan may come again."""
    done = [event("r", i, v, "a", **m) for i, (v, m) in enumerate([("plan", {"disposition": "retire"}), ("dispatch", {}), ("outcome", {"status": "RETIRED", "signed_by": "x", "justification": "y"})])]
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame(done, R.EVENTS).coalesce(1).write.parquet(src)
    q = R.reduced(spark.readStream.schema(R.EVENTS).parquet(src), 0).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            if (q.lastProgress or {"batchId": 0})["batchId"] >= 2:
                break
            time.sleep(0.5)
        spark.createDataFrame([event("r", 9, "plan", "a")], R.EVENTS).coalesce(1).write.mode("append").parquet(src)
        for _ in range(60):
            answers = sorted(map(tuple, spark.read.schema(R.ANSWERS).parquet(out).collect()))
            if len(answers) == 4:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert [a[6] for a in answers] == ["ok"] * 4 and [a[7] for a in answers] == [False, False, True, False]
