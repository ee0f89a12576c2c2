"""Tables that rounds make anew meet by a shuffle, and tasks get a bounded number of rows."""

import random

import pytest
from tessera.operators import cuts, strong


@pytest.fixture()
def plans(monkeypatch):
    """The final plans of all tables that operators cut."""
    seen = []

    def kept(df, laid=False):
        out = cuts.cut(df, laid)
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    from tessera.plans import schedule, types

    for module in (strong, types, schedule):
        monkeypatch.setattr(module, "cut", kept)
    return seen


def test_strong_components_send_nothing_by_broadcast(spark, plans):
    rng = random.Random(7)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(200)] + [(i, i + 1) for i in range(200, 240)]
    got = dict(map(tuple, strong.strong_components(spark.createDataFrame(links, "a long, b long"), small=5).collect()))
    assert got == {x: r for x, r in strong.searched(links).items()}
    assert len(plans) > 10 and not any("Broadcast" in p for p in plans)


def test_references_send_nothing_by_broadcast(spark, plans):
    from tessera.plans import types

    table = lambda rows, *names: spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
    out = types.resolved(table([(i, i, 1) for i in range(9)], "source", "var", "method"), table([(0, 6)], "var", "type"), table([(i // 2, i) for i in range(1, 9)], "src", "dst"), table([(6, 3), (3, 1)], "type", "super"), table([(1, 1), (6, 2)], "type", "method"))
    rows = {tuple(r) for r in out.collect()}
    assert rows == {(i, 1, 1) for i in range(9)}
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 8 and not any("Broadcast" in p for p in plans)


def test_reciprocals_need_no_join(spark):
    from tessera.operators.joins import unreciprocated

    rng = random.Random(3)
    links = [(rng.choice([None, *range(-3, 12)]), rng.choice([None, *range(-3, 12)])) for _ in range(150)]
    out = unreciprocated(spark.createDataFrame(links, "a int, b long"))
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(a, b) for a, b in links if a is None or b is None or (b, a) not in links}
    assert out.dtypes == [("a", "int"), ("b", "bigint")] and "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_hubs_take_a_bounded_number_of_links_a_task(spark, monkeypatch):
    from tessera.operators.orders import hubs

    monkeypatch.setattr(cuts, "SHARE", 20)
    rng = random.Random(5)
    links = [(f"S{rng.randrange(30)}", f"P{rng.randrange(12)}") for _ in range(600)]
    n = {x: links.count(x) for x in links}
    want = {s: min((-n[x], x[1]) for x in n if x[0] == s)[1] for s in {s for s, _ in links} if any(n[x] > 1 for x in n if x[0] == s)}
    out = hubs(spark.createDataFrame(links, "source string, target string"))
    assert dict(map(tuple, out.collect())) == want
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


def test_owners_take_a_bounded_number_of_edges_a_task(spark, monkeypatch):
    from tessera.operators.graph import object_graph

    monkeypatch.setattr(cuts, "SHARE", 20)
    edges = [(f"A{i % 17}", f"B{i % 23}", "uses") for i in range(500)]
    nodes = [(f"A{i}", f"O{i % 5}") for i in range(17)] + [(f"B{i}", f"O{i % 7}") for i in range(20)]
    name = dict(nodes)
    want = {}
    for a, b, k in edges:
        x, y = name.get(a, a), name.get(b, b)
        if x != y:
            want[x, y, k] = want.get((x, y, k), 0) + 1
    out = object_graph(spark.createDataFrame([(*e, None) for e in edges], "source string, target string, kind string, access string"), spark.createDataFrame(nodes, "id string, object string"), len(edges))
    assert {tuple(r[:3]): r[3] for r in out.collect()} == want
    assert out._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 3


def test_frontier_keeps_links_once_and_packed(spark, monkeypatch):
    from pyspark.sql import functions as F
    from tessera.plans import schedule

    kept = []

    def counted(df, laid=False):
        out = cuts.cut(df, laid)
        kept.append(out.count())
        return out

    monkeypatch.setattr(schedule, "cut", counted)
    rng = random.Random(11)
    size = {i: rng.randrange(5) for i in range(60)}
    links = [(a, b) for a in range(40) for b in range(40, 70) for _ in range(2) if rng.random() < 0.3] + [(1, 1), (2, 3)]
    keys = [(i, i // 4) for i in range(60)]
    near = {(a, b) for a, b in links if a != b}
    want: list[int] = []
    for i in sorted(size, key=lambda i: (-size[i], i)):
        if not any((i, j) in near or (j, i) in near or i // 4 == j // 4 for j in want):
            want.append(i)
    ready = spark.createDataFrame(list(size.items()), "id long, size long")
    out = schedule.frontier(ready, spark.createDataFrame(links, "source long, target long"), spark.createDataFrame(keys, "id long, key long"), [(-F.col("size")).alias("s")])
    assert sorted(r["id"] for r in out.collect()) == sorted(want)
    assert max(kept) <= 60 * 8 < len(near)  # a row for each node and batch of a task at most
