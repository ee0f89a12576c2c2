"""Components with hubs and giant groups, and facts over long chains."""

import random

from pyspark.sql import functions as F
from tessera.operators import graph
from tessera.plans import facts


def roots(pairs):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {x: top(x) for x in up}


def test_components_with_hubs(spark, monkeypatch):
    rng = random.Random(5)
    pairs = [(0, i) for i in range(1, 400)] + [(1000, i) for i in range(700, 900)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)] + [(3000 + i, 3001 + i) for i in range(60)] + [(5, 5)]
    df = spark.createDataFrame(pairs, "a long, b long")
    want = roots(pairs)
    assert {r["id"]: r["root"] for r in graph.components(df).collect()} == want
    used = []
    real = graph.crowded
    monkeypatch.setattr(graph, "HOT", 50)
    monkeypatch.setattr(graph, "crowded", lambda *a: used.append(real(*a)) or used[-1])
    assert {r["id"]: r["root"] for r in graph.components(df).collect()} == want
    assert {r["b"] for r in used[0].collect()} == {0, 1000} and any(u is not None and "l" in u.columns for u in used[1:])
    assert graph.components(df.where("false")).count() == 0


def test_a_star_never_meets_in_one_task(spark):
    """Of 60,000 links to one node, no partition of the join holds more than its share."""
    both = spark.range(1, 60001).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b")).repartition(8)
    label = spark.range(0, 60001).select(F.col("id").alias("b"), F.col("id").alias("l"))
    many = graph.crowded(both, "b", 60000)
    sizes = graph.spread_join(both, label, "b", many).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 60000 and max(r["count"] for r in sizes) <= 60000 // 8 + 100


def test_facts_over_a_long_chain(spark, monkeypatch):
    monkeypatch.setattr(facts, "KEPT", 4)
    calls = spark.createDataFrame([(f"o{i:02}", f"o{i + 1:02}") for i in range(10)] + [("o10", "o00")], "source string, target string")
    own = spark.createDataFrame([("o10", "f"), ("o05", "g"), ("o05", "g")], "object string, fact string")
    got = {(r["object"], r["fact"]): r["via"] for r in facts.reached(own, calls).collect()}
    assert got == {**{(f"o{i:02}", "f"): f"o{i + 1:02}" for i in range(10)}, **{(f"o{i:02}", "g"): f"o{(i + 1) % 11:02}" for i in range(11) if i != 5}}
