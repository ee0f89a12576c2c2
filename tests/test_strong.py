"""Strong components against a plain search, and how many jobs shapes with long paths take."""

import random

import pytest
from tessera.operators import strong


def plain(edges):
    """Smallest id of each node's component: order of finishing, then a search backwards."""
    out, back = {}, {}
    for a, b in edges:
        for x, y, links in ((a, b, out), (b, a, back)):
            links.setdefault(x, []).append(y)
            links.setdefault(y, [])
    seen, order = set(), []
    for top in out:
        stack = [(top, iter(out[top]))] if top not in seen else []
        seen.add(top)
        while stack:
            node, rest = stack[-1]
            new = next((x for x in rest if x not in seen), None)
            if new is None:
                order.append(node)
                stack.pop()
            else:
                seen.add(new)
                stack.append((new, iter(out[new])))
    root = {}
    for top in reversed(order):
        if top not in root:
            group = [top]
            root[top] = top
            for x in group:
                for y in back[x]:
                    if y not in root:
                        root[y] = top
                        group.append(y)
            root.update(dict.fromkeys(group, min(group)))
    return root


def found(spark, edges):
    return {r["id"]: r["root"] for r in strong.strong_components(spark.createDataFrame(edges, "a long, b long"), 0).collect()}


def test_random(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(130)]
    assert found(spark, edges) == plain(edges)


def test_shapes(spark):
    """Rings with tails in and out, rings that share nodes, rings beside each other joined one way, a ring with chords, nodes with edges to themselves."""
    ring = lambda at, n: [(at + i, at + (i + 1) % n) for i in range(n)]
    edges = [*ring(10, 7), (1, 2), (2, 3), (3, 10), (12, 30), (30, 31), (31, 32)]
    edges += [*ring(100, 5), *ring(200, 4), (101, 202), (203, 300), *ring(300, 3), (400, 400), (401, 401), (401, 402)]
    edges += [*ring(500, 6), *[(500, 510), (510, 511), (511, 503)], *ring(600, 8), (600, 604), (604, 601), (605, 602)]
    assert found(spark, edges) == plain(edges)


@pytest.mark.parametrize("shape", ["chain", "ring", "grid"])
def test_long_paths(spark, shape, monkeypatch):
    """A hundred thousand nodes in a row, or a mesh: tens of rounds."""
    n = 100_000
    if shape == "grid":  # rows of 6 lead right and down, every fifth row leads back too
        edges = [(6 * y + x, 6 * y + x + 1) for y in range(6) for x in range(5)] + [(6 * y + x, 6 * y + x + 6) for y in range(5) for x in range(6)]
        edges += [(6 * y + 5, 6 * y) for y in range(0, 6, 5)]
        df, want = spark.createDataFrame(edges, "a long, b long"), plain(edges)
    else:
        ids = spark.range(n).withColumnRenamed("id", "a")
        to = {"chain": "a + 1", "ring": f"(a + 1) % {n}"}[shape]
        df = ids.selectExpr("a", f"cast({to} as long) as b").where(f"b < {n} and b >= 0")
        want = {i: 0 if shape == "ring" else i for i in range(n)}
    rounds = []
    real = strong.cut
    monkeypatch.setattr(strong, "cut", lambda d: rounds.append(1) or real(d))
    got = {r["id"]: r["root"] for r in strong.strong_components(df, 0).collect()}
    assert got == {i: want[i] for i in got} and len(got) == len(want)
    assert len(rounds) <= (150 if shape == "grid" else 80), len(rounds)


def test_hub_and_odd_rows(spark):
    star = [(0, i) for i in range(1, 300)] + [(i, 0) for i in range(1, 300, 2)]
    assert found(spark, star) == plain(star)
    assert found(spark, []) == {}
    assert found(spark, [(None, 1), (1, None), (2, 3), (3, 2), (3, 2)]) == {1: 1, 2: 2, 3: 2}


def test_a_cut_table_forgets_guessed_sizes(spark):
    """A join's size is a product: kept over rounds, its digits double each time."""
    t = strong.cut(spark.range(9))
    for _ in range(8):
        t = strong.cut(t.join(t.select("id"), "id"))
    assert t.count() == 9
    assert len(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= 20


def test_rounds_then_a_search(spark):
    """What rounds leave over is searched on the driver, and meets what they found before."""
    rng = random.Random(5)
    links = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(90)} | {(60 + i, 60 + (i + 1) % 20) for i in range(20)} | {(a, b) for a in range(90, 96) for b in range(90, 96)})
    want = strong.searched([(a, b) for a, b in links if a != b])
    got = {r["id"]: r["root"] for r in strong.strong_components(spark.createDataFrame(links, "a long, b long"), small=40).collect()}
    assert got == {i: want.get(i, i) for x in links for i in x}
