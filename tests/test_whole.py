"""Queries over whole tables, without SQL, against brute force."""

import duckdb
import pytest
from tessera.queries_rest import QUERIES

SF = "/root/testdata/sf0.01"


def sql(text):
    return duckdb.sql(text.replace("{}", SF)).fetchall()


def run(spark, name, *columns):
    rows = [tuple(r) for r in QUERIES[name](spark, SF).select(*columns).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def edges():
    ids = [r[0] for r in sql("select p_partkey from '{}/part.parquet'")]
    return [(a, a // 2) for a in ids if a >= 1] + [(a, 10 * (a // 10) + (a + 1) % 10) for a in ids if a % 50 < 10]


@pytest.fixture(scope="module")
def reach(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())

    def far(x):
        seen, todo = set(), [x]
        while todo:
            for y in out[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return seen

    return {x: far(x) for x in out}


@pytest.fixture(scope="module")
def root(reach):
    return {x: min([x, *(y for y in far if x in reach[y])]) for x, far in reach.items()}


def test_components(spark, edges, root):
    assert run(spark, "G12_strong_components", "id", "root") == set(root.items())
    assert run(spark, "G13_condensation", "a", "b") == {(root[a], root[b]) for a, b in edges if root[a] != root[b]}
    assert run(spark, "G26_possible_cycles", "a", "b", "possible_cycle") == {(a, b, root[a] == root[b]) for a, b in edges if a != b}
    assert run(spark, "G23_conflict_groups", "id", "root") == {(x, 0) for x in root}


def test_feedback_arcs(spark, edges, root):
    cuts = run(spark, "G15_feedback_arcs", "source", "target")
    assert cuts <= set(edges) and max(a for a, _ in cuts) >= 500
    size = {}
    for r in root.values():
        size[r] = size.get(r, 0) + 1
    large = {r for r, n in size.items() if n > 4}
    assert {root[a] for a, _ in cuts} == large and all(root[a] == root[b] for a, b in cuts)


def test_reached_facts(spark, edges, reach):
    own = {p: f"f{z % 5}" for p, z in sql("select p_partkey, p_size from '{}/part.parquet' where p_partkey % 9 = 0")}
    known = {x: {own[y] for y in far | {x} if y in own} for x, far in reach.items()}
    via = {}
    for a, b in edges:
        for f in known[b] if a != b else ():
            if own.get(a) != f:
                via.setdefault((f"P{a}", f), set()).add(f"P{b}")
    assert run(spark, "G21_reached_facts", "object", "fact", "via") == {(*k, min(v)) for k, v in via.items()}


def test_ancestors(spark, edges):
    back = {}
    for a, b in edges:
        if a != b:
            back.setdefault(b, set()).add(a)
    want = set()
    for x in (p for (p,) in sql("select p_partkey from '{}/part.parquet' where p_partkey % 5 = 0")):
        seen, todo = set(), [x]
        while todo:
            for y in back.get(todo.pop(), set()) - seen:
                seen.add(y)
                if y % 5:
                    todo.append(y)
        want |= {(f"P{x}", f"P{y}") for y in seen if y % 5 == 0 and y != x}
    assert run(spark, "G22_ancestors", "id", "ancestor") == want


def test_pagerank(spark, edges):
    ids = {x for e in edges for x in e}
    degree = dict.fromkeys(ids, 0)
    for a, _ in edges:
        degree[a] += 1
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(30):
        lost = sum(rank[x] for x in ids if not degree[x])
        new = dict.fromkeys(ids, (0.15 + 0.85 * lost) / len(ids))
        for a, b in edges:
            new[b] += 0.85 * rank[a] / degree[a]
        change, rank = max(abs(new[x] - rank[x]) for x in ids), new
        if change < 1e-6:
            break
    got = dict(run(spark, "G11_pagerank", "id", "rank"))
    assert set(got) == ids and max(got.values()) == 1
    assert all(abs(got[x] - rank[x] / max(rank.values())) <= 0.000051 for x in ids)


def test_reciprocals(spark):
    e = set(sql("select distinct l_suppkey, l_partkey from '{}/lineitem.parquet'"))
    assert run(spark, "J16_reciprocals", "a", "b") == {(a, b) for a, b in e if (b, a) not in e}


def test_program_pools(spark):
    assert run(spark, "G24_program_pools", "id", "root") == {(p, 0) for (p,) in sql("select p_partkey from '{}/part.parquet'")}


def test_frontier(spark):
    """No two of a key or linked, and no part left that could be added."""
    links = {}
    for a, b in sql("select distinct l_suppkey, l_partkey from '{}/lineitem.parquet' where l_suppkey <> l_partkey"):
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set()).add(a)
    got = {i for (i,) in run(spark, "G25_frontier", "id")}
    ids = {p for (p,) in sql("select p_partkey from '{}/part.parquet'")}
    assert any(i % 4 for i in got) and len({i // 12 for i in got}) == len(got)
    assert not any(links.get(i, set()) & got for i in got)
    keys = {i // 12 for i in got}
    assert all(i // 12 in keys or links.get(i, set()) & got for i in ids)
