"""Strongly connected components in rounds that grow with the logarithm of paths.

Three reductions take turns on the cluster until no more than SMALL edges are left, which one search on the driver takes.

* Trimming: an edge out of a node that nothing leads to is on no cycle.
* Contraction: a node that one edge only leads to hangs below the edge's source.  Such nodes form trees, whose roots are found by
  doubling pointers; a ring of them gets its smallest node as a root.  A tree becomes its root.  Later, a node of the tree belongs to the component of
  its root if an edge that starts at or below it leads back into that component.  The same holds with all edges turned round.
* Colouring: every node takes the first, in a random order, of all nodes that reach it, and the first that it reaches, by
  passing names along edges and by jumps (what a node's name is named, too).  Both names equal: a component.
  Components lie within nodes of the same two names, so all other edges go.

Chains, rings and trees need one contraction of log2(length) doublings; meshes are split by colours.
Nodes are whole numbers; null ends, repeated edges and edges from a node to itself don't matter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.cuts import cut, met


#: Distinct edges up to which one search on the driver takes the place of dozens of rounds.
SMALL = 50_000


def searched(links: list[tuple[int, int]]) -> dict[int, int]:
    """Smallest id of each node's strong component: order by finishing times, then search backwards."""
    out: dict[int, list[int]] = {}
    back: dict[int, list[int]] = {}
    for a, b in links:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
        back.setdefault(b, []).append(a)
    seen: set[int] = set()
    finished: list[int] = []
    for top in out:
        stack = [(top, iter(out[top]))] if top not in seen else []
        seen.add(top)
        while stack:
            node, rest = stack[-1]
            for x in rest:
                if x not in seen:
                    seen.add(x)
                    stack.append((x, iter(out[x])))
                    break
            else:
                finished.append(node)
                stack.pop()
    root: dict[int, int] = {}
    for top in reversed(finished):
        if top in root:
            continue
        group, at = [top], 0
        root[top] = top
        while at < len(group):
            for x in back.get(group[at], ()):
                if x not in root:
                    root[x] = top
                    group.append(x)
            at += 1
        low = min(group)
        for x in group:
            root[x] = low
    return root


@dataclass
class Trees:
    """A contraction: pointers after 1, 2, 4, ... steps, (id, root), and the edges that are in no tree as (x, rx, y)."""

    pointers: list[DataFrame]
    roots: DataFrame
    others: DataFrame


def _doubled(parent: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Pointers after 1, 2, 4, ... steps of parent(id, p); the roots to give to rings, if there are any."""
    now = cut(parent.select("id", "p", F.least("id", "p").alias("low")))
    tables, steps, n = [now], 1, now.count()
    while True:
        ahead = now.select(F.col("id").alias("p"), F.col("p").alias("q"), F.col("low").alias("qlow"))
        new = cut(met(now, ahead, "p", "left").select("id", F.coalesce("q", "p").alias("p"), F.least("low", "qlow").alias("low"), F.col("q").isNotNull().alias("on")))
        if new.where("on").isEmpty():
            return tables, None
        now = new.select("id", "p", "low")
        tables.append(now)
        steps *= 2
        if steps > n:  # what still goes on is on a ring or hangs below one; on the ring is what is pointed at
            ring = new.where("on").select(F.col("p").alias("id")).distinct()
            return tables, met(now, ring, "id", "left_semi").where("id = low").select("id")


def _contracted(links: DataFrame) -> tuple[DataFrame, Trees | None]:
    """The links(a, b) between the roots of trees of nodes with one way in."""
    into = cut(links.groupBy("b").agg(F.count("*").alias("n"), F.min("a").alias("p")))
    links = met(links, into.select(F.col("b").alias("a")), "a", "left_semi")  # trimmed
    parent = into.where("n = 1").select(F.col("b").alias("id"), "p")
    if parent.isEmpty():
        return cut(links), None
    tables, rings = _doubled(parent)
    if rings is not None:
        parent = met(parent, rings, "id", "left_anti")
        tables, _ = _doubled(parent)
    roots = tables[-1].select("id", F.col("p").alias("root"))
    others = met(links, roots.select(F.col("id").alias("b")), "b", "left_anti")
    others = met(others, roots.withColumnRenamed("id", "a"), "a", "left").select(F.col("a").alias("x"), F.coalesce("root", "a").alias("rx"), F.col("b").alias("y"))
    others = cut(others)
    return cut(others.where("rx <> y").select(F.col("rx").alias("a"), F.col("y").alias("b")).distinct()), Trees(tables, roots, others)


def _undone(trees: Trees, found: DataFrame | None, known: Callable[[DataFrame | None], DataFrame]) -> DataFrame | None:
    """found(id, c), the components of several nodes among roots, with the tree nodes that belong to one."""
    name = lambda side: known(found).select(F.col("id").alias(side), F.col("c").alias(f"c_{side}"))
    back = met(met(trees.others, name("rx"), "rx", "left"), name("y"), "y", "left")
    marked = cut(back.where(F.coalesce("c_rx", "rx") == F.coalesce("c_y", "y")).select(F.col("x").alias("id")).distinct())
    if marked.isEmpty():
        return found
    for table in trees.pointers:  # all that is above, within twice as many steps each time
        marked = cut(marked.union(met(marked, table, "id").select("p")).distinct())
    own = met(met(marked, trees.roots, "id"), known(found).select(F.col("id").alias("root"), "c"), "root", "left").select("id", F.coalesce("c", "root").alias("c"), "root")
    own = cut(own)
    new = own.select("id", "c").union(own.where("c = root").select("root", "c")).distinct()
    return cut(known(found).union(new).distinct())


def _coloured(links: DataFrame) -> DataFrame:
    """id and the first node, by a random order, that reaches it along links(a, b)."""
    ids = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct()
    now = cut(ids.select("id", F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("c")).alias("first")))
    while True:
        come = met(links, now.select(F.col("id").alias("a"), "first"), "a").groupBy(F.col("b").alias("id")).agg(F.min("first").alias("come"))
        new = cut(met(now, come, "id", "left").select("id", F.least("first", "come").alias("first"), (F.col("come") < F.col("first")).alias("changed")))
        if new.where("changed").isEmpty():
            return new.select("id", F.col("first.c").alias("c"))
        far = new.select(F.col("id").alias("c"), F.col("first").alias("far"))
        now = cut(met(new.select("id", "first", F.col("first.c").alias("c")), far, "c").select("id", F.least("first", "far").alias("first")))


def strong_components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """id, root (the smallest id) of every node's strong component; edges: a, b.

    As soon as no more than `small` distinct edges are left, they are searched on the driver, which is quicker than rounds; the result is the same.
    """
    ends = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    ids = cut(ends.select(F.col("a").alias("id")).union(ends.select(F.col("b").alias("id"))).where("id is not null").distinct())
    links = cut(ends.where("a <> b").distinct())
    none = edges.sparkSession.createDataFrame([], "id long, c long")
    known = lambda found: none if found is None else found
    steps: list[tuple[Trees, DataFrame | None]] = []
    found: DataFrame | None = None
    turned = lambda df: df.select(F.col("b").alias("a"), F.col("a").alias("b"))
    size = links.count()
    while size > small:
        for _ in range(2):  # one way, then the other
            links, trees = _contracted(links)
            if trees:
                steps.append((trees, found))
                found = None
            links = turned(links)
        left = links.count()
        if left > size // 2:
            to, back = _coloured(links), _coloured(turned(links))
            both = cut(met(to.withColumnRenamed("c", "f"), back.withColumnRenamed("c", "g"), "id"))
            new = both.where("f = g").select("id", F.col("f").alias("c"))
            found = cut(known(found).union(new))
            side = lambda s: both.select(F.col("id").alias(s), F.col("f").alias(f"f{s}"), F.col("g").alias(f"g{s}"))  # noqa: E731, B023
            links = cut(met(met(links, side("a"), "a"), side("b"), "b").where("fa = fb and ga = gb and fa <> ga").select("a", "b"))
            left = links.count()
        size = left
    if size:  # few enough for the driver
        roots = searched([(r["a"], r["b"]) for r in links.collect()])
        several = [(x, root) for x, root in roots.items() if root != x]
        groups = [*several, *{(root, root) for _, root in several}]
        found = cut(known(found).union(edges.sparkSession.createDataFrame(groups, "id long, c long")))
    for trees, earlier in reversed(steps):
        found = _undone(trees, found, known)
        if earlier is not None:
            found = cut(known(found).union(earlier).distinct())
    low = known(found).groupBy("c").agg(F.min("id").alias("root"))
    named = met(known(found), low, "c").select("id", "root")
    return met(ids, named, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
