"""Graph operators on edge tables: bounded searches, ranks, components, levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.cuts import cut, dealt
from tessera.operators.strong import strong_components


def blast_radius(edges: DataFrame, depth: int = 3) -> DataFrame:
    """Id, affected: nodes that depend on it in at most `depth` steps, itself not counted."""
    back = edges.select(F.col("target").alias("id"), F.col("source").alias("hit")).distinct()
    seen = front = back = cut(back)
    for _ in range(min(5, max(1, depth)) - 1):
        nxt = front.join(back.select(F.col("id").alias("hit"), F.col("hit").alias("far")), "hit").select("id", F.col("far").alias("hit")).distinct()
        front = cut(nxt.join(seen, ["id", "hit"], "left_anti"))  # read twice: by the next step and by the sum
        seen = seen.unionByName(front)
    return seen.where("id <> hit").groupBy("id").agg(F.count("*").alias("affected"))


def pagerank(edges: DataFrame, rounds: int, d: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """Id, rank; multiple edges count, dangling mass is shared by all."""
    out = edges.select(F.col("source").alias("id"), "target")
    ids = out.select("id").union(out.select("target")).distinct()
    degree = out.groupBy("id").agg(F.count("*").alias("deg"))
    # links and ranks lie by id, so a round shuffles what is sent only
    base = cut(ids.join(degree, "id", "left").repartition("id"))
    links = cut(out.repartition("id"), laid=True)
    n = base.count()
    if not n:
        return base.select("id", F.lit(0.0).alias("rank"))
    ranks = base.withColumn("rank", F.lit(1.0 / n))
    lost = base.where("deg is null").count() / n
    for _ in range(rounds):
        sent = links.join(ranks.select("id", (F.col("rank") / F.col("deg")).alias("give")), "id").groupBy(F.col("target").alias("id")).agg(F.sum("give").alias("got"))
        new = ranks.join(sent, "id", "left").select("id", "deg", F.col("rank").alias("old"), ((1 - d) / n + d * (F.coalesce("got", F.lit(0.0)) + lost / n)).alias("rank"))
        new = cut(new)
        row = new.agg(F.max(F.abs(F.col("rank") - F.col("old"))), F.coalesce(F.sum(F.when(F.col("deg").isNull(), F.col("rank"))), F.lit(0.0))).first()
        ranks, lost = new.select("id", "deg", "rank"), row[1]
        if tolerance is not None and row[0] < tolerance:
            break
    return ranks.select("id", "rank")


#: Rows of one key below which a join needs no care.
HOT = 10_000


def crowded(rows: DataFrame, key: str, total: int) -> DataFrame | None:
    """The keys with over HOT rows and a 4096th of all: fewer than 4096, whatever the data; None if there is none."""
    many = cut(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > max(HOT, total // 4096)).select(key))
    return None if many.isEmpty() else many


def spread_join(left: DataFrame, right: DataFrame, key: str, many: DataFrame | None) -> DataFrame:
    """left joined with right, which has one row a key: the rows of crowded keys stay where they are and get theirs by broadcast, the others meet by a shuffle."""
    if many is None:
        return left.join(right, key)
    many = F.broadcast(many)
    few = left.join(many, key, "left_anti").join(right, key)
    return few.unionByName(left.join(F.broadcast(right.join(many, key, "left_semi")), key))


def components(links: DataFrame) -> DataFrame:
    """Id, root (smallest id) by shrinking labels, with label jumps.

    A node with very many links and a label of very many nodes (a hub, a giant component) never meet theirs in one task.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    total = both.count()
    hubs = crowded(both, "b", total)
    label = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")))
    while True:
        low = spread_join(both, label.select(F.col("a").alias("b"), "l"), "b", hubs).groupBy("a").agg(F.min("l").alias("m"))
        new = cut(label.join(low, "a").select("a", F.least("l", "m").alias("l")))
        jump = new.select(F.col("a").alias("l"), F.col("l").alias("ll"))
        new = cut(spread_join(new, jump, "l", crowded(new, "l", total)).select("a", F.least("l", "ll").alias("l")))
        if new.join(label.select("a", F.col("l").alias("o")), "a").where("l <> o").isEmpty():
            return new.select(F.col("a").alias("id"), F.col("l").alias("root"))
        label = new


def levels(edges: DataFrame) -> DataFrame:
    """Id, level: nodes without predecessors are 0; each level is peeled off.  A cycle is an error."""
    left = cut(edges.select(F.col("source").alias("a"), F.col("target").alias("b")).distinct())
    ids = cut(left.select(F.col("a").alias("id")).union(left.select(F.col("b").alias("id"))).distinct())
    out, k = None, 0
    while not ids.isEmpty():
        top = cut(ids.join(left.select(F.col("b").alias("id")), "id", "left_anti"))
        if top.isEmpty():
            raise ValueError("the graph has a cycle")
        level = top.withColumn("level", F.lit(k).cast("long"))
        out = level if out is None else out.unionByName(level)
        ids = cut(ids.join(top, "id", "left_anti"))
        left = cut(left.join(top.select(F.col("id").alias("a")), "a", "left_anti"))
        k += 1
    return out if out is not None else ids.withColumn("level", F.lit(0).cast("long"))


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Tables are data, nodes that others use are internal, the rest are entries."""
    used = edges.select(F.col("target").alias("id")).distinct().withColumn("used", F.lit(True))
    return nodes.join(used, "id", "left").select("id", F.when(F.col("kind") == "table", "data").when(F.col("used"), "internal").otherwise("entry").alias("layer"))


def boundaries(edges: DataFrame, nodes: DataFrame, total: int | None = None) -> DataFrame:
    """Targets that another object calls, with the number of calling objects."""
    from tessera.operators.joins import with_owners

    return with_owners(edges, nodes, total).where("source_owner <> target_owner").groupBy(F.col("target").alias("id")).agg(F.countDistinct("source_owner").alias("callers"))


def object_graph(edges: DataFrame, nodes: DataFrame, total: int | None = None) -> DataFrame:
    """Edges between objects with the number of links of each kind; total: a bound of the number of edges, for tasks of a bounded number of rows."""
    from tessera.operators.joins import with_owners

    between = with_owners(edges, nodes, total).where("source_owner <> target_owner").select("source_owner", "target_owner", "kind")
    between = between if total is None else dealt(between, "source_owner", "target_owner", total=total)
    return between.groupBy("source_owner", "target_owner", "kind").agg(F.count("*").alias("links"))


def build_nodes(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """G1: id, kind of the objects and of all ends of edges; an object's kind wins, an end that is no object is unknown."""
    ends = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct().withColumn("kind", F.lit(None).cast("string"))
    return objects.select("id", "kind").unionByName(ends).groupBy("id").agg(F.coalesce(F.max("kind"), F.lit("unknown")).alias("kind"))


def capped(nodes: DataFrame, key: str, order: str, cap: int) -> DataFrame:
    """Nodes with kept: whether they are among the first of their graph; edges to the others stay."""
    return nodes.withColumn("kept", F.row_number().over(W.partitionBy(key).orderBy(order)) <= cap)


def successors(edges: DataFrame, backwards: bool = False) -> DataFrame:
    """Id, nodes: distinct targets of each node (sources, backwards), in order."""
    a, b = ("target", "source") if backwards else ("source", "target")
    return edges.groupBy(F.col(a).alias("id")).agg(F.array_sort(F.collect_set(b)).alias("nodes"))


def group_evidence(members: DataFrame, linked: DataFrame) -> DataFrame:
    """Grp, members, linked: how many members(grp, id) have links(id)."""
    with_link = linked.select("id").distinct().withColumn("l", F.lit(1))
    return members.join(with_link, "id", "left").groupBy("grp").agg(F.count("*").alias("members"), F.count("l").alias("linked"))


def possible_cycles(edges: DataFrame) -> DataFrame:
    """A, b, possible_cycle of the distinct edges: whether b leads back to a, as both are in one strong component."""
    e = edges.where("a <> b").distinct()
    root = strong_components(edges)
    j = e.join(root.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a").join(root.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b")
    return j.select("a", "b", (F.col("ra") == F.col("rb")).alias("possible_cycle"))
