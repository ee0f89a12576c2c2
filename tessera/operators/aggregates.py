"""Aggregates: weakest level wins, tallies, readiness, coupling, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import clamp01, level_rank, rank_level, round_half_up


def weakest(rows: DataFrame, key: str, level: str = "level") -> DataFrame:
    """A1: key and the weakest known level (D < C < B < A)."""
    return rows.groupBy(key).agg(rank_level(F.min(level_rank(F.col(level)))).alias("level"))


def tallies(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts by each key alone, as one grouping-sets pass.  kind: the key's name."""
    sets = [[k] for k in keys]
    grouped = rows.groupingSets(sets, *keys).agg(F.count("*").alias("n"))
    kind = F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in keys])
    return grouped.select(kind.alias("kind"), F.coalesce(*keys).alias("value"), "n")


def readiness(objects: DataFrame, findings: DataFrame, blocker: F.Column) -> DataFrame:
    """A3: objects, blocked objects, blocker findings, share of objects without any (100 if there is no object)."""
    bad = findings.where(blocker).groupBy("object").agg(F.count("*").alias("n"))
    row = objects.select("object").distinct().join(bad, "object", "left").agg(F.count("*").alias("objects"), F.count("n").alias("blocked"), F.coalesce(F.sum("n"), F.lit(0)).alias("blockers"))
    pct = F.when(F.col("objects") == 0, 100.0).otherwise(round_half_up(100.0 * (F.col("objects") - F.col("blocked")) / F.nullif("objects", F.lit(0))))
    return row.withColumn("pct", pct)


def level_counts(edges: DataFrame) -> DataFrame:
    """A4: classified edges by level, each edge once; unknown where the registry has no row."""
    return edges.groupBy(F.coalesce("level", F.lit("unknown")).alias("level")).agg(F.count("*").alias("n"))


def grade_buckets(findings: DataFrame, grade: F.Column) -> DataFrame:
    """A5: findings and distinct rules by grade."""
    return findings.groupBy(grade.alias("grade")).agg(F.count("*").alias("n"), F.countDistinct("rule_id").alias("rules"))


def coupling(edges: DataFrame) -> DataFrame:
    """Id, fan_in, fan_out (distinct neighbours); nodes of edges only."""
    ends = edges.select(F.col("source").alias("id"), F.col("target").alias("o"), F.lit(None).cast("string").alias("i")).unionByName(edges.select(F.col("target").alias("id"), F.lit(None).cast("string").alias("o"), F.col("source").alias("i"))).distinct()
    return ends.groupBy("id").agg(F.count("i").alias("fan_in"), F.count("o").alias("fan_out"))


def stability(edges: DataFrame, abstractness: DataFrame) -> DataFrame:
    """100 (1 - mean |A + I - 1|) over objects that others depend on."""
    c = coupling(edges).where("fan_in > 0").join(abstractness, "id", "left")
    i = F.col("fan_out") / (F.col("fan_in") + F.col("fan_out"))
    return c.agg(F.coalesce(round_half_up(100 * (1 - F.avg(F.abs(F.coalesce("a", F.lit(0.0)) + i - 1)))), F.lit(100.0)).alias("stability"))


def share_without(objects: DataFrame, findings: DataFrame, family: str) -> DataFrame:
    """Share of objects without findings of a family."""
    bad = findings.where(F.col("family") == family).select("object").distinct().withColumn("bad", F.lit(1))
    return objects.select("object").distinct().join(bad, "object", "left").agg(F.coalesce(round_half_up(100.0 * (1 - F.count("bad") / F.nullif(F.count("*"), F.lit(0)))), F.lit(100.0)).alias("performance"))


def debt(findings: DataFrame, edges: DataFrame) -> DataFrame:
    """Object, weighted findings, coupling share and composite (rounded to 3)."""
    w = findings.groupBy("object").agg(F.sum(F.when(F.col("severity") == "p1", 10).when(F.col("severity") == "p2", 5).when(F.col("severity") == "p3", 1).otherwise(0)).alias("weighted"), F.count("*").alias("n"))
    c = coupling(edges).select(F.col("id").alias("object"), (F.col("fan_in") + F.col("fan_out")).alias("links"))
    row = w.join(c, "object", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    score = 0.6 * clamp01(F.col("weighted") / (10.0 * F.col("n"))) + 0.4 * clamp01(F.col("links") / 20.0)
    return row.withColumn("debt", round_half_up(score, 3))


def size_classes(sizes: DataFrame) -> DataFrame:
    """Rows by size class."""
    c = F.when(F.col("loc") < 10_000, "small").when(F.col("loc") < 100_000, "medium").when(F.col("loc") < 1_000_000, "large").when(F.col("loc") < 10_000_000, "very large").otherwise("huge")
    return sizes.groupBy(c.alias("size_class")).agg(F.count("*").alias("n"), F.sum("loc").cast("long").alias("loc"), F.max("loc").cast("long").alias("largest"))


def halstead(tokens: DataFrame) -> DataFrame:
    """doc_id, length and vocabulary of its tokens, volume N log2 n."""
    one = tokens.groupBy("doc_id", "token").agg(F.count("*").alias("k"))
    return one.groupBy("doc_id").agg(F.sum("k").alias("length"), F.count("*").alias("vocabulary")).withColumn("volume", round_half_up(F.col("length") * F.log2(F.col("vocabulary").cast("double")), 3))


def driving_rule(findings: DataFrame) -> DataFrame:
    """The rule of an object's most severe finding, by rule id at ties."""
    rank = F.when(F.col("severity") == "p1", 1).when(F.col("severity") == "p2", 2).when(F.col("severity") == "p3", 3).otherwise(99)
    return findings.groupBy("object").agg(F.min(F.struct(rank.alias("r"), "rule_id"))["rule_id"].alias("rule_id"))


def signals(findings: DataFrame) -> DataFrame:
    """Sorted distinct families and rules of an object, as text."""
    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return findings.groupBy("object").agg(join("family").alias("families"), join("rule_id").alias("rules"))


def resolved(registry: DataFrame, key: str) -> DataFrame:
    """Authoritative states if there are any, else the others; the weakest level, then the first state."""
    any_ = F.max(F.col("authoritative").cast("int"))
    pick = lambda flag: F.min(F.when(F.col("authoritative") == flag, F.struct(level_rank(F.col("level")).alias("r"), "state")))
    return registry.groupBy(key).agg(F.when(any_ == 1, pick(True)).otherwise(pick(False)).alias("x")).select(key, rank_level(F.col("x.r")).alias("level"), "x.state")


def gate(expected: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Blocked if any expected verdict is missing or failed; absent evidence blocks."""
    v = expected.select(key).join(verdicts.select(key, "failed"), key, "left")
    bad = F.col("failed").isNull() | (F.col("failed") > 0)
    return v.agg(F.count("*").alias("expected"), F.sum(F.col("failed").isNull().cast("long")).alias("missing"), F.sum(bad.cast("long")).alias("blocking"), F.max(bad).alias("blocked"))


def namespace_summary(nodes: DataFrame) -> DataFrame:
    """Customer, sap, registered: nodes by namespace (members of objects aren't counted)."""
    n = F.col("namespace")
    return nodes.agg(F.count_if(n.isin("Z", "Y")).alias("customer"), F.count_if(n == "sap").alias("sap"), F.count_if(n == "registered").alias("registered"))


def object_health(findings: DataFrame) -> DataFrame:
    """Object, findings, performance findings, the first rule of its worst severity."""
    rank = F.when(F.col("severity") == "p1", 1).when(F.col("severity") == "p2", 2).when(F.col("severity") == "p3", 3).otherwise(4)
    return findings.groupBy("object").agg(F.count("*").alias("n"), F.count_if(F.col("family") == "performance").alias("perf"), F.min(F.struct(rank.alias("r"), "rule_id"))["rule_id"].alias("worst"))


def abstractness(methods: DataFrame) -> DataFrame:
    """Object, abstractness: 1 of interfaces, else the share of abstract methods(object, interface, abstract)."""
    each = methods.groupBy("object").agg(F.max("interface").alias("i"), F.avg(F.col("abstract").cast("int")).alias("a"))
    return each.select("object", F.when(F.col("i"), 1.0).otherwise(F.col("a")).alias("abstractness"))


def branch_counts(statements: DataFrame, keys: list[str], kinds: tuple[str, ...]) -> DataFrame:
    """Keys, cyclomatic: one more than the branches of a routine."""
    return statements.groupBy(*keys).agg((1 + F.count_if(F.col("kind").isin(*kinds))).alias("cyclomatic"))


def size_metrics(lines: DataFrame, key: str) -> DataFrame:
    """Loc, longest, chars, blank of the lines(raw) of each file."""
    n = F.length("raw")
    return lines.groupBy(key).agg(F.count("*").alias("loc"), F.max(n).cast("long").alias("longest"), F.sum(n).cast("long").alias("chars"), F.count_if(F.trim("raw") == "").alias("blank"))


def plan_summary(nodes: DataFrame, *keys: str) -> DataFrame:
    """Counts by all keys, by fewer of them and over all (nulls stand for all)."""
    return nodes.rollup(*keys).agg(F.count("*").alias("n"))


def clean_core_debt(findings: DataFrame) -> DataFrame:
    """Object, debt: ten for each finding of the first priority, five of the second, one of the third."""
    n = lambda x: F.count_if(F.col("severity") == x)
    return findings.groupBy("object").agg((10 * n("p1") + 5 * n("p2") + n("p3")).alias("debt"))


def namespaces_of(names: DataFrame, name: str, pattern: str) -> DataFrame:
    """The distinct namespaces that a pattern's first group finds in names."""
    return names.select(F.regexp_extract(name, pattern, 1).alias("space")).distinct()


def blast_sum(edges: DataFrame) -> DataFrame:
    """Source, blast: how many objects depend on its distinct direct targets, in all."""
    n = edges.groupBy("target").agg(F.countDistinct("source").alias("n"))
    return edges.select("source", "target").distinct().join(n, "target").groupBy("source").agg(F.sum("n").alias("blast"))


def super_node_keys(members: DataFrame, node: str) -> DataFrame:
    """Weakest rank, highest complexity and blast of the members of a component."""
    return members.groupBy(node).agg(F.min("rank").alias("rank"), F.max("complexity").alias("complexity"), F.max("blast").alias("blast"))


def kind_tallies(statements: DataFrame, key: str, **kinds: str) -> DataFrame:
    """Statements of each named kind and the number of different kinds, of each bundle."""
    return statements.groupBy(key).agg(*[F.count_if(F.col("kind") == k).alias(name) for name, k in kinds.items()], F.countDistinct("kind").alias("kinds"))


def lint_summary(findings: DataFrame, error: str = "error") -> DataFrame:
    """Errors, warnings."""
    return findings.agg(F.count_if(F.col("severity") == error).alias("errors"), F.count_if(F.col("severity") != error).alias("warnings"))


def status_counts(nodes: DataFrame) -> DataFrame:
    """Status, n."""
    return nodes.groupBy("status").agg(F.count("*").alias("n"))


def range_digest(rows: DataFrame, number: str, digest: str, joint: str = "||", fan: int = 1024, levels: int = 4, by: tuple[str, ...] = ()) -> DataFrame:
    """One digest of all rows' digests (of each group, if by) in order of their numbers (0 and up), by a tree.

    A node of the tree joins the digests of `fan` neighbouring numbers, so no row ever holds more of them; four levels
    are enough for 10^12 numbers.
    """
    now = rows.select(*by, F.col(number).cast("long").alias("_n"), F.col(digest).alias("_d"))
    for _ in range(levels):
        each = F.array_sort(F.collect_list(F.struct("_n", "_d")))
        now = now.groupBy(*by, F.floor(F.col("_n") / fan).cast("long").alias("_n")).agg(F.sha2(F.array_join(each["_d"], joint), 256).alias("_d"))
    return now.select(*by, F.col("_d").alias(digest))
