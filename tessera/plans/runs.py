"""From sources to findings, and from findings to a plan: the packs and operators joined end to end.

A pack that fails costs its own findings only: it becomes an `info` row of the report.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import severity_grade
from tessera.operators import aggregates as A
from tessera.operators import graph as G
from tessera.operators import predicates as K
from tessera.operators import sets as S
from tessera.plans import documents, identity, linter, packs, rules, types, verdicts
from tessera.plans.features import assembled, call_edges
from tessera.sources import artifacts as P
from tessera.sources import bundle as B
from tessera.sources import records as R

FINDING = "rule_id string, severity string, family string, object string, file string, line long"
CLASSIFIABLE = ("call-function", "uses-table", "consumes-cds", "inherits", "calls")


@dataclass
class Report:
    """The tables of one analysis; all of them are lazy but the findings."""

    files: DataFrame
    statements: DataFrame
    nodes: DataFrame
    edges: DataFrame
    findings: DataFrame
    failed: list[tuple[str, str]]
    notes: DataFrame

    def summary(self) -> DataFrame:
        """metric, value: objects, findings by severity, readiness, debt."""
        grade = severity_grade(F.col("severity"))
        objects = self.files.select("object").distinct()
        ready = A.readiness(objects, self.findings, K.s4_blocker(F.col("family"), grade)).select(F.expr("stack(4, 'objects', double(objects), 'blocked', double(blocked), 'blockers', double(blockers), 'readiness', pct) as (metric, value)"))
        by = self.findings.groupBy(F.concat(F.lit("findings_"), F.col("severity")).alias("metric")).agg(F.count("*").cast("double").alias("value"))
        debt = A.clean_core_debt(self.findings).agg(F.coalesce(F.sum("debt"), F.lit(0)).cast("double").alias("value")).select(F.lit("debt").alias("metric"), "value")
        return ready.unionByName(by).unionByName(debt)

    def write(self, path: str) -> None:
        """JSON lines of every table below a folder; a finding that isn't valid fails the job before any file of findings is committed."""
        documents.write_valid(self.findings, verdicts.finding_errors((*verdicts.SEVERITIES, "error", "warning")), f"{path}/findings")
        for name in ("nodes", "edges", "notes"):
            getattr(self, name).write.mode("overwrite").json(f"{path}/{name}")
        self.summary().write.mode("overwrite").json(f"{path}/summary")


def _shaped(df: DataFrame, family: str) -> DataFrame:
    fields = [f.split() for f in FINDING.split(", ")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(family) if n == "family" else F.lit(None)).cast(t).alias(n) for n, t in fields])


def joined(spark: SparkSession, named: dict) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The findings of all packs, and the packs that failed; each of those is an info row too."""
    out, failed = spark.createDataFrame([], FINDING), []
    for name, pack in named.items():
        good, bad = packs.isolated({name: lambda pack=pack, name=name: _shaped(pack(), name)})
        failed += bad
        for df in good:
            out = out.unionByName(df)
    if failed:
        out = out.unionByName(spark.createDataFrame([(name, "info", "engine", "(engine)", None, None) for name, _ in failed], FINDING))
    return out, failed


def analyse(spark: SparkSession, path: str, registry: DataFrame | None = None, cap: int = B.BYTE_CAP, more: dict | None = None) -> Report:
    """A folder of sources to a report; `more`: further packs by name, functions without arguments."""
    files, notes = B.admitted(R.canonical(B.scan(spark, path)), cap)
    files = G.cut(files)
    named = files.withColumn("file", F.col("filename"))
    statements = G.cut(B.statements(files))
    suffix = lambda s: named.where(F.lower("filename").endswith(s))
    views = P.parsed(suffix(".asddls").select("object", "source"), "view", P.view, P.VIEW)
    behaviors = P.parsed(suffix(".asbdef").select("object", "file", "source"), "behavior", P.behavior, P.BEHAVIOR)
    none = lambda df: df.withColumn("access", F.lit(None).cast("string"))
    objects = files.select("object", F.coalesce(B.node_kind(F.col("object_type")), F.lit("unknown")).alias("kind")).distinct()
    edges = rules.edges(statements).unionByName(none(P.view_edges(views))).unionByName(none(P.behavior_edges(behaviors)))
    edges = G.cut(edges.unionByName(none(call_edges(statements, objects).select("source", "target", "kind"))).unionByName(none(types.instance_edges(statements))).distinct())
    nodes = G.build_nodes(objects.select(F.col("object").alias("id"), "kind"), edges).withColumn("object", F.col("id"))
    b = behaviors.select("object", "file", "source", F.col("behavior.class").alias("class"))
    keys = spark.createDataFrame([], "object string, keys array<string>, leads array<string>")
    all_ = {
        "lines": lambda: rules.seed_findings(named), "statements": lambda: rules.findings(statements, tuple(r for r in rules.RULES if r.id.startswith("talos"))), "invariant": lambda: rules.unchecked_authority(statements), "context": lambda: packs.statement_context(statements, keys), "files": lambda: packs.statement_files(statements), "graph": lambda: packs.graph_pack(edges, nodes), "flow": lambda: packs.flow(statements),
        "metadata": lambda: packs.metadata(named), "views": lambda: packs.view_structure(suffix(".asddls")), "behaviors": lambda: packs.behavior_context(b, statements, keys), "tests": lambda: packs.missing_tests(named), "test-quality": lambda: packs.test_quality(statements), "interfaces": lambda: packs.interfaces(statements), "services": lambda: packs.services(named),
    }
    if registry is not None:
        all_["released-api"] = lambda: packs.released_api(edges, registry, CLASSIFIABLE)
    found, failed = joined(spark, all_ | (more or {}))
    found = identity.identified(found, named.select("file", "source"))
    return Report(files, statements, nodes, edges, G.cut(found), failed, notes)


def linted(spark: SparkSession, path: str, registry: DataFrame | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The second linter over a folder of sources."""
    files = G.cut(R.canonical(B.scan(spark, path)).withColumn("file", F.col("filename")))
    return joined(spark, linter.lint(files, G.cut(B.statements(files)), registry))


def compared(before: Report, after: Report) -> DataFrame:
    """metric, before, after, delta."""
    return S.report_delta(before.summary(), after.summary())


def planned(report: Report) -> DataFrame:
    """id, members, rank, blast, sealed, dependencies, wave: the estate's own objects in an order in which each comes after what it needs."""
    own = report.files.select(F.col("object").alias("id")).distinct()
    ids = packs.numbered(report.nodes.select("id").union(own), "id")
    number = lambda col, name: ids.select(F.col("id").alias(col), F.col("number").alias(name))
    links = G.cut(report.edges.where("source <> target").select("source", "target").distinct().join(number("source", "a"), "source").join(number("target", "b"), "target").select("a", "b"))
    mine = own.join(ids, "id").select(F.col("number").alias("id"), F.col("id").alias("object"))
    worst = report.findings.groupBy("object").agg(F.min(F.when(F.col("severity") == "p1", 0).when(F.col("severity") == "p2", 1).when(F.col("severity") == "p3", 2).otherwise(3)).alias("rank"))
    blast = links.groupBy(F.col("b").alias("id")).agg(F.countDistinct("a").alias("blast"))
    meta = mine.join(worst, "object", "left").join(blast, "id", "left").select("id", F.coalesce("rank", F.lit(3)).alias("rank"), F.coalesce("blast", F.lit(0)).alias("blast"), F.lit(False).alias("sealed"))
    loops = links.unionByName(mine.select(F.col("id").alias("a"), F.col("id").alias("b")))  # objects without links are nodes too
    nodes = G.cut(assembled(loops, mine.select("id"), meta))
    order = nodes.select(F.col("id").alias("target"), F.explode("dependencies").alias("source")).where("source <> target")
    waves = G.levels(order.select("source", "target")).withColumnRenamed("level", "wave")
    names = F.broadcast(ids.select(F.col("number").alias("m"), F.col("id").alias("name"))) if ids.count() <= 100_000 else ids.select(F.col("number").alias("m"), F.col("id").alias("name"))
    named = nodes.select("id", F.explode("members").alias("m")).join(names, "m").groupBy("id").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return nodes.join(named, "id").join(waves, "id", "left").select("id", F.col("names").alias("members"), "rank", "blast", "sealed", "dependencies", F.coalesce("wave", F.lit(0)).alias("wave"))


def blocked(report: Report) -> tuple[bool, int]:
    """Whether a finding of the first priority, or a pack that failed, blocks; and how many findings do."""
    n = report.findings.where("severity = 'p1'").count()
    return bool(n or report.failed), n
