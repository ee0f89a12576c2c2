"""Plans, diffs and verdicts over canonical tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def edge_diff(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per group the values that are gone and those that are new, as sorted text."""
    cols = [*keys, value]
    b, a = before.select(*cols).distinct().withColumn("inb", F.lit(1)), after.select(*cols).distinct().withColumn("ina", F.lit(1))
    both = b.join(a, cols, "full").where("inb is null or ina is null")
    pick = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(F.col(c).isNull(), F.col(value)))), ",")
    return both.groupBy(*keys).agg(pick("ina").alias("removed"), pick("inb").alias("added"))


def ranked(rows: DataFrame, key: str, order: list[Column], limit: int) -> DataFrame:
    """Within a key the first rows are surfaced, the rest are queued."""
    r = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return rows.withColumn("state", F.when(r <= limit, "surfaced").otherwise("queued"))


def parity(points: Column, veto: Column) -> Column:
    """Bands of tenths of a point; a veto fails."""
    return F.when(veto | (points < 3), "fail").when(points <= 7, "needs_review").otherwise("pass")


def ratchet(rows: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """Findings against the ceiling of a baseline; missing evidence or a missing baseline blocks."""
    j = rows.join(baseline, key, "left")
    why = F.when(F.col("n").isNull(), "no-evidence").when(F.col("ceiling").isNull(), "no-baseline").when(F.col("n") > F.col("ceiling"), "above-ceiling").otherwise("pass")
    return j.select(key, why.alias("gate"))


def dropped_dependencies(edges: DataFrame, retired: DataFrame) -> DataFrame:
    """Live nodes that depend on a retired one."""
    r = retired.select("id")
    return edges.join(r.withColumnRenamed("id", "target"), "target", "left_semi").join(r.withColumnRenamed("id", "source"), "source", "left_anti").select("source", "target").distinct()


def indegrees(edges: DataFrame, done: DataFrame) -> DataFrame:
    """Id, open predecessors after completed nodes released theirs; ready at none."""
    links = edges.select("source", "target").distinct()
    left = links.join(done.select(F.col("id").alias("source")), "source", "left_anti").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("indegree"))
    ids = links.select(F.col("source").alias("id")).union(links.select("target")).distinct().join(done.select("id"), "id", "left_anti")
    return ids.join(left, "id", "left").select("id", F.coalesce("indegree", F.lit(0)).alias("indegree")).withColumn("ready", F.col("indegree") == 0)


def disposition(grade: Column, used: Column, size: Column) -> Column:
    """An ordered decision list; order matters."""
    return F.when(~used & (grade == "D"), "retire").when(~used, "park").when(grade == "A", "keep").when((grade == "B") & (size < 20), "wrap").when(grade == "B", "refactor").when(size > 40, "rearchitect").otherwise("rebuild")


#: Statuses of a node, those in flight, and the steps that are always legal.
IN_FLIGHT = ("PENDING", "GROUNDED", "GENERATED", "SYNTAX_OK", "PUSHED", "ACTIVATED", "GATED", "PROVISIONAL_GATED")
STEPS = {
    "PENDING": ("GROUNDED",), "GROUNDED": ("GENERATED", "RETIRED", "REBUILT_HANDOFF"), "GENERATED": ("SYNTAX_OK",), "SYNTAX_OK": ("PUSHED", "PROVISIONAL_GATED"), "PUSHED": ("ACTIVATED",), "ACTIVATED": ("GATED",),
    "GATED": ("GREEN", "REBUILT_HANDOFF"), "PROVISIONAL_GATED": ("REBUILT_HANDOFF",), "PARK": ("PENDING",), "NEEDS_MANUAL_SEAM": ("PENDING",),
}
RETRIED_FROM, CEILING = ("SYNTAX_OK", "GATED", "PROVISIONAL_GATED"), 3


def may_step(before: Column, after: Column, cycle: Column, reason: Column) -> Column:
    """Whether a step of the state machine is legal: forward steps, escalations out of flight, retries below the ceiling, parking for want of a successor."""
    forward = F.concat_ws(">", before, after).isin(*[f"{a}>{b}" for a, to in STEPS.items() for b in to])
    escalated = after.isin("BLOCK", "NEEDS_MANUAL_SEAM") & before.isin(*IN_FLIGHT)
    retried = (after == "GENERATED") & before.isin(*RETRIED_FROM) & (F.coalesce(cycle, F.lit(0)) < CEILING)
    parked = (before == "BLOCK") & (after == "PARK") & (F.coalesce(reason, F.lit("")) == "NO_RELEASED_SUCCESSOR")
    return F.coalesce(forward | escalated | retried | parked, F.lit(False))


def illegal_steps(events: DataFrame, key: str, order: str, legal: Callable[[Column, Column], Column], status: str = "status") -> DataFrame:
    """Key, illegal: steps from one status to the next that aren't legal."""
    before = F.lag(status).over(W.partitionBy(key).orderBy(order))
    return events.withColumn("_before", before).groupBy(key).agg(F.count_if(F.col("_before").isNotNull() & ~legal(F.col("_before"), F.col(status))).alias("illegal"))


def reasons(checks: dict[str, Column]) -> Column:
    """The names of the checks that hold, in their order; a check that can't be told counts as one that holds not."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))


def node_verdict(why: Column, parked: Column) -> Column:
    """Green without reasons; parked only where no defect is known; else blocked."""
    return F.when(F.size(why) == 0, "GREEN").when(F.coalesce(parked, F.lit(False)), "PARK").otherwise("BLOCK")


def parity_points(classes: dict[str, Column]) -> Column:
    """Ten less the deductions of the classes of difference that hold: tenths of a score, so no rounding decides a band."""
    out = F.lit(10)
    for name, c in classes.items():
        out = out - DEDUCTIONS[name] * F.coalesce(c, F.lit(False)).cast("int")
    return out


#: Deductions of classes of differences, in tenths.
DEDUCTIONS = {"lost_path": 3, "lost_effect": 4, "idiom": 2, "style": 1.5}


def rule_gate(findings: DataFrame, rules: tuple[str, ...], severity: str = "p1") -> DataFrame:
    """Object, blocked: whether it has a finding of the rules at the severity that blocks."""
    return findings.groupBy("object").agg(F.max((F.col("severity") == severity) & F.col("rule_id").isin(*rules)).alias("blocked"))


def needs_reasoning(confidence: Column, blast: Column, candidates: Column, grouping: Column) -> Column:
    """Whether rules alone can't decide a node: low confidence, wide blast, several candidates or a shape that groups."""
    return (confidence < 0.9) | (blast > 10) | (F.coalesce(candidates, F.lit(0)) > 1) | F.coalesce(grouping, F.lit(False))


#: Severities of findings.
SEVERITIES = ("p1", "p2", "p3", "info")


def finding_errors(severities: tuple[str, ...] = SEVERITIES, most_lines: int | None = None) -> Column:
    """V1: what is wrong with a finding: missing fields, an unknown severity, a line out of range."""
    known = {"no-rule": F.col("rule_id").isNull(), "no-object": F.col("object").isNull(), "bad-severity": F.col("severity").isNull() | ~F.col("severity").isin(*severities), "bad-line": F.col("line") < 0}
    return reasons(known | ({"late-line": F.col("line") > most_lines} if most_lines else {}))


def violations(rows: DataFrame, errors: Column) -> DataFrame:
    """V1: violation, n."""
    return rows.select(F.explode(errors).alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))
