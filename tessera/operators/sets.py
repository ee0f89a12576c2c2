"""Unions, differences and comparisons of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_findings(outputs: dict[str, DataFrame], family: str) -> DataFrame:
    """What rules give, one below the other; a row without a rule id has its rule's name, one without a family the default."""
    out = None
    for name, df in outputs.items():
        df = df.withColumn("rule_id", F.coalesce("rule_id", F.lit(name)) if "rule_id" in df.columns else F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.withColumn("family", F.coalesce("family", F.lit(family)) if "family" in out.columns else F.lit(family))


def symmetric_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of one side only, each as often as it is too many, with their side."""
    return before.exceptAll(after).withColumn("side", F.lit("before")).union(after.exceptAll(before).withColumn("side", F.lit("after")))


def equal_sets(rows: DataFrame, key: str, left: Column, right: Column) -> DataFrame:
    """U4: key, equal: whether two columns hold the same set of values in a group (nulls don't count)."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(left)).alias("a"), F.array_sort(F.collect_set(right)).alias("b")).select(key, (F.col("a") == F.col("b")).alias("equal"))


def swapped_or_succeeded(swapped: DataFrame, succeeded: DataFrame) -> DataFrame:
    """Keys that are in either."""
    return swapped.union(succeeded).distinct()


def disposition_delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Key, before, after of the nodes whose disposition is another one."""
    b, a = before.select(key, F.col("disposition").alias("before")), after.select(key, F.col("disposition").alias("after"))
    return b.join(a, key).where("before <> after")


def merged_groups(groups: DataFrame) -> DataFrame:
    """Label, members: groups(label, member) of one label are one group."""
    return groups.groupBy("label").agg(F.array_sort(F.collect_set("member")).alias("members"))


def report_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Metric, before, after, delta of two reports(metric, value)."""
    b, a = before.select("metric", F.col("value").alias("before")), after.select("metric", F.col("value").alias("after"))
    return b.join(a, "metric", "full").withColumn("delta", F.col("after") - F.col("before"))


def quality_axis(share: Column, n: Column, least: int = 3, coverage: Column | None = None) -> Column:
    """An axis of the comparison is shown only with enough objects behind it, else null (not available)."""
    enough = n >= least if coverage is None else (n >= least) & (coverage >= 0.2)
    return F.when(enough, share)


def reassembly_broken(before: DataFrame, after: DataFrame, touched: DataFrame) -> DataFrame:
    """files(file, source) that changed though no step touched them; a file that is gone is not broken."""
    digest = lambda df, name: df.select("file", F.sha2("source", 256).alias(name))
    return digest(before, "b").join(digest(after, "a"), "file").where("a <> b").join(touched.select("file"), "file", "left_anti").select("file")
