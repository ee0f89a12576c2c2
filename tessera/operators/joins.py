"""Lookups, theta joins, semi and anti joins over the canonical tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.cuts import dealt


def owner(ids: Column, objects: Column) -> Column:
    """A node's object, else its id up to the first dot."""
    return F.coalesce(objects, F.substring_index(ids, ".", 1))


def with_owners(edges: DataFrame, nodes: DataFrame, total: int | None = None) -> DataFrame:
    """Edges with the owners of both ends; with a bound of their number (total), tasks get a bounded number of them."""
    deal = lambda rows, key: rows if total is None else dealt(rows, key, total=total)
    s = nodes.select(F.col("id").alias("source"), F.col("object").alias("so"))
    t = nodes.select(F.col("id").alias("target"), F.col("object").alias("to"))
    return deal(deal(edges, "source").join(s, "source", "left"), "target").join(t, "target", "left").select("source", "target", "kind", "access", owner(F.col("source"), F.col("so")).alias("source_owner"), owner(F.col("target"), F.col("to")).alias("target_owner"))


def reach_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges between different owners that aren't containment."""
    return with_owners(edges, nodes).where("kind not in ('includes', 'contains') and source_owner <> target_owner")


def classified(edges: DataFrame, registry: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Edges of classifiable kinds with the registry level of their target; unknown targets have none."""
    return edges.where(F.col("kind").isin(*kinds)).join(registry.select(F.col("name").alias("target"), "state", "level"), "target", "left")


def matched_rules(lines: DataFrame, rules: Sequence[tuple[str, str]], scan_comments: bool = False) -> DataFrame:
    """A row for each line and data-driven rule that matches it.  Rules are few: one predicate each, no join."""
    rows = lines if scan_comments else lines.where(~F.col("raw").rlike(r"^\s*[*\"]"))
    hits = F.array(*[F.when(F.col("raw").rlike(p), F.lit(name)) for name, p in rules])
    return rows.select("doc_id", "line", F.explode(F.array_compact(hits)).alias("rule_id"))


def require_or_forbid(pages: DataFrame, text: str, when: str, require: str, forbid: str) -> DataFrame:
    """page_id, rule: required pattern absent, forbidden pattern present; both behind a gate."""
    t = F.col(text)
    found = F.array_compact(F.array(F.when(~t.rlike(require), F.lit("require")), F.when(t.rlike(forbid), F.lit("forbid"))))
    return pages.where(t.rlike(when)).select("page_id", F.explode(found).alias("rule"))


def unused(inventory: DataFrame, usage: DataFrame, key: str) -> DataFrame:
    """Inventory rows without any usage."""
    return inventory.join(usage.select(key).distinct(), key, "left_anti")


def only_kinds(findings: DataFrame, nodes: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Findings of objects of given kinds."""
    return findings.join(nodes.where(F.col("kind").isin(*kinds)).select("object").distinct(), "object", "left_semi")


def conformance(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Key, change: added, removed, changed or same."""
    b = before.select(key, F.col(value).alias("vb"), F.lit(True).alias("inb"))
    a = after.select(key, F.col(value).alias("va"), F.lit(True).alias("ina"))
    change = F.when(F.col("inb").isNull(), "added").when(F.col("ina").isNull(), "removed").when(~F.col("vb").eqNullSafe(F.col("va")), "changed").otherwise("same")
    return b.join(a, key, "full").select(key, change.alias("change"))


def with_ends(edges: DataFrame, nodes: DataFrame, *cols: str) -> DataFrame:
    """Edges with columns of the nodes at both ends (source_..., target_...); null where the graph has no such node."""
    out = edges
    for end in ("source", "target"):
        out = out.join(nodes.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in cols]), end, "left")
    return out


def element_domains(elements: DataFrame, domains: DataFrame) -> DataFrame:
    """Data elements(name, domain) with the columns of their domain; domains are told by upper-case names."""
    return elements.withColumn("domain", F.upper("domain")).join(domains.withColumn("domain", F.upper("domain")), "domain")


def key_coverage(statements: DataFrame, tables: DataFrame, key: str, covered: Column) -> DataFrame:
    """Statements with a verdict: unknown-table (not in the bundle), covered (by the table's key) or partial."""
    known = tables.withColumn("_in_bundle", F.lit(True))
    verdict = F.when(F.col("_in_bundle").isNull(), "unknown-table").when(covered, "covered").otherwise("partial")
    return statements.join(known, key, "left").withColumn("verdict", verdict).drop("_in_bundle")


def strict_classes(classes: DataFrame, behaviors: DataFrame) -> DataFrame:
    """Classes that implement behaviours(class, strict), with the highest of their strict levels."""
    return classes.join(behaviors.groupBy("class").agg(F.max("strict").alias("strict")), "class")


def object_facts(objects: DataFrame, facts: dict[str, DataFrame]) -> DataFrame:
    """Objects with one number of each fact table(object, value); none counts as zero."""
    for name, df in facts.items():
        objects = objects.join(df.select("object", F.col("value").alias(name)), "object", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return objects


def service_chain(bindings: DataFrame, definitions: DataFrame, views: DataFrame) -> DataFrame:
    """bindings(definition) to definitions(definition, entity) to views(entity); a chain with a missing link is left out."""
    return bindings.join(definitions, "definition").join(views, "entity")


def extended_views(extensions: DataFrame, views: DataFrame, named: Column) -> DataFrame:
    """Extensions with the view that their text names."""
    return extensions.withColumn("view", named).join(views, "view")


def unbound(declared: DataFrame, bound: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Declared operations without a handler."""
    return declared.select(*keys).distinct().join(bound.select(*keys).distinct(), list(keys), "left_anti")


def unmentioned(names: DataFrame, texts: DataFrame) -> DataFrame:
    """names(name) that no text(text) holds, in any case.  Names go to all workers: a class's public methods are few."""
    each = F.broadcast(names.select("name").distinct())
    found = texts.select(F.lower("text").alias("t")).join(each, F.contains(F.col("t"), F.lower("name"))).select("name").distinct()
    return names.join(found, "name", "left_anti")


def without_sibling(rows: DataFrame, single: Column, batch: Column, keys: Sequence[str]) -> DataFrame:
    """Rows of one kind that have no row of the other kind under the same keys."""
    return rows.where(single).join(rows.where(batch).select(*keys).distinct(), list(keys), "left_anti")


def unreciprocated(links: DataFrame) -> DataFrame:
    """Links a, b without a link b, a; a link with a null end has none.

    Both directions of a pair are one group, so nothing is joined or sorted.
    """
    e, kinds = links.select("a", "b"), dict(links.dtypes)
    ends = e.where("a is not null and b is not null").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), (F.col("a") <= F.col("b")).alias("up"), (F.col("a") >= F.col("b")).alias("down"))
    one = dealt(ends, "lo", "hi", total=links.count()).groupBy("lo", "hi").agg(F.bool_or("up").alias("up"), F.bool_or("down").alias("down")).where("up <> down")
    out = one.select(F.when(F.col("up"), F.col("lo")).otherwise(F.col("hi")).cast(kinds["a"]).alias("a"), F.when(F.col("up"), F.col("hi")).otherwise(F.col("lo")).cast(kinds["b"]).alias("b"))
    return out.unionByName(e.where("a is null or b is null").distinct())


def warnings_on_changes(changed: DataFrame, warnings: DataFrame) -> DataFrame:
    """N: warnings on lines(file, line) that changed."""
    return warnings.join(changed.select("file", "line").distinct(), ["file", "line"], "left_semi").agg(F.count("*").alias("n"))


def with_overrides(nodes: DataFrame, overrides: DataFrame, key: str, value: str, strict: bool = True) -> DataFrame:
    """Nodes with the values of overrides in place of their own; an override of an unknown node is an error."""
    if strict and (unknown := overrides.join(nodes.select(key), key, "left_anti").select(key).head()):
        raise ValueError(f"an override names the unknown node {unknown[0]}")
    o = overrides.select(key, F.col(value).alias("_override"))
    return nodes.join(o, key, "left").withColumn(value, F.coalesce("_override", value)).drop("_override")
