"""Features of bundles out of statements and parsed artifacts, their diff, native SQL and call edges, contracts and plan assembly."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.facts import condensed, in_plan_ancestors

#: Statement kinds of the counted structures, those that leave a return code alone, and the suffixes of live object types.
EXCEPTIONS, BRANCHES = ("Try", "Catch", "Raise"), ("If", "ElseIf", "Case", "When", "While", "Do", "Loop", "SelectLoop", "Catch")
OPENS, CLOSES = ("If", "Case", "Loop", "While", "Do", "Try", "SelectLoop"), ("EndIf", "EndCase", "EndLoop", "EndWhile", "EndDo", "EndTry", "EndSelect")
SAFE = ("Data", "Move", "If", "ElseIf", "Check", "Types", "FieldSymbol")
LIVE_SUFFIXES = {"CLAS": "clas.abap", "INTF": "intf.abap", "PROG": "prog.abap", "FUGR": "fugr.abap", "DDLS": "ddls.asddls", "BDEF": "bdef.asbdef", "DCLS": "dcls.asdcls", "TABL": "tabl.asdbtab"}


def checked_after(statements: DataFrame, ahead: int = 3) -> DataFrame:
    """The authority checks with `checked`: the return code is read within the next few statements, before one that may change it."""
    w = W.partitionBy("filename").orderBy("seq")
    n = statements.withColumn("n", F.row_number().over(w))
    near = w.rowsBetween(1, ahead)
    hit, stop = F.upper("text").contains("SY-SUBRC"), ~F.col("kind").isin(*SAFE)
    first = lambda c: F.min(F.when(c, F.col("n"))).over(near)
    x = n.withColumns({"h": first(hit), "s": first(stop & ~hit)}).where("kind = 'AuthorityCheck'")
    return x.withColumn("checked", F.col("h").isNotNull() & (F.col("s").isNull() | (F.col("h") < F.col("s")))).drop("n", "h", "s")


def imperative(statements: DataFrame) -> DataFrame:
    """Object, commit_work, client_specified, exception_paths, cfg_branches, max_nesting, auth (object:checked), kinds (counts of statement kinds)."""
    k, w = F.col("kind"), W.partitionBy("filename").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    step = F.when(k.isin(*OPENS), 1).when(k.isin(*CLOSES), -1).otherwise(0)
    d = statements.withColumn("d", F.sum(step).over(w))
    d = d.withColumn("depth", F.col("d") - F.least(F.lit(0), F.min("d").over(w)))
    tally = d.groupBy("object").agg(
        F.count_if(k.isin("Commit", "CommitEntities")).alias("commit_work"), F.count_if(F.upper("text").contains("CLIENT SPECIFIED")).alias("client_specified"), F.count_if(k.isin(*EXCEPTIONS)).alias("exception_paths"),
        F.count_if(k.isin(*BRANCHES)).alias("cfg_branches"), F.max("depth").cast("long").alias("max_nesting"),
    )
    kinds = statements.groupBy("object", "kind").agg(F.count("*").alias("n")).groupBy("object").agg(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "n"))).alias("kinds"))
    auth = checked_after(statements).groupBy("object").agg(F.array_sort(F.collect_set(F.concat_ws(":", F.regexp_extract(F.upper("text"), r" OBJECT '([^']+)'", 1), F.col("checked").cast("string")))).alias("auth"))
    return tally.join(kinds, "object", "left").join(auth, "object", "left").withColumn("auth", F.coalesce("auth", F.array().cast("array<string>")))


def declarative(views: DataFrame, behaviors: DataFrame, grants: DataFrame) -> DataFrame:
    """Object, artifacts, auth (entities with authorization or grants): views, behaviors, grants are parsed files (object, view / behavior / grants)."""
    none = F.array().cast("array<string>")
    b = behaviors.select("object", F.transform(F.filter("behavior.entities", lambda e: e["authorization"].isNotNull()), lambda e: e["entity"]).alias("auth"))
    g = grants.select("object", F.col("grants.entity").alias("auth"))
    all_ = views.select("object", none.alias("auth")).unionByName(b).unionByName(g)
    return all_.groupBy("object").agg(F.count("*").alias("artifacts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("auth")))).alias("auth"))


def bundle_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Key, the regressions between two feature tables (key, auth, kinds: arrays; client_specified, exception_paths, cfg_branches, max_nesting, artifacts).

    A shift to declarative artifacts suspends the three structural regressions, since statements can't be compared with declarations.
    """
    num, arr = ("client_specified", "exception_paths", "cfg_branches", "max_nesting", "artifacts"), ("auth", "kinds")
    side = lambda df, p: df.select(key, *[F.col(c).alias(p + c) for c in (*num, *arr)])
    j = side(before, "b_").join(side(after, "a_"), key, "full")
    b = lambda c: F.coalesce("b_" + c, F.lit(0) if c in num else F.array().cast("array<string>"))
    a = lambda c: F.coalesce("a_" + c, F.lit(0) if c in num else F.array().cast("array<string>"))
    names = lambda x: F.array_sort(F.array_distinct(F.transform(x, lambda s: F.substring_index(s, ":", 1))))
    shift = (a("artifacts") > 0) & (b("artifacts") == 0)
    return j.select(
        key, shift.alias("paradigm_shift"), ((F.size(b("auth")) > 0) & (F.size(a("auth")) == 0)).alias("auth_vanished"), (names(b("auth")) != names(a("auth"))).alias("auth_object_changed"),
        (a("client_specified") != b("client_specified")).alias("client_specified_delta"), F.size(F.array_union(F.array_except(b("kinds"), a("kinds")), F.array_except(a("kinds"), b("kinds")))).alias("statement_kind_changes"),
        (~shift & (a("exception_paths") < b("exception_paths"))).alias("exception_path_dropped"), (~shift & (a("cfg_branches") < b("cfg_branches"))).alias("cfg_branch_regression"), (~shift & (a("max_nesting") < b("max_nesting"))).alias("max_nesting_regression"),
    )


def native_edges(statements: DataFrame) -> DataFrame:
    """Source, target, access of statements between EXEC SQL and ENDEXEC that name a bare table."""
    w = W.partitionBy("filename").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    mark = F.last(F.when(F.col("kind") == "ExecSQL", True).when(F.col("kind") == "EndExec", False), ignorenulls=True).over(w)
    t = F.upper("text")
    name = lambda p: F.nullif(F.regexp_extract(t, p + r" ([A-Z_][A-Z0-9_]*)(?![A-Z0-9_.])", 1), F.lit(""))
    target = F.when(t.startswith("SELECT "), name("^SELECT .* FROM")).when(t.startswith("INSERT "), name("^INSERT INTO")).when(t.startswith("UPDATE "), name("^UPDATE")).when(t.startswith("DELETE "), F.coalesce(name("^DELETE FROM"), name("^DELETE(?! FROM)")))
    return statements.withColumn("native", mark).where("native and kind <> 'EndExec'").select(F.col("object").alias("source"), target.alias("target"), F.when(t.startswith("SELECT "), "read").otherwise("write").alias("access")).where("target is not null").distinct()


def call_edges(statements: DataFrame, objects: DataFrame) -> DataFrame:
    """Source, target, kind of calls that the text shows: static and functional methods, and forms; a target without a known owner falls to its own object.

    Calls through references are in types.instance_edges.
    """
    t = F.upper("text")
    call = F.regexp_extract_all(t, F.lit(r"([A-Z/][A-Z0-9_/]*)=>([A-Z0-9_~]+)\("), F.lit(0))
    methods = statements.select("object", F.explode(F.transform(call, lambda c: F.regexp_replace(F.regexp_replace(c, r"\(", ""), "=>", "."))).alias("target"), F.lit("call-method").alias("kind"))
    forms = statements.where("kind = 'Perform'").select("object", F.regexp_extract(t, r"^PERFORM ([A-Z0-9_]+)", 1).alias("form"), F.regexp_extract(t, r" IN PROGRAM ([A-Z0-9_/]+)", 1).alias("program")).where("form <> ''")
    forms = forms.select("object", F.concat_ws(".", F.coalesce(F.nullif("program", F.lit("")), F.col("object")), "form").alias("target"), F.lit("calls").alias("kind"))
    known = objects.select(F.col("object").alias("owner")).distinct().withColumn("ok", F.lit(True))
    e = methods.union(forms).withColumn("owner", F.substring_index("target", ".", 1)).join(known, "owner", "left")
    return e.select(F.col("object").alias("source"), F.when(F.col("ok"), F.col("target")).otherwise(F.concat_ws(".", "object", F.substring_index("target", ".", -1))).alias("target"), "kind").distinct()


def live_files(listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (filename, source) of pulled objects (name, type, source), slashes as hashes; unsupported types and empty sources are skipped with a reason."""
    suffix = F.element_at(F.create_map(*[F.lit(x) for kv in LIVE_SUFFIXES.items() for x in kv]), F.col("type"))
    reason = F.when(suffix.isNull(), "unsupported type").when(F.coalesce(F.trim("source"), F.lit("")) == "", "empty source")
    x = listed.withColumns({"suffix": suffix, "reason": reason})
    return x.where("reason is null").select(F.concat(F.lower(F.replace("name", F.lit("/"), F.lit("#"))), F.lit("."), "suffix").alias("filename"), "source"), x.where("reason is not null").select("name", "reason")


def rule_rows(spark: SparkSession, path: str) -> DataFrame:
    """Id, family, severity, message, pattern, when, unless of a JSON array of rules; unreadable files give no rows."""
    kind = "id string, family string, severity string, message string, pattern string, `when` string, unless string"
    df = spark.read.schema(kind + ", _bad string").option("columnNameOfCorruptRecord", "_bad").option("multiLine", True).json(path)
    return df.where("id is not null").drop("_bad")


def contract(nodes: DataFrame, patterns: DataFrame) -> DataFrame:
    """Id, objects, contract_hash of nodes (id, object, disposition, shape) by their pattern (shape, components, invariants); an unknown shape is an error."""
    j = nodes.join(patterns, "shape", "left")
    parts = F.transform("components", lambda c: F.struct(F.lit(None).cast("string").alias("spec"), F.concat_ws(".", F.col("object"), c).alias("id"), c.alias("kind"), F.col("invariants").alias("invariants_required")))
    parts = F.when(F.col("components").isNull(), F.raise_error("a shape lies outside the patterns").cast("array<struct<spec:string,id:string,kind:string,invariants_required:array<string>>>")).otherwise(parts)
    base = F.to_json(F.struct(F.col("disposition"), F.col("id").alias("node"), parts.alias("objects"), F.col("shape").alias("target")), {"ignoreNullFields": "false"})
    return j.select("id", F.size(parts).alias("objects"), F.sha2(base, 256).alias("contract_hash"))


def fact_hash(cols: Sequence[str]) -> Column:
    """The digest of a fact stream or a configuration: its columns in alphabetic order, arrays as they are (sort them first)."""
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)


def assembled(edges: DataFrame, planned: DataFrame, meta: DataFrame) -> DataFrame:
    """One row per super-node that holds a planned member: id, members, rank, blast, sealed, dependencies.

    edges: a needs b (longs); planned: id; meta: id, rank, blast, sealed.
    """
    members, links = condensed(edges)
    inside = members.join(planned.select("id"), "id", "left_semi")
    node = inside.join(meta, "id", "left").groupBy(F.col("root").alias("id")).agg(F.array_sort(F.collect_set("id")).alias("members"), F.min("rank").alias("rank"), F.max("blast").alias("blast"), F.bool_or("sealed").alias("sealed"))
    needs = in_plan_ancestors(links.select(F.col("b").alias("source"), F.col("a").alias("target")), node.select("id")).groupBy("id").agg(F.array_sort(F.collect_set("ancestor")).alias("dependencies"))
    return node.join(needs, "id", "left").withColumn("dependencies", F.coalesce("dependencies", F.array().cast("array<long>")))


def config_text(config: dict) -> str:
    """A configuration in the order of its keys."""
    return json.dumps(config, sort_keys=True, separators=(",", ":"))


def by_cache(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D3: the cached features (cache: object, source_hash, more) whose sources are unchanged, and the files that must be read anew."""
    hashed = files.withColumn("source_hash", F.sha2(F.coalesce("source", F.lit("")), 256))
    keys = ["object", "source_hash"]
    return cache.join(hashed.select(*keys).distinct(), keys, "left_semi"), hashed.join(cache.select(*keys).distinct(), keys, "left_anti")


def bundle(imperative_: DataFrame, declarative_: DataFrame, hashes: DataFrame) -> DataFrame:
    """D3: one row per object with both sides' features: authorizations together, missing counts 0."""
    none, counts = F.array().cast("array<string>"), ("commit_work", "client_specified", "exception_paths", "cfg_branches", "max_nesting", "artifacts")
    d = declarative_.withColumnRenamed("auth", "_auth")
    j = hashes.select("object", "source_hash").join(imperative_, "object", "left").join(d, "object", "left")
    auth = F.array_sort(F.array_union(F.coalesce("auth", none), F.coalesce("_auth", none)))
    return j.select("object", "source_hash", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], F.coalesce("kinds", none).alias("kinds"), auth.alias("auth"))


def check_only_document(findings: DataFrame) -> DataFrame:
    """One document of checks alone (findings: object, severity): tallies, readiness and an empty graph with a note on coverage."""
    p = lambda s: F.count_if(F.col("severity") == s)
    clean = F.countDistinct(F.when(~F.col("severity").isin("p1", "p2"), F.col("object")))
    g = findings.groupBy("object").agg(F.min("severity").alias("severity"), p("p1").alias("p1"), p("p2").alias("p2"))
    total = g.agg(F.count("*").alias("objects"), clean.alias("clean"), F.coalesce(F.sum("p1"), F.lit(0)).alias("p1"), F.coalesce(F.sum("p2"), F.lit(0)).alias("p2"))
    share = F.when(F.col("objects") == 0, 100.0).otherwise(F.floor(100.0 * F.col("clean") / F.col("objects") + 0.5).cast("double"))
    return total.select("objects", "p1", "p2", share.alias("readiness"), F.lit(0).alias("nodes"), F.lit(0).alias("edges"), F.lit("checks only: the graph was not read").alias("coverage"))
