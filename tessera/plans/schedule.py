"""Scheduling of plan nodes: frontiers, the decision ladder, verdict steps, gates, registers, replans."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.aggregates import range_digest

from tessera.operators.cuts import cut, dealt, met

#: States, dispositions, reasons that a human may clear, the retry ceiling, decisions of the two gates, review prefixes, standard tables.
RESTED = ("GREEN", "SYNTAX_OK", "PROVISIONAL_GATED", "BLOCK", "PARK", "NEEDS_MANUAL_SEAM", "RETIRED", "REBUILT_HANDOFF")
DISPOSITIONS = ("refactor", "re_architect", "rebuild", "replace", "retire", "seal")
GATED = ("re_architect", "rebuild")
TERMINALS = {"RETIRED": "retire", "REBUILT_HANDOFF": "rebuild"}
CEILING = 3
ESCALATABLE = (("auth-delta-unattested", "AUTH_EQUIVALENCE", False), ("parity-not-equivalent:needs_review", "PARITY_REVIEW", False), ("final-review-unanalysable:", "UNANALYSABLE_ARTIFACT", True))
FIX = "final-review-fix:"
STANDARD_TABLES = {
    "Purchasing": "EKKO EKPO EBAN EKBE", "Sales": "VBAK VBAP", "Delivery": "LIKP LIPS", "Billing": "VBRK VBRP", "Accounting": "BKPF BSEG BSID BSIK ACDOCA", "G/L Account": "SKA1 SKB1",
    "Material": "MARA MARC MARD MBEW", "Customer": "KNA1 KNB1", "Vendor": "LFA1 LFB1",
}


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """win, lose: the rows (win, lose) of a batch, sorted by win, as one array for each win."""
    for b in batches:
        if not b.num_rows:
            continue
        win = b.column("win")
        new = pc.indices_nonzero(pc.not_equal(win.slice(1), win.slice(0, len(win) - 1))).to_numpy() + 1
        starts = np.concatenate(([0], new)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([win.take(pa.array(starts)), pa.ListArray.from_arrays(pa.array(np.append(starts, np.int32(len(win)))), b.column("lose"))], ["win", "lose"])


def frontier(ready: DataFrame, links: DataFrame, keys: DataFrame, order: Sequence[Column], cap: int | None = None) -> DataFrame:
    """Id of the nodes to start: worst first, no two of them linked or sharing a key, `cap` at most.

    Equal to the sequential greedy choice, by rounds: a node is taken if no open node that it excludes is worse; those it excludes go.
    Keys are groups with members, so a key of many holders never makes pairs.  A link is kept once, from its worse end to the other one
    (the links of a node are packed as arrays, a hub's in several), and no longer than both ends are open.
    """
    open_ = cut(ready.select("id", F.struct(*order, F.col("id").alias("i")).alias("rank")))
    held = cut(met(keys.select("key", "id").distinct(), ready.select("id"), "id", "left_semi"))
    ends = links.where("source <> target").select(F.col("source").alias("a"), F.col("target").alias("b"))
    total = links.count()
    for x in "ab":
        ends = met(dealt(ends, x, total=total), open_.select(F.col("id").alias(x), F.col("rank").alias("r" + x)), x)
    first = F.col("ra") < F.col("rb")
    ends = ends.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("win"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("lose"))
    kind = ends.schema["win"].dataType.simpleString()
    rest = cut(dealt(ends, "win", total=total).sortWithinPartitions("win").mapInArrow(_packed, f"win {kind}, lose array<{kind}>"))
    taken = None
    while not open_.isEmpty():
        now = met(held, open_, "id")
        low = now.groupBy("key").agg(F.min("rank").alias("low"))
        behind = met(now, low, "key").where(F.col("rank") > F.col("low")).select("id")
        lost = behind.union(rest.select(F.explode("lose").alias("id"))).distinct()
        won = cut(met(open_, lost, "id", "left_anti"))
        full = met(held, won.select("id"), "id", "left_semi").select("key").distinct()
        out = met(held, full, "key", "left_semi").select("id").union(met(rest, won.select(F.col("id").alias("win")), "win", "left_semi").select(F.explode("lose").alias("id")))
        taken = won if taken is None else taken.unionByName(won)
        open_ = cut(met(met(open_, out.distinct(), "id", "left_anti"), won.select("id"), "id", "left_anti"))
        ids = open_.select(F.col("id").alias("win"))
        both = met(met(rest, ids, "win", "left_semi").select("win", F.explode("lose").alias("lose")), ids.withColumnRenamed("win", "lose"), "lose", "left_semi")
        rest = cut(both.select("win", F.array("lose").alias("lose")))
    taken = open_ if taken is None else taken
    return (taken if cap is None else taken.orderBy("rank").limit(cap)).select("id")


def ladder(nodes: DataFrame, run: str = "run") -> DataFrame:
    """Run, action, nodes: the first action that applies, with the nodes it is about.

    nodes: run, id, status, disposition, indegree, ready, arch_open, parked, sealed, failed, starved, complete.
    """
    rules = [
        ("retire", (F.col("disposition") == "retire") & F.col("status").isin("PENDING", "GROUNDED") & (F.col("indegree") == 0)),
        ("generate", F.col("ready")),
        ("await_arch", F.col("disposition").isin(*GATED) & F.col("arch_open")),
        ("await_human", F.col("parked") | (F.col("status") == "NEEDS_MANUAL_SEAM") | ((F.col("sealed") | (F.col("disposition") == "seal")) & (F.col("status") == "PENDING")) | ((F.col("status") == "PROVISIONAL_GATED") & F.col("failed"))),
        ("blocked", ~F.col("status").isin(*RESTED) & ~F.col("starved")),
    ]
    g = nodes.groupBy(run).agg(F.bool_and("complete").alias("all"), *[F.array_sort(F.collect_set(F.when(c, F.col("id")))).alias(n) for n, c in rules])
    some = lambda n: F.size(n) > 0
    action, about = F.when(F.col("all"), "complete"), F.when(F.col("all"), F.array().cast("array<string>"))
    for n, _ in rules:
        action, about = action.when(some(n), n), about.when(some(n), F.col(n).cast("array<string>"))
    return g.select(run, action.otherwise("provisional_complete").alias("action"), about.otherwise(F.array().cast("array<string>")).alias("nodes"))


def verdict_step(provisional: Column, reasons: Column, cycle: Column) -> tuple[Column, Column]:
    """Next action and escalations of an offline verdict: only reasons that a human may clear wait; others retry up to the ceiling."""
    fits = lambda r: F.coalesce(*[F.when(r.startswith(k) if prefix else r == k, F.lit(kind)) for k, kind, prefix in ESCALATABLE])
    kinds = F.array_sort(F.array_distinct(F.array_compact(F.transform(reasons, fits))))
    human = (F.size(kinds) > 0) & F.forall(reasons, lambda r: fits(r).isNotNull())
    action = F.when(provisional, "decide").when(human, "await_human").when(cycle >= CEILING, "block").otherwise("generate")
    return action, F.when((action == "await_human"), kinds).otherwise(F.array().cast("array<string>"))


def wave_risk(nodes: DataFrame, keys: Sequence[str], bound: int = 10) -> DataFrame:
    """Keys, disposition, flagged of each wave at rest.  nodes: id, status, blast."""
    far = F.col("blast") >= bound
    g = nodes.groupBy(*keys).agg(F.bool_and(F.col("status").isin(*RESTED)).alias("rest"), F.count_if(far).alias("flagged"))
    return g.where("rest").select(*keys, F.when(F.col("flagged") > 0, "REVIEW").otherwise("AUTO").alias("disposition"), "flagged")


def oscillation_clusters(nodes: DataFrame) -> DataFrame:
    """root_signature, ids of nodes that oscillate (id, rule, dependency, oscillating), by shared cause."""
    root = F.concat_ws("|", F.coalesce("rule", F.lit("unknown")), F.coalesce("dependency", F.lit("unknown")))
    return nodes.where("oscillating").groupBy(root.alias("root_signature")).agg(F.array_sort(F.collect_set("id")).alias("ids"))


def node_states(reports: DataFrame, key: str, order: Sequence[str], ceiling: int = CEILING, kept: int = 5) -> DataFrame:
    """Key, status, attempts, series: the state machine of `streaming.runs` over finite reports (passed), as one window pass."""
    w = W.partitionBy(key).orderBy(*order)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    r = reports.withColumns({"fails": F.coalesce(F.count_if(~F.col("passed")).over(before), F.lit(0)), "won": F.coalesce(F.count_if("passed").over(before), F.lit(0)), "back": F.row_number().over(W.partitionBy(key).orderBy(*[F.col(c).desc() for c in order]))})
    live = (F.col("won") == 0) & (F.col("fails") < ceiling)
    tail = F.array_sort(F.collect_list(F.when(F.col("back") <= kept, F.struct((-F.col("back")).alias("b"), F.when(F.col("passed"), "P").otherwise("F").alias("v")))))
    g = r.groupBy(key).agg(F.count_if(live & ~F.col("passed")).alias("attempts"), F.bool_or(live & F.col("passed")).alias("done"), F.array_join(tail["v"], "").alias("series"))
    return g.select(key, F.when(F.col("done"), "COMPLETE").when(F.col("attempts") >= ceiling, "PARKED").otherwise("PENDING").alias("status"), "attempts", "series")


def review_reasons(findings: DataFrame, key: str) -> DataFrame:
    """Key, reason: one for each rule that asks for a fix, with its hits and the first place.  findings: rule_id, file, line."""
    g = findings.groupBy(key, "rule_id").agg(F.count("*").alias("n"), F.min(F.struct("file", "line")).alias("first"))
    text = F.concat(F.lit(FIX), "rule_id", F.lit(" ("), F.col("n").cast("string"), F.when(F.col("n") == 1, " hit, first ").otherwise(" hits, first "), F.col("first.file"), F.lit(":"), F.col("first.line").cast("string"), F.lit(")"))
    return g.select(key, text.alias("reason"))


def attested(events: DataFrame, keys: Sequence[str], order: Sequence[str], now: DataFrame, decision: str) -> DataFrame:
    """Keys, resolved_by: the latest event of a slot counts if it is resolved by that decision in the same run, epoch and generation.

    events: status, decision, run, epoch, generation, resolved_by; now: keys[0], run, epoch, generation.
    """
    cols = ["status", "decision", "run", "epoch", "generation", "resolved_by"]
    last = events.groupBy(*keys).agg(F.max(F.struct(*order, *cols)).alias("x")).select(*keys, *[F.col(f"x.{c}").alias(c) for c in cols])
    same = [F.col(c).eqNullSafe(F.col("n" + c)) for c in ("run", "epoch", "generation")]
    n = now.select(keys[0], *[F.col(c).alias("n" + c) for c in ("run", "epoch", "generation")])
    return last.join(n, keys[0]).where((F.col("status") == "RESOLVED") & (F.col("decision") == decision) & same[0] & same[1] & same[2]).select(*keys, "resolved_by")


def park_errors(reason: Column, signed_by: Column, justification: Column, already: Column) -> Column:
    """Why a node may not be parked, as an array."""
    return F.array_compact(F.array(F.when(~reason.eqNullSafe(F.lit("NO_RELEASED_SUCCESSOR")), "reason"), F.when(F.coalesce(signed_by, F.lit("")) == "", "signature"), F.when(F.coalesce(justification, F.lit("")) == "", "justification"), F.when(already, "already-parked")))


def re_enter(parked: DataFrame, available: DataFrame) -> DataFrame:
    """Parked rows with `reentered`: their probe (in the registry's case) is available now."""
    a = available.select(F.col("name").alias("_p")).distinct().withColumn("reentered", F.lit(True))
    return parked.withColumn("_p", F.upper(F.trim("successor_probe"))).join(a, "_p", "left").withColumn("reentered", F.coalesce("reentered", F.lit(False))).drop("_p")


def plan_hash(nodes: DataFrame, run: str, cols: Sequence[str]) -> DataFrame:
    """Run, plan_hash over the digests of its nodes in order of their ids (numbers), by a tree; a node's columns in alphabetic order."""
    each = F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)
    return range_digest(nodes.select(run, "id", each.alias("plan_hash")), "id", "plan_hash", "|", levels=3, by=(run,))


def replan(before: DataFrame, after: DataFrame, committed: DataFrame) -> DataFrame:
    """Id, change (added, removed, moved) and whether it forces a replan.  before, after: id, wave."""
    b, a, c = before.select("id", F.col("wave").alias("wb")), after.select("id", F.col("wave").alias("wa")), committed.select("id").distinct().withColumn("c", F.lit(True))
    change = F.when(F.col("wb").isNull(), "added").when(F.col("wa").isNull(), "removed").when(F.col("wa") != F.col("wb"), "moved")
    j = b.join(a, "id", "full").withColumn("change", change).where("change is not null").join(c, "id", "left")
    return j.select("id", "change", (F.coalesce("c", F.lit(False)) & (F.col("change") != "added")).alias("forces"))


def overrides(events: DataFrame, run: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The overrides that stand (sig, disposition), and those that a later decision replaced (sig, disposition, superseded_by).

    events: sig, run, kind, status, verb, value.
    """
    e = events.where((F.col("run") == run) & (F.col("status") == "RESOLVED") & F.col("kind").isin("DISPOSITION_REVIEW", "NO_TARGET_SHAPE"))
    e = e.withColumn("last", F.max(F.struct(*order, "kind", "verb")).over(W.partitionBy("sig"))).withColumn("final", F.struct(*order) == F.struct(*[F.col(f"last.{c}").alias(c) for c in order]))
    stand = e.where(F.col("final") & F.col("verb").isin("override", "shape")).select("sig", F.when(F.col("verb") == "shape", "re_architect").otherwise(F.col("value")).alias("disposition"))
    lost = e.where(~F.col("final") & (F.col("verb") == "override") & (F.col("last.verb") != "override")).select("sig", F.col("value").alias("disposition"), F.col("last.kind").alias("superseded_by"))
    return stand, lost


def entry_hash(*cols: str) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)


def cached(requests: DataFrame, cache: DataFrame, keys: Sequence[str], strict: bool = True) -> DataFrame:
    """Requests with status (cached, await or tampered) and recommendation.  cache: keys, recommendation, entry_hash; strict: tampering is an error."""
    ok = entry_hash(*keys, "recommendation") == F.col("entry_hash")
    c = cache.withColumn("_ok", ok).select(*keys, "recommendation", "_ok")
    bad = F.raise_error("the verdict cache was tampered with").cast("string") if strict else F.lit("tampered")
    j = requests.join(c, list(keys), "left")
    status = F.when(F.col("_ok").isNull(), "await").when(F.col("_ok"), "cached").otherwise(bad)
    return j.withColumn("status", status).withColumn("recommendation", F.when(F.col("_ok"), F.col("recommendation"))).drop("_ok")


def decision(raw: Column, simple: Sequence[str], with_text: Sequence[str], with_value: dict[str, Sequence[str]]) -> tuple[Column, Column]:
    """Verb and parameter of a decision; both null if the grammar doesn't hold."""
    verb, param = F.trim(F.substring_index(raw, ":", 1)), F.trim(F.when(raw.contains(":"), F.expr("''")).otherwise(""))
    param = F.when(raw.contains(":"), F.trim(F.regexp_replace(raw, r"(?s)^[^:]*:", ""))).otherwise(F.lit(""))
    fits = verb.isin(*simple) | (verb.isin(*with_text) & (param != ""))
    for v, values in with_value.items():
        fits = fits | ((verb == v) & param.isin(*values))
    return F.when(fits, verb), F.when(fits & ~verb.isin(*simple), param)


def prompt_options(recommended: Column, alternatives: Column) -> Column:
    """The recommended disposition, the distinct valid others, and other; fewer than three, or an invalid one, is an error."""
    valid = F.array(*map(F.lit, DISPOSITIONS))
    all_ = F.array_distinct(F.concat(F.array(recommended), alternatives, F.array(F.lit("other"))))
    fine = F.array_contains(valid, recommended) & F.forall(alternatives, lambda a: F.array_contains(valid, a)) & (F.size(all_) >= 3)
    return F.when(fine, all_).otherwise(F.raise_error("options need valid dispositions and three choices at least").cast("array<string>"))


def dropped_features(register: DataFrame, nodes: DataFrame, strict: bool = True) -> DataFrame:
    """K8: sig, status, disposition, error: register rows against the plan's nodes; strict: the first error fails the query."""
    need = F.element_at(F.create_map(*[F.lit(x) for kv in TERMINALS.items() for x in kv]), F.col("status"))
    j = register.join(nodes.select("sig", "disposition"), "sig", "left")
    signed = (F.coalesce("signed_by", F.lit("")) != "") & (F.coalesce("justification", F.lit("")) != "")
    error = F.when(F.col("disposition").isNull(), "unknown-node").when(need.isNull(), "not-terminal").when(need != F.col("disposition"), "wrong-disposition").when(~signed, "unsigned")
    out = j.select("sig", "status", "disposition", error.alias("error"))
    return out.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("dropped features: "), "error")).cast("string"))) if strict else out


def fit_to_standard(uses: DataFrame, calls: DataFrame, members: DataFrame) -> DataFrame:
    """Node, domains, tables, apis, action.  uses: object, target (tables); calls: object, target, released; members: node, object."""
    domain = F.coalesce(*[F.when(F.upper("target").isin(*names.split()), F.lit(d)) for d, names in STANDARD_TABLES.items()])
    t = uses.select("object", F.upper("target").alias("tbl"), domain.alias("domain")).where("domain is not null")
    name = F.upper(F.substring_index("target", ".", 1))
    delivered = F.col("api").rlike("^(BAPI_|IDOC_INPUT_|IDOC_OUTPUT_|MASTER_IDOC_)") | F.col("released")
    c = calls.select("object", name.alias("api"), "released").where(~F.col("api").rlike(r"^CL_ABAP_|^CX_|^[ZY]|^/[A-Z0-9_]+/") & delivered)
    of = lambda df, *cols: members.join(df, "object").groupBy("node").agg(*[F.array_sort(F.collect_set(a)).alias(b) for a, b in cols])
    j = members.select("node").distinct().join(of(t, ("domain", "domains"), ("tbl", "tables")), "node", "left").join(of(c, ("api", "apis")), "node", "left")
    fill = lambda x: F.coalesce(x, F.array().cast("array<string>")).alias(x)
    return j.select("node", fill("domains"), fill("tables"), fill("apis")).withColumn("action", F.when((F.size("tables") > 0) | (F.size("apis") > 0), "verify_live").otherwise("build"))


def blueprint_violations(objects: DataFrame, groups: DataFrame, shapes: DataFrame) -> DataFrame:
    """Tier, item: objects of unknown shape, members that are no objects, references to no group, and app members without a user interface.

    objects: sig, shape, refs (array); groups: kind, id, member; shapes: shape, ui.
    """
    shape = objects.join(shapes.select("shape").distinct(), "shape", "left_anti").select(F.lit("unknown-shape").alias("tier"), F.col("sig").alias("item"))
    member = groups.join(objects.select(F.col("sig").alias("member")), "member", "left_anti").select(F.lit("unknown-member"), F.concat_ws(":", "id", "member"))
    refs = objects.select("sig", F.explode("refs").alias("id")).join(groups.select("id").distinct(), "id", "left_anti").select(F.lit("unknown-group"), F.concat_ws(":", "sig", "id"))
    ui = groups.where("kind = 'fiori_apps'").join(objects.select(F.col("sig").alias("member"), "shape"), "member").join(shapes, "shape").where("not ui").select(F.lit("no-ui"), F.concat_ws(":", "id", "member"))
    return shape.union(member).union(refs).union(ui).distinct()


def invariant_diff(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys, violations, lost, auth_delta of two sets of checks (keys, object, field, dummy, checked) and commits (commit rows have object null)."""
    side = lambda df: df.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.when(F.col("object").isNotNull() & ~F.col("dummy"), F.concat_ws("|", "object", "field")))).alias("on"),
        F.count_if(F.col("object").isNull()).alias("commits"), F.bool_or(F.col("object").isNotNull() & ~F.col("dummy") & ~F.col("checked")).alias("open"),
    )
    b, a = side(before), side(after).select(*keys, F.col("on").alias("aon"), F.col("commits").alias("acommits"), F.col("open").alias("aopen"))
    none = F.array().cast("array<string>")
    j = b.join(a, list(keys), "full").withColumns({"on": F.coalesce("on", none), "aon": F.coalesce("aon", none)})
    bad = F.array_compact(F.array(F.when(F.coalesce("acommits", F.lit(0)) < F.coalesce("commits", F.lit(0)), "P4b:commit-suppressed"), F.when(F.coalesce("aopen", F.lit(False)), "P4c:subrc-unchecked")))
    return j.select(*keys, bad.alias("violations"), F.array_except("on", "aon").alias("lost"), (F.col("on") != F.col("aon")).alias("auth_delta"))


def checkpoint_counts(nodes: DataFrame, findings: DataFrame, analysed: DataFrame, key: str) -> DataFrame:
    """Key, p1, p2: counts of findings; null, never 0, for nodes without an analysis."""
    n = findings.groupBy(key).agg(F.count_if(F.col("severity") == "p1").alias("a"), F.count_if(F.col("severity") == "p2").alias("b"))
    j = nodes.select(key).join(analysed.select(key).distinct().withColumn("ok", F.lit(True)), key, "left").join(n, key, "left")
    return j.select(key, *[F.when(F.col("ok"), F.coalesce(c, F.lit(0))).alias(o) for c, o in (("a", "p1"), ("b", "p2"))])
