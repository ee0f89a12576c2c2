"""Facts about objects: the surfaces they consume, whose tables they touch, what their references are grounded on."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import cut, strong_components

#: Surface facts by names that are called, the first that fits: what a part of the name (between dots) begins with, and what the name holds;
#: a word among those between underscores; the directions of document exchange by what names begin with; facts of node kinds.
CONSTRUCTS = {
    "ui_salv": (("CL_GUI_ALV_GRID", "CL_SALV", "REUSE_ALV"), ("ALV_GRID_DISPLAY",)), "ui_frontend": (("CL_GUI_FRONTEND", "GUI_UPLOAD", "GUI_DOWNLOAD", "WS_UPLOAD", "WS_DOWNLOAD"), ()), "ui_dynpro": (("CL_GUI_DYNP", "CL_GUI_CONTAINER"), ("CALL_SCREEN",)),
    "remote_idoc": (("MASTER_IDOC_", "IDOC_", "EDI_", "INBOUND_IDOC"), ()), "remote_bapi": (("BAPI_",), ()),
}
REMOTE_WORD, REMOTE = "RFC", "remote_rfc"
DIRECTIONS = {"remote_idoc_inbound": ("IDOC_INPUT_",), "remote_idoc_outbound": ("IDOC_OUTPUT_", "MASTER_IDOC_")}
SURFACE_KINDS = {"report": "batch_report", "program": "batch_report", "executable": "batch_report", "screen": "ui_dynpro", "dynpro": "ui_dynpro"}
NO_SURFACE, NO_PERSISTENCE = "no_surface_evidence", "no_persistence_evidence"
#: Names that write through a sanctioned interface: what they begin with, and what follows an underscore in names of the application interface.
WRITERS, WRITING = ("BAPI_TRANSACTION_COMMIT", "POSTING_INTERFACE_", "IDOC_INPUT_", "IDOC_OUTPUT_", "IDOC_INBOUND_", "MASTER_IDOC_", "EDI_DOCUMENT_STATUS_SET", "EDI_DOCUMENT_OPEN_FOR_PROCESS", "EDI_DOCUMENT_CLOSE_PROCESS"), ("CREATE", "CHANGE", "POST", "CANCEL", "REVERSE", "DELETE", "CONFIRM", "SETSTATUS", "SAVE")
#: Release states, tiers and targets; triage of rules.
RELEASE_STATES = {"A": "released", "B": "deprecated", "C": "deprecated", "D": "removed"}
RELEASE_TIERS = {"A": "keep-and-clean", "B": "re-platform", "C": "re-platform", "D": "retire"}
TARGETS = {"class": "RAP Business Object", "report": "Fiori Elements App", "function": "OData V4 Service", "interface": "RAP Interface", "table": "CDS View Entity", "cds": "CDS View Entity"}
TRIAGE = {
    "talos-cc-001-obsolete-arithmetic": "fix", "talos-duplicate-block": "fix", "talos-cloud-005-class-final-abstract": "fix", "talos-rap-draft-action-no-optimized": "fix",
    "talos-perf-73-eml-local-mode": "document", "talos-eml-local-mode-outside-test": "document", "talos-dynamic-where-subquery": "document", "talos-cds-auth-not-required": "document",
}
SUFFIX_CONTEXTS = (
    (".testclasses.abap", "test_class"), (".asddls", "cds"), (".asdcls", "dcls"), (".asddlx", "ddlx"), (".asbdef", "bdef"), (".asdbtab", "dbtab"), (".srvd", "srvd"), (".srvb", "srvb"),
    (".clas.abap", "class"), (".intf.abap", "intf"), (".prog.abap", "prog"), (".fugr.abap", "fugr"),
)


def lookup(key: Column, table: dict[str, str], otherwise: str | None = None) -> Column:
    found = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    return found if otherwise is None else F.coalesce(found, F.lit(otherwise))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def construct(name: Column) -> Column:
    """The first surface fact whose parts a name has."""
    parts = F.split(name, r"\.")
    begins = lambda starts: F.exists(parts, lambda p: _any([p.startswith(x) for x in starts]))
    facts = [F.when(begins(starts) | _any([name.contains(x) for x in held]), F.lit(fact)) for fact, (starts, held) in CONSTRUCTS.items()]
    return F.coalesce(*facts, F.when(F.array_contains(F.split(name, "_"), REMOTE_WORD), F.lit(REMOTE)))


def writes_through(name: Column) -> Column:
    """Whether a name is that of an interface that writes."""
    return _any([name.startswith(x) for x in WRITERS]) | (name.startswith("BAPI_") & _any([name.contains(f"_{x}") for x in WRITING]))


def surface(target: Column, destination: Column, classic: Column) -> Column:
    """Surface facts of one call as an array: a construct, its direction, else a destination, else the registry's word."""
    t = F.upper(target)
    named = construct(t)
    fact = F.coalesce(named, F.when(destination.isNotNull(), F.lit("remote_rfc")), F.when(classic, F.lit("classic_api_surface")))
    way = F.coalesce(*[F.when(_any([t.startswith(x) for x in starts]), F.lit(name)) for name, starts in DIRECTIONS.items()])
    return F.array_compact(F.array(fact, F.when(named == "remote_idoc", way)))


def owns(name: Column, customer: tuple[str, ...] = (), sap: tuple[str, ...] = (), otherwise: bool = False) -> Column:
    """Z and Y names are own, bare ones are not; registered namespaces go by the two lists, then by the default."""
    space = F.regexp_extract(name, r"^(/[A-Z0-9_]+/)", 1)
    return F.when(name.rlike("^[ZY]"), True).when(space == "", False).when(space.isin(*customer), True).when(space.isin(*sap), False).otherwise(F.lit(otherwise))


def persistence(target: Column, kind: Column, access: Column, own: Column) -> Column:
    """The persistence fact of one edge, or null."""
    bare = F.upper(F.substring_index(target, ".", 1))
    writes = F.lower(F.coalesce(access, F.lit("read"))) == "write"
    table = F.when(own, F.when(writes, "owns_customer_table").otherwise("reads_customer_table")).otherwise(F.when(writes, "writes_sap_table").otherwise("reads_sap_table"))
    through = F.when(~bare.rlike("^[ZY]") & writes_through(bare), "writes_via_sap_api")
    return F.when(bare != "", F.when(F.lower(kind) == "uses-table", table).otherwise(through))


def with_absence(objects: DataFrame, facts: DataFrame, absence: str) -> DataFrame:
    """object, facts (sorted, distinct); objects without any carry the marker of absence."""
    some = facts.groupBy("object").agg(F.array_sort(F.collect_set("fact")).alias("facts"))
    return objects.select("object").distinct().join(some, "object", "left").select("object", F.coalesce("facts", F.array(F.lit(absence))).alias("facts"))


#: Rounds whose new pairs stay in tables of their own.
KEPT = 16


def reached(facts: DataFrame, calls: DataFrame) -> DataFrame:
    """Object, fact, via: facts that objects reach over calls and don't have themselves, by their smallest such callee.

    facts: object, fact; calls: source, target between objects.  The set of (object, fact) pairs grows by its newest pairs only until no pair is new, so cycles end by themselves.
    A round writes its new pairs only; all pairs are written together once in KEPT rounds, so the plan stays small.
    """
    links = cut(calls.where("source <> target").select("source", "target").distinct())
    own = cut(facts.select("object", "fact").distinct())
    known = front = own
    for k in count(1):
        new = links.join(front, links["target"] == front["object"]).select(F.col("source").alias("object"), "fact").distinct()
        front = cut(new.join(known, ["object", "fact"], "left_anti"))
        if front.isEmpty():
            break
        known = known.unionByName(front)
        if k % KEPT == 0:
            known = cut(known)
    via = links.join(known.withColumnRenamed("object", "target"), "target").groupBy(F.col("source").alias("object"), "fact").agg(F.min("target").alias("via"))
    return via.join(own, ["object", "fact"], "left_anti").select("object", "fact", "via")


def member_union(facts: DataFrame, members: DataFrame, absence: str) -> DataFrame:
    """U8: node, facts: the union over a node's members; the marker of absence goes if there is any other fact."""
    all_ = members.join(facts, "object").groupBy("node").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("facts")))).alias("all"))
    return all_.select("node", F.when(F.size("all") > 1, F.array_remove("all", absence)).otherwise(F.col("all")).alias("facts"))


def release(level: Column) -> list[Column]:
    """release_state and tier of a registry level."""
    return [lookup(level, RELEASE_STATES, "unknown").alias("release_state"), lookup(level, RELEASE_TIERS, "unknown").alias("tier")]


def grounded(findings: DataFrame, edges: DataFrame, objects: DataFrame, blockers: tuple[str, ...], strong: float = 1.0, weak: float = 0.8) -> DataFrame:
    """C11: object, released_clean, certainty, no_successor_refs.

    findings: object, priority, family; edges: source, target, level, successors (level null: unknown).  Clean: analysed and without a P1 finding of a blocking
    family.  Certainty is strong if clean and every reference that isn't customer code is released, weak else.
    """
    seen = findings.groupBy("object").agg((F.count_if((F.col("priority") == "P1") & F.col("family").isin(*blockers)) == 0).alias("clean"))
    ref = F.upper(F.substring_index("target", ".", 1))
    e = edges.select(F.substring_index("source", ".", 1).alias("object"), ref.alias("ref"), "level", "successors")
    foreign = ~F.col("ref").rlike("^[ZY]")
    gone = F.col("level").isin("B", "C", "D") & (F.col("successors") == 0)
    by = e.groupBy("object").agg(F.count_if(foreign).alias("n"), F.count_if(foreign & (F.coalesce("level", F.lit("-")) != "A")).alias("bad"), F.array_sort(F.collect_set(F.when(gone, F.col("ref")))).alias("no_successor_refs"))
    j = objects.select("object").join(seen, "object", "left").join(by, "object", "left")
    clean = F.coalesce("clean", F.lit(False))
    sure = clean & (F.coalesce("n", F.lit(0)) > 0) & (F.col("bad") == 0)
    return j.select("object", clean.alias("released_clean"), F.when(sure, strong).otherwise(weak).alias("certainty"), F.coalesce("no_successor_refs", F.array().cast("array<string>")).alias("no_successor_refs"))


def context(file: Column) -> Column:
    """The kind of artifact that a file name's end tells."""
    return F.coalesce(*[F.when(F.lower(file).endswith(s), F.lit(c)) for s, c in SUFFIX_CONTEXTS], F.lit("unknown"))


def triage(rule: Column) -> Column:
    """Fix, document, or recommend for rules that the table lacks."""
    return lookup(rule, TRIAGE, "recommend")


def grade_rank(grade: Column) -> Column:
    """D is worst with 0; unknown grades are 4."""
    return F.coalesce(lookup(F.upper(grade), {"D": "0", "C": "1", "B": "2", "A": "3"}).cast("int"), F.lit(4))


def target_of(kind: Column) -> Column:
    """X19."""
    return lookup(kind, TARGETS, "Review Required")


def scrubbed(message: Column) -> Column:
    """User names in addresses and credential headers are masked; 500 characters at most."""
    m = F.coalesce(message, F.lit(""))
    m = F.regexp_replace(m, r"https?://[^@\s]+@", "https://***@")
    return F.substring(F.regexp_replace(m, r"(?i)(X-SAP-(?:Password|User|Host))\s*[:=]\s*\S+", "$1: ***"), 1, 500)


def status_of(message: Column) -> Column:
    """401, 502 or 500 by the words of an error."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return F.when(m.contains("401") | m.contains("auth"), 401).when(m.contains("connect") | m.contains("unreachable"), 502).otherwise(500)


def condensed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (id, root: smallest member) and the distinct edges between roots (a, b)."""
    members = cut(strong_components(edges))
    a, b = (members.select(F.col("id").alias(c), F.col("root").alias("r" + c)) for c in "ab")
    return members, edges.select("a", "b").join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()


def in_plan_ancestors(edges: DataFrame, planned: DataFrame) -> DataFrame:
    """Id, ancestor: the nearest planned nodes before each planned node; unplanned ones in between pass on.  edges: source before target."""
    links = cut(edges.select("source", "target").distinct())
    inside = cut(planned.select("id").distinct())
    front = cut(links.join(inside.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("target").alias("id"), F.col("source").alias("at")))
    seen = front
    while True:
        through = front.join(inside.select(F.col("id").alias("at")), "at", "left_anti")
        nxt = through.join(links.select(F.col("target").alias("at"), F.col("source").alias("far")), "at").select("id", F.col("far").alias("at")).distinct()
        front = cut(nxt.join(seen, ["id", "at"], "left_anti"))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen.where("id <> at").join(inside.select(F.col("id").alias("at")), "at", "left_semi").select("id", F.col("at").alias("ancestor")).distinct()


def successors_of(registry: DataFrame, levels: tuple[str, ...] = ("C", "D")) -> DataFrame:
    """C4: name, successor, state of the successor, of entries that aren't to be used; null state where the registry has no such name."""
    known = registry.select(F.col("name").alias("successor"), "state")
    return registry.where(F.col("level").isin(*levels)).select("name", "successor").join(known, "successor", "left").select("name", "successor", "state")


def harvested(texts: DataFrame, key: str, text: str, words: tuple[str, ...]) -> DataFrame:
    """Key, ref: upper-case tokens of four characters or more in free text that are neither customer names nor words of the language."""
    each = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Z][A-Z0-9_]{3,}"), F.lit(0)))).alias("ref"))
    return each.where(~F.col("ref").rlike("^[ZY]") & ~F.col("ref").isin(*words))


def grounding_counts(refs: DataFrame, registry: DataFrame) -> DataFrame:
    """State, n of references(name); unknown where the registry has no row."""
    return refs.join(registry.select("name", "state"), "name", "left").groupBy(F.coalesce("state", F.lit("unknown")).alias("state")).agg(F.count("*").alias("n"))


def builtin_severity(rule: Column, severity: Column, promoted: tuple[str, ...] = ("cloud_types",)) -> Column:
    """Severities of the parser's own rules; some rules are promoted."""
    return F.when(rule.isin(*promoted), "p1").when(severity == "Error", "p2").when(severity == "Warning", "p3").otherwise("info")


def brief(findings: DataFrame) -> DataFrame:
    """Object, brief: its rules in order with how often each fires."""
    n = findings.groupBy("object", "rule_id").agg(F.count("*").alias("n"))
    line = F.concat("rule_id", F.lit(" x"), F.col("n").cast("string"))
    return n.groupBy("object").agg(F.array_join(F.array_sort(F.collect_list(F.struct("rule_id", line.alias("t"))))["t"], "; ").alias("brief"))
