"""Statement rules as data, evaluated as column predicates over one window pass; edges out of statements."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Fires on statements of the kinds (all if none) whose text matches `has` and not `lacks`; in_loop: inside a loop only."""

    id: str
    severity: str
    kinds: tuple[str, ...] = ()
    has: str = ""
    lacks: str = ""
    in_loop: bool = False


#: Rule ids with the statements they are about.
RULES = (
    Rule("talos-select-in-loop", "p1", ("Select", "SelectLoop"), in_loop=True),
    Rule("talos-dml-in-loop", "p2", ("InsertDatabase", "UpdateDatabase", "ModifyDatabase", "DeleteDatabase"), in_loop=True),
    Rule("talos-rap-modify-in-loop", "p1", ("ModifyEntities",), in_loop=True),
    Rule("talos-rap-commit-in-loop", "p1", ("CommitEntities",), in_loop=True),
    Rule("talos-commit-in-loop", "p1", ("Commit",), in_loop=True),
    Rule("talos-free-in-loop", "p2", has="^FREE ", in_loop=True),
    Rule("talos-itab-fulltable-op-in-loop", "p2", ("Sort",), in_loop=True),
    Rule("talos-itab-fulltable-op-in-loop", "p2", ("DeleteInternal",), has=r"(?<!\w)(WHERE|ADJACENT DUPLICATES)(?!\w)", in_loop=True), Rule("talos-sync-http-in-loop", "p1", has=r"\w->\s*(SEND|RECEIVE)\s*\(", in_loop=True),
    Rule("talos-window-function-candidate", "p2", has=r"^(\w+)\s*=\s*\1\s*[+-]", in_loop=True), Rule("talos-scalar-fn-in-loop", "p2", ("CallFunction",), has="'(CONVERT_TO_(LOCAL|FOREIGN)_CURRENCY|UNIT_CONVERSION_SIMPLE|CURRENCY_CONVERSION|FISCAL_[^']*)'", in_loop=True),
    Rule("talos-excessive-secondary-keys", "info", ("Data", "ClassData", "Types"), has=r"((?<!\w)KEY(?!\w).*){4}"), Rule("talos-assign-component-in-loop", "info", has="^ASSIGN COMPONENT ", in_loop=True),
    Rule("talos-aggregation-in-loop", "p2", has="^COLLECT ", in_loop=True),
    Rule("talos-enqueue-no-wait", "p1", ("CallFunction",), has="'ENQUEUE_", lacks="_WAIT"),
    Rule("talos-endselect-no-package-size", "p2", ("SelectLoop",), lacks="PACKAGE SIZE"),
    Rule("talos-select-single-no-where", "p2", ("Select",), has="^SELECT SINGLE ", lacks=" WHERE "),
    Rule("talos-limit-without-filter", "p2", ("Select", "SelectLoop"), has=" UP TO [^ ]+ ROWS", lacks=" WHERE "),
    Rule("talos-cloud-005-class-final-abstract", "p2", ("ClassDefinition",), lacks=" (FINAL|ABSTRACT|DEFERRED|LOCAL FRIENDS|FOR TESTING)"),
    Rule("gf-cloud-no-tables", "error", ("Tables",)), Rule("gf-cloud-no-write", "error", ("Write",)), Rule("gf-cloud-no-native-sql", "error", ("ExecSQL",)),
    Rule("gf-cloud-no-dynpro", "error", ("CallScreen", "SetScreen")), Rule("gf-cloud-no-call-transaction", "error", ("CallTransaction",)), Rule("gf-cloud-call-function", "warning", ("CallFunction",)),
    Rule("gf-clean-no-create-object", "error", ("CreateObject",)), Rule("gf-clean-no-concatenate", "error", ("Concatenate",)), Rule("gf-clean-no-move-to", "error", ("Move",), has="^MOVE "), Rule("gf-clean-no-call-method", "error", ("Call",), has="^CALL METHOD "),
    Rule("gf-clean-no-form", "error", ("Form",)), Rule("gf-cloud-no-describe-lines", "error", ("Describe",), has=" LINES"), Rule("gf-cloud-no-get-reference", "error", ("GetReference",)), Rule("gf-cloud-no-read-report", "error", ("ReadReport",)),
    Rule("gf-cloud-no-break-point", "error", ("Break",)), Rule("gf-cloud-no-leave", "error", ("Leave",)), Rule("gf-cloud-no-enhancement-point", "error", ("EnhancementPoint", "EnhancementSection")), Rule("gf-cloud-no-compute", "warning", ("Compute",)),
    Rule("gf-cloud-class-not-final", "warning", ("ClassDefinition",), lacks=" (FINAL|ABSTRACT)"), Rule("gf-cloud-fs-type-any", "warning", ("FieldSymbol",), has=" TYPE ANY"), Rule("gf-perf-select-in-loop", "warning", ("Select", "SelectLoop"), in_loop=True), Rule("gf-inv-commit-in-loop", "error", ("Commit",), in_loop=True),
)
_OPEN, _CLOSE = ("Loop", "While", "Do", "SelectLoop"), ("EndLoop", "EndWhile", "EndDo", "EndSelect")


def _fits(rule: Rule, depth: Column) -> Column:
    t = F.upper("text")
    out = F.col("kind").isin(*rule.kinds) if rule.kinds else F.lit(True)
    for part in (t.rlike(rule.has) if rule.has else None, ~t.rlike(rule.lacks) if rule.lacks else None, depth > 0 if rule.in_loop else None):
        out = out & part if part is not None else out
    return out


def findings(statements: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """rule_id, severity, object, file, line of every hit: one window for the loop depth, no join with the rules."""
    w = W.partitionBy("filename").orderBy("seq")
    step = F.when(F.col("kind").isin(*_OPEN), 1).when(F.col("kind").isin(*_CLOSE), -1).otherwise(0)
    d = statements.withColumn("d", F.sum(step).over(w.rowsBetween(W.unboundedPreceding, 0)))
    after = F.col("d") - F.least(F.lit(0), F.min("d").over(w.rowsBetween(W.unboundedPreceding, 0)))
    d = d.withColumn("after", after).withColumn("depth", F.coalesce(F.lag("after").over(w), F.lit(0)))
    hits = F.array_compact(F.array(*[F.when(_fits(r, F.col("depth")), F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"))) for r in rules]))
    return d.select(F.explode(hits).alias("h"), "object", F.col("filename").alias("file"), F.col("row").alias("line")).select("h.rule_id", "h.severity", "object", "file", "line")


def unchecked_authority(statements: DataFrame, ahead: int = 3) -> DataFrame:
    """Authority checks whose result isn't looked at within the next few statements."""
    w = W.partitionBy("filename").orderBy("seq").rowsBetween(1, ahead)
    seen = F.coalesce(F.max(F.upper("text").contains("SY-SUBRC").cast("int")).over(w), F.lit(0))
    hit = statements.withColumn("seen", seen).where("kind = 'AuthorityCheck' and seen = 0")
    return hit.select(F.lit("invariant-authority-check-subrc").alias("rule_id"), F.lit("p1").alias("severity"), "object", F.col("filename").alias("file"), F.col("row").alias("line"))


def edges(statements: DataFrame) -> DataFrame:
    """Source, target, kind, access; dynamic and host-variable targets have none."""
    k, t = F.col("kind"), F.upper("text")
    pick = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    select, name = k.isin("Select", "SelectLoop"), r"([A-Z/][A-Z0-9_/]*)"
    target = (
        F.when(select, pick(rf" FROM {name}")).when(k == "DeleteDatabase", pick(rf"^DELETE FROM {name}")).when(k.isin("InsertDatabase", "UpdateDatabase", "ModifyDatabase"), pick(rf"^\w+ (?:INTO )?{name}"))
        .when(k == "CallFunction", pick("'([^']+)'")).when(k == "AuthorityCheck", pick(" OBJECT '([^']+)'")).when(k == "Include", pick(rf"^INCLUDE {name}")).when(k == "ClassDefinition", pick(rf" INHERITING FROM {name}")).when(k == "InterfaceDef", pick(rf"^INTERFACES {name}"))
    )
    kind = F.when(select | k.isin("InsertDatabase", "UpdateDatabase", "ModifyDatabase", "DeleteDatabase"), "uses-table").when(k == "CallFunction", "call-function").when(k == "AuthorityCheck", "authority-check").when(k == "Include", "includes").otherwise("inherits")
    access = F.when(select, "read").when(kind == "uses-table", "write")
    return statements.select(F.col("object").alias("source"), target.alias("target"), kind.alias("kind"), access.alias("access")).where("target is not null").distinct()


def cyclomatic(statements: DataFrame) -> DataFrame:
    """File, unit (number of its opener), 1 + branches of every method, form and function."""
    branch = F.col("kind").isin("If", "ElseIf", "Case", "When", "Loop", "While", "SelectLoop", "Catch", "Check", "Assert", "Select")
    opener = F.col("kind").isin("MethodImplementation", "Form", "FunctionModule")
    unit = F.sum(opener.cast("int")).over(W.partitionBy("filename").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    return statements.withColumn("unit", unit).where("unit > 0").groupBy("filename", "unit").agg((1 + F.count_if(branch & (F.col("kind") != "Select"))).alias("cyclomatic"))


@dataclass(frozen=True)
class Seed:
    """A rule about lines: has (any case) on a line of an object of the types (all if none), if the file matches `when` and not `unless`; comments are scanned only if asked for."""

    id: str
    severity: str
    family: str
    has: str
    example: str
    counter: str
    types: tuple[str, ...] = ()
    when: str = ""
    unless: str = ""
    comments: bool = False


#: A small table of our own under known ids; a JSON file of such rows may take its place.
SEEDS = (
    Seed("talos-native-sql", "p1", "clean-core", r"^\s*EXEC\s+SQL", "EXEC SQL.", "x = 'EXEC SQL'."),
    Seed("talos-os-command", "p1", "security", r"(?<!\w)SXPG_(CALL|COMMAND)\w*|OPEN\s+DATASET.*FILTER", "CALL FUNCTION 'SXPG_COMMAND_EXECUTE'.", "CALL FUNCTION 'ZSX'."),
    Seed("talos-cloud-006-write", "p2", "clean-core", r"^\s*WRITE[\s:/]", "WRITE / 'x'.", "rewrite = 1."),
    Seed("talos-cloud-001-call-function", "p2", "clean-core", r"(?<!\w)CALL\s+FUNCTION(?!\w)", "CALL FUNCTION 'X'.", "call_function( )."),
    Seed("talos-rap-commit-work-in-handler", "p1", "rap-odata", r"(?<!\w)(COMMIT|ROLLBACK)\s+WORK(?!\w)", "COMMIT WORK. \" cl_abap_behavior_handler", "COMMIT ENTITIES. \" cl_abap_behavior_handler", when=r"cl_abap_behavior_(handler|saver)"),
    Seed("talos-cloud-020-sap-modification-marker", "p1", "modification", r"\*\$\*\$-(Start|End)", "*$*$-Start: (1)", "* start of block", comments=True),
    Seed("talos-dynamic-where-subquery", "p2", "security", r"(?<!\w)WHERE\s+\(", "SELECT a FROM t WHERE (lv_cond).", "SELECT a FROM t WHERE a = 1."),
    Seed("talos-adbc-native-bypass", "p1", "security", r"(?<!\w)CL_SQL_(STATEMENT|CONNECTION|PREPARED_STATEMENT)(?!\w)", "lo = NEW cl_sql_statement( ).", "lo = NEW cl_sql( )."),
    Seed("talos-perf-73-eml-local-mode", "p3", "rap-odata", r"(?<!\w)IN\s+LOCAL\s+MODE(?!\w)", "READ ENTITIES OF zi IN LOCAL MODE", "READ ENTITIES OF zi"),
    Seed("talos-eml-local-mode-outside-test", "p3", "rap-odata", r"(?<!\w)IN\s+LOCAL\s+MODE(?!\w)", "READ ENTITIES OF zi IN LOCAL MODE", "READ ENTITIES OF zi", unless=r"FOR\s+TESTING"),
)


def seed_findings(files: DataFrame, seeds: tuple[Seed, ...] = SEEDS) -> DataFrame:
    """F1, 2.12.1: rule_id, severity, family, object, file, line of files(object, object_type, file, source): one pass over the lines, gates once a file."""
    like = lambda c, p: F.col(c).rlike("(?i)" + p)
    on = {s.id: (like("source", s.when) if s.when else F.lit(True)) & (~like("source", s.unless) if s.unless else F.lit(True)) & (F.col("object_type").isin(*s.types) if s.types else F.lit(True)) for s in seeds}
    rows = files.withColumn("gates", F.struct(*[c.alias(f"g{i}") for i, c in enumerate(on.values())]))
    rows = rows.select("object", "file", "gates", F.posexplode(F.split("source", "\n")).alias("at", "raw")).withColumn("comment", F.col("raw").rlike(r"^\s*[*\"]"))
    hits = [F.when(F.col("gates")[f"g{i}"] & like("raw", s.has) & (F.lit(s.comments) | ~F.col("comment")), F.struct(F.lit(s.id).alias("rule_id"), F.lit(s.severity).alias("severity"), F.lit(s.family).alias("family"))) for i, s in enumerate(seeds)]
    return rows.select(F.explode(F.array_compact(F.array(*hits))).alias("h"), "object", "file", (F.col("at") + 1).cast("long").alias("line")).select("h.rule_id", "h.severity", "h.family", "object", "file", "line")
