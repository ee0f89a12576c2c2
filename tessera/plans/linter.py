"""The linter of generated code: rules of kinds and words of statements, of what is around them, of methods, views, behaviours, names and references.

Findings: rule_id, severity (error, warning, info), family, object, file, line.  Rules of single statements are rows of one table and cost one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.facts import harvested
from tessera.plans.packs import READS, WRITES, _declared, after, annotated, marked_class, marked_method, says, words


@dataclass(frozen=True)
class Lint:
    """Holds for statements of the kinds (all if none) with one of the words (all if none) and none of the others; start: words begin the statement; marks: an expression beside them."""

    id: str
    severity: str
    family: str
    kinds: tuple[str, ...] = ()
    has: tuple[str, ...] = ()
    lacks: tuple[str, ...] = ()
    start: bool = False
    marks: str = ""

    def holds(self) -> Column:
        out = F.col("kind").isin(*self.kinds) if self.kinds else F.lit(True)
        out = out & says(*self.has, start=self.start) if self.has else out
        out = out & ~says(*self.lacks) if self.lacks else out
        return out & F.col("t").rlike(self.marks) if self.marks else out


CLOUD, CORE, CLEAN, TEST = "abap-cloud", "clean-core", "clean-abap", "test-quality"
#: Rules of single statements.
LINTS = (
    Lint("gf-cloud-no-tables", "error", CLOUD, ("Tables",)), Lint("gf-cloud-no-write", "error", CLOUD, ("Write",)), Lint("gf-cloud-no-native-sql", "error", CLOUD, ("ExecSQL",)), Lint("gf-cloud-no-dynpro", "error", CLOUD, ("CallScreen", "SetScreen")),
    Lint("gf-cloud-no-call-transaction", "error", CLOUD, ("CallTransaction",)), Lint("gf-cloud-call-function", "warning", CLOUD, ("CallFunction",)), Lint("gf-clean-no-create-object", "error", CLEAN, ("CreateObject",)), Lint("gf-clean-no-concatenate", "error", CLEAN, ("Concatenate",)),
    Lint("gf-clean-no-move-to", "error", CLEAN, ("Move",), ("MOVE",), start=True), Lint("gf-clean-no-call-method", "error", CLEAN, ("Call",), ("CALL METHOD",), start=True), Lint("gf-clean-no-form", "error", CLEAN, ("Form",)), Lint("gf-cloud-no-describe-lines", "error", CLOUD, ("Describe",), ("LINES",)),
    Lint("gf-cloud-no-get-reference", "error", CLOUD, ("GetReference",)), Lint("gf-cloud-no-read-report", "error", CLOUD, ("ReadReport",)), Lint("gf-cloud-no-break-point", "error", CLOUD, ("Break",)), Lint("gf-cloud-no-leave", "error", CLOUD, ("Leave",)),
    Lint("gf-cloud-no-perform-sap", "error", CORE, ("Perform",), ("IN PROGRAM",)), Lint("gf-cloud-no-enhancement-point", "error", CORE, ("EnhancementPoint", "EnhancementSection")), Lint("gf-cloud-no-internal-badi", "error", CORE, ("InterfaceDef",), marks=r"IF_EX_\w*INTERNAL"),
    Lint("gf-cloud-message-type", "warning", CLOUD, ("Message",), marks=r"(?<!\w)TYPE\s+'?[EAXIWS]"), Lint("gf-cloud-class-not-final", "warning", CLOUD, ("ClassDefinition",), lacks=("FINAL", "ABSTRACT", "DEFERRED", "FOR TESTING")),
    Lint("gf-cloud-fs-type-any", "warning", CLOUD, ("FieldSymbol",), ("TYPE ANY",), ("TYPE ANY TABLE",)), Lint("gf-cloud-no-compute", "warning", CLEAN, ("Compute",)),
    Lint("gf-cloud-no-classic-alv", "error", CLOUD, marks=r"(?<!\w)CL_SALV_TABLE\s*=>\s*FACTORY(?!\w)"), Lint("gf-cloud-no-using-client", "error", CLOUD, has=("USING CLIENT",)), Lint("gf-cloud-no-db-cursor", "error", CLOUD, has=("OPEN CURSOR", "CLOSE CURSOR", "FETCH NEXT CURSOR")),
    Lint("gf-cloud-no-client-specified", "error", CLOUD, has=("CLIENT SPECIFIED",)), Lint("gf-cloud-sy-time-direct", "warning", CLOUD, has=("SY-UZEIT", "SY-DATUM", "SY-TIMLO", "SY-TZONE", "SY-ZONLO")), Lint("gf-cloud-no-user-exit", "warning", CORE, marks=r"^(FORM\s+USEREXIT|FUNCTION\s+CUSTOMER_FUNCTION)_"),
    Lint("gf-cloud-legacy-ui", "warning", CORE, marks=r"(?<!\w)((IF|CL)_WD|IWCI)_\w"), Lint("gf-cloud-ci-include", "warning", CORE, marks=r"(?<!\w)INCLUDE\s+STRUCTURE\s+CI_\w"), Lint("gf-cloud-segw-bopf", "warning", CORE, marks=r"/(IWBEP|BOBF)/(CL|IF)_\w"), Lint("gf-clean-bool-literal", "warning", CLEAN, marks=r"=\s*'[X ]'"),
    Lint("gf-test-friends-reach", "warning", TEST, has=("LOCAL FRIENDS",)),
    Lint("gf-clean-hungarian", "warning", CLEAN, ("Data", "ClassData"), marks=r"^(CLASS-)?DATA\s+[LGME][TVSORAIXE]_"), Lint("gf-clean-standalone-data", "warning", CLEAN, ("Data",), ("DATA % TYPE",), start=True), Lint("gf-clean-raise-exc-type", "warning", CLEAN, ("Raise",), ("TYPE",)),
    Lint("gf-clean-redundant-exporting", "warning", CLEAN, ("Call", "Move"), lacks=("IMPORTING", "CHANGING", "RECEIVING", "EXCEPTIONS"), marks=r"\(\s*EXPORTING\s"),
    Lint("gf-cloud-with-header-line", "error", CLOUD, has=("WITH HEADER LINE",)), Lint("gf-cloud-select-star", "warning", "performance", marks=r"(?<!\w)SELECT\s+(SINGLE\s+)?\*"),
)
#: Kinds that branch and nest in this linter's counts, and the two bounds of each count (above the first a warning, above the second an error).
BRANCHES, OPENS, CLOSES = ("If", "ElseIf", "When", "While", "Do", "Loop", "Catch", "Check"), ("If", "Loop", "Do", "While", "Case", "Try"), ("EndIf", "EndLoop", "EndDo", "EndWhile", "EndCase", "EndTry")
BOUNDS = {"gf-cx-param-count": (3, 6), "gf-cx-method-length": (40, 80), "gf-cx-cyclomatic": (10, 20), "gf-cx-nesting-depth": (4, 6), "gf-test-assert-count": (3, 6), "gf-test-too-many-calls": (3, None)}


def emit(rows: DataFrame, *rules: tuple[str, str | Column, str, Column]) -> DataFrame:
    """A finding for each (rule, severity, family, condition) that holds in a row (object, file, line)."""
    severity = lambda x: x if isinstance(x, Column) else F.lit(x)
    hits = F.array_compact(F.array(*[F.when(holds, F.struct(F.lit(r).alias("rule_id"), severity(v).alias("severity"), F.lit(f).alias("family"))) for r, v, f, holds in rules]))
    return rows.select(F.explode(hits).alias("h"), "object", "file", F.col("line").cast("long").alias("line")).select("h.rule_id", "h.severity", "h.family", "object", "file", "line")


def statement_rules(statements: DataFrame) -> DataFrame:
    """Rules of single statements."""
    s = statements.select("object", F.col("filename").alias("file"), F.col("row").alias("line"), "kind", F.upper("text").alias("t"))
    return emit(s, *[(r.id, r.severity, r.family, r.holds()) for r in LINTS])


def context_rules(statements: DataFrame, ahead: int = 20) -> DataFrame:
    """Rules of statements among others: in loops, after authority checks, in behaviour pools."""
    s = annotated(statements)
    k, w = F.col("kind"), W.partitionBy("file").orderBy("seq")
    out = emit(s.where("depth > 0"), ("gf-perf-select-in-loop", "warning", "performance", k.isin(*READS)), ("gf-inv-commit-in-loop", "error", "invariant", k == "Commit"))
    local = s.where(k.isin("Data", "ClassData")).select("file", "seq", after("DATA", "CLASS-DATA", start=True).alias("name")).where("name is not null")
    target = F.when(k.isin(*WRITES), after("INSERT INTO", "INSERT", "UPDATE", "MODIFY TABLE", "MODIFY", "DELETE FROM", "DELETE", start=True))
    s = _declared(s.withColumn("target", target), "target", local).withColumn("n", F.row_number().over(w))
    writes = F.col("target").isNotNull() & ~F.col("known")
    first = lambda c: F.coalesce(F.min(F.when(c, F.col("n"))).over(w.rowsBetween(1, ahead)), F.lit(1 << 30))
    a = s.withColumns({"ok": first(says("SY-SUBRC")), "wrote": first(writes), "end": first(k.isin("EndMethod", "EndForm"))}).where("kind = 'AuthorityCheck'")
    ok, wrote, end, none = F.col("ok"), F.col("wrote"), F.col("end"), 1 << 30
    late = (wrote < none) & (wrote < ok) & (wrote < end)
    seen = (ok < none) & (ok < end) & ~late
    out = out.unionByName(emit(a, ("gf-x-authcheck-subrc-after-write", "error", "invariant", late), ("gf-inv-authcheck-no-subrc", "error", "invariant", ~seen & ~late)))
    pools = s.where(F.col("t").rlike(r"(?<!\w)CL_ABAP_BEHAVIOR_(HANDLER|SAVER)(?!\w)") | ((k == "MethodDef") & says("FOR MODIFY", "FOR READ", "FOR DETERMINE", "FOR VALIDATE", "FOR LOCK", "FOR FEATURES", "FOR GLOBAL AUTHORIZATION", "FOR INSTANCE AUTHORIZATION")))
    in_pool = s.join(pools.select("object").distinct(), "object", "left_semi")
    return out.unionByName(emit(in_pool, ("gf-rap-direct-db-write", "warning", "rap-odata", writes), ("gf-rap-no-commit-in-pool", "error", "rap-odata", says("COMMIT WORK", "ROLLBACK WORK"))))


def _tier(value: Column, rule: str) -> Column:
    warn, bad = BOUNDS[rule]
    out = F.when(value > bad, "error") if bad else F
    return out.when(value > warn, "warning")


def method_rules(statements: DataFrame) -> DataFrame:
    """Counts of each method against two bounds, and what test methods do.

    One pass: what a statement says is told where it is split off, so only marks and numbers meet by file; from there on a file's rows stay together.
    """
    s = statements.select("object", F.col("filename").alias("file"), F.col("row").alias("line"), "seq", "kind", F.upper("text").alias("t"))
    k, t, no = F.col("kind"), F.col("t"), F.lit("")
    section = F.regexp_replace(F.regexp_extract("t", r"(?s)(?<!\w)IMPORTING(?!\w)(.*)$", 1), r"(?s)(?<!\w)(EXPORTING|CHANGING|RETURNING|RAISING|EXCEPTIONS|PREFERRED\s+PARAMETER)(?!\w).*$", "")
    params = F.size(F.regexp_extract_all(section, F.lit(r"\w+\s+TYPE(?!\w)"), F.lit(0)))
    s = s.select(
        "object", "file", "line", "seq", (k != "MethodImplementation").alias("body"), marked_class(k).alias("class_"), marked_method(k).alias("method_"), F.when(k.isin(*OPENS), 1).when(k.isin(*CLOSES), -1).otherwise(0).alias("step"), k.isin(*BRANCHES).alias("branch"),
        F.when(k == "MethodDef", _tier(params, "gf-cx-param-count")).alias("tier"), F.when((k == "MethodDef") & says("FOR TESTING"), after("METHODS", start=True)).alias("named"), t.rlike(words("CL_ABAP_UNIT_ASSERT", "CL_AUNIT_ASSERT")).alias("asserting"),
        F.size(F.regexp_extract_all("t", F.lit(r"->\w+\s*\("), F.lit(0))).alias("call"), t.rlike(r"(?<!\w)NEW\s+Z[CI]L_\w+\s*\(").alias("making"), k.isin(*READS, *WRITES, "ExecSQL").alias("asking"), t.rlike("CL_(ABAP_BEHV|CDS|OSQL)_TEST_ENVIRONMENT").alias("doubling"),
    )
    w = W.partitionBy("file").orderBy("seq")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(so_far)
    s = s.withColumns({"_d": F.sum("step").over(so_far), "class": F.nullif(last("class_"), no), "method": F.nullif(last("method_"), no), "unit": F.sum((~F.col("body")).cast("int")).over(so_far)})
    s = s.withColumn("_d", F.col("_d") - F.least(F.lit(0), F.min("_d").over(so_far)))
    s = s.withColumn("nest", F.coalesce(F.lag("_d").over(w), F.lit(0)))
    s = s.withColumn("base", last(F.when(~F.col("body"), F.col("nest"))))  # a unit begins with its METHOD
    m = s.groupBy("object", "file", "class", "method", "unit").agg(
        F.min("line").alias("line"), F.count_if("body").alias("count"), (1 + F.count_if("branch")).alias("cyclo"), F.coalesce(F.max(F.when(F.col("step") > 0, F.col("nest") + 1 - F.col("base"))), F.lit(0)).alias("nesting"), F.count_if("asserting").alias("asserts"),
        F.sum("call").alias("calls"), F.count_if("making").alias("made"), F.count_if("asking").alias("db"), F.max(F.col("doubling") & F.col("class").isNotNull()).alias("double"), F.max(F.col("asserting") & F.col("body")).alias("proved"),
        F.collect_set("named").alias("names"), F.collect_list(F.when(F.col("tier").isNotNull(), F.struct("tier", F.col("line").alias("at")))).alias("wide"),
    )
    m = m.withColumns({"double": F.max("double").over(W.partitionBy("file", "class")), "names": F.flatten(F.collect_list("names").over(W.partitionBy("file")))})
    inside = F.col("method").isNotNull()
    m = m.withColumn("testing", inside & F.coalesce(F.array_contains("names", F.col("method")), F.lit(False)))
    # a test method of a test include asserts nothing in any of its units: told at the first of them
    whole = W.partitionBy("file", "object", "class", "method")
    mute = F.lower("file").contains(".testclasses.") & F.col("testing") & ~F.max("proved").over(whole) & (F.col("unit") == F.min("unit").over(whole))
    m = m.withColumns({"first": F.min("line").over(whole), "mute": mute})
    counts = {"gf-cx-method-length": ("count", "complexity"), "gf-cx-cyclomatic": ("cyclo", "complexity"), "gf-cx-nesting-depth": ("nesting", "complexity"), "gf-test-assert-count": ("asserts", TEST), "gf-test-too-many-calls": ("calls", TEST)}
    found = lambda rule, severity, family, line: F.struct(F.lit(rule).alias("rule_id"), severity.alias("severity"), F.lit(family).alias("family"), line.cast("long").alias("line"))
    warning, line = F.lit("warning"), F.col("line")
    hits = []
    for rule, (name, family) in counts.items():
        v = _tier(F.col(name), rule)
        hits.append(F.when(inside & v.isNotNull() & (F.col("testing") if family == TEST else F.lit(True)), found(rule, v, family, line)))
    hits.append(F.when(F.col("testing") & (F.col("made") > 0), found("gf-test-instantiates-prod", warning, TEST, line)))
    hits.append(F.when(F.col("testing") & (F.col("db") > 0) & ~F.col("double"), found("gf-x-test-hits-real-db", warning, TEST, line)))
    hits.append(F.when(F.col("mute"), found("gf-hardy-test-no-assert", warning, TEST, F.col("first"))))
    wide = F.transform("wide", lambda x: found("gf-cx-param-count", x["tier"], "complexity", x["at"]))
    out = m.select("object", "file", F.explode(F.concat(F.array_compact(F.array(*hits)), wide)).alias("h"))
    return out.select("h.rule_id", "h.severity", "h.family", "object", "file", "h.line")


def untested(statements: DataFrame) -> DataFrame:
    """Public methods that the class's test include never names."""
    from tessera.plans.packs import test_quality

    return emit(test_quality(statements).where("rule_id = 'talos-public-method-untested'").select("object", "file", "line"), ("gf-test-public-untested", "warning", TEST, F.lit(True)))


def source_rules(files: DataFrame) -> DataFrame:
    """Rules of raw texts, at the first line that shows them: views of the old kind, markers of modifications."""
    lines = F.split("source", "\n")
    at = lambda p: F.array_position(F.transform(lines, lambda x: x.rlike(p)), F.lit(True))
    old = F.when(F.lower("file").rlike(r"\.ddls(\.asddls)?$"), at(r"(?i)(?<!\w)define\s+view(?!\w)(?!\s+entity(?!\w))"))
    marked = at(r"\*\$\*\$-(Start|End):")
    rows = files.select("object", "file", F.explode(F.array(F.struct(F.lit("c").alias("w"), old.alias("line")), F.struct(F.lit("m").alias("w"), marked.alias("line")))).alias("x")).select("object", "file", "x.w", "x.line").where("line > 0")
    return emit(rows, ("gf-cds-classic-view", "error", "cds-structure", F.col("w") == "c"), ("gf-cloud-no-mod-marker", "error", CORE, F.col("w") == "m"))


#: Findings of registry states, and words of the language that are no references.
GROUNDED = {"deprecated": ("gf-ground-deprecated", "error"), "notToBeReleased": ("gf-ground-not-released", "error"), "noAPI": ("gf-ground-no-api", "error"), "classicAPI": ("gf-ground-classic-api", "info")}
WORDS = tuple("""SELECT FROM WHERE INTO TABLE DATA TYPES CLASS METHOD METHODS ENDCLASS ENDMETHOD PUBLIC PRIVATE PROTECTED SECTION RETURNING IMPORTING EXPORTING CHANGING VALUE ABAP_TRUE ABAP_FALSE ABAP_BOOL ENDIF ENDLOOP
WHILE CASE WHEN RAISE EXCEPTION CREATE OBJECT CALL FUNCTION PERFORM REPORT DEFINE VIEW ENTITY ASSOCIATION COMPOSITION MANAGED UNMANAGED IMPLEMENTATION BEHAVIOR DEFINITION FINAL ABSTRACT INHERITING INTERFACE CONSTANTS BEGIN
APPEND INSERT UPDATE MODIFY DELETE COMMIT ROLLBACK""".split())


def grounding(files: DataFrame, registry: DataFrame) -> DataFrame:
    """References of files(object, file, source) to names whose state in the registry is no release, at their first line."""
    refs = harvested(files.withColumn("u", F.upper("source")), "file", "u", WORDS).join(registry.select(F.upper("name").alias("ref"), "state"), "ref")
    rows = refs.join(files.select("object", "file", F.upper("source").alias("u")), "file")
    at = F.array_position(F.transform(F.split("u", "\n"), lambda x: F.rlike(x, F.concat(F.lit(r"(?<![\w~])"), F.col("ref"), F.lit(r"(?![\w~])")))), F.lit(True))
    return emit(rows.withColumn("line", F.greatest(F.lit(1), at)), *[(rule, severity, "released-api", F.col("state") == state) for state, (rule, severity) in GROUNDED.items()])


def _views(files: DataFrame) -> DataFrame:
    """object, file, u (text without literals and comments), name, root, base, parent, children, keyed, open of view entities."""
    f = files.where(F.lower("file").rlike(r"\.ddls(\.asddls)?$")).withColumn("u", bare(F.col("source")))
    pick = lambda p: F.nullif(F.regexp_extract("u", "(?i)" + p, 1), F.lit(""))
    category = F.upper(F.regexp_extract("u", r"(?i)@AbapCatalog\.viewEnhancementCategory\s*:\s*\[?\s*#(\w+)", 1))
    shut = F.col("u").rlike(r"(?i)@AbapCatalog\.extensibility\.extensible\s*:\s*false")
    return f.select(
        "object", "file", "u", pick(r"(?<!\w)define\s+(?:root\s+)?view\s+entity\s+([\w/]+)").alias("name"), F.col("u").rlike(r"(?i)(?<!\w)define\s+root\s+view\s+entity").alias("root"), pick(r"(?<!\w)as\s+projection\s+on\s+([\w/]+)").alias("base"),
        pick(r"(?<!\w)association\s+(?:\[[^\]]*\]\s+)?to\s+parent\s+([\w/]+)").alias("parent"), F.regexp_extract_all("u", F.lit(r"(?i)(?<!\w)composition\s+(?:\[[^\]]*\]\s+)?of\s+([\w/]+)"), F.lit(1)).alias("children"),
        F.col("u").rlike(r"(?i)(?<!\w)key\s+[\w/]").alias("keyed"), (~category.isin("", "NONE") & ~shut).alias("open"), pick(r"(?<!\w)extend\s+view\s+entity\s+([\w/]+)").alias("extends"), F.lit(1).alias("line"),
    )


def bare(source: Column) -> Column:
    """A view's text without literals' contents and comments."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(source, r"'(?:[^']|'')*'", "''"), r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")


UI = ("headerInfo", "lineItem", "selectionField")


def view_rules(files: DataFrame) -> DataFrame:
    """Views among each other: compositions and parents, projections and interfaces, extensions, what a list page needs, names."""
    v = _views(files)
    e = v.where("name is not null")
    name, base = F.upper("name"), F.upper("base")
    own = name.rlike("^[ZY]")
    out = emit(e,
        ("gf-x-cds-node-no-key", "error", "cds-structure", ~F.col("keyed")), ("gf-x-cds-projection-not-on-interface", "warning", "cds-structure", base.rlike("(^|/)ZC_")),
        ("gf-x-cds-root-not-declared", "error", "cds-structure", (F.size("children") > 0) & F.col("parent").isNull() & ~F.col("root")),
        ("gf-x-naming-cds-projection", "warning", "naming", own & F.col("base").isNotNull() & ~name.startswith("ZC_")), ("gf-x-naming-cds-interface", "warning", "naming", own & F.col("base").isNull() & ~name.startswith("ZI_")),
    )
    known = e.select(F.lower("name").alias("child"), F.lower("parent").alias("parent"), "object", "file", "line", "open")
    composed = e.select(F.lower("name").alias("of"), F.explode("children").alias("c")).select("of", F.lower("c").alias("child")).join(known, "child")
    out = out.unionByName(emit(composed, ("gf-x-cds-composition-no-back-association", "error", "cds-structure", ~F.col("parent").eqNullSafe(F.col("of")))))
    extended = v.where("extends is not null").select("object", "file", "line", F.lower("extends").alias("child")).join(known.select("child", "open"), "child")
    out = out.unionByName(emit(extended, ("gf-x-cds-extend-base-not-extensible", "error", "cds-structure", ~F.col("open"))))

    notes = files.where(F.lower("file").rlike(r"\.ddlx(\.asddlx)?$")).select(bare(F.col("source")).alias("u"))
    notes = notes.withColumn("view", F.lower(F.regexp_extract("u", r"(?i)annotate\s+(?:view\s+)?(?:entity\s+)?([\w/]+)", 1))).groupBy("view").agg(F.array_join(F.collect_list("u"), "\n").alias("notes"))
    shown = e.where("base is not null").withColumn("view", F.lower("name")).join(notes, "view", "left").withColumn("all", F.concat_ws("\n", "u", "notes"))
    key = lambda *names: F.col("all").rlike(r"(?i)(?<!\w)(" + "|".join(names) + r")\s*:")
    whole = key("facet", "identification")
    for n in UI:
        whole = whole & key(n)
    return out.unionByName(emit(shown, ("gf-x-ui-fe-readiness", "error", "fiori-ui", F.col("all").rlike(r"@UI(?!\w)") & ~whole)))


def behavior_rules(files: DataFrame) -> DataFrame:
    """Behaviours against their classes: a saver where the save asks for one, a handler for each operation, a draft table for each entity, the class's name."""
    is_behavior = F.lower("file").rlike(r"\.bdef(\.asbdef)?$")
    b = files.where(is_behavior).withColumn("u", F.regexp_replace("source", r"//[^\n]*", ""))
    head = F.regexp_extract("u", r"(?is)^(.*?)(?:(?<!\w)define\s+behavior(?!\w)|$)", 1)
    pick = lambda p, c="u": F.nullif(F.regexp_extract(c, "(?i)" + p, 1), F.lit(""))
    b = b.withColumn("head", head).withColumns({
        "projection": F.col("head").rlike(r"(?i)(?<!\w)projection\s*;"), "class": F.lower(F.regexp_replace(pick(r"implementation\s+in\s+class\s+([\w/]+)"), "[/#]", "")), "named": pick(r"implementation\s+in\s+class\s+([\w/]+)"),
        "saver": F.col("head").rlike(r"(?i)(?<!\w)unmanaged(?!\w)|(?<!\w)managed\s+with\s+(additional|unmanaged)\s+save"), "line": F.lit(1),
    })
    code = files.where(~is_behavior).select(F.lower(F.regexp_replace(F.regexp_extract("file", r"(?i)^(.*?)\.clas(?!\w)", 1), "[/#]", "")).alias("class"), F.regexp_replace(F.regexp_replace("source", r"(?m)^\s*\*[^\n]*", ""), r'"[^\n]*', "").alias("code")).where("class <> ''")
    code = code.groupBy("class").agg(F.array_join(F.collect_list("code"), "\n").alias("code"))  # the few files of one class
    j = b.join(code, "class", "left").withColumn("code", F.coalesce("code", F.lit("")))
    saves = F.col("code").rlike(r"(?i)INHERITING\s+FROM\s+cl_abap_behavior_saver") & F.col("code").rlike(r"(?i)(?<!\w)save_modified(?!\w)")
    own = F.col("named").rlike("(?i)^[ZY]")
    out = emit(j, ("gf-x-bdef-managed-save-consistency", "error", "rap-odata", F.col("saver") & ~saves), ("gf-x-naming-behavior-pool", "warning", "naming", own & ~F.col("named").rlike("(?i)^ZBP_")))
    part = j.where("not projection").withColumn("p", F.explode(F.slice(F.split("u", r"(?i)(?<!\w)define\s+behavior\s+for\s+"), 2, 1 << 20)))
    part = part.withColumns({"entity": F.regexp_extract("p", r"^([\w/]+)", 1), "alias": pick(r"^[\w/]+\s+alias\s+(\w+)", "p"), "drafted": F.col("u").rlike(r"(?i)(?<!\w)with\s+draft(?!\w)")})
    part = part.withColumn("alias", F.coalesce("alias", "entity"))
    out = out.unionByName(emit(part, ("gf-x-bdef-draft-table-missing", "error", "rap-odata", F.col("drafted") & ~F.col("p").rlike(r"(?i)(?<!\w)draft\s+table\s+[\w/]+"))))
    every = lambda p: F.regexp_extract_all("p", F.lit("(?i)" + p), F.lit(1))
    framework = F.transform(F.concat(every(r"(?<!\w)draft\s+action\s+(?:\([^)]*\)\s*)?(\w+)"), every(r"(?<!\w)determine\s+action\s+(\w+)")), F.lower)
    actions = F.filter(every(r"(?<!\w)action\s+(?:\([^)]*\)\s*)?(\w+)"), lambda x: ~F.array_contains(framework, F.lower(x)))
    ops = part.select("object", "file", "line", "alias", "code", F.explode(F.array_distinct(F.concat(every(r"(?<!\w)(?:determination|validation)\s+(\w+)\s+on\s+(?:save|modify)"), actions))).alias("op"))
    binding = F.concat(F.lit(r"(?i)(?<!\w)FOR\s+(ACTION\s+)?"), F.col("alias"), F.lit(r"\s*~\s*"), F.col("op"), F.lit(r"(?!\w)"))
    return out.unionByName(emit(ops, ("gf-x-bdef-handler-reconciliation", "error", "rap-odata", ~F.rlike("code", binding))))


def lint(files: DataFrame, statements: DataFrame, registry: DataFrame | None = None) -> dict:
    """The packs of this linter, each a function without arguments (see packs.isolated)."""
    packs = {
        "statements": lambda: statement_rules(statements), "context": lambda: context_rules(statements), "methods": lambda: method_rules(statements), "untested": lambda: untested(statements),
        "sources": lambda: source_rules(files), "views": lambda: view_rules(files), "behaviors": lambda: behavior_rules(files),
    }
    return packs | ({"grounding": lambda: grounding(files, registry)} if registry is not None else {})


