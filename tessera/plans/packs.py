"""Rule packs of the analyser over statements, graphs, dictionary objects, views, behaviours and services.

A pack is a function of canonical tables that gives findings (rule_id, severity, family, object, file, line).  What a statement holds is told
by words: `words("UP TO % ROWS")` fits those words in a row, any token in place of the percent sign.  All packs over statements share one partitioning: the file.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.scalars import namespace
from tessera.operators.graph import cut, strong_components
from tessera.operators.joins import with_owners
from tessera.plans.documents import dangling_symbols

#: Severity and family of each rule.
RULES = {
    "talos-fae-no-guard": ("p1", "performance"), "talos-rap-modify-no-guard": ("p1", "rap-odata"), "talos-rap-modify-entities-in-read-handler": ("p1", "rap-odata"), "talos-data-in-block": ("p2", "anti-pattern"),
    "talos-cloud-021-direct-table-write": ("p1", "clean-core"), "talos-bapi-in-enhancement": ("info", "deprecation"), "talos-binary-search-no-order-by": ("p2", "performance"), "talos-fae-unindexed-where": ("p2", "performance"),
    "talos-fae-nonpk-where-prefix": ("p2", "performance"), "talos-select-single-partial-key": ("p2", "performance"), "talos-client-sort-after-select": ("p2", "performance"),
    "talos-repeated-select-single": ("p2", "performance"), "talos-cds-join-candidate": ("info", "performance"),
    "talos-god-object": ("p3", "anti-pattern"), "talos-high-fan-out": ("p3", "anti-pattern"), "talos-dependency-cycle": ("p2", "anti-pattern"),
    "talos-legacy-ui-rollup": ("p2", "clean-core"), "talos-filter-not-delegated": ("p2", "rap-odata"), "talos-heavy-loop-calc": ("p3", "performance"), "talos-lock-held-across-calls": ("p2", "performance"), "talos-dangling-field-symbol": ("p2", "invariant"),
    "talos-tabl-cluster-pool": ("p1", "deprecation"), "talos-tabl-low-cardinality-key": ("p2", "performance"), "talos-tabl-buffered-write": ("p2", "performance"), "talos-append-on-sap-table": ("p2", "clean-core"), "talos-dtel-conversion-exit": ("p3", "performance"), "talos-dtel-duplicates-sap": ("info", "clean-core"),
    "talos-rap-draft-child-create": ("p1", "rap-odata"), "talos-rap-draft-table-no-uuid": ("p1", "rap-odata"), "talos-strict-call-transaction": ("p1", "clean-core"), "talos-strict-direct-db": ("p1", "clean-core"), "talos-rap-read-unbounded": ("p1", "rap-odata"),
    "talos-cds-too-many-tables": ("p1", "performance"), "talos-cds-service-quality-mismatch": ("p2", "performance"), "talos-cds-cyclic-join": ("p1", "performance"), "talos-cds-calc-field-in-join": ("p2", "performance"), "talos-cds-calc-field-in-where": ("p2", "performance"),
    "talos-cds-business-logic": ("p2", "performance"), "talos-cds-field-order": ("info", "performance"), "talos-cds-groupby-in-reuse": ("p2", "performance"), "talos-cds-composite-direct-ddic": ("p2", "performance"),
    "talos-missing-test-class": ("p2", "anti-pattern"), "talos-test-no-assert": ("p2", "anti-pattern"), "talos-public-method-untested": ("p3", "anti-pattern"), "talos-intf-read-no-paging": ("p2", "performance"), "talos-intf-no-batch-sibling": ("p2", "performance"),
    "talos-bf-owned-object-ref": ("p1", "clean-core"), "talos-bf-always-off-probe": ("p1", "clean-core"), "talos-srvb-no-paging-policy": ("p1", "rap-odata"), "talos-srvb-offset-paging": ("p2", "rap-odata"),
    "talos-duplicate-block": ("p3", "anti-pattern"), "released-api": ("p2", "released-api"),
}
#: Statement kinds by what they do, fields that often lead a primary key, operators that build a value in place.
LOOPS, LOOP_ENDS = ("Loop", "While", "Do", "SelectLoop"), ("EndLoop", "EndWhile", "EndDo", "EndSelect")
BLOCKS, BLOCK_ENDS = (*LOOPS, "If", "Case"), (*LOOP_ENDS, "EndIf", "EndCase")
WRITES, READS = ("InsertDatabase", "UpdateDatabase", "ModifyDatabase", "DeleteDatabase"), ("Select", "SelectLoop")
KEY_LEADS = tuple("MANDT BUKRS BELNR GJAHR MATNR VBELN POSNR KUNNR LIFNR WERKS EBELN EBELP AUFNR KOKRS PERNR OBJNR EQUNR TPLNR QMNUM BANFN BNFPO RLDNR RBUKRS CARRID CONNID SPRAS LANGU".split())
BUILDERS = tuple("VALUE NEW CONV CORRESPONDING CAST REF EXACT REDUCE FILTER COND SWITCH".split())
ASSERTION = "CL_ABAP_UNIT_ASSERT", "CL_AUNIT_ASSERT"


def words(*options: str, start: bool = False) -> str:
    """An expression for any of the options: words in a row, % any token; `start`: at the beginning of the statement."""
    each = [re.escape(o).replace(r"\ ", r"\s+").replace("%", r"\S+") for o in options]
    return ("^" if start else r"(?<![\w~])") + "(?:" + "|".join(each) + r")(?![\w~])"


def says(*options: str, start: bool = False) -> Column:
    return F.col("t").rlike(words(*options, start=start))


def after(*heads: str, start: bool = False) -> Column:
    """The name that follows one of the heads (an at sign before it doesn't count); null if there is none."""
    heads = [re.escape(h).replace(r"\ ", r"\s+") for h in heads]
    return F.nullif(F.regexp_extract("t", ("^" if start else r"(?<![\w~])") + "(?:" + "|".join(heads) + r")\s+@?(\w+)", 1), F.lit(""))


def findings(rows: DataFrame, *rules: tuple[str, Column]) -> DataFrame:
    """A finding for each rule that holds in a row (object, file, line)."""
    hits = F.array_compact(F.array(*[F.when(holds, F.struct(F.lit(r).alias("rule_id"), F.lit(RULES[r][0]).alias("severity"), F.lit(RULES[r][1]).alias("family"))) for r, holds in rules]))
    return rows.select(F.explode(hits).alias("h"), "object", "file", "line").select("h.rule_id", "h.severity", "h.family", "object", "file", "line")


def _running(df: DataFrame, name: str, opens: tuple[str, ...], closes: tuple[str, ...]) -> DataFrame:
    """Depth before each statement: openers less closers so far, never below zero."""
    w = W.partitionBy("file").orderBy("seq")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    d = df.withColumn("_d", F.sum(F.when(F.col("kind").isin(*opens), 1).when(F.col("kind").isin(*closes), -1).otherwise(0)).over(so_far))
    d = d.withColumn("_d", F.col("_d") - F.least(F.lit(0), F.min("_d").over(so_far)))
    return d.withColumn(name, F.coalesce(F.lag("_d").over(w), F.lit(0))).drop("_d")


def marked_class(k: Column) -> Column:
    """The class that begins at a statement (an empty text: one ends), else null; t: upper-case text."""
    return F.when(k.isin("ClassDefinition", "ClassImplementation", "Interface"), after("CLASS", "INTERFACE", start=True)).when(k == "EndClass", F.lit(""))


def marked_method(k: Column) -> Column:
    """The same of methods."""
    return F.when(k == "MethodImplementation", F.regexp_extract("t", r"^METHOD\s+([\w~]+)", 1)).when(k.isin("EndMethod", "EndClass", "ClassDefinition", "ClassImplementation"), F.lit(""))


def annotated(statements: DataFrame) -> DataFrame:
    """Statements with t (upper-case text), loop, block and enhancement depth before them, class, method and the number of their method."""
    w = W.partitionBy("file").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    d = statements.select("object", "object_type", F.col("filename").alias("file"), F.col("row").alias("line"), "seq", "kind", F.upper("text").alias("t"))
    for name, opens, closes in (("depth", LOOPS, LOOP_ENDS), ("block", BLOCKS, BLOCK_ENDS), ("enhancement", ("Enhancement",), ("EndEnhancement",))):
        d = _running(d, name, opens, closes)
    k, no = F.col("kind"), F.lit("")
    named = lambda c: F.nullif(F.last(c, ignorenulls=True).over(w), no)
    return d.withColumns({"class": named(marked_class(k)), "method": named(marked_method(k)), "unit": F.sum((k == "MethodImplementation").cast("int")).over(w)})


def _declared(rows: DataFrame, name: str, by: DataFrame) -> DataFrame:
    """rows with `known`: whether `by` (file, name, seq) has the name in the same file at an earlier statement."""
    first = by.groupBy("file", "name").agg(F.min("seq").alias("_first")).withColumnRenamed("name", name)
    return rows.join(first, ["file", name], "left").withColumn("known", F.coalesce(F.col("_first") < F.col("seq"), F.lit(False))).drop("_first")


def statement_context(statements: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Rules that need what is around a statement.  tables: object, keys, leads (of secondary indexes) of the dictionary tables in the bundle."""
    s = annotated(statements)
    w = W.partitionBy("file").orderBy("seq")
    k = F.col("kind")
    local = s.where(k.isin("Data", "ClassData")).select("file", "seq", after("DATA", "CLASS-DATA", start=True).alias("name")).where("name is not null")
    back = [F.lag("t", i).over(w) for i in range(1, 7)]
    s = s.withColumn("before", F.array_compact(F.array(*back))).withColumn("near", F.array_compact(F.array(*[F.lag(F.struct("kind", "t"), i).over(w) for i in (1, 2, 3)])))

    # a driver that may be empty, without a look at it in the statements before
    drivers = s.where(k.isin(*READS) | (k == "ModifyEntities")).withColumn("d", F.when(k == "ModifyEntities", after("WITH")).otherwise(after("FOR ALL ENTRIES IN"))).where("d is not null")
    built = F.col("d").isin(*BUILDERS)
    source = F.coalesce(F.nullif(F.regexp_extract("t", r"(?<!\w)FOR\s+\w+\s+IN\s+@?(\w+)", 1), F.lit("")), F.when(says("CORRESPONDING"), F.nullif(F.regexp_extract("t", r"CORRESPONDING[^(]*\(\s*@?(\w+)", 1), F.lit(""))))
    drivers = _declared(drivers.withColumn("from_", F.when(built, source)), "from_", local).where(~built | F.col("known")).withColumn("d", F.coalesce("from_", "d"))
    seen = F.exists("before", lambda t: t.contains(F.col("d")) & (t.contains("IS INITIAL") | t.contains("IS NOT INITIAL") | t.contains("LINES(")))
    out = findings(drivers.where(~seen), ("talos-fae-no-guard", k != "ModifyEntities"), ("talos-rap-modify-no-guard", k == "ModifyEntities"))

    # a read handler that changes data: defined anywhere in the object's files
    handlers = s.where((k == "MethodDef") & says("FOR READ")).select("object", "class", after("METHODS", start=True).alias("method")).where("method is not null").distinct()
    out = out.unionByName(findings(s.where(k == "ModifyEntities").join(handlers, ["object", "class", "method"], "left_semi"), ("talos-rap-modify-entities-in-read-handler", F.lit(True))))

    # a statement alone with its depths
    out = out.unionByName(findings(s, ("talos-data-in-block", k.isin("Data", "ClassData") & (F.col("block") > 0)), ("talos-bapi-in-enhancement", (k == "CallFunction") & (F.col("enhancement") > 0) & F.col("t").contains("CALL FUNCTION 'BAPI_"))))

    # writes to tables of the platform: neither customer names nor names declared before
    target = after("INSERT INTO", "INSERT", "UPDATE", "MODIFY TABLE", "MODIFY", "DELETE FROM", "DELETE", start=True)
    written = s.where(k.isin(*WRITES)).withColumn("target", target).where(~F.substring("target", 1, 1).isin("Z", "Y", "Q"))
    out = out.unionByName(findings(_declared(written, "target", local), ("talos-cloud-021-direct-table-write", ~F.col("known"))))

    # searches by halves in what no order was asked for
    reads = s.where(k.isin(*READS))
    into = F.nullif(F.regexp_extract("t", r"(?<!\w)INTO\s+TABLE\s+@?(?:DATA\()?(\w+)", 1), F.lit(""))
    unordered = reads.where(~says("ORDER BY")).select("file", "seq", into.alias("name")).where("name is not null")
    searched = s.where((k == "ReadTable") & says("BINARY SEARCH")).withColumn("itab", after("READ TABLE", start=True))
    out = out.unionByName(findings(_declared(searched, "itab", unordered), ("talos-binary-search-no-order-by", F.col("known"))))

    # conditions against the keys of tables: those of the bundle, else fields that lead keys often
    empty = statements.sparkSession.createDataFrame([], "object string, keys array<string>, leads array<string>")
    known = (tables if tables is not None else empty).select(F.upper("object").alias("table"), F.transform("keys", F.upper).alias("keys"), F.transform("leads", F.upper).alias("leads"))
    table = F.nullif(F.regexp_extract("t", r"(?<!\w)FROM\s+(?!@)(\w+)", 1), F.lit(""))
    q = reads.withColumn("table", table).withColumn("lead", after("WHERE")).join(known, "table", "left")
    each, lead, inside = says("FOR ALL ENTRIES IN") & F.col("lead").isNotNull(), F.col("lead"), F.col("keys").isNotNull()
    fields = F.filter("keys", lambda x: ~x.isin("MANDT", "CLIENT"))
    condition = F.regexp_extract("t", r"(?<!\w)WHERE(?!\w)(.*)$", 1)
    present = F.filter(fields, lambda x: F.rlike(condition, F.concat(F.lit(r"(?<![\w~])"), x, F.lit(r"(?![\w~])"))))
    partial = inside & ~F.array_contains("keys", ".INCLUDE") & (F.size(fields) >= 2) & (F.size(present) > 0) & (F.size(present) < F.size(fields))
    out = out.unionByName(findings(q,
        ("talos-fae-unindexed-where", each & inside & ~F.array_contains("keys", lead) & ~F.array_contains("leads", lead)),
        ("talos-fae-nonpk-where-prefix", each & ~inside & ~lead.isin(*KEY_LEADS)),
        ("talos-select-single-partial-key", says("SELECT SINGLE", start=True) & says("WHERE") & F.coalesce(partial, F.lit(False))),
    ))

    # a sort of what the statement before could have been asked to order
    sorted_ = s.where(k == "Sort").withColumn("itab", after("SORT", start=True)).where("itab is not null")
    latest = F.get(F.filter("near", lambda x: (x["kind"] == "Select") & x["t"].contains("INTO TABLE") & x["t"].contains(F.col("itab"))), 0)["t"]
    return out.unionByName(findings(sorted_, ("talos-client-sort-after-select", F.coalesce(~latest.contains("ORDER BY"), F.lit(False)))))


def statement_files(statements: DataFrame) -> DataFrame:
    """Rules about all statements of a file: the same single row read three times, three tables read one by one."""
    s = statements.select("object", F.col("filename").alias("file"), F.col("row").alias("line"), "seq", "kind", F.upper("text").alias("t")).where(F.col("kind").isin(*READS))
    same = F.trim(F.regexp_replace(F.regexp_replace("t", r"(?<!\w)INTO(?!\w).*?(?=(?<!\w)WHERE(?!\w)|$)", " "), r"\s+", " "))
    first = lambda rows, *keys: rows.groupBy("object", "file", *keys).agg(F.min_by("line", "seq").alias("line"), F.count("*").alias("n"))
    again = first(s.where(says("SELECT SINGLE", start=True)).withColumn("q", same), "q").where("n >= 3")
    out = findings(again, ("talos-repeated-select-single", F.lit(True)))
    table = F.nullif(F.regexp_extract("t", r"(?<!\w)FROM\s+(?!@)(\w+)", 1), F.lit(""))
    many = s.withColumn("table", table).where("table is not null").groupBy("object", "file").agg(F.min_by("line", "seq").alias("line"), F.countDistinct("table").alias("n")).where("n >= 3")
    return out.unionByName(findings(many, ("talos-cds-join-candidate", F.lit(True))))


def numbered(ids: DataFrame, name: str) -> DataFrame:
    """Distinct ids with a number each, fixed by a checkpoint."""
    return cut(ids.select(name).distinct().withColumn("number", F.monotonically_increasing_id()))


def graph_pack(edges: DataFrame, nodes: DataFrame, fan_in: int = 10, fan_out: int = 20) -> DataFrame:
    """Customer objects that many depend on, that depend on many, or that are part of a cycle."""
    links = cut(with_owners(edges, nodes).select(F.col("source_owner").alias("s"), F.col("target_owner").alias("o")).where("s <> o").distinct())
    counts = links.select(F.col("s").alias("object"), F.lit(1).alias("out"), F.lit(0).alias("in_")).unionByName(links.select(F.col("o").alias("object"), F.lit(0).alias("out"), F.lit(1).alias("in_")))
    counts = counts.groupBy("object").agg(F.sum("out").alias("out"), F.sum("in_").alias("in_"))
    ids = numbered(links.select(F.col("s").alias("object")).union(links.select("o")), "object")
    pairs = links.join(ids.select(F.col("object").alias("s"), F.col("number").alias("a")), "s").join(ids.select(F.col("object").alias("o"), F.col("number").alias("b")), "o").select("a", "b")
    roots = strong_components(pairs)
    cyclic = roots.join(roots.groupBy("root").agg(F.count("*").alias("n")).where("n > 1"), "root", "left_semi").select(F.col("id").alias("number")).join(ids, "number").select("object", F.lit(True).alias("cyclic"))
    rows = counts.join(cyclic, "object", "left").where(namespace(F.col("object")).isin("Z", "Y")).withColumns({"file": F.lit(None).cast("string"), "line": F.lit(None).cast("long")})
    return findings(rows, ("talos-god-object", F.col("in_") >= fan_in), ("talos-high-fan-out", F.col("out") >= fan_out), ("talos-dependency-cycle", F.col("cyclic")))


def flow(statements: DataFrame, heavy: int = 8, legacy: int = 3) -> DataFrame:
    """Rules about what lies between two statements: loops, locks, handlers of sets, and the classic screens of an object."""
    s = annotated(statements)
    k = F.col("kind")
    w = W.partitionBy("file").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    screens = s.where(says("WRITE", "CALL SCREEN", "SET SCREEN", "LEAVE SCREEN", "LEAVE PROGRAM", start=True) | F.col("t").rlike(r"^CALL\s+FUNCTION\s+'REUSE_ALV"))
    per_object = screens.groupBy("object").agg(F.count("*").alias("n"), F.min(F.struct("file", "seq", "line")).alias("at")).where(F.col("n") >= legacy)
    out = findings(per_object.select("object", "at.file", "at.line"), ("talos-legacy-ui-rollup", F.lit(True)))

    sets = s.where(k == "MethodDef").select("object", after("METHODS", start=True).alias("method")).where(F.col("method").contains("GET_ENTITYSET")).distinct()
    unfiltered = s.where(k.isin(*READS) & ~says("WHERE")).join(sets, ["object", "method"], "left_semi")
    out = out.unionByName(findings(unfiltered, ("talos-filter-not-delegated", F.lit(True))))

    # outermost loops by number: the arithmetic in them, once they are closed
    opens = k.isin(*LOOPS) & (F.col("depth") == 0)
    plain = F.regexp_replace("t", r"'[^']*'", "''")
    sums = (F.col("depth") > 0) & ~k.isin(*LOOPS, *LOOP_ENDS) & plain.rlike(r"^\w[\w-]*\s*=\s") & plain.rlike(r"\s[-+*/]+\s")
    in_loops = s.withColumn("loop", F.sum(opens.cast("int")).over(w)).where("loop > 0")
    loops = in_loops.groupBy("object", "file", "loop").agg(F.count_if(sums).alias("n"), F.min_by("line", "seq").alias("line"), F.max(k.isin(*LOOP_ENDS) & (F.col("depth") == 1)).alias("closed"))
    out = out.unionByName(findings(loops.where(F.col("closed") & (F.col("n") >= heavy)), ("talos-heavy-loop-calc", F.lit(True))))

    # locks: from where one is taken to where it is given back or the method ends, the first other call
    module = F.when(k == "CallFunction", F.regexp_extract("t", r"CALL\s+FUNCTION\s+'([^']+)'", 1))
    taken, given = module.startswith("ENQUEUE_"), module.startswith("DEQUEUE_")
    mark = F.when(taken, F.lit(True)).when(given | (k == "EndMethod"), F.lit(False))
    held = s.withColumn("mark", mark).withColumn("window", F.count("mark").over(w)).withColumn("held", F.last("mark", ignorenulls=True).over(w))
    calls = held.where((k == "CallFunction") & F.col("held") & F.col("mark").isNull())
    first = calls.groupBy("object", "file", "window").agg(F.min_by("line", "seq").alias("line"))
    out = out.unionByName(findings(first, ("talos-lock-held-across-calls", F.lit(True))))

    loose = dangling_symbols(statements).select(F.col("filename").alias("file"), F.col("row").alias("line")).join(statements.select(F.col("filename").alias("file"), "object").distinct(), "file")
    return out.unionByName(findings(loose, ("talos-dangling-field-symbol", F.lit(True))))


def written_tables(statements: DataFrame) -> DataFrame:
    """object: tables that statements write to."""
    s = statements.where(F.col("kind").isin(*WRITES)).select(F.upper("text").alias("t"))
    return s.select(after("INSERT INTO", "INSERT", "UPDATE", "MODIFY TABLE", "MODIFY", "DELETE FROM", "DELETE", start=True).alias("object")).where("object is not null").distinct()


def dictionary(tables: DataFrame, elements: DataFrame, domains: DataFrame, statements: DataFrame) -> DataFrame:
    """tables: object, file, category, fields, keys, buffered, extends; elements: object, file, domain; domains: domain, exit."""
    t = tables.withColumn("line", F.lit(1)).join(written_tables(statements).withColumn("w", F.lit(True)), "object", "left")
    real = F.filter("keys", lambda x: x != "MANDT")
    only_client = (F.col("category") == "TRANSP") & (F.size("fields") > 0) & ~F.array_contains("keys", ".INCLUDE") & (F.size(real) == 0)
    out = findings(t,
        ("talos-tabl-cluster-pool", F.col("category").isin("CLUSTER", "POOL")), ("talos-tabl-low-cardinality-key", only_client), ("talos-tabl-buffered-write", F.col("buffered") & F.col("w")),
        ("talos-append-on-sap-table", (F.col("category") == "APPEND") & (namespace(F.col("extends")) == "sap")),
    )
    e = elements.withColumn("domain", F.upper("domain")).join(domains.select(F.upper("domain").alias("domain"), "exit"), "domain", "left").withColumn("line", F.lit(1))
    return out.unionByName(findings(e, ("talos-dtel-conversion-exit", F.coalesce(F.col("exit"), F.lit("")) != ""), ("talos-dtel-duplicates-sap", namespace(F.col("object")).isin("Z", "Y") & (namespace(F.col("domain")) == "sap"))))


def behavior_context(behaviors: DataFrame, statements: DataFrame, tables: DataFrame) -> DataFrame:
    """behaviors: object, file, source, class, entities (as parsed); tables: object, keys."""
    low = F.lower("source")
    pick = lambda p: F.nullif(F.upper(F.regexp_extract("source", f"(?i){p}", 1)), F.lit(""))
    strict = F.when(low.rlike(r"(?<!\w)strict\s*(\(\s*\d\s*\))?\s*;"), F.coalesce(F.nullif(F.regexp_extract(low, r"(?<!\w)strict\s*\(\s*(\d)", 1), F.lit("")).cast("int"), F.lit(1))).otherwise(0)
    b = behaviors.withColumns({"strict": strict, "draft": low.rlike(r"(?<!\w)with\s+draft(?!\w)"), "late": low.rlike(r"(?<!\w)late\s+numbering(?!\w)"), "drafts": pick(r"(?<!\w)draft\s+table\s+([\w/]+)"), "line": F.lit(1)})
    parts = F.slice(F.split(low, r"define\s+behavior\s+for\s"), 3, 1 << 20)  # what stands before the first entity, the root, then its children
    creates = F.exists(parts, lambda p: F.regexp_replace(p, r"association\s+_\w+\s*\{[^}]*\}", "").rlike(r"(?<!\w)create\s*;"))
    b = b.join(tables.select(F.upper("object").alias("drafts"), F.transform("keys", F.upper).alias("draft_keys")), "drafts", "left")
    no_uuid = F.col("draft") & F.col("late") & F.col("draft_keys").isNotNull() & ~F.array_contains("draft_keys", "DRAFTUUID")
    out = findings(b, ("talos-rap-draft-child-create", F.col("draft") & creates), ("talos-rap-draft-table-no-uuid", no_uuid))

    s = annotated(statements)
    k = F.col("kind")
    classes = b.where("class is not null").groupBy(F.upper("class").alias("object")).agg(F.max("strict").alias("strict"))
    own = s.withColumn("object", F.upper("object")).join(F.broadcast(classes) if classes.count() <= 100_000 else classes, "object")
    out = out.unionByName(findings(own.where("strict >= 2"), ("talos-strict-call-transaction", k == "CallTransaction"), ("talos-strict-direct-db", k.isin(*WRITES))))
    readers = s.where((k == "MethodDef") & says("FOR READ")).select(F.upper("object").alias("object"), after("METHODS", start=True).alias("method")).distinct()
    bounded = says("SELECT SINGLE", start=True) | says("FOR ALL ENTRIES", "UP TO", "PACKAGE SIZE")
    return out.unionByName(findings(own.where(k.isin(*READS) & ~bounded).join(readers, ["object", "method"], "left_semi"), ("talos-rap-read-unbounded", F.lit(True))))


#: Calculating functions of the view language, and tables that each grade of service may join.
CALCULATES = ("CAST", "CONCAT", "SUBSTRING", "COALESCE", "DIVISION", "LEFT", "RIGHT", "UPPER", "LOWER", "REPLACE")
TABLES, GRADED, REPEATS, CASES = 100, {"A": 3, "B": 5}, 3, 3


def view_structure(files: DataFrame) -> DataFrame:
    """files: object, file, source of views."""
    v = files.withColumns({"u": F.upper("source"), "line": F.lit(1)})
    u = F.col("u")
    v = v.withColumn("tables", F.regexp_extract_all("u", F.lit(r"(?<![\w.])(?:FROM|JOIN)\s+([\w/]+)"), F.lit(1)))
    v = v.withColumn("distinct_", F.array_distinct("tables"))
    n = F.size("distinct_")
    grade = F.regexp_extract(u, r"@OBJECTMODEL\.USAGETYPE\.SERVICEQUALITY\s*:\s*#([AB])(?!\w)", 1)
    limit = F.coalesce(*[F.when(grade == g, F.lit(x)) for g, x in GRADED.items()])
    often = F.exists("distinct_", lambda x: F.size(F.filter("tables", lambda y: y == x)) >= REPEATS)
    calculates = words("CASE") + "|" + words(*CALCULATES) + r"\s*\("
    joins = F.regexp_extract_all("u", F.lit(r"(?s)(?<!\w)JOIN(?!\w).*?(?<!\w)ON(?!\w)(.*?)(?=(?<!\w)JOIN(?!\w)|\{|$)"), F.lit(1))
    where = F.regexp_extract(u, r"(?s)(?<!\w)WHERE(?!\w)(.*?)(?=(?<!\w)GROUP\s+BY(?!\w)|(?<!\w)UNION(?!\w)|$)", 1)
    body = F.regexp_extract(u, r"(?s)(?<!\w)SELECT(?!\w)[^{]*\{(.*)\}", 1)
    elements = F.filter(F.transform(F.split(body, ","), lambda e: F.trim(F.regexp_replace(e, r"^[\s\n]+", ""))), lambda e: e != "")
    is_key = F.transform(elements, lambda e: e.rlike(r"^KEY\s"))
    late = F.coalesce(F.array_position(is_key, F.lit(False)), F.lit(0))
    late_key = (late > 0) & F.array_contains(F.slice(is_key, F.greatest(late, F.lit(1)).cast("int"), F.greatest(F.size(is_key), F.lit(1))), True)
    layer = F.regexp_extract(u, r"@VDM\.VIEWTYPE\s*:\s*#(\w+)", 1)
    basic = layer.isin("BASIC", "COMPOSITE") | u.rlike(r"(?<!\w)DEFINE\s+VIEW(\s+ENTITY)?\s+Z?I_")
    direct = F.exists("tables", lambda x: ~x.rlike("^(Z?[IC]_|/)"))
    return findings(v,
        ("talos-cds-too-many-tables", n > TABLES), ("talos-cds-service-quality-mismatch", n > limit), ("talos-cds-cyclic-join", often), ("talos-cds-calc-field-in-join", F.exists(joins, lambda x: x.rlike(calculates))),
        ("talos-cds-calc-field-in-where", where.rlike(calculates)), ("talos-cds-business-logic", F.size(F.regexp_extract_all(body, F.lit(words("CASE")), F.lit(0))) >= CASES), ("talos-cds-field-order", late_key),
        ("talos-cds-groupby-in-reuse", u.rlike(r"(?<!\w)GROUP\s+BY(?!\w)") & basic), ("talos-cds-composite-direct-ddic", layer.isin("COMPOSITE", "CONSUMPTION") & direct),
    )


def _note(name: str, value: str = "") -> str:
    """An expression for an annotation, with a value if one is given."""
    return r"@" + re.escape(name) + (r"\s*:\s*" + re.escape(value) if value else "")


#: Rules about annotations and headers: severity, family, kinds of objects, and what they ask of the text (gate, exception, required, barred).
DDLS, BDEF = ("DDLS",), ("BDEF",)
PRIVATE = _note("VDM.private", "true")
METADATA = {
    "talos-cds-auth-not-required": ("p2", "security", DDLS, None, _note("ObjectModel.query.implementedBy"), None, _note("AccessControl.authorizationCheck", "#NOT_REQUIRED")),
    "talos-cds-missing-access-control": ("p2", "security", DDLS, None, None, _note("AccessControl.authorizationCheck"), None),
    "talos-cds-legacy-sqlview": ("p2", "deprecation", DDLS, None, None, None, _note("AbapCatalog.sqlViewName")),
    "talos-rap-draft-no-optimistic-lock": ("p2", "rap-odata", (*DDLS, *BDEF), words("with draft") + "|" + _note("ObjectModel.draftEnabled"), words("total etag") + "|" + _note("Semantics.systemDate.lastChangedAt"), _note("ObjectModel.draftEnabled.lockingMode"), None),
    "talos-cds-analytical-missing-analytics": ("p2", "rap-odata", DDLS, "AnalyticalListPage|" + _note("UI.headerInfo"), None, _note("Analytics.dataCategory"), None),
    "talos-cds-virtual-element-cost": ("info", "rap-odata", DDLS, None, None, None, _note("ObjectModel.virtualElement")),
    "talos-cds-expand-no-cardinality-cap": ("p2", "rap-odata", DDLS, None, None, None, r"composition\s*\[\s*0\.\.\*\s*\](?!.*maxItems)"),
    "talos-rap-early-numbering": ("p2", "rap-odata", BDEF, None, None, None, words("early numbering")),
    "talos-rap-deep-create-no-cap": ("p3", "rap-odata", BDEF, None, None, None, r"association\s+_\w+\s*\{[^}]*" + words("create")),
    "talos-rap-mixed-managed-unmanaged": ("p1", "rap-odata", BDEF, words("managed implementation"), None, None, words("unmanaged implementation")),
    "talos-cds-missing-service-quality": ("p3", "performance", DDLS, None, PRIVATE, _note("ObjectModel.usageType.serviceQuality"), None),
    "talos-cds-missing-size-category": ("p3", "performance", DDLS, None, PRIVATE, _note("ObjectModel.usageType.sizeCategory"), None),
    "talos-cds-missing-data-class": ("p3", "performance", DDLS, None, PRIVATE, _note("ObjectModel.usageType.dataClass"), None),
    "talos-cds-missing-view-enhancement-category": ("p3", "performance", DDLS, None, PRIVATE, _note("AbapCatalog.viewEnhancementCategory"), None),
}


def _like(pattern: str) -> Callable[[Column], Column]:
    return lambda x: x.rlike(pattern)


def metadata(files: DataFrame) -> DataFrame:
    """files(object, object_type, file, source): what a file lacks or must not have; a barred text is reported once, at its first line."""
    s, has = F.col("source"), lambda p: F.col("source").rlike("(?i)" + p)
    lines = F.split(s, "\n")
    hits = []
    for rule, (severity, family, types, gate, exception, required, barred) in METADATA.items():
        on = F.col("object_type").isin(*types)
        on = on & has(gate) if gate else on
        on = on & ~has(exception) if exception else on
        line = F.lit(1)
        if barred:
            line = F.array_position(F.transform(lines, _like("(?i)" + barred)), F.lit(True)).cast("int")
            on = on & (line > 0)
        else:
            on = on & ~has(required)
        hits.append(F.when(on, F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(family).alias("family"), line.cast("long").alias("line"))))
    return files.select(F.explode(F.array_compact(F.array(*hits))).alias("h"), "object", "file").select("h.rule_id", "h.severity", "h.family", "object", "file", "h.line")


def released_api(edges: DataFrame, registry: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Uses of objects that the registry doesn't release, one finding for each source and target: gone ones weigh more."""
    r = registry.select(F.col("name").alias("target"), "state", "successor")
    e = edges.where(F.col("kind").isin(*kinds)).select("source", "target").distinct().join(r, "target").where("state not in ('released', 'unknown')")
    severity = F.when(F.col("state").isin("removed", "notToBeReleased"), "p1").otherwise("p2")
    return e.select(F.lit("released-api").alias("rule_id"), severity.alias("severity"), F.lit("released-api").alias("family"), F.col("source").alias("object"), "target", "state", "successor")


def missing_tests(files: DataFrame) -> DataFrame:
    """files(object, object_type, file, source): classes without a test include and without test classes of their own; test classes need none."""
    c = files.where("object_type = 'CLAS'").withColumns({"test": F.lower("file").contains(".testclasses."), "has": F.upper("source").rlike(words("FOR TESTING"))})
    per = c.groupBy("object").agg(F.max(F.col("test") | F.col("has")).alias("tested"), F.min_by("file", F.struct("test", "file")).alias("file"))
    return findings(per.where("not tested").withColumn("line", F.lit(1)), ("talos-missing-test-class", F.lit(True)))


def test_methods(statements: DataFrame) -> DataFrame:
    """object, file, class, method, line, body (text of the statements), asserts, of the test methods of test includes."""
    s = annotated(statements.where(F.lower("filename").contains(".testclasses.")))
    named = s.where((F.col("kind") == "MethodDef") & says("FOR TESTING")).select("file", after("METHODS", start=True).alias("method")).distinct().withColumn("testing", F.lit(True))
    inside = s.where("method is not null").groupBy("object", "file", "class", "method").agg(
        F.min("line").alias("line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") != "MethodImplementation", F.struct("seq", "t")))), lambda x: x["t"]), "\n").alias("body"),
    )
    return inside.join(named, ["file", "method"], "left").withColumn("testing", F.coalesce("testing", F.lit(False))).withColumn("asserts", F.col("body").rlike(words(*ASSERTION)))


def test_quality(statements: DataFrame) -> DataFrame:
    """Test methods that assert nothing, neither themselves nor by a method of the same include that they name; public methods no test names."""
    m = test_methods(statements)
    helpers = m.where("asserts").select("file", F.col("method").alias("helper")).hint("merge")
    mute = m.where("testing and not asserts")
    helped = mute.join(helpers, "file").where(F.rlike("body", F.concat(F.lit(r"(?<![\w~])"), F.col("helper"), F.lit(r"(?![\w~])")))).select("file", "method").distinct().hint("merge")
    out = findings(mute.join(helped, ["file", "method"], "left_anti"), ("talos-test-no-assert", F.lit(True)))

    w = W.partitionBy("filename").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    t = F.upper("text")
    section = F.when(t.rlike("^PUBLIC SECTION"), "public").when(t.rlike("^(PROTECTED|PRIVATE) SECTION"), "other").when(F.col("kind").isin("ClassDefinition", "EndClass"), "other")
    open_ = statements.where(~F.lower("filename").contains(".testclasses.") & (F.col("object_type") == "CLAS")).withColumn("section", F.last(section, ignorenulls=True).over(w))
    public = open_.where("section = 'public' and kind = 'MethodDef'").select("object", F.regexp_extract(t, r"^(?:CLASS-)?METHODS\s+(\w+)", 1).alias("name")).where("name <> '' and name not like 'CONSTRUCTOR%'")
    tests = statements.where(F.lower("filename").contains(".testclasses.")).select("object", F.col("filename").alias("file"), F.upper("text").alias("t"))
    named = public.join(tests, "object").groupBy("object", "file", "name").agg(F.max(F.contains(F.col("t"), F.col("name"))).alias("known"))
    lost = named.where("not known").select("object", "file").distinct().withColumn("line", F.lit(1))
    return out.unionByName(findings(lost, ("talos-public-method-untested", F.lit(True))))


def interfaces(statements: DataFrame) -> DataFrame:
    """Methods of interfaces that give tables without paging, and those for one row without one for many."""
    s = statements.where("object_type = 'INTF' and kind = 'MethodDef'").select("object", F.col("filename").alias("file"), F.col("row").alias("line"), F.upper("text").alias("t"))
    s = s.withColumn("name", after("METHODS", "CLASS-METHODS", start=True)).where("name is not null")
    gives = F.col("t").rlike(r"(?<!\w)RETURNING\s+VALUE\(\w+\)\s+TYPE\s+((STANDARD|SORTED|HASHED)\s+)?TABLE(?!\w)")
    asked = F.regexp_replace(F.regexp_replace("t", r"^(CLASS-)?METHODS\s+[\w~]+", ""), r"(?s)RETURNING.*$", "")
    out = findings(s, ("talos-intf-read-no-paging", gives & ~asked.rlike("TOP|SKIP|OFFSET|MAX|LIMIT|PAGE|PAGING")))
    one, many = r"^(\w+?)_(?:ONE|SINGLE)$", r"_(MANY|ALL|LIST|MULTI|BATCH|TABLE)$"
    batch = s.where(F.col("name").rlike(many)).select(F.col("object").alias("o"), F.col("name").alias("other")).distinct()
    single = s.where(F.col("name").rlike(one)).withColumn("stem", F.regexp_extract("name", one, 1))
    lone = single.join(batch, (F.col("object") == F.col("o")) & F.col("other").startswith(F.col("stem")), "left_anti")
    return out.unionByName(findings(lone, ("talos-intf-no-batch-sibling", F.lit(True))))


def business_functions(lines: DataFrame, edges: DataFrame, owned: DataFrame, functions: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """lines(object, file, line, raw), edges, owned(target, bf), functions(bf, state): probes of functions that are always off, and uses of what they own."""
    off = functions.where("state = 'always-off'").select(F.upper("bf").alias("bf"))
    probe = F.upper(F.regexp_extract("raw", r"(?i)(?:cl_sfw_bf_status_check|cl_fdt_environment|sfw_active|switch_is_active)[^\n]*?'(\w+)'", 1))
    probed = lines.where(~F.col("raw").rlike(r'^\s*[*"]')).withColumn("bf", probe).join(off, "bf", "left_semi")
    out = findings(probed, ("talos-bf-always-off-probe", F.lit(True)))
    used = edges.where(F.col("kind").isin(*kinds)).join(owned.withColumn("bf", F.upper("bf")).join(off, "bf", "left_semi").select("target").distinct(), "target", "left_semi")
    return out.unionByName(findings(used.select(F.col("source").alias("object"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("line")), ("talos-bf-owned-object-ref", F.lit(True))))


def services(files: DataFrame) -> DataFrame:
    """files(object, file, source) of bindings, definitions and views: exposed views without a paging policy, large ones behind the old protocol."""
    name = F.lower("file")
    bound = files.where(name.contains(".srvb.")).select("object", "file", "source", F.explode(F.transform(F.regexp_extract_all("source", F.lit(r"(?i)<SRVD_NAME>\s*([\w/]+)\s*</SRVD_NAME>"), F.lit(1)), F.upper)).alias("definition"))
    exposed = files.where(name.contains(".srvd")).where(~name.contains(".srvb.")).select(F.upper("object").alias("definition"), F.explode(F.transform(F.regexp_extract_all("source", F.lit(r"(?i)expose\s+(\w+)"), F.lit(1)), F.upper)).alias("entity"))
    v = files.where(name.endswith(".asddls"))
    declared = F.upper(F.regexp_extract("source", r"(?i)(?<!\w)define\s+(?:root\s+)?view\s+entity\s+([\w/]+)", 1))
    views = v.select(F.explode(F.array_distinct(F.array_compact(F.array(F.upper("object"), F.nullif(declared, F.lit("")))))).alias("entity"), F.col("source").alias("view"))
    chain = bound.join(exposed, "definition").join(views, "entity").withColumn("line", F.lit(1))
    pages = F.col("view").rlike("(?i)@Capabilities|maxItems|presentationVariant|skipSupported|topSupported")
    old = F.upper("source").contains("V2") & F.upper("source").contains("ODATA")
    large = F.col("view").rlike(r"(?i)" + _note("ObjectModel.usageType.sizeCategory") + r"\s*:\s*#X{0,2}L(?!\w)")
    return findings(chain, ("talos-srvb-no-paging-policy", ~pages), ("talos-srvb-offset-paging", old & large))


def isolated(packs: dict[str, Callable[[], DataFrame]], probe: bool = True) -> tuple[list[DataFrame], list[tuple[str, str]]]:
    """What the packs give, and what went wrong with the others: a pack that can't be planned or (probe) run costs its own findings only."""
    good, bad = [], []
    for name, pack in packs.items():
        try:
            df = pack()
            good.append(cut(df) if probe else df)
        except Exception as e:  # noqa: BLE001 - any failure of a pack becomes a row of the report
            bad.append((name, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:300]))
    return good, bad


