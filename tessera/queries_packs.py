"""Queries of the rule packs over sources that are made from the rows of `part`: a fragment of code is in a row's file if its condition holds.

The SQL of a query knows the conditions and what each fragment should give; it never sees the code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans import descriptor as M
from tessera.plans import linter as L
from tessera.plans import packs as K
from tessera.queries import CLASSIFIABLE, query
from tessera.queries_rest import ORACLES, QUERIES
from tessera.sources import adapters as D
from tessera.sources import bundle as B

__all__ = ["ORACLES", "QUERIES"]

#: (condition, code, rules with severity that it gives): the code of a file is that of all conditions that hold, in this order.
Fragments = list[tuple[str, str, list[tuple[str, str]]]]


def files(s, sf: str, fragments: Fragments, suffix: str, kind: str) -> DataFrame:
    """object, object_type, filename, file, source of every part.

    A few bytes of a part become kilobytes of code, so the parts are dealt out first: one small file of them would be one task's work.
    """
    parts = int(s.conf.get("spark.sql.shuffle.partitions"))
    source = F.concat(*[F.when(F.expr(c), F.lit(code)).otherwise("") for c, code, _ in fragments])
    p = D.read(s, sf, "part").repartition(parts).select(F.concat(F.lit("Z"), F.col("p_partkey").cast("string")).alias("object"), source.alias("source"))
    name = F.concat(F.lower("object"), F.lit(suffix))
    return p.select("object", F.lit(kind).alias("object_type"), name.alias("filename"), name.alias("file"), "source")


def expected(fragments: Fragments, more: Fragments = ()) -> str:
    rows = [f"SELECT 'Z'||p_partkey AS object, '{r}' AS rule_id, '{v}' AS severity FROM part WHERE {c}" for c, _, rules in [*fragments, *more] for r, v in rules]
    return "SELECT object, rule_id, severity, count(*) AS n FROM (" + " UNION ALL ".join(rows) + ") GROUP BY 1,2,3"


def counted(findings: DataFrame) -> DataFrame:
    return findings.groupBy("object", "rule_id", "severity").agg(F.count("*").alias("n"))


def rules(*names: str) -> list[tuple[str, str]]:
    return [(n, K.RULES[n][0]) for n in names]


# ------------------------------------------------------------ statements

CONTEXT: Fragments = [
    ("p_size % 5 = 0", "SELECT * FROM ztab INTO TABLE @lt_a FOR ALL ENTRIES IN @lt_d WHERE matnr = lt_d-matnr.\n", rules("talos-fae-no-guard")),
    ("p_size % 5 = 1", "IF lt_e IS NOT INITIAL.\nSELECT * FROM ztab INTO TABLE @lt_b FOR ALL ENTRIES IN @lt_e WHERE zfield = lt_e-f.\nENDIF.\n", rules("talos-fae-nonpk-where-prefix")),
    ("p_size % 3 = 0", "READ TABLE lt_a INTO ls BINARY SEARCH.\n", []),
    ("p_size % 4 = 1", "IF x = 1.\nDATA lv TYPE i.\nENDIF.\n", rules("talos-data-in-block")),
    ("p_size % 4 = 2", "DATA mara TYPE i.\nUPDATE mara SET a = 1.\n", []),
    ("p_size % 4 = 3", "UPDATE mara SET a = 1.\nDELETE FROM zmine WHERE a = 1.\n", rules("talos-cloud-021-direct-table-write")),
    ("p_size % 7 = 0", "ENHANCEMENT 1 zenh.\nCALL FUNCTION 'BAPI_X'.\nENDENHANCEMENT.\nCALL FUNCTION 'BAPI_Y'.\n", rules("talos-bapi-in-enhancement")),
    ("p_size % 7 = 1", "SELECT * FROM zt INTO TABLE lt_s WHERE a = 1.\nSORT lt_s BY a.\nSELECT * FROM zt INTO TABLE lt_q WHERE a = 1 ORDER BY a.\nSORT lt_q BY b.\n", rules("talos-client-sort-after-select")),
    ("p_size % 7 = 2", "SELECT SINGLE a FROM zkeyed INTO x WHERE k1 = 1.\nSELECT SINGLE a FROM zkeyed INTO x WHERE k1 = 1 AND k2 = 2.\n", rules("talos-select-single-partial-key")),
    ("p_size % 7 = 3", "SELECT * FROM zkeyed INTO TABLE lt_z FOR ALL ENTRIES IN lt_k WHERE other = lt_k-a.\n", rules("talos-fae-no-guard", "talos-fae-unindexed-where")),
    ("p_size % 6 = 0", "CLASS lhc DEFINITION FINAL.\nMETHODS read FOR READ IMPORTING keys.\nMETHODS act FOR MODIFY.\nENDCLASS.\nCLASS lhc IMPLEMENTATION.\nMETHOD read.\nMODIFY ENTITIES OF zi WITH VALUE #( ( a = 1 ) ).\nENDMETHOD.\nMETHOD act.\nMODIFY ENTITIES OF zi WITH lt_m.\nENDMETHOD.\nENDCLASS.\n", rules("talos-rap-modify-entities-in-read-handler", "talos-rap-modify-no-guard")),
]


def tables(s):
    return s.createDataFrame([("ZKEYED", ["MANDT", "K1", "K2"], ["IDX"])], "object string, keys array<string>, leads array<string>")


@query("R_statement_context", expected(CONTEXT, [("p_size % 15 = 0", "", rules("talos-binary-search-no-order-by"))]))
def _(s, sf):
    return counted(K.statement_context(B.statements(files(s, sf, CONTEXT, ".prog.abap", "PROG")), tables(s)))


WHOLE: Fragments = [
    ("p_size % 3 = 0", "SELECT SINGLE a FROM zt1 INTO x WHERE k = 1.\nSELECT SINGLE a FROM zt1 INTO y WHERE k = 1.\nSELECT SINGLE a FROM zt1 INTO @DATA(z) WHERE k = 1.\n", rules("talos-repeated-select-single")),
    ("p_size % 3 = 1", "SELECT SINGLE a FROM zt1 INTO x WHERE k = 1.\nSELECT SINGLE a FROM zt1 INTO y WHERE k = 1.\nSELECT SINGLE a FROM zt1 INTO y WHERE k = 2.\n", []),
    ("p_size % 4 = 0", "SELECT a FROM zt2 INTO TABLE l1.\nSELECT a FROM zt3 INTO TABLE l2.\nSELECT a FROM @lt AS x INTO TABLE l3.\n", []),
]


@query("R_statement_files", expected(WHOLE, [("p_size % 4 = 0 AND p_size % 3 < 2", "", rules("talos-cds-join-candidate"))]))
def _(s, sf):
    return counted(K.statement_files(B.statements(files(s, sf, WHOLE, ".prog.abap", "PROG"))))


FLOW: Fragments = [
    ("p_size % 3 = 0", "WRITE a.\nWRITE b.\nCALL SCREEN 100.\n", rules("talos-legacy-ui-rollup")), ("p_size % 3 = 1", "WRITE a.\nLEAVE SCREEN.\n", []),
    ("p_size % 4 = 0", "LOOP AT lt INTO ls.\n" + "a = b + 1.\n" * 8 + "ENDLOOP.\n", rules("talos-heavy-loop-calc")), ("p_size % 4 = 1", "LOOP AT lt INTO ls.\n" + "a = b + 1.\n" * 7 + "a = 'x - y'.\na = b-c.\nENDLOOP.\n", []),
    ("p_size % 5 = 0", "CALL FUNCTION 'ENQUEUE_EZ'.\nCALL FUNCTION 'ZOTHER'.\nCALL FUNCTION 'ZTHIRD'.\nCALL FUNCTION 'DEQUEUE_EZ'.\nCALL FUNCTION 'ZFREE'.\n", rules("talos-lock-held-across-calls")), ("p_size % 5 = 1", "CALL FUNCTION 'ENQUEUE_EZ'.\nCALL FUNCTION 'DEQUEUE_EZ'.\nCALL FUNCTION 'ZFREE'.\n", []),
    ("p_size % 7 = 0", "CLASS zd DEFINITION FINAL.\nMETHODS orders_get_entityset.\nMETHODS other.\nENDCLASS.\nCLASS zd IMPLEMENTATION.\nMETHOD orders_get_entityset.\nSELECT * FROM vbak INTO TABLE lt.\nSELECT * FROM vbak INTO TABLE lt WHERE a = 1.\nENDMETHOD.\nMETHOD other.\nSELECT * FROM vbak INTO TABLE lt.\nENDMETHOD.\nENDCLASS.\n", rules("talos-filter-not-delegated")),
    ("p_size % 9 = 0", "LOOP AT lt ASSIGNING <f>.\nENDLOOP.\n<f>-a = 1.\n", rules("talos-dangling-field-symbol")), ("p_size % 9 = 1", "LOOP AT lt ASSIGNING <g>.\nENDLOOP.\nIF <g> IS ASSIGNED.\n<g>-a = 1.\nENDIF.\n", []),
]


@query("R_flow", expected(FLOW))
def _(s, sf):
    return counted(K.flow(B.statements(files(s, sf, FLOW, ".prog.abap", "PROG"))))


#: A statement and the rules of single statements that it breaks.
SINGLE = [
    ("TABLES mara.", "gf-cloud-no-tables"), ("WRITE x.", "gf-cloud-no-write"), ("EXEC SQL.\nENDEXEC.", "gf-cloud-no-native-sql"), ("CALL SCREEN 100.", "gf-cloud-no-dynpro"), ("CALL TRANSACTION 'VA01'.", "gf-cloud-no-call-transaction"), ("CALL FUNCTION 'ZF'.", "gf-cloud-call-function"),
    ("CREATE OBJECT lo.", "gf-clean-no-create-object"), ("CONCATENATE a b INTO c.", "gf-clean-no-concatenate"), ("MOVE a TO b.", "gf-clean-no-move-to"), ("CALL METHOD lo->m.", "gf-clean-no-call-method"), ("FORM f.\nENDFORM.", "gf-clean-no-form"), ("DESCRIBE TABLE lt LINES n.", "gf-cloud-no-describe-lines"),
    ("GET REFERENCE OF a INTO b.", "gf-cloud-no-get-reference"), ("READ REPORT p INTO lt.", "gf-cloud-no-read-report"), ("BREAK-POINT.", "gf-cloud-no-break-point"), ("LEAVE PROGRAM.", "gf-cloud-no-leave"), ("PERFORM f IN PROGRAM p.", "gf-cloud-no-perform-sap"), ("PERFORM f.", ""),
    ("ENHANCEMENT-POINT a SPOTS b.", "gf-cloud-no-enhancement-point"), ("INTERFACES if_ex_internal_x.", "gf-cloud-no-internal-badi"), ("INTERFACES if_x.", ""), ("MESSAGE 'x' TYPE 'E'.", "gf-cloud-message-type"), ("CLASS zc DEFINITION.\nENDCLASS.", "gf-cloud-class-not-final"), ("CLASS zc DEFINITION FINAL.\nENDCLASS.", ""),
    ("FIELD-SYMBOLS <f> TYPE ANY.", "gf-cloud-fs-type-any"), ("FIELD-SYMBOLS <f> TYPE ANY TABLE.", ""), ("COMPUTE a = b + 1.", "gf-cloud-no-compute"), ("lo = cl_salv_table=>factory( ).", "gf-cloud-no-classic-alv"), ("SELECT a FROM t USING CLIENT '100' INTO TABLE lt.", "gf-cloud-no-using-client"),
    ("OPEN CURSOR c FOR SELECT a FROM t.", "gf-cloud-no-db-cursor"), ("DELETE FROM t CLIENT SPECIFIED WHERE a = 1.", "gf-cloud-no-client-specified"), ("x = sy-datum.", "gf-cloud-sy-time-direct"), ("FORM userexit_x.\nENDFORM.", "gf-cloud-no-user-exit gf-clean-no-form"), ("DATA lo TYPE REF TO if_wd_view.", "gf-cloud-legacy-ui gf-clean-standalone-data"),
    ("INCLUDE STRUCTURE ci_x.", "gf-cloud-ci-include"), ("x = /iwbep/cl_mgw=>a( ).", "gf-cloud-segw-bopf"), ("x = 'X'.", "gf-clean-bool-literal"), ("CLASS zc DEFINITION LOCAL FRIENDS zt.", "gf-test-friends-reach gf-cloud-class-not-final"), ("DATA lv_x TYPE i.", "gf-clean-hungarian gf-clean-standalone-data"), ("DATA x LIKE y.", ""),
    ("RAISE EXCEPTION TYPE zcx.", "gf-clean-raise-exc-type"), ("x = lo->m( EXPORTING a = 1 ).", "gf-clean-redundant-exporting"), ("x = lo->m( EXPORTING a = 1 IMPORTING b = c ).", ""), ("DATA lt TYPE STANDARD TABLE OF x WITH HEADER LINE.", "gf-cloud-with-header-line gf-clean-standalone-data"), ("SELECT * FROM t INTO TABLE lt.", "gf-cloud-select-star"),
]
_SEVERITY = {r.id: r.severity for r in L.LINTS}
LINTS: Fragments = [(f"p_partkey % {len(SINGLE)} = {i}", code + "\n", [(r, _SEVERITY[r]) for r in names.split()]) for i, (code, names) in enumerate(SINGLE)]


@query("R_lint_statements", expected(LINTS))
def _(s, sf):
    return counted(L.statement_rules(B.statements(files(s, sf, LINTS, ".prog.abap", "PROG"))))


CHECK = "AUTHORITY-CHECK OBJECT 'A' ID 'B' FIELD c.\n"
AROUND: Fragments = [
    ("p_size % 4 = 1", f"FORM g.\n{CHECK}UPDATE ztab SET a = 1.\nIF sy-subrc <> 0.\nENDIF.\nENDFORM.\n", [("gf-x-authcheck-subrc-after-write", "error")]), ("p_size % 4 = 2", f"FORM h.\n{CHECK}ENDFORM.\nIF sy-subrc = 0.\nENDIF.\n", [("gf-inv-authcheck-no-subrc", "error")]),
    ("p_size % 4 = 3", f"FORM i.\n{CHECK}IF sy-subrc <> 0.\nENDIF.\nENDFORM.\n", []),
    ("p_size % 3 = 0", "LOOP AT lt INTO ls.\nSELECT a FROM t INTO TABLE l2.\nCOMMIT WORK.\nENDLOOP.\n", [("gf-perf-select-in-loop", "warning"), ("gf-inv-commit-in-loop", "error")]),
    ("p_size % 5 = 0", "CLASS lhc DEFINITION INHERITING FROM cl_abap_behavior_handler.\nENDCLASS.\nCLASS lhc IMPLEMENTATION.\nMETHOD m.\nUPDATE ztab2 SET a = 1.\nCOMMIT WORK.\nENDMETHOD.\nENDCLASS.\n", [("gf-rap-direct-db-write", "warning"), ("gf-rap-no-commit-in-pool", "error")]),
]


@query("R_lint_context", expected(AROUND, [("p_size % 20 = 5", "", [("gf-rap-direct-db-write", "warning")]), ("p_size % 15 = 0", "", [("gf-rap-no-commit-in-pool", "error")])]))
def _(s, sf):
    return counted(L.context_rules(B.statements(files(s, sf, AROUND, ".prog.abap", "PROG"))))


def _method(name: str, body: str) -> str:
    return f"CLASS z{name} DEFINITION FINAL.\nMETHODS {name}.\nENDCLASS.\nCLASS z{name} IMPLEMENTATION.\nMETHOD {name}.\n{body}ENDMETHOD.\nENDCLASS.\n"


def _test(name: str, body: str) -> str:
    return _method(name, body).replace(f"METHODS {name}.", f"METHODS {name} FOR TESTING.")


ASSERT = "cl_abap_unit_assert=>fail( ).\n"
METHODS: Fragments = [
    ("p_size % 3 = 0", "CLASS zp DEFINITION FINAL.\nMETHODS m IMPORTING a TYPE i b TYPE i c TYPE i d TYPE i EXPORTING e TYPE i f TYPE i g TYPE i.\nENDCLASS.\n", [("gf-cx-param-count", "warning")]),
    ("p_size % 3 = 1", "CLASS zq DEFINITION FINAL.\nMETHODS m IMPORTING a TYPE i b TYPE i c TYPE i d TYPE i e TYPE i f TYPE i g TYPE i.\nMETHODS n IMPORTING a TYPE i b TYPE i c TYPE i.\nENDCLASS.\n", [("gf-cx-param-count", "error")]),
    ("p_size % 4 = 0", _method("long", "a = 1.\n" * 41), [("gf-cx-method-length", "warning")]), ("p_size % 4 = 1", _method("longer", "a = 1.\n" * 81), [("gf-cx-method-length", "error")]), ("p_size % 4 = 2", _method("short", "a = 1.\n" * 40), []),
    ("p_size % 5 = 0", _method("paths", "IF a = 1.\nENDIF.\n" * 10), [("gf-cx-cyclomatic", "warning")]), ("p_size % 5 = 1", _method("deep", "IF a = 1.\n" * 5 + "ENDIF.\n" * 5), [("gf-cx-nesting-depth", "warning")]), ("p_size % 5 = 2", _method("deeper", "IF a = 1.\n" * 7 + "ENDIF.\n" * 7), [("gf-cx-nesting-depth", "error")]),
    ("p_size % 7 = 0", _test("many", ASSERT * 4), [("gf-test-assert-count", "warning")]), ("p_size % 7 = 1", _test("calls", "lo->a( ).\n" * 4 + ASSERT), [("gf-test-too-many-calls", "warning")]),
    ("p_size % 7 = 2", _test("made", "lo = NEW zcl_x( ).\nSELECT a FROM t INTO TABLE lt.\n" + ASSERT), [("gf-test-instantiates-prod", "warning"), ("gf-x-test-hits-real-db", "warning")]),
    ("p_size % 7 = 3", _test("doubled", "cl_osql_test_environment=>create( ).\nSELECT a FROM t INTO TABLE lt.\n" + ASSERT), []), ("p_size % 7 = 4", _test("mute", "a = 1.\n"), [("gf-hardy-test-no-assert", "warning")]),
]


@query("R_lint_methods", expected(METHODS))
def _(s, sf):
    return counted(L.method_rules(B.statements(files(s, sf, METHODS, ".clas.testclasses.abap", "CLAS"))))


TESTS: Fragments = [
    ("p_size % 3 = 0", _test("alone", "a = 1.\n"), rules("talos-test-no-assert")), ("p_size % 3 = 1", _test("helped", "check_it( ).\n").replace("ENDMETHOD.", "ENDMETHOD.\nMETHOD check_it.\n" + ASSERT + "ENDMETHOD."), []),
    ("p_size % 4 = 0", "lo->first( ).\n", []), ("true", "lo->second( ).\n", []),
]
PUBLIC: Fragments = [("true", "CLASS zc DEFINITION FINAL.\nPUBLIC SECTION.\nMETHODS first.\nMETHODS second.\nMETHODS constructor.\nPRIVATE SECTION.\nMETHODS third.\nENDCLASS.\n", [])]


@query("R_test_quality", expected(TESTS, [("p_size % 4 <> 0", "", rules("talos-public-method-untested"))]))
def _(s, sf):
    both = files(s, sf, TESTS, ".clas.testclasses.abap", "CLAS").unionByName(files(s, sf, PUBLIC, ".clas.abap", "CLAS"))
    return counted(K.test_quality(B.statements(both)))


@query("R_lint_untested", expected([("p_size % 4 <> 0", "", [("gf-test-public-untested", "warning")])]))
def _(s, sf):
    both = files(s, sf, TESTS, ".clas.testclasses.abap", "CLAS").unionByName(files(s, sf, PUBLIC, ".clas.abap", "CLAS"))
    return counted(L.untested(B.statements(both)))


INTF: Fragments = [
    ("p_size % 3 = 0", "METHODS get_top_orders IMPORTING a TYPE i RETURNING VALUE(r) TYPE STANDARD TABLE OF x.\n", rules("talos-intf-read-no-paging")), ("p_size % 3 = 1", "METHODS get_orders IMPORTING iv_top TYPE i RETURNING VALUE(r) TYPE STANDARD TABLE OF x.\n", []),
    ("p_size % 4 = 0", "METHODS read_one.\n", []), ("p_size % 8 = 0", "METHODS read_many.\n", []),
]


@query("R_interfaces", expected(INTF, [("p_size % 8 = 4", "", rules("talos-intf-no-batch-sibling"))]))
def _(s, sf):
    return counted(K.interfaces(B.statements(files(s, sf, INTF, ".intf.abap", "INTF"))))


@query("R_missing_tests", expected([("p_size % 3 = 0", "", rules("talos-missing-test-class"))]))
def _(s, sf):
    c = [("p_size % 3 < 2", "CLASS zc DEFINITION FINAL.\nENDCLASS.\n", []), ("p_size % 3 = 2", "CLASS zt DEFINITION FOR TESTING.\nENDCLASS.\n", [])]
    test = files(s, sf, [("p_size % 3 = 1", "x", [])], ".clas.testclasses.abap", "CLAS").where("source <> ''")
    return counted(K.missing_tests(files(s, sf, c, ".clas.abap", "CLAS").unionByName(test)))


# ------------------------------------------------------------ views and behaviours

CHECKED, MISSING = "p_size % 2 = 0", "p_size % 2 = 1 AND p_size % 3 <> 0"
OPEN = "p_size % 5 <> 0"
NOTES: Fragments = [
    (CHECKED, "@AccessControl.authorizationCheck: #CHECK\n", []), ("p_size % 2 = 1 AND p_size % 3 = 0", "@AccessControl.authorizationCheck: #NOT_REQUIRED\n", [("talos-cds-auth-not-required", "p2")]), ("p_size % 5 = 0", "@VDM.private: true\n", []),
    ("p_size % 7 = 0", "@AbapCatalog.sqlViewName: 'ZV'\n", [("talos-cds-legacy-sqlview", "p2")]), ("p_size % 7 = 1", "@ObjectModel.virtualElement: true\n", [("talos-cds-virtual-element-cost", "info")]), ("p_size % 7 = 2", "@UI.headerInfo: { }\n", [("talos-cds-analytical-missing-analytics", "p2")]),
    ("p_size % 7 = 3", "@UI.headerInfo: { }\n@Analytics.dataCategory: #CUBE\n", []), ("p_size % 4 = 0", "@ObjectModel.usageType.serviceQuality: #C\n@ObjectModel.usageType.sizeCategory: #S\n", []), ("p_size % 9 = 0", "composition [0..*] of x as _x\n", [("talos-cds-expand-no-cardinality-cap", "p2")]),
]
LACKS: Fragments = [
    (MISSING, "", [("talos-cds-missing-access-control", "p2")]), (f"{OPEN} AND p_size % 4 <> 0", "", [("talos-cds-missing-service-quality", "p3"), ("talos-cds-missing-size-category", "p3")]),
    (OPEN, "", [("talos-cds-missing-data-class", "p3"), ("talos-cds-missing-view-enhancement-category", "p3")]),
]


@query("R_metadata_views", expected(NOTES, LACKS))
def _(s, sf):
    return counted(K.metadata(files(s, sf, NOTES, ".ddls.asddls", "DDLS")))


BDEF: Fragments = [
    ("p_size % 3 = 0", "managed implementation in class zbp_a unique;\nwith draft;\n", []), ("p_size % 3 = 0 AND p_size % 2 = 0", "total etag x\n", []), ("p_size % 4 = 0", "early numbering\n", [("talos-rap-early-numbering", "p2")]),
    ("p_size % 5 = 0", "association _a { create; }\n", [("talos-rap-deep-create-no-cap", "p3")]), ("p_size % 7 = 0", "unmanaged implementation in class x;\n", []),
]


@query("R_metadata_behaviors", expected(BDEF, [("p_size % 3 = 0 AND p_size % 2 = 1", "", [("talos-rap-draft-no-optimistic-lock", "p2")]), ("p_size % 21 = 0", "", [("talos-rap-mixed-managed-unmanaged", "p1")])]))
def _(s, sf):
    return counted(K.metadata(files(s, sf, BDEF, ".bdef.asbdef", "BDEF")))


VIEWS: Fragments = [
    ("p_size % 4 = 0", "@ObjectModel.usageType.serviceQuality: #A\n", []), ("p_size % 5 = 0", "@VDM.viewType: #COMPOSITE\n", rules("talos-cds-composite-direct-ddic")), ("true", "define view entity ZX_V as select from zi_base\n", []),
    ("p_size % 3 = 0", "join zt1 on a = b join zt2 on a = b join zt3 on a = b\n", []), ("p_size % 3 = 1", "join zt1 on cast( a as abap.int4 ) = b join zt1 on a = b join zt1 on a = b\n", rules("talos-cds-calc-field-in-join", "talos-cds-cyclic-join")), ("p_size % 3 = 2", "join zi_other on a = b\n", []), ("true", "{\n", []),
    ("p_size % 7 = 0", "case a when 1 then 2 end as x, case a when 1 then 2 end as y, case a when 1 then 2 end as z,\n", rules("talos-cds-business-logic")), ("p_size % 7 = 1", "a,\n", rules("talos-cds-field-order")), ("true", "key k }\n", []),
    ("p_size % 8 = 0", "where upper( a ) = 'X'\n", rules("talos-cds-calc-field-in-where")), ("p_size % 8 = 1", "where a = 'X'\n", []), ("p_size % 9 = 0", "group by a\n", []),
]


@query("R_view_structure", "WITH e AS (" + expected([(c if "composite" not in str(r) else f"({c}) AND p_size % 3 < 2", t, r) for c, t, r in VIEWS], [("p_size % 12 = 0", "", rules("talos-cds-service-quality-mismatch")), ("p_size % 7 = 0", "", rules("talos-cds-field-order")), ("p_size % 45 = 0", "", rules("talos-cds-groupby-in-reuse"))]) + ") SELECT * FROM e")
def _(s, sf):
    return counted(K.view_structure(files(s, sf, VIEWS, ".ddls.asddls", "DDLS")))


GRAPH = "WITH v AS (SELECT p_partkey AS p, p_size FROM part) "
VIEW_RULES = {
    "gf-x-cds-node-no-key": ("error", "p_size % 3 = 0"), "gf-x-cds-projection-not-on-interface": ("warning", "p_size % 4 = 1"), "gf-x-naming-cds-interface": ("warning", "p_size % 4 >= 2 AND p_size % 5 = 0"), "gf-x-naming-cds-projection": ("warning", "p_size % 4 < 2 AND p_size % 5 = 0"),
    "gf-x-cds-root-not-declared": ("error", "p_size % 7 = 0"), "gf-cds-classic-view": ("error", "p_size % 11 = 0"), "gf-x-ui-fe-readiness": ("error", "p_size % 4 < 2 AND p_size % 3 = 1"),
}


@query("R_lint_views", expected([(c, "", [(r, v)]) for r, (v, c) in VIEW_RULES.items()], [("p_size % 7 IN (0, 1)", "", [("gf-x-cds-composition-no-back-association", "error")]), ("p_size % 13 = 0", "", [("gf-x-cds-extend-base-not-extensible", "error")])]))
def _(s, sf):
    p = D.read(s, sf, "part").select("p_size", F.col("p_partkey").cast("string").alias("k"))
    z = F.col("p_size")
    prefix = F.when(z % 5 == 0, "ZX_").when(z % 4 < 2, "ZC_").otherwise("ZI_")
    own = F.concat(prefix, "k")
    base = F.when(z % 4 == 0, "as projection on ZI_BASE").when(z % 4 == 1, "as projection on ZC_OTHER").otherwise("as select from ztab")
    child = F.when(z % 7 < 2, F.concat(F.lit(" composition [0..*] of ZI_CHILD"), "k", F.lit(" as _c"))).otherwise("")
    parent = F.when(z % 7 == 1, " association to parent ZI_ROOT as _p").otherwise("")
    notes = F.when(z % 3 == 1, "@UI.headerInfo: { }\n").when(z % 3 == 2, "@UI: { headerInfo: { }, lineItem: [ ], selectionField: [ ], facet: [ ] }\n").otherwise("")
    main = F.concat(notes, F.lit("define view entity "), own, F.lit(" "), base, child, parent, F.lit(" { "), F.when(z % 3 == 0, "a // key b\n").otherwise("key a"), F.lit(" }"))
    inner = F.concat(F.lit("@AbapCatalog.viewEnhancementCategory: [#NONE]\ndefine view entity ZI_CHILD"), "k", F.lit(" as select from z { key a }"))
    extension = F.concat(F.lit("extend view entity ZI_CHILD"), "k", F.lit(" with { b }"))
    classic = F.lit("/* old */\ndefine view zold as select from z { key a }")
    obj = F.concat(F.lit("Z"), "k")
    part = lambda name, text, on: p.where(on).select(obj.alias("object"), F.concat(F.lower(obj), F.lit(name)).alias("file"), text.alias("source"))
    all_ = part(".ddls.asddls", main, F.lit(True)).unionByName(part("_c.ddls.asddls", inner, (z % 7 < 2) | (z % 13 == 0))).unionByName(part("_e.ddls.asddls", extension, z % 13 == 0)).unionByName(part("_o.ddls.asddls", classic, z % 11 == 0))
    return counted(L.view_rules(all_).unionByName(L.source_rules(all_)))


@query("R_lint_behaviors", expected([("p_size % 2 = 0 AND p_size % 3 <> 0", "", [("gf-x-bdef-managed-save-consistency", "error")]), ("p_size % 5 = 0", "", [("gf-x-naming-behavior-pool", "warning")]), ("p_size % 7 = 0", "", [("gf-x-bdef-draft-table-missing", "error")]), ("p_size % 4 <> 0", "", [("gf-x-bdef-handler-reconciliation", "error")]), ("true", "", [("gf-x-bdef-handler-reconciliation", "error")])]))
def _(s, sf):
    p = D.read(s, sf, "part").select("p_size", F.col("p_partkey").cast("string").alias("k"))
    z, obj = F.col("p_size"), F.concat(F.lit("Z"), F.col("k"))
    name = F.concat(F.when(z % 5 == 0, "zcl_").otherwise("zbp_"), "k")
    head = F.concat(F.when(z % 2 == 0, "managed with additional save").otherwise("managed"), F.lit(" implementation in class "), name, F.lit(" unique;\n"), F.when(z % 7 < 2, "with draft;\n").otherwise(""))
    text = F.concat(head, F.lit("define behavior for ZI_A alias Root draft table zd1\n{ validation checkIt on save { create; } determination setIt on modify { } draft action Edit; action (features: instance) doIt result x; }\ndefine behavior for ZI_B alias Child "), F.when(z % 7 != 0, "draft table zd2 ").otherwise(""), F.lit("{ }"))
    code = F.concat(F.lit("CLASS lhc DEFINITION INHERITING FROM cl_abap_behavior_handler.\nMETHODS v FOR VALIDATE ON SAVE IMPORTING keys FOR Root~checkIt.\nMETHODS d FOR DETERMINE ON MODIFY IMPORTING keys FOR Root~setIt. \" FOR ACTION Root~doIt\n"), F.when(z % 4 == 0, "").otherwise("* METHODS gone.\n"), F.when(z % 3 == 0, "CLASS lsc DEFINITION INHERITING FROM cl_abap_behavior_saver.\nMETHODS save_modified REDEFINITION.\n").otherwise(""))
    code = F.when(z % 4 == 0, code).otherwise(F.regexp_replace(code, "Root~setIt", "Child~setIt"))
    both = p.select(obj.alias("object"), F.concat(F.lower(obj), F.lit(".bdef.asbdef")).alias("file"), text.alias("source")).unionByName(p.select(obj.alias("object"), F.concat(name, F.lit(".clas.locals_imp.abap")).alias("file"), code.alias("source")))
    return counted(L.behavior_rules(both))


@query("R_behavior_context", expected([("p_size % 3 = 0", "", rules("talos-rap-draft-child-create")), ("p_size % 4 = 0 AND p_size % 3 = 0", "", rules("talos-rap-draft-table-no-uuid")), ("p_size % 5 = 0", "", rules("talos-strict-call-transaction", "talos-strict-direct-db")), ("p_size % 7 = 0", "", rules("talos-rap-read-unbounded"))]).replace("'Z'||", "'Z'||"))
def _(s, sf):
    p = D.read(s, sf, "part").select("p_size", F.concat(F.lit("Z"), F.col("p_partkey").cast("string")).alias("object"))
    z = F.col("p_size")
    text = F.concat(F.when(z % 5 == 0, "strict ( 2 );\n").otherwise("strict;\n"), F.when(z % 3 == 0, "with draft;\n").otherwise(""), F.when(z % 4 == 0, "late numbering draft table zdraft\n").otherwise(""), F.lit("define behavior for A { create; }\ndefine behavior for B { association _c { create; } create; }"))
    behaviors = p.select("object", F.lit("b").alias("file"), text.alias("source"), F.lower("object").alias("class"))
    code: Fragments = [("true", "CALL TRANSACTION 'X'.\nUPDATE zt SET a = 1.\nCLASS l DEFINITION FINAL.\nMETHODS read FOR READ IMPORTING keys.\nENDCLASS.\nCLASS l IMPLEMENTATION.\nMETHOD read.\nSELECT SINGLE a FROM zt INTO x WHERE b = 1.\n", []), ("p_size % 7 = 0", "SELECT a FROM zt INTO TABLE lt WHERE b = 1.\n", []), ("true", "ENDMETHOD.\nENDCLASS.\n", [])]
    drafts = s.createDataFrame([("ZDRAFT", ["MANDT", "ID"])], "object string, keys array<string>")
    return counted(K.behavior_context(behaviors, B.statements(files(s, sf, code, ".clas.abap", "CLAS")), drafts))


# ------------------------------------------------------------ dictionary, graph, registry, services, descriptors


@query("R_dictionary", expected([("p_size % 4 = 1", "", rules("talos-tabl-cluster-pool")), ("p_size % 4 = 0 AND p_size % 3 = 0", "", rules("talos-tabl-low-cardinality-key")), ("p_size % 5 = 0 AND p_size % 2 = 0", "", rules("talos-tabl-buffered-write")), ("p_size % 4 = 2 AND p_size % 3 = 1", "", rules("talos-append-on-sap-table")), ("p_size % 7 = 0", "", rules("talos-dtel-conversion-exit")), ("p_size % 7 < 3", "", rules("talos-dtel-duplicates-sap"))]))
def _(s, sf):
    p = D.read(s, sf, "part").select("p_size", F.concat(F.lit("Z"), F.col("p_partkey").cast("string")).alias("object"))
    z = F.col("p_size")
    category = F.element_at(F.array(*map(F.lit, ("TRANSP", "POOL", "APPEND", "VIEW"))), z % 4 + 1)
    keys = F.when(z % 3 == 0, F.array(F.lit("MANDT"))).when(z % 3 == 1, F.array(F.lit("MANDT"), F.lit(".INCLUDE"))).otherwise(F.array(F.lit("MANDT"), F.lit("K")))
    t = p.select("object", F.lit("t").alias("file"), category.alias("category"), F.array(F.lit("MANDT"), F.lit("K")).alias("fields"), keys.alias("keys"), (z % 5 == 0).alias("buffered"), F.when(z % 3 == 1, "MARA").otherwise("ZTAB").alias("extends"))
    e = p.select("object", F.lit("e").alias("file"), F.when(z % 7 == 0, "matnr").when(z % 7 < 3, "other").otherwise("zdom").alias("domain"))
    d = s.createDataFrame([("MATNR", "MATN1"), ("OTHER", None)], "domain string, exit string")
    writes = p.where("p_size % 2 = 0").select(F.lit("InsertDatabase").alias("kind"), F.concat(F.lit("insert into "), F.lower("object"), F.lit(" values x")).alias("text"))
    return counted(K.dictionary(t, e, d, writes))


@query("R_graph", D.with_("cyc", recursive=True) + ", l AS (SELECT DISTINCT a, b FROM cyc WHERE a<>b UNION SELECT p_partkey, 0 FROM part WHERE p_partkey<>0 UNION SELECT 1, p_partkey FROM part WHERE p_partkey BETWEEN 2 AND 30), r(a,b) AS (SELECT a,b FROM l UNION SELECT r.a,l.b FROM r JOIN l ON l.a=r.b) SELECT 'Z'||b AS object, 'talos-god-object' AS rule_id, 'p3' AS severity, 1::BIGINT AS n FROM l GROUP BY b HAVING count(*)>=10 UNION ALL SELECT 'Z'||a, 'talos-high-fan-out', 'p3', 1 FROM l GROUP BY a HAVING count(*)>=20 UNION ALL SELECT DISTINCT 'Z'||a, 'talos-dependency-cycle', 'p2', 1 FROM r WHERE a=b")
def _(s, sf):
    p = D.read(s, sf, "part").select(F.col("p_partkey").cast("long").alias("k"))
    e = D.cyclic_edges(s, sf).union(p.where("k <> 0").select("k", F.lit(0).cast("long"))).union(p.where("k between 2 and 30").select(F.lit(1).cast("long"), "k"))
    z = lambda c: F.concat(F.lit("Z"), F.col(c).cast("string"))
    named = e.select(z("a").alias("source"), z("b").alias("target"), F.lit("calls").alias("kind"), F.lit(None).cast("string").alias("access"))
    return counted(K.graph_pack(named, p.select(z("k").alias("id"), z("k").alias("object"))))


@query("R_released_api", D.with_("edges", "registry") + "SELECT DISTINCT e.source AS object, e.target, CASE WHEN r.state='notToBeReleased' THEN 'p1' ELSE 'p2' END AS severity FROM edges e JOIN registry r ON r.name=e.target WHERE e.kind IN ('uses-table','inherits','consumes-cds') AND r.state<>'released'")
def _(s, sf):
    return K.released_api(D.edges(s, sf), D.registry(s, sf), CLASSIFIABLE).select("object", "target", "severity")


@query("R_grounding", "SELECT 'Z'||p_partkey AS object, CASE p_size%5 WHEN 1 THEN 'gf-ground-classic-api' WHEN 2 THEN 'gf-ground-deprecated' WHEN 3 THEN 'gf-ground-not-released' ELSE 'gf-ground-no-api' END AS rule_id, CASE WHEN p_size%5=1 THEN 'info' ELSE 'error' END AS severity, 1::BIGINT AS n FROM part WHERE p_size%5>0 AND p_size%7<>0")
def _(s, sf):
    p = D.read(s, sf, "part").select("p_size", F.concat(F.lit("Z"), F.col("p_partkey").cast("string")).alias("object"))
    text = F.concat(F.lit("SELECT a FROM ZOWN.\n"), F.when(F.col("p_size") % 7 == 0, "x_").otherwise("x "), F.element_at(F.array(*map(F.lit, ("CL_GOOD", "MARA_CLASSIC", "BAPI_OLD", "VBAK_NOT", "CL_NONE"))), F.col("p_size") % 5 + 1), F.lit(" mara_classic\n" if False else "\n"))
    registry = s.createDataFrame([("CL_GOOD", "released"), ("MARA_CLASSIC", "classicAPI"), ("BAPI_OLD", "deprecated"), ("VBAK_NOT", "notToBeReleased"), ("CL_NONE", "noAPI")], "name string, state string")
    return counted(L.grounding(p.select("object", F.lower("object").alias("file"), text.alias("source")), registry))


@query("R_business_functions", expected([("p_size % 3 = 0", "", rules("talos-bf-always-off-probe")), ("p_size % 4 = 0", "", rules("talos-bf-owned-object-ref"))]))
def _(s, sf):
    p = D.read(s, sf, "part").select("p_size", F.concat(F.lit("Z"), F.col("p_partkey").cast("string")).alias("object"))
    z = F.col("p_size")
    probe = F.concat(F.when(z % 3 == 2, "* ").otherwise(""), F.lit("IF cl_sfw_bf_status_check=>get( '"), F.when(z % 3 == 1, "ON_BF").otherwise("off_bf"), F.lit("' )."))
    lines = p.select("object", F.lit("f").alias("file"), F.lit(1).alias("line"), probe.alias("raw"))
    edges = p.select(F.col("object").alias("source"), F.when(z % 4 == 0, "OWNED").otherwise("FREE").alias("target"), F.when(z % 4 == 1, "includes").otherwise("uses-table").alias("kind"))
    owned = s.createDataFrame([("OWNED", "off_bf"), ("FREE", "on_bf")], "target string, bf string")
    return counted(K.business_functions(lines, edges, owned, s.createDataFrame([("off_bf", "always-off"), ("on_bf", "on")], "bf string, state string"), CLASSIFIABLE))


@query("R_services", expected([("p_size % 3 <> 0", "", rules("talos-srvb-no-paging-policy")), ("p_size % 4 = 0 AND p_size % 2 = 0 AND p_size % 5 < 2", "", rules("talos-srvb-offset-paging"))]))
def _(s, sf):
    p = D.read(s, sf, "part").select("p_size", F.concat(F.lit("Z"), F.col("p_partkey").cast("string")).alias("object"))
    z, k = F.col("p_size"), F.lower("object")
    binding = p.select("object", F.concat(k, F.lit(".srvb.xml")).alias("file"), F.concat(F.lit("<T>ODATA</T>"), F.when(z % 2 == 0, "<V>V2</V>").otherwise("<V>V4</V>"), F.lit("<SRVD_NAME> D_"), "object", F.lit(" </SRVD_NAME><SRVD_NAME>GONE</SRVD_NAME>")).alias("source"))
    definition = p.select(F.concat(F.lit("D_"), "object").alias("object"), F.concat(F.lit("d_"), k, F.lit(".srvd.srvdsrv")).alias("file"), F.concat(F.lit("expose V_"), "object", F.lit(" as X; expose NOWHERE;")).alias("source"))
    size = F.when(z % 5 == 0, "@ObjectModel.usageType.sizeCategory: #L\n").when(z % 5 == 1, "@ObjectModel.usageType.sizeCategory: #XXL\n").otherwise("@ObjectModel.usageType.sizeCategory: #M\n")
    large = F.when(z % 4 == 0, size).otherwise("")
    view = p.select(F.concat(F.lit("SRC_"), "object").alias("object"), F.concat(F.lit("src_"), k, F.lit(".ddls.asddls")).alias("file"), F.concat(large, F.when(z % 3 == 0, "@Capabilities.topSupported: true\n").otherwise(""), F.lit("define view entity V_"), "object", F.lit(" as select from t { key a }")).alias("source"))
    return counted(K.services(binding.unionByName(definition).unionByName(view)))


#: What a descriptor lacks, by a number, with the rules that it then breaks.
BROKEN = [
    ("", ""), ("text", "fe-manifest-invalid-json"), ("list", "fe-manifest-invalid"), ("app", "fe-manifest-no-sap-app fe-no-odata-datasource"), ("ui", "fe-manifest-no-sap-ui5 fe-model-no-datasource fe-no-list-report fe-no-object-page fe-no-entityset"), ("source", "fe-no-odata-datasource"), ("model", "fe-model-no-datasource"),
    ("named", "fe-model-datasource-unresolved"), ("uri", "fe-datasource-wrong-service"), ("list-page", "fe-no-list-report"), ("object-page", "fe-no-object-page"), ("set", "fe-no-entityset"), ("entity", "fe-entityset-projection-mismatch"), ("path", ""), ("wrong-path", "fe-entityset-projection-mismatch"),
]


def manifest(flaw: str) -> str:
    import json

    settings = {"set": {}, "entity": {"entitySet": "ZI_Other"}, "path": {"contextPath": "/ZC_Main"}, "wrong-path": {"contextPath": "ZI_Main"}}.get(flaw, {"entitySet": "zc_main"})
    page = lambda name: {"name": f"sap.fe.templates.{name}", "options": {"settings": settings}}
    doc = {
        "sap.app": {"id": "x", "dataSources": {"main": {"type": "Other" if flaw == "source" else "OData", "uri": "/sap/wrong/" if flaw == "uri" else "/sap/ZUI_SERVICE/"}}},
        "sap.ui5": {"models": {"": {} if flaw == "model" else {"dataSource": "gone" if flaw == "named" else "main"}}, "routing": {"targets": {n: page(n) for n in ("ListReport", "ObjectPage") if flaw != {"ListReport": "list-page", "ObjectPage": "object-page"}[n]}}},
    }
    doc.pop({"app": "sap.app", "ui": "sap.ui5"}.get(flaw, ""), None)
    return {"text": "{ no json", "list": "[1]"}.get(flaw) or json.dumps(doc)


@query("R_descriptors", expected([(f"p_partkey % {len(BROKEN)} = {i}", "", [(r, M.RULES[r]) for r in names.split()]) for i, (_, names) in enumerate(BROKEN)]))
def _(s, sf):
    text = F.element_at(F.array(*[F.lit(manifest(flaw)) for flaw, _ in BROKEN]), (F.col("p_partkey") % len(BROKEN) + 1).cast("int"))
    p = D.read(s, sf, "part").select(F.concat(F.lit("Z"), F.col("p_partkey").cast("string")).alias("object"), text.alias("manifest"), F.lit("ZC_Main").alias("entity"), F.lit("zui_service").alias("service"))
    return counted(M.findings(p))


@query("X30_islands", "SELECT page_id, sha256(replace(replace(replace(html,'<','\\u003c'),'>','\\u003e'),'&','\\u0026')) AS digest FROM pages")
def _(s, sf):
    from tessera.functions import scalars as X

    return D.read(s, sf, "pages").select("page_id", F.sha2(X.island(F.col("html")), 256).alias("digest"))


@query("D11_legal_steps", "WITH s(a) AS (VALUES ('PENDING'),('GROUNDED'),('GENERATED'),('SYNTAX_OK'),('GATED'),('GREEN'),('BLOCK'),('PARK')), p AS (SELECT x.a AS a, y.a AS b, n_nationkey AS n FROM s x, s y, nation) SELECT a, b, n, ((a='PENDING' AND b='GROUNDED') OR (a='GROUNDED' AND b='GENERATED') OR (a='GENERATED' AND b='SYNTAX_OK') OR (a='GATED' AND b='GREEN') OR (a='PARK' AND b='PENDING') OR (b='BLOCK' AND a IN ('PENDING','GROUNDED','GENERATED','SYNTAX_OK','GATED')) OR (b='GENERATED' AND a IN ('SYNTAX_OK','GATED') AND n%5<3) OR (a='BLOCK' AND b='PARK' AND n%2=0)) AS legal FROM p")
def _(s, sf):
    from tessera.plans import verdicts as V

    names = s.createDataFrame([(x,) for x in ("PENDING", "GROUNDED", "GENERATED", "SYNTAX_OK", "GATED", "GREEN", "BLOCK", "PARK")], "a string")
    pairs = names.join(names.withColumnRenamed("a", "b")).join(D.read(s, sf, "nation").select(F.col("n_nationkey").alias("n")))
    reason = F.when(F.col("n") % 2 == 0, "NO_RELEASED_SUCCESSOR").otherwise("other")
    return pairs.withColumn("legal", V.may_step(F.col("a"), F.col("b"), F.col("n") % 5, reason))


