"""Queries of parsers, edges and features over sources that are made from the rows of `part`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans import documents as M
from tessera.plans import facts as P
from tessera.plans import features as T
from tessera.plans import rules as U
from tessera.queries import query
from tessera.queries_packs import ORACLES, QUERIES, Fragments, files
from tessera.sources import adapters as D
from tessera.sources import artifacts as A
from tessera.sources import bundle as B

__all__ = ["ORACLES", "QUERIES"]


def made(s, sf: str, *by_size: str) -> DataFrame:
    """object, source: one of the texts, by the part's size; @ in a text stands for the part's key."""
    p = D.read(s, sf, "part")
    text = F.element_at(F.array(*map(F.lit, by_size)), (F.col("p_size") % len(by_size) + 1).cast("int"))
    key = F.col("p_partkey").cast("string")
    return p.select("p_partkey", F.concat(F.lit("Z"), key).alias("object"), F.replace(text, F.lit("@"), key).alias("source"))


def parsed(s, sf: str, parse, kind: str, *by_size: str) -> DataFrame:
    return A.parsed(made(s, sf, *by_size), "x", parse, kind)


def case(*by_size: str) -> str:
    """The SQL of one of the values (expressions) by the part's size."""
    return f"CASE p_size%{len(by_size)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(by_size)) + " END"


@query("F4_code_without_comments", "SELECT p_partkey, " + case("''", "'x = ''a\"b''. '", "'y = |c \" d|. '", "' * no'") + " AS code FROM part")
def _(s, sf):
    strip = lambda x: A.without_comments(x, '"', block=False, star=True)
    return parsed(s, sf, strip, "string", "* whole line", "x = 'a\"b'. \" rest", 'y = |c " d|. "rest', " * no").select("p_partkey", F.col("x").alias("code"))


@query("F5_views_without_comments", "SELECT p_partkey, " + case("'a '", "'b   c'", "'''l // no'' '") + " AS code FROM part")
def _(s, sf):
    return parsed(s, sf, A.without_comments, "string", "a // x", "b /* y */ c", "'l // no' // z").select("p_partkey", F.col("x").alias("code"))


@query("X6_snippets", "SELECT p_partkey, " + case("'MOVE A TO ''b  c''.'", "'X = `q r` & |s t|'", "'OPEN ''lit'") + " AS snippet FROM part")
def _(s, sf):
    return parsed(s, sf, A.snippet, "string", "  move   a to 'b  c'.", "x = `q r`  & |s t|", "open 'lit").select("p_partkey", F.col("x").alias("snippet"))


@query("X31_parts", "SELECT p_partkey, " + case("'a| f(b,c)| ''x,y''| d'", "'one'", "'{a,b}|c'") + " AS parts FROM part")
def _(s, sf):
    return parsed(s, sf, A.split_top, "array<string>", "a, f(b,c), 'x,y', d", "one", "{a,b},c").select("p_partkey", F.array_join("x", "|").alias("parts"))


VIEW = "@VDM.private: true\ndefine root view entity ZI_@ as select from zt\nassociation [0..1] to ZI_OTHER as _o on a = b\n{ key a, // key b\n cast( c as abap.int4 ) as d, _o }"


@query("X35_views", "SELECT p_partkey, CASE WHEN p_size%2=0 THEN 'ZI_'||p_partkey END AS entity, CASE WHEN p_size%2=0 THEN 'zt' END AS source, CASE WHEN p_size%2=0 THEN 'a' ELSE '' END AS keys, CASE WHEN p_size%2=0 THEN 2 ELSE 0 END AS fields, CASE WHEN p_size%2=0 THEN 'ZI_OTHER' ELSE '' END AS associations FROM part")
def _(s, sf):
    x = F.col("x")
    return parsed(s, sf, A.view, A.VIEW, VIEW, "no view at all").select("p_partkey", x["entity"].alias("entity"), x["source"].alias("source"), F.array_join(x["keys"], ",").alias("keys"), F.size(x["fields"]).alias("fields"), F.array_join(x["associations"]["target"], ",").alias("associations"))


BEHAVIORS = (
    "managed with additional save implementation in class zbp_@ unique;\ndefine behavior for ZI_A alias Root authorization master ( global, instance )\n{ create; update; action doIt; association _items { create; } }",
    "unmanaged;\ndefine behavior for ZI_B { delete; }", "projection;\ndefine behavior for ZC_C alias c { use create; }",
)


@query("X36_behaviors", "SELECT p_partkey, " + case("'managed with additional save'", "'unmanaged'", "'projection'") + " AS implementation, p_size%3<2 AS needs_saver, CASE WHEN p_size%3=0 THEN 'ZBP_'||p_partkey END AS class, " + case("'ZI_A'", "'ZI_B'", "'ZC_C'") + " AS entity, " + case("'create,update,doIt'", "'delete'", "''") + " AS operations FROM part")
def _(s, sf):
    x = F.col("x")
    e = x["entities"][0]
    return parsed(s, sf, A.behavior, A.BEHAVIOR, *BEHAVIORS).select("p_partkey", x["implementation"].alias("implementation"), x["needs_saver"].alias("needs_saver"), x["class"].alias("class"), e["entity"].alias("entity"), F.array_join(e["operations"], ",").alias("operations"))


@query("X37_grants", "SELECT p_partkey, " + case("'ZI_A:pfcg_auth:S_X'", "'ZI_B:condition:'", "''") + " AS grants FROM part")
def _(s, sf):
    g = F.transform("x", lambda e: F.concat_ws(":", e["entity"], e["form"], F.array_join(e["objects"], "+")))
    texts = ("define role r { grant select on zi_a where ( a ) = aspect pfcg_auth( s_x, f, actvt = '03' ); }", "define role r { grant select on zi_b where a = 'X'; }", "define role r { }")
    return parsed(s, sf, A.access, A.ACCESS, *texts).select("p_partkey", F.array_join(g, ",").alias("grants"))


@query("S18_elements", "SELECT p_partkey, " + case("2", "1", "0") + " AS n, " + case("'A'", "'B'", "''") + " AS first FROM part")
def _(s, sf):
    fields = lambda x: A.elements(x, "DD03P")
    texts = ('<x:r xmlns:x="u"><x:DD03P><FIELDNAME>A</FIELDNAME></x:DD03P><DD03P><FIELDNAME>C</FIELDNAME></DD03P></x:r>', "<r><DD03P><FIELDNAME> B </FIELDNAME></DD03P></r>", "<r><DD03P>")
    return parsed(s, sf, fields, A.XML, *texts).select("p_partkey", F.size("x").alias("n"), F.coalesce(F.get("x", 0)["FIELDNAME"], F.lit("")).alias("first"))


@query("S5_listings", "SELECT 'Z'||p_partkey AS name, CASE WHEN p_size%3=2 THEN NULL ELSE 'CLAS' END AS type FROM part WHERE p_size%4<>3")
def _(s, sf):
    p, k = D.read(s, sf, "part"), F.concat(F.lit("Z"), F.col("p_partkey").cast("string"))
    name, kind = F.element_at(F.array(*map(F.lit, ("name", "OBJECT_NAME", "objectName"))), F.col("p_size") % 3 + 1), F.when(F.col("p_size") % 3 == 0, "type").when(F.col("p_size") % 3 == 1, "OBJECT_TYPE").otherwise("kind")
    box = F.element_at(F.array(*map(F.lit, ("objects", "items", "nodes", "other"))), F.col("p_size") % 4 + 1)
    return A.listing(s, p.select(F.format_string('{"%s":[{"%s":"%s","%s":"CLAS"},{"else":"x"}]}', box, name, k, kind).alias("value")))


@query("S4_live_files", "SELECT lower('/N/z'||p_partkey) AS object, " + case("replace(lower('/N/z'||p_partkey),'/','#')||'.clas.abap'", "NULL", "NULL") + " AS filename, " + case("NULL", "'unsupported type'", "'empty source'") + " AS reason FROM part")
def _(s, sf):
    p = D.read(s, sf, "part").select(F.concat(F.lit("/N/z"), F.col("p_partkey").cast("string")).alias("name"), F.when(F.col("p_size") % 3 == 1, "NONE").otherwise("CLAS").alias("type"), F.when(F.col("p_size") % 3 == 2, "  ").otherwise("x").alias("source"))
    good, bad = T.live_files(p)
    return good.select(F.lower(F.replace(F.regexp_extract("filename", r"^([^.]*)", 1), F.lit("#"), F.lit("/"))).alias("object"), "filename", F.lit(None).cast("string").alias("reason")).unionByName(bad.select(F.lower("name").alias("object"), F.lit(None).cast("string").alias("filename"), "reason"))


EDGES: Fragments = [
    ("p_size % 2 = 0", "SELECT * FROM mara INTO TABLE lt.\nUPDATE zorders SET a = 1.\n", []), ("p_size % 3 = 0", "CALL FUNCTION 'ZF'.\nAUTHORITY-CHECK OBJECT 'S_X' ID 'A' FIELD b.\nINCLUDE zinc.\n", []), ("p_size % 5 = 0", "CLASS zc DEFINITION FINAL INHERITING FROM zbase.\nINTERFACES zif.\nENDCLASS.\n", []),
]


def statements(s, sf: str, fragments: Fragments) -> DataFrame:
    return B.statements(files(s, sf, fragments, ".prog.abap", "PROG"))


def _edges(*rows: tuple[str, str, str, str]) -> str:
    return " UNION ALL ".join(f"SELECT 'Z'||p_partkey AS source, '{t}' AS target, '{k}' AS kind, {a} AS access FROM part WHERE {c}" for c, t, k, a in rows)


@query("G3_statement_edges", _edges(("p_size%2=0", "MARA", "uses-table", "'read'"), ("p_size%2=0", "ZORDERS", "uses-table", "'write'"), ("p_size%3=0", "ZF", "call-function", "NULL"), ("p_size%3=0", "S_X", "authority-check", "NULL"), ("p_size%3=0", "ZINC", "includes", "NULL")))
def _(s, sf):
    return U.edges(statements(s, sf, EDGES)).where("kind <> 'inherits'")


@query("G5_inherits_edges", _edges(("p_size%5=0", "ZBASE", "inherits", "NULL"), ("p_size%5=0", "ZIF", "inherits", "NULL")))
def _(s, sf):
    return U.edges(statements(s, sf, EDGES)).where("kind = 'inherits'")


NATIVE: Fragments = [("p_size % 2 = 0", "EXEC SQL.\nSELECT a FROM t_read WHERE a = 1.\nINSERT INTO t_new VALUES (1).\nENDEXEC.\n", []), ("p_size % 3 = 0", "EXEC SQL.\nDELETE FROM t_old.\nUPDATE s.t SET a = 1.\nENDEXEC.\nUPDATE t_open SET a = 1.\n", [])]


@query("G4_native_edges", " UNION ALL ".join(f"SELECT 'Z'||p_partkey AS source, '{t}' AS target, '{a}' AS access FROM part WHERE {c}" for c, t, a in (("p_size%2=0", "T_READ", "read"), ("p_size%2=0", "T_NEW", "write"), ("p_size%3=0", "T_OLD", "write"))))
def _(s, sf):
    return T.native_edges(statements(s, sf, NATIVE))


CALLS: Fragments = [("p_size % 2 = 0", "x = zcl_known=>run( a ).\ny = zcl_other=>go( ).\n", []), ("p_size % 3 = 0", "PERFORM f.\nPERFORM g IN PROGRAM zprog.\n", [])]


@query("G2_call_edges", _edges(("p_size%2=0", "ZCL_KNOWN.RUN", "call-method", "NULL")).replace(", NULL AS access", "") + " UNION ALL SELECT 'Z'||p_partkey, 'Z'||p_partkey||'.GO', 'call-method' FROM part WHERE p_size%2=0 UNION ALL SELECT 'Z'||p_partkey, 'Z'||p_partkey||'.F', 'calls' FROM part WHERE p_size%3=0 UNION ALL SELECT 'Z'||p_partkey, 'ZPROG.G', 'calls' FROM part WHERE p_size%3=0")
def _(s, sf):
    st = statements(s, sf, CALLS)
    return T.call_edges(st, st.select("object").distinct().union(s.createDataFrame([("ZCL_KNOWN",), ("ZPROG",)], "object string")))


@query("G6_view_edges", "SELECT 'ZI_'||p_partkey AS source, unnest(['ZT','ZI_OTHER']) AS target, 'consumes-cds' AS kind FROM part WHERE p_size%2=0")
def _(s, sf):
    return A.view_edges(A.parsed(made(s, sf, VIEW, "no view at all"), "view", A.view, A.VIEW))


@query("G7_behavior_edges", "SELECT 'Z'||p_partkey AS source, " + case("'ZI_A'", "'ZI_B'", "'ZC_C'") + " AS target, 'consumes-cds' AS kind FROM part UNION ALL SELECT 'Z'||p_partkey, 'ZBP_'||p_partkey, 'calls' FROM part WHERE p_size%3=0")
def _(s, sf):
    return A.behavior_edges(A.parsed(made(s, sf, *BEHAVIORS), "behavior", A.behavior, A.BEHAVIOR))


WORK: Fragments = [
    ("p_size % 2 = 0", "COMMIT WORK.\nIF a = 1.\nLOOP AT lt INTO ls.\nENDLOOP.\nENDIF.\n", []), ("p_size % 3 = 0", "TRY.\nDELETE FROM t CLIENT SPECIFIED WHERE a = 1.\nCATCH zcx.\nENDTRY.\n", []),
    ("p_size % 5 = 0", "AUTHORITY-CHECK OBJECT 'S_A' ID 'X' FIELD y.\nIF sy-subrc <> 0.\nENDIF.\n", []), ("p_size % 5 = 1", "AUTHORITY-CHECK OBJECT 'S_B' ID 'X' FIELD y.\nUPDATE t SET a = 1.\nIF sy-subrc <> 0.\nENDIF.\n", []), ("true", "x = 1.\n", []),
]


@query("D1_imperative", "SELECT 'Z'||p_partkey AS object, (p_size%2=0)::BIGINT AS commit_work, (p_size%3=0)::BIGINT AS client_specified, 2*(p_size%3=0)::BIGINT AS exception_paths, 2*(p_size%2=0)::BIGINT+(p_size%3=0)::BIGINT+(p_size%5<2)::BIGINT AS cfg_branches, CASE WHEN p_size%2=0 THEN 2 WHEN p_size%3=0 OR p_size%5<2 THEN 1 ELSE 0 END::BIGINT AS max_nesting, CASE p_size%5 WHEN 0 THEN 'S_A:true' WHEN 1 THEN 'S_B:false' ELSE '' END AS auth FROM part")
def _(s, sf):
    return T.imperative(statements(s, sf, WORK)).withColumn("auth", F.array_join("auth", ",")).drop("kinds")


@query("W3_checked_after", "SELECT 'Z'||p_partkey AS object, p_size%5=0 AS checked FROM part WHERE p_size%5<2")
def _(s, sf):
    return T.checked_after(statements(s, sf, WORK)).select("object", "checked")


@query("D2_declarative", "SELECT 'Z'||p_partkey AS object, 2::BIGINT AS artifacts, CASE WHEN p_size%3=0 THEN 'ZI_A' WHEN p_size%3=1 THEN 'ZI_B' ELSE '' END AS auth FROM part")
def _(s, sf):
    b = A.parsed(made(s, sf, BEHAVIORS[0], "unmanaged;\ndefine behavior for ZI_B authorization master ( global ) { delete; }", BEHAVIORS[2]), "behavior", A.behavior, A.BEHAVIOR)
    v = A.parsed(made(s, sf, VIEW), "view", A.view, A.VIEW)
    g = A.parsed(made(s, sf, "x").where("false"), "grants", A.access, A.ACCESS)
    return T.declarative(v, b, g).withColumn("auth", F.array_join("auth", ","))


@query("W10_dangling_symbols", "SELECT 'Z'||p_partkey AS object, '<F>' AS symbol FROM part WHERE p_size%3=0")
def _(s, sf):
    code: Fragments = [("p_size % 3 = 0", "LOOP AT lt ASSIGNING <f>.\nENDLOOP.\n<f>-a = 1.\n", []), ("p_size % 3 = 1", "LOOP AT lt ASSIGNING <f>.\n<f>-a = 1.\nENDLOOP.\nUNASSIGN <f>.\n", [])]
    return M.dangling_symbols(statements(s, sf, code)).select(F.upper(F.substring_index("filename", ".", 1)).alias("object"), "symbol")


@query("C20_seals", "SELECT 'Z'||p_partkey AS object, " + case("'dynamic-construct:1'", "''", "'enhancement-marker:2'", "'dynamic-construct:1,dynamic-target:1'") + " AS seals, " + case("''", "'LATE:perform-on-commit'", "''", "'ZCL_H=>GO:set-handler'") + " AS edges FROM part")
def _(s, sf):
    texts = ("CALL FUNCTION lv_name.", "CALL FUNCTION 'X'.\nPERFORM late ON COMMIT.", "x = 1.\n* ENHANCEMENT-POINT zz\n", "SET HANDLER lo->go me->(x) FOR a. DATA lo TYPE REF TO zcl_h.")
    d = parsed(s, sf, M.dynamics, M.DYNAMICS, *texts)
    line = lambda a, *names: F.array_join(F.transform(a, lambda x: F.concat_ws(":", *[x[n].cast("string") for n in names])), ",")
    return d.select("object", line(F.col("x.seals"), "kind", "line").alias("seals"), line(F.col("x.edges"), "target", "kind").alias("edges"))


@query("X25_contexts", "SELECT p_partkey, " + case("'test_class'", "'cds'", "'class'", "'bdef'", "'unknown'") + " AS context FROM part")
def _(s, sf):
    suffix: Column = F.element_at(F.array(*map(F.lit, (".clas.testclasses.abap", ".ddls.asddls", ".clas.abap", ".bdef.asbdef", ".txt"))), F.col("p_size") % 5 + 1)
    return D.read(s, sf, "part").select("p_partkey", P.context(F.concat(F.lit("z"), suffix)).alias("context"))


@query("X19_targets", "SELECT p_partkey, " + case("'RAP Business Object'", "'Fiori Elements App'", "'OData V4 Service'", "'RAP Interface'", "'CDS View Entity'", "'Review Required'") + " AS target FROM part")
def _(s, sf):
    kind = F.element_at(F.array(*map(F.lit, ("class", "report", "function", "interface", "table", "else"))), F.col("p_size") % 6 + 1)
    return D.read(s, sf, "part").select("p_partkey", P.target_of(kind).alias("target"))


@query("X13_content_hash", "SELECT p_partkey, sha256('{\"a\":['||p_size||',null],\"z\":true}') AS digest FROM part")
def _(s, sf):
    doc = F.concat(F.lit('{"z":true,"a":['), F.col("p_size").cast("string"), F.lit(",null]}"))
    return D.read(s, sf, "part").select("p_partkey", M.content_hash(doc).alias("digest"))


@query("W7_units", "SELECT 'Z'||p_partkey AS object, n AS line, CASE WHEN n IN (2,3) THEN 'FIRST' WHEN n IN (5,6) AND p_size%2=0 THEN 'SECOND' END AS method FROM part, (VALUES (1),(2),(3),(4),(5),(6),(7)) t(n) WHERE p_size%2=0 OR n<=5")
def _(s, sf):
    from tessera.plans.packs import annotated

    code: Fragments = [("true", "CLASS zc IMPLEMENTATION.\nMETHOD first.\na = 1.\nENDMETHOD.\n", []), ("p_size % 2 = 0", "METHOD second.\nb = 1.\nENDMETHOD.\n", []), ("p_size % 2 = 1", "ENDCLASS.\n", [])]
    return annotated(statements(s, sf, code)).select("object", "line", "method")


FACTS = {
    "consumption": ("ui_salv", "remote_rfc", "remote_idoc_outbound", "remote_idoc", "no_surface_evidence"), "persistence": ("owns_customer_table", "reads_sap_table", "no_persistence_evidence"), "disposition": ("rebuild", "replace", "keep"),
    "target": ("RAP Business Object", "CDS View Entity"), "kind": ("class", "function"),
}
_FACT = "f AS (SELECT p_partkey AS id, " + ", ".join(f"([{','.join(repr(x) for x in v)}])[p_partkey//{7 * i + 1}%{len(v)}+1] AS {k}" for i, (k, v) in enumerate(FACTS.items())) + " FROM part)"


def facts(s, sf) -> DataFrame:
    pick = lambda i, v: F.element_at(F.array(*map(F.lit, v)), (F.floor(F.col("p_partkey") / (7 * i + 1)) % len(v) + 1).cast("int"))
    one = [pick(i, v).alias(k) for i, (k, v) in enumerate(FACTS.items())]
    f = D.read(s, sf, "part").select(F.col("p_partkey").alias("id"), *one)
    none = F.array().cast("array<string>")
    return f.withColumns({"consumption": F.array("consumption"), "persistence": F.array("persistence"), "hints": none, "rules": none, "families": none}).withColumnRenamed("id", "node")


@query("C17_target_shapes", f"WITH {_FACT}, s AS (SELECT id, 'rap_bo_headless' AS shape, (disposition='rebuild')::INT+(target='RAP Business Object')::INT AS score FROM f WHERE (disposition='rebuild' OR target='RAP Business Object') AND consumption='remote_idoc_outbound' AND persistence<>'no_persistence_evidence' UNION ALL SELECT id, 'rap_bo_odata', 2 FROM f WHERE kind='function' AND consumption='remote_rfc' AND persistence<>'no_persistence_evidence' UNION ALL SELECT id, 'rap_bo_fiori', 2 FROM f WHERE consumption='ui_salv' AND persistence='owns_customer_table' UNION ALL SELECT id, 'fiori_list_report', 1 FROM f WHERE consumption='ui_salv' AND persistence='reads_sap_table' UNION ALL SELECT id, 'rap_bo_events', 1 FROM f WHERE consumption='remote_idoc_outbound' AND persistence<>'no_persistence_evidence' UNION ALL SELECT id, 'rap_bo_message_driven', 1 FROM f WHERE consumption='remote_idoc' AND persistence<>'no_persistence_evidence' UNION ALL SELECT id, 'analytical_cds', 1 FROM f WHERE target='CDS View Entity' AND consumption<>'no_surface_evidence' UNION ALL SELECT id, 'custom_entity_query', 1 FROM f WHERE consumption='remote_rfc' AND persistence<>'owns_customer_table' UNION ALL SELECT id, 'released_replace', 1 FROM f WHERE disposition='replace') SELECT id AS node, shape, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, shape)::INT AS place FROM s")
def _(s, sf):
    from tessera.operators.orders import best_shapes
    from tessera.plans import shapes

    m = shapes.matched(facts(s, sf), "node")
    return best_shapes(m, "node", 10).join(m, ["node", "id"]).select("node", F.col("id").alias("shape"), "score", "place")


@query("F9_shape_gaps", f"WITH {_FACT} SELECT id AS node, CASE WHEN kind='function' THEN '' ELSE 'object_kind:function' END AS unmet_all, CASE WHEN consumption='remote_rfc' THEN '' ELSE 'consumption:remote_rfc,consumption:remote_bapi' END AS unmet_any, CASE WHEN persistence='no_persistence_evidence' THEN 'persistence:no_persistence_evidence' ELSE '' END AS violated_none FROM f WHERE NOT (kind='function' AND consumption='remote_rfc' AND persistence<>'no_persistence_evidence')")
def _(s, sf):
    from tessera.plans import shapes

    text = lambda c: F.array_join(c, ",").alias(c)
    return shapes.explained(facts(s, sf), "node").where("id = 'rap_bo_odata'").select("node", text("unmet_all"), text("unmet_any"), text("violated_none"))
