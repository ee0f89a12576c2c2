"""Queries by survey id: facts, grounding, condensation, scalars of the planner."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as X
from tessera.operators import aggregates as A
from tessera.operators import graph as G
from tessera.plans import facts as P
from tessera.queries_plan import ORACLES, QUERIES
from tessera.queries import query
from tessera.sources import adapters as D

__all__ = ["ORACLES", "QUERIES"]

#: Names that the test edges call, by part.
NAMES = ("CL_GUI_ALV_GRID", "GUI_UPLOAD", "CL_GUI_CONTAINER", "IDOC_INPUT_ORDERS", "MASTER_IDOC_DISTRIBUTE", "BAPI_PO_CREATE", "ZCL_LOCAL", "RFC_PING", "EDI_DOCUMENT_STATUS_SET", "/ACME/TORDER", "/SAPAPO/MATKEY", "ZORDERS", "MARA")
_SQL_NAMES = "[" + ",".join(f"'{n}'" for n in NAMES) + "]"
#: edges of objects to those names (source, target, kind, access, destination)
CALLS = f"calls AS (SELECT DISTINCT 'S'||l_suppkey AS source, ({_SQL_NAMES})[l_partkey%{len(NAMES)}+1] AS target, CASE WHEN l_partkey%{len(NAMES)}>=9 THEN 'uses-table' ELSE 'calls' END AS kind, CASE WHEN l_returnflag='R' THEN 'write' END AS access, CASE WHEN l_partkey%{len(NAMES)}=6 AND l_suppkey%2=0 THEN 'DEST' END AS destination FROM lineitem)"
_OR = lambda parts: "(" + " OR ".join(parts) + ")"
_CONSTRUCT = lambda x: "CASE " + " ".join(f"WHEN {_OR([f'starts_with({x},{p!r})' for p in starts] + [f'contains({x},{p!r})' for p in held])} THEN '{n}'" for n, (starts, held) in P.CONSTRUCTS.items()) + f" WHEN list_contains(string_split({x},'_'),'RFC') THEN 'remote_rfc' END"
_WAY = lambda x: "CASE " + " ".join(f"WHEN {_OR([f'starts_with({x},{p!r})' for p in starts])} THEN '{n}'" for n, starts in P.DIRECTIONS.items()) + " END"
_WRITES = lambda x: _OR([f"starts_with({x},{p!r})" for p in P.WRITERS] + [f"starts_with({x},'BAPI_') AND contains({x},'_{p}')" for p in P.WRITING])


def calls(s, sf):
    li = D.read(s, sf, "lineitem")
    k = F.col("l_partkey") % len(NAMES)
    return li.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("source"), F.element_at(F.array(*map(F.lit, NAMES)), (k + 1).cast("int")).alias("target"), F.when(k >= 9, "uses-table").otherwise("calls").alias("kind"),
        F.when(F.col("l_returnflag") == "R", "write").alias("access"), F.when((k == 6) & (F.col("l_suppkey") % 2 == 0), "DEST").alias("destination"),
    ).distinct()


def objects(s, sf):
    return D.read(s, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("object"))


@query("C8_consumption", f"WITH {CALLS}, f AS (SELECT source AS object, coalesce({_CONSTRUCT('target')}, CASE WHEN destination IS NOT NULL THEN 'remote_rfc' END, CASE WHEN target='MARA' THEN 'classic_api_surface' END) AS fact FROM calls UNION ALL SELECT source, {_WAY('target')} FROM calls) SELECT 'S'||s_suppkey AS object, coalesce((SELECT string_agg(DISTINCT fact, ',' ORDER BY fact) FROM f WHERE f.object='S'||s_suppkey), 'no_surface_evidence') AS facts FROM supplier")
def _(s, sf):
    facts = calls(s, sf).select(F.col("source").alias("object"), F.explode(P.surface(F.col("target"), F.col("destination"), F.col("target") == "MARA")).alias("fact"))
    return P.with_absence(objects(s, sf), facts, P.NO_SURFACE).select("object", F.array_join("facts", ",").alias("facts"))


@query("C9_persistence", f"WITH {CALLS}, f AS (SELECT source AS object, CASE WHEN kind='uses-table' THEN CASE WHEN target[1] IN ('Z','Y') OR target LIKE '/ACME/%' THEN CASE WHEN access='write' THEN 'owns_customer_table' ELSE 'reads_customer_table' END ELSE CASE WHEN access='write' THEN 'writes_sap_table' ELSE 'reads_sap_table' END END WHEN regexp_matches(target,'^[ZY]') THEN NULL WHEN {_WRITES('target')} THEN 'writes_via_sap_api' END AS fact FROM calls) SELECT 'S'||s_suppkey AS object, coalesce((SELECT string_agg(DISTINCT fact, ',' ORDER BY fact) FROM f WHERE f.object='S'||s_suppkey), 'no_persistence_evidence') AS facts FROM supplier")
def _(s, sf):
    own = P.owns(F.col("target"), customer=("/ACME/",))
    facts = calls(s, sf).select(F.col("source").alias("object"), P.persistence(F.col("target"), F.col("kind"), F.col("access"), own).alias("fact")).where("fact is not null")
    return P.with_absence(objects(s, sf), facts, P.NO_PERSISTENCE).select("object", F.array_join("facts", ",").alias("facts"))


@query("C10_ownership", f"WITH {CALLS} SELECT target, count(*) AS n, bool_or(CASE WHEN regexp_matches(target,'^[ZY]') THEN true WHEN NOT regexp_matches(target,'^/[A-Z0-9_]+/') THEN false ELSE target LIKE '/ACME/%' END) AS own FROM calls GROUP BY 1")
def _(s, sf):
    return calls(s, sf).groupBy("target").agg(F.count("*").alias("n"), F.bool_or(P.owns(F.col("target"), ("/ACME/",), ("/SAPAPO/",))).alias("own"))


@query("C3_release_states", D.with_("registry") + "SELECT name, CASE level WHEN 'A' THEN 'released' WHEN 'D' THEN 'removed' ELSE 'deprecated' END AS release_state, CASE level WHEN 'A' THEN 'keep-and-clean' WHEN 'D' THEN 'retire' ELSE 're-platform' END AS tier FROM registry")
def _(s, sf):
    return D.registry(s, sf).select("name", *P.release(F.col("level")))


@query("C6_grounding", D.with_("registry") + "SELECT coalesce(r.state,'unknown') AS state, count(*) AS n FROM (SELECT DISTINCT l_partkey FROM lineitem) l LEFT JOIN registry r ON r.name='P'||l_partkey GROUP BY 1")
def _(s, sf):
    refs = D.read(s, sf, "lineitem").select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("name")).distinct()
    return P.grounding_counts(refs, D.registry(s, sf))


@query("C11_candidates", D.with_("edges", "registry", "findings") + ", e AS (SELECT e.source, e.target, r.level, CASE WHEN r.name IS NULL OR r.state='noAPI' THEN 0 ELSE 1 END AS successors FROM edges e LEFT JOIN registry r ON r.name=e.target WHERE e.kind='uses-table'), f AS (SELECT object, count(*) FILTER (severity='p1' AND family IN ('released-api','deprecation'))=0 AS clean FROM findings WHERE line<=2 AND file LIKE '%7' GROUP BY 1), b AS (SELECT source AS object, count(*) AS n, count(*) FILTER (coalesce(level,'-')<>'A') AS bad, string_agg(DISTINCT CASE WHEN level IN ('B','C','D') AND successors=0 THEN target END, ',' ORDER BY target) AS refs FROM (SELECT *, target AS t2 FROM e) GROUP BY 1) SELECT 'S'||s_suppkey AS object, coalesce(clean,false) AS released_clean, CASE WHEN coalesce(clean,false) AND coalesce(n,0)>0 AND bad=0 THEN 1.0 ELSE 0.8 END::DOUBLE AS certainty, coalesce(refs,'') AS refs FROM supplier LEFT JOIN f ON f.object='S'||s_suppkey LEFT JOIN b ON b.object='S'||s_suppkey".replace("string_agg(DISTINCT CASE WHEN level IN ('B','C','D') AND successors=0 THEN target END, ',' ORDER BY target)", "array_to_string(list_sort(list_distinct(list(CASE WHEN level IN ('B','C','D') AND successors=0 THEN target END))), ',')"))
def _(s, sf):
    r = D.registry(s, sf).select(F.col("name").alias("target"), "level", F.when(F.col("state") == "noAPI", 0).otherwise(1).alias("successors"))
    e = D.edges(s, sf).where("kind = 'uses-table'").join(r, "target", "left").withColumn("successors", F.coalesce("successors", F.lit(0)))
    f = D.findings(s, sf).where("line <= 2 and file like '%7'").select("object", F.when(F.col("severity") == "p1", "P1").otherwise("P2").alias("priority"), "family")
    return P.grounded(f, e, objects(s, sf), ("released-api", "deprecation")).select("object", "released_clean", "certainty", F.array_join("no_successor_refs", ",").alias("refs"))


@query("C23_triage", "WITH f AS (SELECT p_partkey, (['talos-duplicate-block','talos-cds-auth-not-required','talos-select-in-loop'])[p_partkey%3+1] AS rule_id, 'z'||p_partkey||(['.clas.testclasses.abap','.clas.abap','.ddls.asddls','.txt'])[p_partkey%4+1] AS file FROM part) SELECT p_partkey, CASE rule_id WHEN 'talos-duplicate-block' THEN 'fix' WHEN 'talos-cds-auth-not-required' THEN 'document' ELSE 'recommend' END AS action, CASE WHEN file LIKE '%.testclasses.abap' THEN 'test_class' WHEN file LIKE '%.asddls' THEN 'cds' WHEN file LIKE '%.clas.abap' THEN 'class' ELSE 'unknown' END AS context FROM f")
def _(s, sf):
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("p_partkey") % len(xs) + 1).cast("int"))
    rule = pick(("talos-duplicate-block", "talos-cds-auth-not-required", "talos-select-in-loop"))
    file = F.concat(F.lit("z"), F.col("p_partkey").cast("string"), pick((".clas.testclasses.abap", ".clas.abap", ".ddls.asddls", ".txt")))
    return D.read(s, sf, "part").select("p_partkey", P.triage(rule).alias("action"), P.context(file).alias("context"))


# ------------------------------------------------------------ graphs

_FACTS = "fact AS (SELECT 'P'||p_partkey AS object, 'f'||(p_size%5) AS fact FROM part WHERE p_partkey%9=0)"
_STR = "e AS (SELECT 'P'||a AS source, 'P'||b AS target FROM cyc WHERE a<>b)"


def _string_edges(s, sf):
    return D.cyclic_edges(s, sf).where("a <> b").select(F.concat(F.lit("P"), F.col("a").cast("string")).alias("source"), F.concat(F.lit("P"), F.col("b").cast("string")).alias("target"))


def _facts(s, sf):
    return D.read(s, sf, "part").where("p_partkey % 9 = 0").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("object"), F.concat(F.lit("f"), (F.col("p_size") % 5).cast("string")).alias("fact"))


@query("G21_reached_facts", "WITH RECURSIVE " + D.SQL["cyc"] + f", {_STR}, {_FACTS}, k(object, fact) AS (SELECT object, fact FROM fact UNION SELECT e.source, k.fact FROM e JOIN k ON k.object=e.target) SELECT e.source AS object, k.fact, min(e.target) AS via FROM e JOIN k ON k.object=e.target WHERE NOT EXISTS (SELECT 1 FROM fact f WHERE f.object=e.source AND f.fact=k.fact) GROUP BY 1,2")
def _(s, sf):
    return P.reached(_facts(s, sf), _string_edges(s, sf))


@query("U8_member_union", "WITH f AS (SELECT s_suppkey AS k, s_nationkey AS node, CASE WHEN s_acctbal<0 THEN 'none' WHEN s_acctbal<5000 THEN 'low' ELSE 'high' END AS fact FROM supplier), u AS (SELECT node, list_sort(list_distinct(list(fact))) AS facts FROM f GROUP BY 1) SELECT node, array_to_string(CASE WHEN len(facts)>1 THEN list_filter(facts, lambda x: x<>'none') ELSE facts END, ',') AS facts FROM u")
def _(s, sf):
    d = D.read(s, sf, "supplier")
    fact = F.when(F.col("s_acctbal") < 0, "none").when(F.col("s_acctbal") < 5000, "low").otherwise("high")
    members = d.select(F.col("s_suppkey").alias("object"), F.col("s_nationkey").alias("node"))
    return P.member_union(d.select(F.col("s_suppkey").alias("object"), F.array(fact).alias("facts")), members, "none").select("node", F.array_join("facts", ",").alias("facts"))


@query("G13_condensation", "WITH RECURSIVE " + D.SQL["cyc"] + ", r(a,b) AS (SELECT a,b FROM cyc UNION SELECT r.a, cyc.b FROM r JOIN cyc ON cyc.a=r.b), ids AS (SELECT a AS id FROM cyc UNION SELECT b FROM cyc), root AS (SELECT id, least(id, coalesce((SELECT min(x.b) FROM r x JOIN r y ON y.a=x.b AND y.b=x.a WHERE x.a=ids.id), id)) AS root FROM ids) SELECT DISTINCT p.root AS a, q.root AS b FROM cyc JOIN root p ON p.id=cyc.a JOIN root q ON q.id=cyc.b WHERE p.root<>q.root")
def _(s, sf):
    return P.condensed(D.cyclic_edges(s, sf))[1]


@query("G22_ancestors", "WITH RECURSIVE " + D.SQL["cyc"] + f", {_STR}, inside AS (SELECT 'P'||p_partkey AS id FROM part WHERE p_partkey%5=0), w(id, place) AS (SELECT target, source FROM e WHERE target IN (SELECT id FROM inside) UNION SELECT w.id, e.source FROM w JOIN e ON e.target=w.place WHERE w.place NOT IN (SELECT id FROM inside)) SELECT DISTINCT id, place AS ancestor FROM w WHERE place IN (SELECT id FROM inside) AND id<>place")
def _(s, sf):
    inside = D.read(s, sf, "part").where("p_partkey % 5 = 0").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"))
    return P.in_plan_ancestors(_string_edges(s, sf), inside)


@query("G24_program_pools", "WITH RECURSIVE c AS (SELECT p_partkey AS a, p_partkey//3 AS b FROM part), u AS (SELECT a,b FROM c UNION SELECT b,a FROM c), r(a) AS (SELECT 0::BIGINT UNION SELECT u.b FROM r JOIN u ON u.a=r.a) SELECT DISTINCT u.a AS id, CASE WHEN u.a IN (SELECT a FROM r) THEN 0 ELSE u.a END::BIGINT AS root FROM u")
def _(s, sf):
    return G.components(D.read(s, sf, "part").select(F.col("p_partkey").alias("a"), F.floor(F.col("p_partkey") / 3).cast("long").alias("b")))


# ------------------------------------------------------------ scalars


@query("X17_priority", "SELECT p_partkey, CASE WHEN p_size/50.0>0.8 THEN 'P1' WHEN p_size/50.0>0.5 THEN 'P2' ELSE 'P3' END AS priority, CASE p_size%7 WHEN 0 THEN 'RAP Business Object' WHEN 1 THEN 'Fiori Elements App' WHEN 2 THEN 'OData V4 Service' WHEN 3 THEN 'RAP Interface' WHEN 4 THEN 'CDS View Entity' WHEN 5 THEN 'CDS View Entity' ELSE 'Review Required' END AS target FROM part")
def _(s, sf):
    kind = F.element_at(F.array(*map(F.lit, ("class", "report", "function", "interface", "table", "cds", "behavior"))), F.col("p_size") % 7 + 1)
    return D.read(s, sf, "part").select("p_partkey", X.priority(F.col("p_size") / 50.0).alias("priority"), P.target_of(kind).alias("target"))


@query("X18_migration_complexity", "SELECT p_partkey, (p_size/50.0>0.3)::INT+(p_size>10)::INT+(p_partkey%9>5)::INT+(p_retailprice/2000>0.6)::INT AS complexity FROM part")
def _(s, sf):
    return D.read(s, sf, "part").select("p_partkey", X.migration_complexity(F.col("p_size") / 50.0, F.col("p_size"), F.col("p_partkey") % 9, F.col("p_retailprice") / 2000).alias("complexity"))


@query("X27_grade_rank", "SELECT p_partkey, CASE p_partkey%5 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 0 ELSE 4 END AS rank FROM part")
def _(s, sf):
    grade = F.element_at(F.array(*map(F.lit, ("a", "B", "c", "D", "unknown"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return D.read(s, sf, "part").select("p_partkey", P.grade_rank(grade).alias("rank"))


@query("X29_scrub", "WITH m AS (SELECT event_id, event_type||' https://u'||user_id||':x@host X-SAP-Password: '||props AS m FROM events) SELECT event_id, left(regexp_replace(regexp_replace(m, 'https?://[^@\\s]+@', 'https://***@', 'g'), '(X-SAP-(?:Password|User|Host))\\s*[:=]\\s*\\S+', '\\1: ***', 'gi'), 500) AS message, CASE WHEN event_id%3=0 THEN 401 WHEN event_id%3=1 THEN 502 ELSE 500 END AS status FROM m")
def _(s, sf):
    m = F.concat("event_type", F.lit(" https://u"), F.col("user_id").cast("string"), F.lit(":x@host X-SAP-Password: "), "props")
    err = F.element_at(F.array(*map(F.lit, ("Unauthorized", "host Unreachable", "boom"))), (F.col("event_id") % 3 + 1).cast("int"))
    return D.read(s, sf, "events").select("event_id", P.scrubbed(m).alias("message"), P.status_of(err).alias("status"))


@query("X1_upper", "SELECT p_partkey, upper(p_type) AS ident, sha256(upper(p_type)) AS digest, regexp_replace(p_type, '([^A-Za-z0-9_ ])', '\\\\\\1', 'g') AS escaped FROM part")
def _(s, sf):
    t = F.col("p_type")
    return D.read(s, sf, "part").select("p_partkey", X.ident(t).alias("ident"), X.sha256_hex(X.ident(t)).alias("digest"), F.regexp_replace(t, r"([^A-Za-z0-9_ ])", r"\\$1").alias("escaped"))


@query("X33_arrays", "WITH g AS (SELECT p_brand, list(p_size ORDER BY p_partkey) AS xs, list(p_partkey%7 ORDER BY p_partkey) AS ys FROM part GROUP BY 1) SELECT p_brand, array_to_string(list_sort(list_distinct(xs)), ',') AS sorted, array_to_string(list_sort(list_distinct(list_concat(xs,ys))), ',') AS joined, list_contains(xs, 7) AS has7, array_to_string(list_sort(list_distinct(xs))[1:3], ',') AS head FROM g")
def _(s, sf):
    g = D.read(s, sf, "part").groupBy("p_brand").agg(F.collect_list("p_size").alias("xs"), F.collect_list((F.col("p_partkey") % 7).cast("int")).alias("ys"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    each = X.evidence_union(F.col("xs"))
    return g.select("p_brand", text(each).alias("sorted"), text(X.evidence_union(F.col("xs"), F.col("ys"))).alias("joined"), F.array_contains("xs", 7).alias("has7"), text(F.slice(each, 1, 3)).alias("head"))


@query("X34_maps", "SELECT user_id, count(*) FILTER (event_type='view') AS views, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def _(s, sf):
    n = D.read(s, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return m.select("user_id", X.counter_get(F.col("m"), "view").alias("views"), F.size(F.map_entries("m")).cast("long").alias("kinds"))


@query("A17_abstractness", "SELECT 'S'||l_suppkey AS object, CASE WHEN l_suppkey%10=0 THEN 1.0 ELSE avg((l_returnflag='N')::INT) END::DOUBLE AS abstractness FROM lineitem GROUP BY 1, l_suppkey")
def _(s, sf):
    methods = D.read(s, sf, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("object"), (F.col("l_suppkey") % 10 == 0).alias("interface"), (F.col("l_returnflag") == "N").alias("abstract"))
    return A.abstractness(methods)