"""Queries by survey id: remaining filters, joins, orders, graphs and validators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as X
from tessera.operators import graph as G
from tessera.operators import joins as J
from tessera.operators import orders as O  # noqa: E741
from tessera.operators import patterns as N
from tessera.operators import predicates as K
from tessera.plans import documents as M
from tessera.plans import facts as P
from tessera.plans import gate as Y
from tessera.queries import query
from tessera.queries_schedule import ORACLES, QUERIES
from tessera.sources import adapters as D
from tessera.sources import records as R

__all__ = ["ORACLES", "QUERIES"]


def _key(prefix, col):
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


@query("F11_transformations", D.with_("findings") + "SELECT object, count(*) AS n FROM findings WHERE family IS NOT NULL AND family<>'abaplint' GROUP BY 1")
def _(s, sf):
    return D.findings(s, sf).where(K.transformation(F.col("family"))).groupBy("object").agg(F.count("*").alias("n"))


@query("F13_owners", "SELECT event_id, coalesce(CASE WHEN event_id%3=0 THEN 'O'||user_id END, split_part('Z'||user_id||'.'||event_type, '.', 1)) AS owner FROM events")
def _(s, sf):
    return D.read(s, sf, "events").select("event_id", J.owner(F.concat(_key("Z", "user_id"), F.lit("."), "event_type"), F.when(F.col("event_id") % 3 == 0, _key("O", "user_id"))).alias("owner"))


@query("F14_digest_projections", D.with_("findings") + "SELECT object, rule_id, severity, family, message FROM findings WHERE severity='p1'")
def _(s, sf):
    return R.digest_findings(D.findings(s, sf).where("severity = 'p1'"))


@query("J3_source_lines", D.with_("lines") + "SELECT d.doc_id, 1+d.n_chars%40 AS line, sha256(coalesce(raw,'')) AS digest FROM documents d LEFT JOIN lines l ON l.doc_id=d.doc_id AND l.line=1+d.n_chars%40")
def _(s, sf):
    f = D.read(s, sf, "documents").select(F.col("doc_id").alias("file"), (1 + F.col("n_chars") % 40).alias("line"))
    return R.source_lines(f, D.lines(s, sf).withColumnRenamed("doc_id", "file")).select(F.col("file").alias("doc_id"), "line", F.sha2("raw", 256).alias("digest"))


@query("J4_file_owners", "SELECT o_orderkey, coalesce('C'||c.c_custkey, upper('f'||o_orderkey)) AS owner FROM orders o LEFT JOIN customer c ON c.c_custkey=o.o_custkey AND c.c_acctbal>0")
def _(s, sf):
    o = D.read(s, sf, "orders").select("o_orderkey", "o_custkey", F.concat(_key("src/f", "o_orderkey"), F.lit(".prog.abap")).alias("file"))
    c = D.read(s, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), _key("C", "c_custkey").alias("object"))
    return R.file_owners(o, o.join(c, "o_custkey")).select("o_orderkey", "owner")


@query("J5_domains", "SELECT s_suppkey, n_name AS domain FROM supplier JOIN nation ON upper('n'||s_nationkey)='N'||n_nationkey WHERE n_regionkey<3")
def _(s, sf):
    domains = D.read(s, sf, "nation").where("n_regionkey < 3").select(_key("N", "n_nationkey").alias("domain"), "n_name")
    elements = D.read(s, sf, "supplier").select("s_suppkey", _key("n", "s_nationkey").alias("domain"))
    return J.element_domains(elements, domains).select("s_suppkey", F.col("n_name").alias("domain"))


@query("J6_table_keys", "SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NULL THEN 'unknown-table' WHEN l_quantity<=p_size THEN 'covered' ELSE 'partial' END AS verdict FROM lineitem LEFT JOIN part ON p_partkey=l_partkey AND p_partkey%5<>0")
def _(s, sf):
    tables = D.read(s, sf, "part").where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    return J.key_coverage(D.read(s, sf, "lineitem"), tables, "l_partkey", F.col("l_quantity") <= F.col("p_size")).select("l_orderkey", "l_linenumber", "verdict")


@query("J7_strict_classes", "SELECT s_suppkey, m.strict FROM supplier JOIN (SELECT l_suppkey, max(l_linenumber) AS strict FROM lineitem WHERE l_returnflag='A' GROUP BY 1) m ON l_suppkey=s_suppkey")
def _(s, sf):
    behaviors = D.read(s, sf, "lineitem").where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("class"), F.col("l_linenumber").alias("strict"))
    return J.strict_classes(D.read(s, sf, "supplier").select(F.col("s_suppkey").alias("class")), behaviors).select(F.col("class").alias("s_suppkey"), "strict")


@query("J9_theta_rules", "SELECT page_id, r.id AS rule_id FROM pages, (VALUES ('script','<script'),('nav','<nav'),('number','[0-9]{4}')) r(id,p) WHERE regexp_matches(html, r.p)")
def _(s, sf):
    return K.text_hits(D.read(s, sf, "pages"), [("script", "<script"), ("nav", "<nav"), ("number", "[0-9]{4}")], "html").select("page_id", "rule_id")


#: Syllables of the documents' invented words; rules look for two of them and what follows.
SYLLABLES = tuple("th er on an re he in ed nd ha at en es or nt ea ti to it st io le is ou ar as de rt ve ng al te co me ll ri ro se ne ic".split())


def many_rules(n: int) -> list[tuple[str, str]]:
    """n line rules, numbered: two syllables, letters, then a sign; every third one in any case."""
    k = len(SYLLABLES)
    return [(f"r{i}", ("(?i)" if i % 3 == 0 else "") + SYLLABLES[i % k] + SYLLABLES[i // k % k] + "[a-z]*[,.]") for i in range(n)]


@query("J9_many_rules", f"WITH s AS (SELECT ['{"','".join(SYLLABLES)}'] AS s), rules AS (SELECT 'r'||i AS rule_id, i % 3 = 0 AS any_case, s[1+i%40]||s[1+i//40%40] AS factor, CASE WHEN i % 3 = 0 THEN '(?i)' ELSE '' END||s[1+i%40]||s[1+i//40%40]||'[a-z]*[,.]' AS p FROM s, range(0, 1600) t(i)), " + D.SQL["lines"] + ", code AS (SELECT doc_id, line, raw, lower(raw) AS low FROM lines WHERE NOT regexp_matches(raw, '^\\s*[*\"]')), grams AS (SELECT DISTINCT doc_id, line, raw, substr(low, i, 4) AS factor FROM (SELECT *, unnest(range(1, length(low) - 2)) AS i FROM code)) SELECT doc_id, line, rule_id FROM grams JOIN rules USING (factor) WHERE regexp_matches(raw, p)")
def _(s, sf):
    return N.scanned(D.read(s, sf, "documents"), many_rules(1600))


@query("J10_service_chain", "SELECT r_name, n_name, count(*) AS n FROM region JOIN nation ON n_regionkey=r_regionkey JOIN supplier ON s_nationkey=n_nationkey GROUP BY 1,2")
def _(s, sf):
    r, n, p = (D.read(s, sf, t) for t in ("region", "nation", "supplier"))
    views = p.groupBy(F.col("s_nationkey").alias("entity")).agg(F.count("*").alias("n"))
    return J.service_chain(r.withColumnRenamed("r_regionkey", "definition"), n.select(F.col("n_regionkey").alias("definition"), F.col("n_nationkey").alias("entity"), "n_name"), views).select("r_name", "n_name", "n")


@query("J11_extensions", "SELECT page_id, l.doc_id FROM (SELECT page_id, regexp_extract(url,'/([0-9]+)',1) AS k FROM pages) p JOIN documents l ON l.doc_id::VARCHAR=p.k")
def _(s, sf):
    views = D.read(s, sf, "documents").select(F.col("doc_id").cast("string").alias("view"), "doc_id")
    return J.extended_views(D.read(s, sf, "pages"), views, F.regexp_extract("url", "/([0-9]+)", 1)).select("page_id", "doc_id")


@query("J15_batch_siblings", "SELECT p_partkey FROM part p WHERE p_partkey%3=0 AND NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand=p.p_brand AND q.p_size=p.p_size AND q.p_partkey%3=1)")
def _(s, sf):
    k = F.col("p_partkey") % 3
    return J.without_sibling(D.read(s, sf, "part"), k == 0, k == 1, ["p_brand", "p_size"]).select("p_partkey")


@query("J16_reciprocals", "WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem) SELECT a, b FROM e WHERE NOT EXISTS (SELECT 1 FROM e r WHERE r.a=e.b AND r.b=e.a)")
def _(s, sf):
    return J.unreciprocated(D.read(s, sf, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")))


@query("S12_business_functions", "SELECT p_partkey, 'BF'||(p_size%10) AS bf FROM part WHERE p_size%10 IN (SELECT n_nationkey FROM nation WHERE n_regionkey=1)")
def _(s, sf):
    functions = D.read(s, sf, "nation").where("n_regionkey = 1").select(_key("BF", "n_nationkey").alias("bf"), F.lit("always-off").alias("state"))
    objects = D.read(s, sf, "part").select("p_partkey", F.concat(F.lit("BF"), (F.col("p_size") % 10).cast("string")).alias("bf"))
    return R.always_off(objects, functions).select("p_partkey", "bf")


@query("S11_provenance", "SELECT doc_id, CASE WHEN doc_id%3=0 THEN NULL ELSE doc_id%3=1 END AS matches_sidecar FROM documents")
def _(s, sf):
    d = D.read(s, sf, "documents").select(F.col("doc_id").alias("name"), F.col("text").alias("content"))
    sidecar = d.where("name % 3 <> 0").select("name", F.when(F.col("name") % 3 == 1, F.sha2("content", 256)).otherwise("0").alias("sha256"))
    return R.provenance(d, sidecar).select(F.col("name").alias("doc_id"), "matches_sidecar")


@query("S17_datasets", "SELECT coalesce(u.k,m.k) AS object, u.n AS uses, m.n AS changes FROM (SELECT user_id AS k, count(*) AS n FROM events WHERE event_type='view' GROUP BY 1) u FULL JOIN (SELECT user_id AS k, count(*) AS n FROM events WHERE event_type='error' AND value>50 GROUP BY 1) m ON u.k=m.k")
def _(s, sf):
    e = D.read(s, sf, "events").withColumnRenamed("user_id", "object")
    count = lambda rows, name: rows.groupBy("object").agg(F.count("*").alias(name))
    return R.dataset(count(e.where("event_type = 'view'"), "uses"), count(e.where("event_type = 'error' and value > 50"), "changes"))


@query("G1_nodes", D.with_("nodes", "edges") + "SELECT id, coalesce(max(kind),'unknown') AS kind FROM (SELECT id, kind FROM nodes WHERE kind<>'table' UNION ALL SELECT source, NULL FROM edges UNION ALL SELECT target, NULL FROM edges) GROUP BY 1")
def _(s, sf):
    return G.build_nodes(D.nodes(s, sf).where("kind <> 'table'"), D.edges(s, sf))


@query("G8_node_cap", "SELECT n_name, s_suppkey, r<=3 AS kept FROM (SELECT n_name, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier JOIN nation ON n_nationkey=s_nationkey)")
def _(s, sf):
    n = D.read(s, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return G.capped(D.read(s, sf, "supplier").join(n, "s_nationkey"), "s_nationkey", "s_suppkey", 3).select("n_name", "s_suppkey", "kept")


@query("G16_waves", "WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey//2 AS b FROM part WHERE p_partkey>=1 UNION SELECT p_partkey, p_partkey//3 FROM part WHERE p_partkey>=1), w(id, n) AS (SELECT 0::BIGINT, 0 UNION SELECT e.a, w.n+1 FROM e JOIN w ON w.id=e.b AND e.a<>e.b) SELECT id, max(n)::BIGINT AS level FROM w GROUP BY 1")
def _(s, sf):
    p = D.read(s, sf, "part").where("p_partkey >= 1").select("p_partkey")
    e = p.select("p_partkey", F.floor(F.col("p_partkey") / 2).cast("long").alias("source")).union(p.select("p_partkey", F.floor(F.col("p_partkey") / 3).cast("long"))).distinct()
    return G.levels(e.select("source", F.col("p_partkey").cast("long").alias("target")).where("source <> target"))


@query("G17_dependency_counts", D.with_("nodes", "edges") + "SELECT coalesce(a.object,e.source) AS object, count(DISTINCT coalesce(b.object,e.target)) AS needs FROM edges e LEFT JOIN nodes a ON a.id=e.source LEFT JOIN nodes b ON b.id=e.target WHERE coalesce(a.object,e.source)<>coalesce(b.object,e.target) GROUP BY 1")
def _(s, sf):
    return G.object_graph(D.edges(s, sf), D.nodes(s, sf), D.edges_at_most(s, sf)).groupBy(F.col("source_owner").alias("object")).agg(F.countDistinct("target_owner").alias("needs"))


@query("G26_possible_cycles", "WITH RECURSIVE " + D.SQL["cyc"] + ", r(a,b) AS (SELECT a,b FROM cyc UNION SELECT r.a, cyc.b FROM r JOIN cyc ON cyc.a=r.b) SELECT DISTINCT c.a, c.b, EXISTS (SELECT 1 FROM r WHERE r.a=c.b AND r.b=c.a) AS possible_cycle FROM cyc c WHERE c.a<>c.b")
def _(s, sf):
    return G.possible_cycles(D.cyclic_edges(s, sf))


@query("G15_feedback_arcs")
def _(s, sf):
    return M.feedback_arcs(D.cyclic_edges(s, sf), 4)


@query("T6_debt_order", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_totalprice DESC, o_orderkey) AS symbols FROM orders GROUP BY 1")
def _(s, sf):
    return O.debt_order(D.read(s, sf, "orders"), "o_custkey", "o_totalprice", "o_orderkey")


@query("T9_shape_order", "SELECT p_brand, p_partkey, r::INT AS place FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r FROM part) WHERE r<=3")
def _(s, sf):
    rows = D.read(s, sf, "part").select("p_brand", F.col("p_partkey").alias("id"), F.col("p_size").alias("score"))
    return O.best_shapes(rows, "p_brand", 3).select("p_brand", F.col("id").alias("p_partkey"), "place")


@query("T2_json_order", "SELECT s_nationkey, sha256(string_agg('{\"id\":\"S'||s_suppkey||'\",\"kind\":\"class\"}', ',' ORDER BY '{\"id\":\"S'||s_suppkey||'\",\"kind\":\"class\"}')) AS digest FROM supplier GROUP BY 1")
def _(s, sf):
    rows = D.read(s, sf, "supplier").select("s_nationkey", _key("S", "s_suppkey").alias("id"), F.lit("class").alias("kind"))
    return O.json_order(rows, "s_nationkey", "id", "kind")


@query("T13_top_objects", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 200")
def _(s, sf):
    return O.by_count(D.read(s, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")), "n", "l_partkey", 200)


@query("X11_node_ids", "SELECT p_partkey, sha256('rule|'||p_brand||'|s'||(p_size%3)) AS id FROM part")
def _(s, sf):
    return D.read(s, sf, "part").select("p_partkey", M.node_id(F.lit("rule"), F.col("p_brand"), F.concat(F.lit("s"), (F.col("p_size") % 3).cast("string"))).alias("id"))


@query("X12_canonical_json", "SELECT p_partkey, '{\"a\":'||p_size||',\"b\":\"'||p_brand||'\"}' AS doc, sha256('{\"a\":'||p_size||',\"b\":\"'||p_brand||'\"}') AS digest FROM part")
def _(s, sf):
    doc = F.to_json(F.struct(F.col("p_brand").alias("b"), F.col("p_size").cast("double").alias("a")))
    return D.read(s, sf, "part").select("p_partkey", M.canonical_json(doc).alias("doc"), M.content_hash(doc).alias("digest"))


@query("X39_brief", D.with_("findings") + "SELECT object, string_agg(rule_id||' x'||n, '; ' ORDER BY rule_id) AS brief FROM (SELECT object, rule_id, count(*) AS n FROM findings GROUP BY 1,2) GROUP BY 1")
def _(s, sf):
    return P.brief(D.findings(s, sf))


@query("V2_digest_errors", "SELECT s_nationkey, len(list_filter([CASE WHEN s_nationkey%4=0 THEN 1 END, CASE WHEN count(*)>3 THEN 1 END, CASE WHEN bool_or(s_suppkey%7=0) THEN 1 END], lambda x: x IS NOT NULL))::INT AS errors FROM supplier GROUP BY 1")
def _(s, sf):
    grade = F.when(F.col("s_suppkey") % 7 == 0, "Q").otherwise("A")
    g = D.read(s, sf, "supplier").groupBy("s_nationkey").agg(F.collect_list(F.struct(_key("S", "s_suppkey").alias("object"), grade.alias("grade"), F.lit("retire").alias("effort_tier"))).alias("objects"))
    none = F.array().cast("array<struct<object:string,rule_id:string,severity:string,message:string>>")
    doc = g.withColumns({"digest_version": F.lit("1"), "package": F.when(F.col("s_nationkey") % 4 != 0, "p"), "source_system": F.lit("x"), "object_count": F.lit(3), "finding_count": F.lit(0), "findings": none})
    return doc.select("s_nationkey", F.size(M.digest_errors()).alias("errors"))


@query("V3_verdict_errors", "SELECT event_id, CASE WHEN event_type='view' THEN 4 ELSE 1 END AS errors FROM events")
def _(s, sf):
    kind = F.when(F.col("event_type") == "view", "security").otherwise("none")
    doc = F.when(F.col("event_type") == "view", F.concat(F.lit('{"gate":"x","pass":"maybe","range":'), F.col("event_id").cast("string"), F.lit("}")))
    return D.read(s, sf, "events").select("event_id", F.size(Y.verdict_errors(kind, doc)).alias("errors"))


@query("V4_signal_errors", "SELECT event_id, CASE WHEN value IS NULL OR value<0 THEN 1 ELSE 0 END+(user_id%2)::INT AS errors FROM events")
def _(s, sf):
    system = F.when(F.col("user_id") % 2 == 0, "s")
    row = F.struct(F.lit("PROG").alias("object_type"), _key("Z", "user_id").alias("object_name"), F.col("value").alias("exec_count"))
    doc = F.to_json(F.struct(F.lit("1").alias("schema_version"), system.alias("system"), F.lit("g").alias("generated_at"), F.struct(F.lit("SCMON").alias("source"), F.array(row).alias("rows")).alias("usage")))
    return D.read(s, sf, "events").select("event_id", F.size(M.signal_errors(doc)).alias("errors"))


@query("X5_escape", "SELECT p_partkey, regexp_replace(p_name||'.*(x)', '([.*+?^$(){}|\\[\\]\\\\])', '\\\\\\1', 'g') AS escaped FROM part")
def _(s, sf):
    return D.read(s, sf, "part").select("p_partkey", X.escape_pattern(F.concat("p_name", F.lit(".*(x)"))).alias("escaped"))


@query("X7_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(s, sf):
    return D.read(s, sf, "documents").select("doc_id", X.sha256_hex(F.col("text")).alias("digest"))


@query("X10_config_hash", "SELECT p_partkey, sha256('{\"brand\":\"'||p_brand||'\",\"size\":'||p_size||'}') AS config_hash FROM part")
def _(s, sf):
    from tessera.plans.features import fact_hash

    return D.read(s, sf, "part").select("p_partkey", F.col("p_size").alias("size"), F.col("p_brand").alias("brand")).select("p_partkey", fact_hash(["size", "brand"]).alias("config_hash"))


@query("S6_check_document", D.with_("findings") + ", g AS (SELECT object, min(severity) AS m, count(*) FILTER (severity='p1') AS p1, count(*) FILTER (severity='p2') AS p2 FROM findings WHERE line>1 OR object LIKE '%7' GROUP BY 1) SELECT count(*) AS objects, sum(p1)::BIGINT AS p1, sum(p2)::BIGINT AS p2, floor(100.0::DOUBLE*count(*) FILTER (m NOT IN ('p1','p2'))/count(*)+0.5)::DOUBLE AS readiness FROM g")
def _(s, sf):
    from tessera.plans.features import check_only_document

    return check_only_document(D.findings(s, sf).where("line > 1 or object like '%7'")).select("objects", "p1", "p2", "readiness")
