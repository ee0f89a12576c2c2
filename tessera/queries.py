"""Queries by the ids of the operator survey, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import scalars as X
from tessera.operators import aggregates as A
from tessera.operators import graph as G
from tessera.operators import joins as J
from tessera.operators import orders as O  # noqa: E741
from tessera.operators import predicates as K
from tessera.operators import sequence as Q
from tessera.operators import sets as S
from tessera.plans import facts as P
from tessera.plans import verdicts as V
from tessera.sources import adapters as D
from tessera.sources import bundle as B
from tessera.sources import records as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


CLASSIFIABLE = ("call-function", "uses-table", "consumes-cds", "inherits")

# ------------------------------------------------------------ sources


@query("S2_canonical_files", "SELECT doc_id, len(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)))::BIGINT AS n_lines FROM documents")
def _(s, sf):
    files = R.canonical(D.read(s, sf, "documents").select("doc_id", F.col("text").alias("source")))
    return files.select("doc_id", F.size(F.split("source", "\n")).cast("long").alias("n_lines"))


@query("S3_byte_cap", "SELECT octet_length(encode(text)) <= 2000 AS admitted, count(*) AS n FROM documents GROUP BY 1")
def _(s, sf):
    admitted, notes = B.admitted(D.read(s, sf, "documents").select(F.col("doc_id").cast("string").alias("filename"), F.col("text").alias("source")), 2000)
    n = F.count("*").alias("n")
    return admitted.agg(n).withColumn("admitted", F.lit(True)).unionByName(notes.agg(n).withColumn("admitted", F.lit(False))).where("n > 0")


@query("S7_priorities", "SELECT CASE WHEN l_linenumber BETWEEN 1 AND 3 THEN 'priority-'||l_linenumber ELSE 'info' END AS priority, count(*) AS n FROM lineitem GROUP BY 1")
def _(s, sf):
    return R.check_rows(D.read(s, sf, "lineitem").select(F.col("l_linenumber").alias("priority"))).groupBy("priority").agg(F.count("*").alias("n"))


@query("S8_migration_summary", "SELECT o_orderstatus AS status, CASE WHEN count(*)=0 THEN 100.0 ELSE floor(100.0::DOUBLE*count(*) FILTER (o_totalprice>100000)/count(*)+0.5) END::DOUBLE AS pct FROM orders GROUP BY 1")
def _(s, sf):
    return D.read(s, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(X.round_half_up(100.0 * F.count_if(F.col("o_totalprice") > 100000) / F.count("*")).cast("double").alias("pct"))


@query("S9_bundle_sources", "SELECT 'O'||(doc_id//8) AS object, sha256(string_agg(text, chr(10) ORDER BY doc_id)) AS digest FROM documents GROUP BY 1")
def _(s, sf):
    name = F.concat(F.lit("o"), F.floor(F.col("doc_id") / 8).cast("string"), F.lit("."), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".abap"))
    return R.object_sources(D.read(s, sf, "documents").select(name.alias("filename"), F.col("text").alias("source")))


@query("S10_registry", D.with_("registry") + "SELECT state, authoritative, count(*) AS n FROM registry GROUP BY 1, 2")
def _(s, sf):
    return R.registry_index(D.registry(s, sf), "successor").groupBy("state", "authoritative").agg(F.count("*").alias("n"))


@query("S15_usage", "SELECT user_id AS object, count(*) AS exec_count, strftime(max(ts), '%Y-%m-%d') AS last_used FROM events GROUP BY 1")
def _(s, sf):
    log = D.read(s, sf, "events").groupBy(F.col("user_id").alias("object_name")).agg(F.count("*").cast("string").alias("exec_count"), F.date_format(F.max("ts"), "yyyyMMdd").alias("last_used"))
    good, _refused = R.usage_rows(log.withColumn("object_type", F.lit("PROG")), "object_name")
    return good.select(F.col("object_name").alias("object"), "exec_count", "last_used")


@query("K3_sarif_rules", D.with_("findings") + "SELECT rule_id, arg_min(message, file||lpad(line::VARCHAR,9,'0')||message) AS first_message, count(*) AS results FROM findings GROUP BY 1")
def _(s, sf):
    return R.sarif_rules(D.findings(s, sf))


# ------------------------------------------------------------ filters and theta joins

RULES = [("pipe", r"\|"), ("caps", r"[A-Z][A-Z][A-Z]"), ("address", r"@[a-z]+"), ("number", r"[0-9][0-9][0-9]"), ("junk", r"\$\$\$|%%%")]


@query("F1_line_rules", D.with_("lines") + ", rules(rule_id, p) AS (VALUES ('pipe','\\|'),('caps','[A-Z][A-Z][A-Z]'),('address','@[a-z]+'),('number','[0-9][0-9][0-9]'),('junk','\\$\\$\\$|%%%')) SELECT doc_id, line, rule_id FROM lines, rules WHERE regexp_matches(raw, p) AND NOT regexp_matches(raw, '^\\s*[*\"]')")
def _(s, sf):
    return J.matched_rules(D.lines(s, sf), RULES)


@query("F2_comment_lines", D.with_("lines") + "SELECT doc_id, count(*) AS n FROM lines WHERE regexp_matches(raw, '^\\s*[*\"]|^[A-Z]') GROUP BY 1")
def _(s, sf):
    return D.lines(s, sf).where(X.is_comment(F.col("raw")) | F.col("raw").rlike("^[A-Z]")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("F3_code_part", D.with_("lines") + """SELECT doc_id, line, length(regexp_extract(raw, '^((?:[^''"]|''(?:[^'']|'''')*(?:''|$))*)', 1))::BIGINT AS n FROM lines WHERE contains(raw, '"') OR contains(raw, chr(39))""")
def _(s, sf):
    return D.lines(s, sf).where("contains(raw, '\"') or contains(raw, '\\'')").select("doc_id", "line", F.length(X.code_part(F.col("raw"))).cast("long").alias("n"))


@query("F6_metadata_rules", "SELECT page_id, 'require' AS rule FROM pages WHERE contains(html,'<script') AND NOT contains(html,'<nav') UNION ALL SELECT page_id, 'forbid' FROM pages WHERE contains(html,'<script') AND contains(html,'&amp;')")
def _(s, sf):
    return J.require_or_forbid(D.read(s, sf, "pages"), "html", "<script", "<nav", "&amp;")


@query("F7_statement_patterns", "SELECT event_id, CASE WHEN event_type='view' THEN 'view-k1' ELSE 'other-k1' END AS rule FROM events WHERE regexp_matches(props, '\"k\": 1') AND NOT regexp_matches(props, '\"k\": 1[05]')")
def _(s, sf):
    rest = ("signup", "click", "error", "purchase")
    patterns = [K.Pattern("view-k1", ("view",), '"k": 1', '"k": 1[05]'), K.Pattern("other-k1", rest, '"k": 1', '"k": 1[05]')]
    return K.pattern_hits(D.read(s, sf, "events"), patterns, "event_type", "props").select("event_id", F.col("rule_id").alias("rule"))


@query("F8_signals", "SELECT p_partkey, (p_size>25)::INT+(p_retailprice>1200)::INT+(p_partkey%2=0)::INT AS score, p_size>25 AND (p_retailprice>1200 OR p_partkey%2=0) AND p_brand<>'Brand#1' AS holds FROM part")
def _(s, sf):
    all_, any_, none = {"size": F.col("p_size") > 25}, {"price": F.col("p_retailprice") > 1200, "even": F.col("p_partkey") % 2 == 0}, {"brand": F.col("p_brand") == "Brand#1"}
    return D.read(s, sf, "part").select("p_partkey", K.shape_score(all_, any_).alias("score"), K.shape_holds(all_, any_, none).alias("holds"))


@query("F9_explain", "SELECT p_partkey, concat_ws(',', CASE WHEN NOT p_size>25 THEN 'size' END, CASE WHEN NOT p_retailprice>1200 THEN 'price' END) AS unmet FROM part")
def _(s, sf):
    gaps = K.shape_gaps({"size": F.col("p_size") > 25, "price": F.col("p_retailprice") > 1200}, {}, {})
    return D.read(s, sf, "part").select("p_partkey", F.concat_ws(",", gaps["unmet_all"]).alias("unmet"))


@query("F10_blockers", D.with_("findings") + "SELECT family, severity, count(*) AS n FROM findings WHERE family IN ('deprecation','modification') OR (family='released-api' AND severity IN ('p1','p2')) GROUP BY 1,2")
def _(s, sf):
    f = D.findings(s, sf)
    return f.where(K.s4_blocker(F.col("family"), X.severity_grade(F.col("severity")))).groupBy("family", "severity").agg(F.count("*").alias("n"))


@query("F12_reach_edges", D.with_("nodes", "edges") + "SELECT e.kind, count(*) AS n FROM edges e LEFT JOIN nodes a ON a.id=e.source LEFT JOIN nodes b ON b.id=e.target WHERE coalesce(a.object, split_part(e.source,'.',1))<>coalesce(b.object, split_part(e.target,'.',1)) AND e.kind NOT IN ('includes','contains') GROUP BY 1")
def _(s, sf):
    return J.reach_edges(D.edges(s, sf), D.nodes(s, sf)).groupBy("kind").agg(F.count("*").alias("n"))


@query("F15_search_guard", "SELECT p_partkey, regexp_full_match(p_type, '[A-Za-z0-9*_]{1,100}') AS ok, least(500, greatest(1, p_size*20))::INT AS top FROM part")
def _(s, sf):
    return D.read(s, sf, "part").select("p_partkey", K.search_allowed(F.col("p_type")).alias("ok"), K.search_limit(F.col("p_size") * 20).alias("top"))


# ------------------------------------------------------------ joins


@query("J1_edge_owners", D.with_("nodes", "edges") + "SELECT coalesce(a.kind,'none') AS from_kind, coalesce(b.kind,'none') AS to_kind, count(*) AS n FROM edges e LEFT JOIN nodes a ON a.id=e.source LEFT JOIN nodes b ON b.id=e.target GROUP BY 1,2")
def _(s, sf):
    ends = J.with_ends(D.edges(s, sf), D.nodes(s, sf), "kind")
    return ends.groupBy(F.coalesce("source_kind", F.lit("none")).alias("from_kind"), F.coalesce("target_kind", F.lit("none")).alias("to_kind")).agg(F.count("*").alias("n"))


@query("J2_registry_levels", D.with_("edges", "registry") + "SELECT e.source, e.target, r.level FROM edges e LEFT JOIN registry r ON r.name=e.target WHERE e.kind IN ('uses-table','inherits','consumes-cds','call-function')")
def _(s, sf):
    return J.classified(D.edges(s, sf), D.registry(s, sf), CLASSIFIABLE).select("source", "target", "level")


@query("J8_object_facts", D.with_("findings") + "SELECT s.s_suppkey, s.s_name, coalesce(f.n,0)::BIGINT AS n FROM supplier s LEFT JOIN (SELECT object, count(*) n FROM findings WHERE severity='p1' GROUP BY 1) f ON f.object='S'||s.s_suppkey")
def _(s, sf):
    p1 = D.findings(s, sf).where("severity = 'p1'").groupBy("object").agg(F.count("*").alias("value"))
    objects = D.read(s, sf, "supplier").withColumn("object", F.concat(F.lit("S"), F.col("s_suppkey").cast("string")))
    return J.object_facts(objects, {"n": p1}).select("s_suppkey", "s_name", "n")


@query("J13_without_test", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey=p_partkey AND l_returnflag='R' AND l_quantity>45)")
def _(s, sf):
    return J.unused(D.read(s, sf, "part").select("p_partkey"), D.read(s, sf, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query("J17_inventory_without_usage", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice>150000)")
def _(s, sf):
    return J.unused(D.read(s, sf, "customer").select("c_custkey"), D.read(s, sf, "orders").where("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("J18_customer_findings", D.with_("findings", "nodes") + "SELECT rule_id, count(*) AS n FROM findings WHERE object IN (SELECT object FROM nodes WHERE kind='class') GROUP BY 1")
def _(s, sf):
    return J.only_kinds(D.findings(s, sf), D.nodes(s, sf), ["class"]).groupBy("rule_id").agg(F.count("*").alias("n"))


BEFORE = "SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey%5<>0"
AFTER = "SELECT o_orderkey AS k, CASE WHEN o_orderkey%7=0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey%3<>0"


def _sides(s, sf):
    o = D.read(s, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    return o.where("k % 5 <> 0"), o.where("k % 3 <> 0").withColumn("v", F.when(F.col("k") % 7 == 0, "X").otherwise(F.col("v")))


@query("J19_conformance", f"WITH b AS ({BEFORE}), a AS ({AFTER}) SELECT coalesce(a.k,b.k) AS k, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' WHEN a.v IS DISTINCT FROM b.v THEN 'changed' ELSE 'same' END AS change FROM b FULL JOIN a ON a.k=b.k")
def _(s, sf):
    return J.conformance(*_sides(s, sf), "k", "v")


@query("J20_warnings_on_changes", f"WITH b AS ({BEFORE}), a AS ({AFTER}) SELECT count(*) AS n FROM a JOIN b USING(k) JOIN lineitem ON l_orderkey=a.k WHERE a.v<>b.v AND l_linenumber=1")
def _(s, sf):
    b, a = _sides(s, sf)
    changed = J.conformance(b, a, "k", "v").where("change = 'changed'").select(F.col("k").alias("file"), F.lit(1).alias("line"))
    return J.warnings_on_changes(changed, D.read(s, sf, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line")))


@query("J21_overrides", "SELECT p_partkey, coalesce(o.v, CASE WHEN p_size>25 THEN 'rebuild' ELSE 'keep' END) AS disposition FROM part LEFT JOIN (SELECT p_partkey AS k, 'retire' AS v FROM part WHERE p_partkey%11=0) o ON o.k=p_partkey")
def _(s, sf):
    nodes = D.read(s, sf, "part").select("p_partkey", F.when(F.col("p_size") > 25, "rebuild").otherwise("keep").alias("disposition"))
    chosen = nodes.where("p_partkey % 11 = 0").withColumn("disposition", F.lit("retire"))
    return J.with_overrides(nodes, chosen, "p_partkey", "disposition")


# ------------------------------------------------------------ aggregates


@query("A1_weakest_level", D.with_("edges", "registry") + "SELECT e.source, ['D','C','B','A'][min(CASE r.level WHEN 'D' THEN 0 WHEN 'C' THEN 1 WHEN 'B' THEN 2 WHEN 'A' THEN 3 END)+1] AS level FROM edges e LEFT JOIN registry r ON r.name=e.target WHERE e.kind IN ('uses-table','inherits','consumes-cds') GROUP BY 1")
def _(s, sf):
    return A.weakest(J.classified(D.edges(s, sf), D.registry(s, sf), CLASSIFIABLE), "source")


@query("A2_tallies", D.with_("findings") + "SELECT 'family' AS kind, family AS value, count(*) AS n FROM findings GROUP BY family UNION ALL SELECT 'severity', severity, count(*) FROM findings GROUP BY severity UNION ALL SELECT 'rule_id', rule_id, count(*) FROM findings GROUP BY rule_id")
def _(s, sf):
    return A.tallies(D.findings(s, sf), "family", "severity", "rule_id")


@query("A3_readiness", D.with_("findings") + ", o AS (SELECT 'S'||s_suppkey AS object FROM supplier), b AS (SELECT object, count(*) n FROM findings WHERE family='modification' AND severity='p1' GROUP BY 1) SELECT count(*) AS objects, count(n) AS blocked, coalesce(sum(n),0)::BIGINT AS blockers, CASE WHEN count(*)=0 THEN 100.0 ELSE floor(100.0::DOUBLE*(count(*)-count(n))/count(*)+0.5) END::DOUBLE AS pct FROM o LEFT JOIN b USING(object)")
def _(s, sf):
    objects = D.read(s, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("object"))
    return A.readiness(objects, D.findings(s, sf), (F.col("family") == "modification") & (F.col("severity") == "p1"))


@query("A4_api_hygiene", D.with_("edges", "registry") + "SELECT coalesce(r.level,'unknown') AS level, count(*) AS n FROM edges e LEFT JOIN registry r ON r.name=e.target WHERE e.kind IN ('uses-table','inherits','consumes-cds') GROUP BY 1")
def _(s, sf):
    return A.level_counts(J.classified(D.edges(s, sf), D.registry(s, sf), CLASSIFIABLE))


@query("A5_grade_buckets", D.with_("findings") + "SELECT CASE severity WHEN 'p1' THEN 'blocker' WHEN 'p2' THEN 'warning' ELSE 'advisory' END AS grade, count(*) AS n, count(DISTINCT rule_id) AS rules FROM findings GROUP BY 1")
def _(s, sf):
    return A.grade_buckets(D.findings(s, sf), X.severity_grade(F.col("severity")))


@query("A6_namespaces", D.with_("nodes") + "SELECT count(*) FILTER (namespace IN ('Z','Y')) AS customer, count(*) FILTER (namespace='sap') AS sap, count(*) FILTER (namespace='registered') AS registered FROM nodes")
def _(s, sf):
    return A.namespace_summary(D.nodes(s, sf))


@query("A7_coupling", D.with_("edges") + ", o AS (SELECT source AS id, count(DISTINCT target) n FROM edges GROUP BY 1), i AS (SELECT target AS id, count(DISTINCT source) n FROM edges GROUP BY 1) SELECT id, coalesce(i.n,0)::BIGINT AS fan_in, coalesce(o.n,0)::BIGINT AS fan_out FROM o FULL JOIN i USING(id)")
def _(s, sf):
    return A.coupling(D.edges(s, sf))


@query("A8_stability", D.with_("edges", "nodes") + ", o AS (SELECT source AS id, count(DISTINCT target) n FROM edges GROUP BY 1), i AS (SELECT target AS id, count(DISTINCT source) n FROM edges GROUP BY 1), c AS (SELECT i.id, i.n AS fi, coalesce(o.n,0) AS fo FROM i LEFT JOIN o ON o.id=i.id) SELECT floor(100*(1-avg(abs(CASE WHEN kind='interface' THEN 1.0 ELSE 0.0 END::DOUBLE + fo::DOUBLE/(fi+fo) - 1)))+0.5)::DOUBLE AS stability FROM c LEFT JOIN nodes USING(id)")
def _(s, sf):
    return A.stability(D.edges(s, sf), D.nodes(s, sf).select("id", F.when(F.col("kind") == "interface", 1.0).otherwise(0.0).alias("a"))).select(F.col("stability").cast("double").alias("stability"))


@query("A9_performance", D.with_("findings") + "SELECT floor(100.0::DOUBLE*(1-count(DISTINCT CASE WHEN family='performance' AND severity='p1' THEN object END)::DOUBLE/(SELECT count(*) FROM supplier))+0.5)::DOUBLE AS performance FROM findings")
def _(s, sf):
    objects = D.read(s, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("object"))
    return A.share_without(objects, D.findings(s, sf).where("severity = 'p1'"), "performance").select(F.col("performance").cast("double").alias("performance"))


@query("A12_debt", D.with_("findings", "edges") + ", w AS (SELECT object, sum(CASE severity WHEN 'p1' THEN 10 WHEN 'p2' THEN 5 WHEN 'p3' THEN 1 ELSE 0 END)::BIGINT AS weighted, count(*) AS n FROM findings GROUP BY 1), o AS (SELECT source AS id, count(DISTINCT target) n FROM edges GROUP BY 1), i AS (SELECT target AS id, count(DISTINCT source) n FROM edges GROUP BY 1), c AS (SELECT id, coalesce(i.n,0)+coalesce(o.n,0) AS links FROM o FULL JOIN i USING(id)) SELECT object, weighted, n, coalesce(links,0)::BIGINT AS links, floor((0.6::DOUBLE*least(1.0::DOUBLE,weighted/(10.0::DOUBLE*n))+0.4::DOUBLE*least(1.0::DOUBLE,coalesce(links,0)/20.0::DOUBLE))*1000+0.5)/1000::DOUBLE AS debt FROM w LEFT JOIN c ON c.id=w.object")
def _(s, sf):
    return A.debt(D.findings(s, sf), D.edges(s, sf))


@query("A13_size_classes", "SELECT CASE WHEN n_chars<10000 THEN 'small' WHEN n_chars<100000 THEN 'medium' WHEN n_chars<1000000 THEN 'large' WHEN n_chars<10000000 THEN 'very large' ELSE 'huge' END AS size_class, count(*) AS n, sum(n_chars)::BIGINT AS loc, max(n_chars)::BIGINT AS largest FROM documents GROUP BY 1")
def _(s, sf):
    return A.size_classes(D.read(s, sf, "documents").select(F.col("n_chars").alias("loc")))


@query("A14_halstead", "WITH t AS (SELECT doc_id, unnest(string_split(text,' ')) AS token FROM documents), u AS (SELECT doc_id, token, count(*) k FROM t GROUP BY 1,2) SELECT doc_id, sum(k)::BIGINT AS length, count(*) AS vocabulary, floor(sum(k)*log2(count(*)::DOUBLE)*1000+0.5)/1000::DOUBLE AS volume FROM u GROUP BY 1")
def _(s, sf):
    return A.halstead(D.read(s, sf, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("token")))


@query("A15_maintainability", "SELECT doc_id, floor(greatest(0.0::DOUBLE, least(100.0::DOUBLE, (171-5.2*ln(greatest(n_chars*3.0,1)::DOUBLE)-0.23*greatest(doc_id%20,1)-16.2*ln(greatest(n_chars/40.0,1)::DOUBLE)+50*sin(sqrt(2.4*((doc_id%10)/10.0)::DOUBLE)))*100/171))*100+0.5)/100::DOUBLE AS mi FROM documents")
def _(s, sf):
    n, i = F.col("n_chars").cast("double"), F.col("doc_id")
    return D.read(s, sf, "documents").select("doc_id", X.round_half_up(X.maintainability(n * 3.0, (i % 20).cast("double"), n / 40.0, (i % 10) / 10.0), 2).alias("mi"))


@query("A18_cyclomatic", "SELECT user_id AS file, 1+count(*) FILTER (event_type IN ('signup','view')) AS cyclomatic FROM events GROUP BY 1")
def _(s, sf):
    return A.branch_counts(D.statements(s, sf), ["file"], ("Loop", "Select"))


@query("A22_resolved_states", D.with_("registry") + ", k AS (SELECT substr(name,1,3) AS key, *, CASE level WHEN 'D' THEN 0 WHEN 'C' THEN 1 WHEN 'B' THEN 2 ELSE 3 END AS r FROM registry), h AS (SELECT key, bool_or(authoritative) AS any_ FROM k GROUP BY 1), m AS (SELECT key, arg_min(struct_pack(r:=r,s:=state), r::VARCHAR||state) AS x FROM k JOIN h USING(key) WHERE authoritative=any_ GROUP BY 1) SELECT key, ['D','C','B','A'][x.r+1] AS level, x.s AS state FROM m")
def _(s, sf):
    return A.resolved(D.registry(s, sf).withColumn("key", F.substring("name", 1, 3)), "key")


@query("A24_driving_rule", D.with_("findings") + "SELECT object, arg_min(rule_id, CASE severity WHEN 'p1' THEN '1' WHEN 'p2' THEN '2' WHEN 'p3' THEN '3' ELSE '9' END||rule_id) AS rule_id FROM findings GROUP BY 1")
def _(s, sf):
    return A.driving_rule(D.findings(s, sf))


@query("A25_signals", D.with_("findings") + "SELECT object, string_agg(DISTINCT family, ',' ORDER BY family) AS families, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules FROM findings GROUP BY 1")
def _(s, sf):
    return A.signals(D.findings(s, sf))


@query("A26_blast_sum", D.with_("edges") + ", b AS (SELECT target AS id, count(DISTINCT source) AS n FROM edges GROUP BY 1) SELECT e.source, sum(b.n)::BIGINT AS blast FROM (SELECT DISTINCT source, target FROM edges) e JOIN b ON b.id=e.target GROUP BY 1")
def _(s, sf):
    return A.blast_sum(D.edges(s, sf))


@query("A34_gate", "SELECT count(*) AS expected, count(*) FILTER (l.doc_id IS NULL) AS missing, count(*) FILTER (l.doc_id IS NULL OR l.toxic>0) AS blocking, bool_or(l.doc_id IS NULL OR l.toxic>0) AS blocked FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) l USING(doc_id)")
def _(s, sf):
    v = D.read(s, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("failed"))
    return A.gate(D.read(s, sf, "documents"), v, "doc_id")


# ------------------------------------------------------------ sequences

ST = D.with_("statements")
DEPTH = ST + ", d AS (SELECT *, sum(CASE kind WHEN 'Loop' THEN 1 WHEN 'EndLoop' THEN -1 ELSE 0 END) OVER w AS d FROM statements WINDOW w AS (PARTITION BY file ORDER BY ts,seq ROWS UNBOUNDED PRECEDING)), f AS (SELECT *, d-least(0,min(d) OVER w) AS after_ FROM d WINDOW w AS (PARTITION BY file ORDER BY ts,seq ROWS UNBOUNDED PRECEDING)), g AS (SELECT file,seq,kind,coalesce(lag(after_) OVER (PARTITION BY file ORDER BY ts,seq),0)::BIGINT AS depth FROM f) "


@query("W1_depth", DEPTH + "SELECT file, seq, kind, depth FROM g")
def _(s, sf):
    return Q.depth_before(D.statements(s, sf)).select("file", "seq", "kind", "depth")


@query("R_select_in_loop", DEPTH + "SELECT file, count(*) AS n FROM g WHERE kind='Select' AND depth>0 GROUP BY 1")
def _(s, sf):
    return Q.depth_before(D.statements(s, sf)).where("kind = 'Select' and depth > 0").groupBy("file").agg(F.count("*").alias("n"))


@query("W2_checked_soon", ST + ", x AS (SELECT *, coalesce(max((kind='Select')::INT) OVER (PARTITION BY file ORDER BY ts,seq ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING),0) AS hit FROM statements) SELECT file, seq, hit=1 AS checked FROM x WHERE kind='AuthorityCheck'")
def _(s, sf):
    return Q.checked_soon(D.statements(s, sf), "AuthorityCheck", "Select", 3)


@query("W4_three_way", ST + ", n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ts,seq) AS n FROM statements), x AS (SELECT *, coalesce(min(CASE WHEN kind='Select' THEN n END) OVER w, 1<<30) AS h, coalesce(min(CASE WHEN kind='Other' THEN n END) OVER w, 1<<30) AS w_, coalesce(min(CASE WHEN kind='EndLoop' THEN n END) OVER w, 1<<30) AS e FROM n WINDOW w AS (PARTITION BY file ORDER BY ts,seq ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)) SELECT file, seq, CASE WHEN h>=(1<<30) OR h>e THEN 'missing' WHEN w_<h THEN 'after-write' ELSE 'ok' END AS verdict FROM x WHERE kind='AuthorityCheck'")
def _(s, sf):
    return Q.three_way(D.statements(s, sf), "AuthorityCheck", "Select", "Other", "EndLoop", 20)


@query("W5_guard", ST + ", x AS (SELECT *, last_value(CASE WHEN kind='Select' THEN value END IGNORE NULLS) OVER (PARTITION BY file ORDER BY ts,seq ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS guard FROM statements) SELECT file, seq, guard FROM x WHERE kind='AuthorityCheck'")
def _(s, sf):
    return Q.guarded(D.statements(s, sf), "AuthorityCheck", "Select", 6)


@query("W8_scope", ST + ", x AS (SELECT *, last_value(CASE kind WHEN 'Loop' THEN seq WHEN 'EndLoop' THEN -1 END IGNORE NULLS) OVER (PARTITION BY file ORDER BY ts,seq ROWS UNBOUNDED PRECEDING) AS m FROM statements) SELECT file, seq, CASE WHEN m>=0 THEN m END AS scope FROM x")
def _(s, sf):
    return Q.scope(D.statements(s, sf), "Loop", "EndLoop")


SESSION = ST + ", x AS (SELECT *, sum((kind='Loop')::INT) OVER (PARTITION BY file ORDER BY ts,seq ROWS UNBOUNDED PRECEDING) AS session FROM statements) "


@query("W9_lock_window", SESSION + "SELECT file, session::BIGINT AS session, seq FROM (SELECT *, row_number() OVER (PARTITION BY file, session ORDER BY ts,seq) AS r FROM x WHERE session>0 AND kind='Select') WHERE r=1")
def _(s, sf):
    return Q.first_in_session(D.statements(s, sf), "Loop", "Select")


@query("W11_duplicate_block", D.with_("lines") + ", n AS (SELECT doc_id, line, regexp_replace(trim(raw), '[ \\t]+', ' ', 'g') AS x FROM lines), m AS (SELECT * FROM n WHERE x<>''), b AS (SELECT doc_id, line, list(x) OVER w AS b, max(line) OVER w AS e FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)), k AS (SELECT doc_id, line, array_to_string(b, chr(10)) AS k FROM b WHERE len(b)=3 AND e=line+2), f AS (SELECT *, min(line) OVER (PARTITION BY doc_id, k) AS f FROM k) SELECT doc_id, arg_min(f, line) AS first, min(line) AS second FROM f WHERE line>=f+3 GROUP BY 1")
def _(s, sf):
    return Q.repeated_blocks(D.lines(s, sf), 3)


@query("W12_latest", "SELECT conv_id, arg_max(role, turn) AS role, max(turn) AS turn FROM conversations GROUP BY 1")
def _(s, sf):
    return Q.latest(D.read(s, sf, "conversations"), "conv_id", "turn", "role").select("conv_id", "role", "turn")


@query("W14_oscillation", ST + ", t AS (SELECT file, (kind='Select')::INT AS v, row_number() OVER (PARTITION BY file ORDER BY ts DESC, seq DESC) AS r FROM statements), c AS (SELECT file, (v<>lag(v) OVER (PARTITION BY file ORDER BY r))::INT AS c FROM t WHERE r<=5) SELECT file, coalesce(sum(c),0)::BIGINT AS flips, coalesce(sum(c),0)>=2 AS oscillating FROM c GROUP BY 1")
def _(s, sf):
    return Q.flips(D.statements(s, sf), "Select")


@query("W15_first_fill", "SELECT o_custkey AS k, arg_min(o_orderstatus, o_orderkey) AS status, arg_min(CASE WHEN o_totalprice>200000 THEN o_orderpriority END, CASE WHEN o_totalprice>200000 THEN o_orderkey END) AS priority FROM orders GROUP BY 1")
def _(s, sf):
    o = D.read(s, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("n"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_totalprice") > 200000, F.col("o_orderpriority")).alias("priority"))
    return Q.first_fill(o, "k", "n", "status", "priority")


@query("W16_first_edge", "SELECT l_suppkey, l_partkey, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey,l_partkey ORDER BY l_orderkey*10+l_linenumber) AS r FROM lineitem) WHERE r=1")
def _(s, sf):
    li = D.read(s, sf, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return Q.first_row(li, ["l_suppkey", "l_partkey"], "o").drop("o")


@query("W17_key_order", "SELECT l_orderkey, l_linenumber FROM (SELECT *, max((l_returnflag<>'R')::INT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM lineitem) WHERE l_returnflag='R' AND o=1")
def _(s, sf):
    return Q.key_after_other(D.read(s, sf, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber")


@query("W18_surplus_lines", "WITH b AS (SELECT l_suppkey k, l_returnflag v, count(*) n FROM lineitem WHERE l_linenumber<=2 GROUP BY 1,2), a AS (SELECT l_suppkey k, l_returnflag v, count(*) n FROM lineitem WHERE l_linenumber>2 GROUP BY 1,2) SELECT k, v, a.n-coalesce(b.n,0) AS extra FROM a LEFT JOIN b USING(k,v) WHERE a.n-coalesce(b.n,0)>0")
def _(s, sf):
    li = D.read(s, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("v"), "l_linenumber")
    return Q.surplus(li.where("l_linenumber <= 2"), li.where("l_linenumber > 2"), ["k", "v"])


@query("W19_heavy_loops", SESSION + "SELECT file, session::BIGINT AS session, count(*) FILTER (kind='Select') AS n FROM x WHERE session>0 GROUP BY 1,2 HAVING count(*) FILTER (kind='Select')>=3")
def _(s, sf):
    return Q.heavy_loops(D.statements(s, sf), "Loop", "Select", 3)


@query("W20_declared_before", ST + ", x AS (SELECT *, count(*) FILTER (kind='Loop') OVER (PARTITION BY file ORDER BY ts,seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM statements) SELECT file, seq, n FROM x WHERE kind='AuthorityCheck'")
def _(s, sf):
    return Q.declared_before(D.statements(s, sf), "Loop", "AuthorityCheck")


# ------------------------------------------------------------ order and top-k


@query("T1_finding_order", D.with_("findings") + "SELECT k, row_number() OVER (ORDER BY k) AS n FROM (SELECT concat_ws('|', file, lpad(line::VARCHAR,9,'0'), rule_id, object, message) AS k FROM findings) ORDER BY k LIMIT 500")
def _(s, sf):
    return O.finding_order(D.findings(s, sf), 500, "message")


@query("T3_digest_objects", D.with_("edges", "nodes") + ", r AS (SELECT target AS id, count(*) n FROM edges GROUP BY 1) SELECT id, kind, coalesce(r.n,0)::BIGINT AS n FROM nodes LEFT JOIN r USING(id) ORDER BY namespace NOT IN ('Z','Y'), coalesce(r.n,0) DESC, id LIMIT 500")
def _(s, sf):
    r = D.edges(s, sf).groupBy(F.col("target").alias("object")).agg(F.count("*").alias("value"))
    return O.digest_objects(J.object_facts(D.nodes(s, sf), {"n": r})).select("id", "kind", "n")


@query("T4_digest_findings", D.with_("findings") + "SELECT severity, rule_id, object, file, line, message FROM findings ORDER BY severity='info', severity, rule_id, object, file, line, message LIMIT 200")
def _(s, sf):
    return O.digest_findings(D.findings(s, sf)).select("severity", "rule_id", "object", "file", "line", "message")


@query("T7_transport_order", D.with_("nodes") + "SELECT id, row_number() OVER (ORDER BY CASE kind WHEN 'cds' THEN 1 WHEN 'interface' THEN 2 WHEN 'class' THEN 3 WHEN 'behavior' THEN 4 ELSE 99 END, id) AS n FROM nodes")
def _(s, sf):
    return O.transport_order(D.nodes(s, sf))


@query("T12_hub", D.with_("edges") + "SELECT source AS id, arg_min(target, lpad((99999-n)::VARCHAR,6,'0')||target) AS hub FROM (SELECT source, target, count(*) n FROM edges GROUP BY 1,2) WHERE n>1 GROUP BY 1")
def _(s, sf):
    return O.hubs(D.edges(s, sf), D.edges_at_most(s, sf))


# ------------------------------------------------------------ set operations


@query("U1_union_defaults", D.with_("findings") + "SELECT rule_id, family, count(*) AS n FROM findings GROUP BY 1,2 UNION ALL SELECT 'page', 'metadata', count(*) FROM pages")
def _(s, sf):
    a = D.findings(s, sf).groupBy("rule_id", "family").agg(F.count("*").alias("n"))
    return S.union_findings({"rules": a, "page": D.read(s, sf, "pages").agg(F.count("*").alias("n"))}, "metadata").select("rule_id", "family", "n")


@query("U2_symmetric_difference", f"WITH b AS ({BEFORE}), a AS ({AFTER}) SELECT k, v, 'before' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) UNION ALL SELECT k, v, 'after' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)")
def _(s, sf):
    return S.symmetric_difference(*_sides(s, sf))


@query("U4_set_equality", "SELECT count(*) FILTER (a=b) AS equal, count(*) AS n FROM (SELECT l_suppkey, list_sort(list(DISTINCT l_returnflag) FILTER (l_linenumber<=2)) AS a, list_sort(list(DISTINCT l_returnflag)) AS b FROM lineitem GROUP BY 1)")
def _(s, sf):
    g = S.equal_sets(D.read(s, sf, "lineitem"), "l_suppkey", F.when(F.col("l_linenumber") <= 2, F.col("l_returnflag")), F.col("l_returnflag"))
    return g.agg(F.count_if(F.col("equal")).alias("equal"), F.count("*").alias("n"))


@query("U5_union_distinct", "SELECT c_nationkey::BIGINT AS k FROM customer WHERE c_acctbal>9000 UNION SELECT s_nationkey::BIGINT FROM supplier")
def _(s, sf):
    c, p = D.read(s, sf, "customer").where("c_acctbal > 9000"), D.read(s, sf, "supplier")
    return S.swapped_or_succeeded(c.select(F.col("c_nationkey").cast("long").alias("k")), p.select(F.col("s_nationkey").cast("long").alias("k")))


@query("U6_plan_diff", f"WITH b AS ({BEFORE}), a AS ({AFTER}) SELECT count(*) FILTER (b.k IS NULL) AS added, count(*) FILTER (a.k IS NULL) AS removed, count(*) FILTER (a.v<>b.v) AS moved FROM b FULL JOIN a ON a.k=b.k")
def _(s, sf):
    c = F.col("change")
    return J.conformance(*_sides(s, sf), "k", "v").agg(F.count_if(c == "added").alias("added"), F.count_if(c == "removed").alias("removed"), F.count_if(c == "changed").alias("moved"))


@query("U11_report_delta", "SELECT unnest(['orders','price']) AS metric, unnest([count(*) FILTER (o_orderkey%2=0), floor(sum(o_totalprice) FILTER (o_orderkey%2=0))::BIGINT]) AS before, unnest([count(*), floor(sum(o_totalprice))::BIGINT]) AS after FROM orders")
def _(s, sf):
    def report(o):
        row = o.agg(F.count("*").alias("n"), F.floor(F.sum("o_totalprice")).alias("p"))
        return row.select(F.expr("stack(2, 'orders', n, 'price', p) as (metric, value)"))

    o = D.read(s, sf, "orders")
    return S.report_delta(report(o.where("o_orderkey % 2 = 0")), report(o)).drop("delta")


# ------------------------------------------------------------ scalars


@query("X8_finding_id", D.with_("findings") + "SELECT sha256(rule_id||'|'||object||'|'||file||'|'||message) AS finding_id FROM findings")
def _(s, sf):
    return D.findings(s, sf).select(X.identity(F.col("rule_id"), F.col("object"), F.col("file"), F.col("message")).alias("finding_id"))


@query("X14_rounding", "SELECT c_custkey, floor(c_acctbal*100/7+0.5)/100::DOUBLE AS r2, greatest(0.0::DOUBLE, least(1.0::DOUBLE, c_acctbal/5000)) AS share FROM customer")
def _(s, sf):
    b = F.col("c_acctbal")
    return D.read(s, sf, "customer").select("c_custkey", (F.floor(b * 100 / 7 + 0.5) / 100.0).alias("r2"), X.clamp01(b / 5000).alias("share"))


@query("X15_ramps", "SELECT p_partkey, CASE WHEN p_size>5 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (p_size-10)/30.0::DOUBLE)) END AS penalty FROM part")
def _(s, sf):
    return D.read(s, sf, "part").select("p_partkey", X.ramp(F.when(F.col("p_size") > 5, F.col("p_size").cast("double")), 10.0, 40.0).alias("penalty"))


@query("X16_tiers", "SELECT p_partkey, CASE WHEN p_size/50.0>0.7 OR p_partkey%250>200 THEN 'XL' WHEN p_size/50.0>0.5 OR p_partkey%250>100 THEN 'L' WHEN p_size/50.0>0.3 OR p_partkey%250>50 THEN 'M' ELSE 'S' END AS effort, CASE WHEN p_size/50.0>0.8 THEN 'P1' WHEN p_size/50.0>0.5 THEN 'P2' ELSE 'P3' END AS priority, CASE WHEN p_size>=50 THEN 'critical' WHEN p_size>=20 THEN 'high' WHEN p_size>=5 THEN 'medium' ELSE 'low' END AS impact FROM part")
def _(s, sf):
    d = F.col("p_size") / 50.0
    return D.read(s, sf, "part").select("p_partkey", X.effort_tier(d, F.col("p_partkey") % 250).alias("effort"), X.priority(d).alias("priority"), X.impact_tier(F.col("p_size")).alias("impact"))


@query("X21_namespace", "SELECT n_nationkey, CASE WHEN n_name LIKE '/%' THEN 'registered' WHEN n_name LIKE 'Z%' THEN 'Z' WHEN n_name LIKE 'Y%' THEN 'Y' ELSE 'sap' END AS namespace FROM nation")
def _(s, sf):
    return D.read(s, sf, "nation").select("n_nationkey", X.namespace(F.col("n_name")).alias("namespace"))


@query("X23_activity", "SELECT user_id AS object, CASE WHEN date_diff('day', max(ts)::DATE, DATE '2024-02-01')<=2 THEN 'active' WHEN date_diff('day', max(ts)::DATE, DATE '2024-02-01')<=10 THEN 'idle' ELSE 'stale' END AS activity FROM events GROUP BY 1")
def _(s, sf):
    days = F.datediff(F.lit("2024-02-01").cast("date"), F.max("ts").cast("date"))
    return D.read(s, sf, "events").groupBy(F.col("user_id").alias("object")).agg(X.activity(days, 2, 10).alias("activity"))


@query("X28_escape_xml", "SELECT page_id, sha256(replace(replace(replace(replace(replace(html,'&','&amp;'),'<','&lt;'),'>','&gt;'),'\"','&quot;'),chr(39),'&apos;')) AS digest FROM pages")
def _(s, sf):
    return D.read(s, sf, "pages").select("page_id", F.sha2(X.escape_xml(F.col("html")), 256).alias("digest"))


@query("X3_token_after", "SELECT doc_id, CASE WHEN list_position(string_split(text,' '),'the')>0 THEN string_split(text,' ')[list_position(string_split(text,' '),'the')+1] END AS token FROM documents")
def _(s, sf):
    return D.read(s, sf, "documents").select("doc_id", X.token_after(F.col("text"), "the").alias("token"))


# ------------------------------------------------------------ graph


@query("G9_successors", D.with_("edges") + "SELECT source, string_agg(DISTINCT target, ',' ORDER BY target) AS targets FROM edges GROUP BY 1")
def _(s, sf):
    return G.successors(D.edges(s, sf)).select(F.col("id").alias("source"), F.array_join("nodes", ",").alias("targets"))


@query("G10_blast_radius", D.with_("edges") + ", b AS (SELECT DISTINCT target AS id, source AS hit FROM edges), two AS (SELECT a.id, c.hit FROM b a JOIN b c ON c.id=a.hit), three AS (SELECT a.id, c.hit FROM (SELECT DISTINCT * FROM two) a JOIN b c ON c.id=a.hit) SELECT id, count(*) AS affected FROM (SELECT * FROM b UNION SELECT * FROM two UNION SELECT * FROM three) WHERE id<>hit GROUP BY 1")
def _(s, sf):
    return G.blast_radius(D.edges(s, sf), 3)


PR = "ids AS (SELECT a AS id FROM cyc UNION SELECT b FROM cyc), n AS (SELECT count(*)::DOUBLE AS n FROM ids), deg AS (SELECT a AS id, count(*) AS deg FROM cyc GROUP BY 1), base AS MATERIALIZED (SELECT id, deg FROM ids LEFT JOIN deg USING(id)), r0 AS MATERIALIZED (SELECT id, 1/n AS rank FROM ids, n)"
for _k in range(1, 31):
    PR += f", r{_k} AS MATERIALIZED (SELECT base.id, 0.15::DOUBLE/n + 0.85::DOUBLE*(coalesce(g.got,0)+(SELECT coalesce(sum(rank),0) FROM r{_k - 1} JOIN base USING(id) WHERE deg IS NULL)/n) AS rank FROM base CROSS JOIN n LEFT JOIN (SELECT b AS id, sum(r.rank/d.deg) AS got FROM cyc JOIN r{_k - 1} r ON r.id=cyc.a JOIN deg d ON d.id=cyc.a GROUP BY 1) g ON g.id=base.id)"
#: all rounds, and the last one that counts: the first that moves no rank by a millionth
PR += ", every AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {_k} AS k, a.id, a.rank, abs(a.rank-b.rank) AS moved FROM r{_k} a JOIN r{_k - 1} b USING(id)" for _k in range(1, 31)) + "), moves AS (SELECT k, max(moved) AS m FROM every GROUP BY 1), last_ AS (SELECT coalesce(min(k) FILTER (m<1e-6), 30) AS k FROM moves)"


@query("G11_pagerank", D.with_("cyc") + ", " + PR + " SELECT id, floor(rank/(SELECT max(rank) FROM every WHERE k=(SELECT k FROM last_))*1e4+0.5)/1e4 AS rank FROM every WHERE k=(SELECT k FROM last_)")
def _(s, sf):
    ranks = G.pagerank(D.cyclic_edges(s, sf).select(F.col("a").alias("source"), F.col("b").alias("target")), 30, tolerance=1e-6)
    top = ranks.agg(F.max("rank").alias("top"))
    return ranks.join(F.broadcast(top)).select("id", X.round_half_up(F.col("rank") / F.col("top"), 4).alias("rank"))


@query("G12_strong_components", D.with_("cyc", recursive=True) + ", r AS (SELECT DISTINCT a, b FROM cyc WHERE a<>b UNION SELECT r.a, c.b FROM r JOIN cyc c ON c.a=r.b), ids AS (SELECT a AS id FROM cyc UNION SELECT b FROM cyc) SELECT id, least(id, coalesce((SELECT min(x.b) FROM r x JOIN r y ON y.a=x.b AND y.b=x.a WHERE x.a=id), id)) AS root FROM ids")
def _(s, sf):
    return G.strong_components(D.cyclic_edges(s, sf))


@query("G14_levels", D.with_("edges") + "SELECT id, CASE WHEN id[1] IN ('C','S') THEN 0 WHEN id[1] IN ('N','P') THEN 1 ELSE 2 END::BIGINT AS level FROM (SELECT source AS id FROM edges UNION SELECT target FROM edges) WHERE NOT (id[1]='N' AND id NOT IN (SELECT target FROM edges WHERE kind IN ('calls','inherits')))")
def _(s, sf):
    e = D.edges(s, sf)
    called = e.where("kind in ('calls', 'inherits')").select(F.col("target").alias("id")).distinct()
    out = G.levels(e)
    return out.where("not startswith(id, 'N')").unionByName(out.where("startswith(id, 'N')").join(called, "id", "left_semi"))


@query("G18_layers", D.with_("nodes", "edges") + "SELECT id, CASE WHEN kind='table' THEN 'data' WHEN id IN (SELECT target FROM edges) THEN 'internal' ELSE 'entry' END AS layer FROM nodes")
def _(s, sf):
    return G.layers(D.nodes(s, sf), D.edges(s, sf))


@query("G19_boundaries", D.with_("edges") + "SELECT target AS id, count(DISTINCT source) AS callers FROM edges WHERE source<>target GROUP BY 1")
def _(s, sf):
    return G.boundaries(D.edges(s, sf), D.nodes(s, sf), D.edges_at_most(s, sf))


@query("G20_object_graph", D.with_("edges") + "SELECT source AS source_owner, target AS target_owner, kind, count(*) AS links FROM edges GROUP BY 1,2,3")
def _(s, sf):
    return G.object_graph(D.edges(s, sf), D.nodes(s, sf), D.edges_at_most(s, sf))


@query("G23_conflict_groups", D.with_("cyc", recursive=True) + ", s AS (SELECT a, b FROM cyc UNION SELECT b, a FROM cyc), r(a, root) AS (SELECT a, 0::BIGINT FROM cyc WHERE a=0 UNION SELECT s.b, r.root FROM r JOIN s ON s.a=r.a) SELECT DISTINCT x.id, coalesce(r.root, x.id) AS root FROM (SELECT a AS id FROM s UNION SELECT b FROM s) x LEFT JOIN r ON r.a=x.id")
def _(s, sf):
    return G.components(D.cyclic_edges(s, sf))


# ------------------------------------------------------------ enrichment, verdicts, validators


@query("C1_node_enrichment", D.with_("nodes", "edges", "registry") + ", w AS (SELECT e.source AS id, min(CASE r.level WHEN 'D' THEN 0 WHEN 'C' THEN 1 WHEN 'B' THEN 2 END) AS m FROM edges e JOIN registry r ON r.name=e.target GROUP BY 1) SELECT id, CASE WHEN namespace IN ('sap','registered') THEN coalesce(o.level,'unknown') ELSE coalesce(['D','C','B','A'][w.m+1],'unknown') END AS grade FROM nodes LEFT JOIN w USING(id) LEFT JOIN registry o ON o.name=nodes.id")
def _(s, sf):
    r = D.registry(s, sf).select("name", "level")
    known = J.classified(D.edges(s, sf), D.registry(s, sf), CLASSIFIABLE).where("level <> 'A'").select(F.col("source").alias("id"), "level")
    w = A.weakest(known, "id").withColumnRenamed("level", "dep")
    own = r.select(F.col("name").alias("id"), F.col("level").alias("own"))
    return D.nodes(s, sf).join(w, "id", "left").join(own, "id", "left").select("id", F.coalesce(F.when(F.col("namespace").isin("sap", "registered"), F.col("own")).otherwise(F.col("dep")), F.lit("unknown")).alias("grade"))


@query("C2_curation", D.with_("findings") + "SELECT CASE severity WHEN 'p1' THEN 'blocker' WHEN 'p2' THEN 'warning' ELSE 'advisory' END AS grade, CASE severity WHEN 'p1' THEN 'P1' WHEN 'p2' THEN 'P2' ELSE 'P3' END AS atc_priority, count(*) AS n FROM findings GROUP BY 1,2")
def _(s, sf):
    g = X.severity_grade(F.col("severity"))
    return D.findings(s, sf).groupBy(g.alias("grade"), X.grade_priority(g).alias("atc_priority")).agg(F.count("*").alias("n"))


@query("C4_successors", D.with_("registry") + "SELECT a.name, a.successor, b.state FROM registry a LEFT JOIN registry b ON b.name=a.successor WHERE a.level IN ('C','D')")
def _(s, sf):
    return P.successors_of(D.registry(s, sf))


@query("C5_harvested_references", "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][A-Z0-9_]{3,}')) AS ref FROM documents) SELECT ref, count(DISTINCT doc_id) AS docs FROM t WHERE ref[1] NOT IN ('Z','Y') AND ref NOT IN ('THAT','WITH','THIS','FROM') GROUP BY 1")
def _(s, sf):
    refs = P.harvested(D.read(s, sf, "documents"), "doc_id", "text", ("THAT", "WITH", "THIS", "FROM"))
    return refs.groupBy("ref").agg(F.countDistinct("doc_id").alias("docs"))


@query("C24_risk_flags", "SELECT d.doc_id, concat_ws(',', CASE WHEN l.toxic IS NULL THEN 'missing-evidence' END, CASE WHEN l.toxic>0 THEN 'P1' END, CASE WHEN l.quality=0 THEN 'P2' END, CASE WHEN d.n_chars>5000 THEN 'blast' END) AS flags FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) toxic, min(quality) quality FROM labels GROUP BY 1) l USING(doc_id)")
def _(s, sf):
    v = D.read(s, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    flags = V.reasons({"missing-evidence": F.col("toxic").isNull(), "P1": F.col("toxic") > 0, "P2": F.col("quality") == 0, "blast": F.col("n_chars") > 5000})
    return D.read(s, sf, "documents").join(v, "doc_id", "left").select("doc_id", F.concat_ws(",", flags).alias("flags"))


@query("D5_parity", "SELECT o_orderkey, CASE WHEN o_totalprice>400000 THEN 'fail' WHEN 1-0.3*(o_orderstatus='P')::INT-0.4*(o_totalprice>200000)::INT-0.2*(o_custkey%3=0)::INT<0.3 THEN 'fail' WHEN 1-0.3*(o_orderstatus='P')::INT-0.4*(o_totalprice>200000)::INT-0.2*(o_custkey%3=0)::INT<=0.7 THEN 'needs_review' ELSE 'pass' END AS verdict FROM orders")
def _(s, sf):
    points = V.parity_points({"lost_path": F.col("o_orderstatus") == "P", "lost_effect": F.col("o_totalprice") > 200000, "idiom": F.col("o_custkey") % 3 == 0})
    return D.read(s, sf, "orders").select("o_orderkey", V.parity(points, F.col("o_totalprice") > 400000).alias("verdict"))


@query("D9_verdict_reasons", "SELECT d.doc_id, concat_ws(',', CASE WHEN l.n IS NULL THEN 'no-evidence' END, CASE WHEN l.toxic>0 THEN 'p1' END, CASE WHEN l.quality=0 THEN 'p2' END) AS reasons, l.n IS NOT NULL AND l.toxic=0 AND l.quality=1 AS green FROM documents d LEFT JOIN (SELECT doc_id, count(*) n, max(toxic) toxic, min(quality) quality FROM labels GROUP BY 1) l USING(doc_id)")
def _(s, sf):
    v = D.read(s, sf, "labels").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    why = V.reasons({"no-evidence": F.col("n").isNull(), "p1": F.col("toxic") > 0, "p2": F.col("quality") == 0})
    rows = D.read(s, sf, "documents").join(v, "doc_id", "left").withColumn("why", why)
    return rows.select("doc_id", F.concat_ws(",", "why").alias("reasons"), (V.node_verdict(F.col("why"), F.lit(False)) == "GREEN").alias("green"))


@query("D11_transitions", "SELECT conv_id, count(*) FILTER (prev IS NOT NULL AND prev=role) AS illegal FROM (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) GROUP BY 1")
def _(s, sf):
    return V.illegal_steps(D.read(s, sf, "conversations"), "conv_id", "turn", lambda a, b: a != b, "role")


@query("V1_violations", D.with_("findings") + "SELECT 'bad-severity' AS violation, count(*) AS n FROM findings WHERE severity NOT IN ('p1','p2','p3') UNION ALL SELECT 'late-line', count(*) FROM findings WHERE line>6")
def _(s, sf):
    return V.violations(D.findings(s, sf), V.finding_errors(("p1", "p2", "p3"), 6))