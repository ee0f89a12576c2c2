"""Further queries by survey id: plans, diffs, orders, scalars and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as X
from tessera.operators import aggregates as A
from tessera.operators import graph as G
from tessera.operators import joins as J
from tessera.operators import orders as O  # noqa: E741
from tessera.operators import sequence as Q
from tessera.operators import sets as S
from tessera.plans import facts as N
from tessera.plans import verdicts as P
from tessera.queries import ORACLES, QUERIES, query
from tessera.sources import adapters as D
from tessera.sources import records as R

__all__ = ["ORACLES", "QUERIES"]


@query("U3_edge_diff", "WITH b AS (SELECT DISTINCT l_suppkey AS s, l_returnflag AS k, l_partkey AS t FROM lineitem WHERE l_linenumber<=3), a AS (SELECT DISTINCT l_suppkey AS s, l_returnflag AS k, l_partkey AS t FROM lineitem WHERE l_linenumber>=3) SELECT s, k, coalesce(string_agg(CASE WHEN a.t IS NULL THEN b.t END::VARCHAR, ',' ORDER BY t),'') AS removed, coalesce(string_agg(CASE WHEN b.t IS NULL THEN a.t END::VARCHAR, ',' ORDER BY t),'') AS added FROM b FULL JOIN a USING(s,k,t) WHERE a.t IS NULL OR b.t IS NULL GROUP BY 1,2".replace("CASE WHEN a.t IS NULL THEN b.t END", "CASE WHEN a.t IS NULL THEN t END").replace("CASE WHEN b.t IS NULL THEN a.t END", "CASE WHEN b.t IS NULL THEN t END"))
def _(s, sf):
    li = D.read(s, sf, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("k"), F.col("l_partkey").alias("t"), "l_linenumber")
    return P.edge_diff(li.where("l_linenumber <= 3"), li.where("l_linenumber >= 3"), ["s", "k"], "t")


@query("U7_disposition_delta", "SELECT p_partkey, CASE WHEN p_size>25 THEN 'rebuild' ELSE 'keep' END AS before, CASE WHEN p_partkey%11=0 THEN 'retire' WHEN p_size>25 THEN 'rebuild' ELSE 'keep' END AS after FROM part WHERE p_partkey%11=0")
def _(s, sf):
    old = D.read(s, sf, "part").select("p_partkey", F.when(F.col("p_size") > 25, "rebuild").otherwise("keep").alias("disposition"))
    new = old.withColumn("disposition", F.when(F.col("p_partkey") % 11 == 0, "retire").otherwise(F.col("disposition")))
    return S.disposition_delta(old, new, "p_partkey")


@query("U9_merged_groups", "SELECT p_brand AS label, count(DISTINCT p_type) AS types, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS members FROM part GROUP BY 1")
def _(s, sf):
    g = S.merged_groups(D.read(s, sf, "part").select(F.col("p_brand").alias("label"), F.col("p_type").alias("member")))
    return g.select("label", F.size("members").cast("long").alias("types"), F.array_join("members", ",").alias("members"))


@query("U10_coverage_note", "SELECT 'large: '||count(*) FILTER (n_chars>5000)||' | empty: '||count(*) FILTER (n_chars=0) AS note FROM documents")
def _(s, sf):
    n = F.col("n_chars")
    return D.read(s, sf, "documents").agg(R.coverage_note(large=F.count_if(n > 5000), empty=F.count_if(n == 0)).alias("note"))


@query("U12_reassembly", "SELECT o_orderkey AS k FROM orders WHERE o_orderkey%4<>0 AND o_orderkey%7<>0 AND sha256(o_orderstatus)<>sha256(CASE WHEN o_orderkey%3=0 THEN 'X' ELSE o_orderstatus END)")
def _(s, sf):
    o = D.read(s, sf, "orders").select(F.col("o_orderkey").alias("file"), F.col("o_orderstatus").alias("source"))
    after = o.where("file % 4 <> 0").withColumn("source", F.when(F.col("file") % 3 == 0, "X").otherwise(F.col("source")))
    return S.reassembly_broken(o, after, o.where("file % 7 = 0")).select(F.col("file").alias("k"))


@query("T5_blast_order", D.with_("edges") + "SELECT target AS id, count(DISTINCT source) AS n FROM edges GROUP BY 1 ORDER BY n DESC, id LIMIT 100")
def _(s, sf):
    n = D.edges(s, sf).groupBy(F.col("target").alias("id")).agg(F.countDistinct("source").alias("n"))
    return O.by_count(n, "n", "id", 100)


@query("T8_worst_first", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size%5, p_size DESC, p_retailprice DESC, p_partkey) AS n, p_brand FROM part QUALIFY n<=10")
def _(s, sf):
    rows = D.read(s, sf, "part").select(F.col("p_partkey").alias("id"), "p_brand", (F.col("p_size") % 5).alias("rank"), F.col("p_size").alias("complexity"), F.col("p_retailprice").alias("blast"))
    return O.worst_first(rows, "p_brand", 10).select(F.col("id").alias("p_partkey"), "n", "p_brand")


@query("T10_surfacing", "SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey)<=5 THEN 'surfaced' ELSE 'queued' END AS state FROM orders")
def _(s, sf):
    return P.ranked(D.read(s, sf, "orders"), "o_custkey", [F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_orderkey")], 5).select("o_orderkey", "state")


@query("T14_sweep_order", "SELECT o_orderkey FROM orders WHERE o_orderstatus='P' ORDER BY o_custkey%7, o_orderkey LIMIT 300")
def _(s, sf):
    nodes = D.read(s, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 7).alias("wave"), F.lit(False).alias("swept"))
    return O.sweep_order(nodes, ["P"], 300).select(F.col("id").alias("o_orderkey"))


@query("A11_object_health", D.with_("findings") + "SELECT object, count(*) AS n, count(*) FILTER (family='performance') AS perf, arg_min(rule_id, CASE severity WHEN 'p1' THEN '1' WHEN 'p2' THEN '2' WHEN 'p3' THEN '3' ELSE '4' END||rule_id) AS worst FROM findings GROUP BY 1")
def _(s, sf):
    return A.object_health(D.findings(s, sf))


@query("A10_clarity", "SELECT p_brand AS object, floor(100*(1-avg(greatest(least(1.0,greatest(0.0,(p_size-10)/30.0)), least(1.0,greatest(0.0,(p_retailprice-1000)/1000))))::DOUBLE)*100+0.5)/100::DOUBLE AS clarity FROM part GROUP BY 1")
def _(s, sf):
    worst = F.greatest(X.ramp(F.col("p_size").cast("double"), 10.0, 40.0), X.ramp(F.col("p_retailprice"), 1000.0, 2000.0))
    return D.read(s, sf, "part").groupBy(F.col("p_brand").alias("object")).agg(X.round_half_up(100 * (1 - F.avg(worst)), 2).alias("clarity"))


@query("A16_cohesion", "WITH m AS (SELECT l_suppkey AS c, count(DISTINCT l_linenumber) AS m, count(DISTINCT l_returnflag) AS a, count(DISTINCT l_linenumber*10+ascii(l_returnflag)) AS links FROM lineitem GROUP BY 1) SELECT c, CASE WHEN m<=1 OR a=0 THEN 0.0 ELSE floor(least(1.0,greatest(0.0,(m-links::DOUBLE/a)/(m-1)))*1000+0.5)/1000 END::DOUBLE AS lcom FROM m")
def _(s, sf):
    g = D.read(s, sf, "lineitem").groupBy(F.col("l_suppkey").alias("c")).agg(F.countDistinct("l_linenumber").alias("m"), F.countDistinct("l_returnflag").alias("a"), F.countDistinct("l_linenumber", "l_returnflag").alias("links"))
    value = X.clamp01((F.col("m") - F.col("links") / F.nullif("a", F.lit(0))) / F.nullif(F.col("m") - 1, F.lit(0)))
    return g.select("c", F.when((F.col("m") <= 1) | (F.col("a") == 0), 0.0).otherwise(X.round_half_up(value, 3)).alias("lcom"))


@query("A19_size_metrics", D.with_("lines") + "SELECT doc_id, count(*) AS loc, max(length(raw))::BIGINT AS longest, sum(length(raw))::BIGINT AS chars, count(*) FILTER (trim(raw)='') AS blank FROM lines GROUP BY 1")
def _(s, sf):
    return A.size_metrics(D.lines(s, sf), "doc_id")


@query("A20_plan_summary", "SELECT CASE WHEN p_size>40 THEN 'XL' WHEN p_size>20 THEN 'L' ELSE 'S' END AS effort, p_brand AS brand, count(*) AS n FROM part GROUP BY ROLLUP(1,2)")
def _(s, sf):
    e = F.when(F.col("p_size") > 40, "XL").when(F.col("p_size") > 20, "L").otherwise("S")
    return A.plan_summary(D.read(s, sf, "part").select(e.alias("effort"), F.col("p_brand").alias("brand")), "effort", "brand")


@query("A21_clean_core_debt", D.with_("findings") + "SELECT object, (10*count(*) FILTER (severity='p1')+5*count(*) FILTER (severity='p2')+count(*) FILTER (severity='p3'))::BIGINT AS debt FROM findings GROUP BY 1")
def _(s, sf):
    return A.clean_core_debt(D.findings(s, sf))


@query("A23_namespaces_of_names", "SELECT DISTINCT regexp_extract(url, '://[^/]*?([a-z]+\\.[a-z]+)/', 1) AS space FROM pages")
def _(s, sf):
    return A.namespaces_of(D.read(s, sf, "pages"), "url", r"://[^/]*?([a-z]+\.[a-z]+)/")


@query("A27_super_node_keys", "SELECT p_partkey//10 AS node, min(p_size%5)::INT AS rank, max(p_size)::INT AS complexity, max(p_retailprice) AS blast FROM part GROUP BY 1")
def _(s, sf):
    members = D.read(s, sf, "part").select(F.floor(F.col("p_partkey") / 10).alias("node"), (F.col("p_size") % 5).alias("rank"), F.col("p_size").alias("complexity"), F.col("p_retailprice").alias("blast"))
    return A.super_node_keys(members, "node")


@query("A29_feature_tallies", D.with_("statements") + "SELECT file, count(*) FILTER (kind='Loop') AS loops, count(*) FILTER (kind='Select') AS selects, count(*) FILTER (kind='AuthorityCheck') AS checks, count(DISTINCT kind) AS kinds FROM statements GROUP BY 1")
def _(s, sf):
    return A.kind_tallies(D.statements(s, sf), "file", loops="Loop", selects="Select", checks="AuthorityCheck")


@query("A31_lint_summary", D.with_("findings") + "SELECT count(*) FILTER (severity='p1') AS errors, count(*) FILTER (severity<>'p1') AS warnings FROM findings")
def _(s, sf):
    return A.lint_summary(D.findings(s, sf), "p1")


@query("A32_coverage", "SELECT p_brand AS node, CASE WHEN sum(p_size) FILTER (p_partkey%2=0)=0 THEN NULL ELSE floor(100.0::DOUBLE*sum(CASE WHEN p_partkey%4=0 THEN p_size ELSE 0 END) FILTER (p_partkey%2=0)/sum(p_size) FILTER (p_partkey%2=0)*100+0.5)/100 END::DOUBLE AS pct FROM part GROUP BY 1")
def _(s, sf):
    leaf = D.read(s, sf, "part").where("p_partkey % 2 = 0")
    return leaf.groupBy(F.col("p_brand").alias("node")).agg(X.round_half_up(100.0 * F.sum(F.when(F.col("p_partkey") % 4 == 0, F.col("p_size")).otherwise(0)) / F.nullif(F.sum("p_size"), F.lit(0)), 2).alias("pct"))


@query("A33_status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def _(s, sf):
    return A.status_counts(D.read(s, sf, "orders").select(F.col("o_orderstatus").alias("status")))


@query("W13_bounded_history", D.with_("statements") + "SELECT file, string_agg(substr(kind,1,1), '' ORDER BY ts, seq) AS series FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ts DESC, seq DESC) AS r FROM statements) WHERE r<=5 GROUP BY 1")
def _(s, sf):
    last = Q.last_series(D.statements(s, sf), "file", ["ts", "seq"], F.substring("kind", 1, 1))
    return last.select("file", F.array_join("series", "").alias("series"))


@query("W6_latest_fill", D.with_("statements") + ", x AS (SELECT *, last_value(CASE WHEN kind='Other' THEN value END IGNORE NULLS) OVER (PARTITION BY file ORDER BY ts,seq ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS guard FROM statements) SELECT file, seq, guard FROM x WHERE kind='Select'")
def _(s, sf):
    return Q.guarded(D.statements(s, sf), "Select", "Other", 3)


@query("X2_strip_quotes", "SELECT event_id, regexp_replace(props, '[{}\"]', '', 'g') AS plain FROM events")
def _(s, sf):
    return D.read(s, sf, "events").select("event_id", X.strip_quotes(F.col("props"), '{}"').alias("plain"))


@query("X4_captures", "SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title, len(regexp_extract_all(html, 'href=\"/([^\"]*)', 1))::BIGINT AS links FROM pages")
def _(s, sf):
    h = F.col("html")
    return D.read(s, sf, "pages").select("page_id", X.capture(h, r"<title>([^<]*)").alias("title"), F.size(X.captures(h, r'href="/([^"]*)')).cast("long").alias("links"))


@query("X9_source_hash", "WITH a AS (SELECT doc_id//1024 AS n, sha256(string_agg(sha256(doc_id||'|'||text), '||' ORDER BY doc_id)) AS d FROM documents GROUP BY 1), b AS (SELECT n//1024 AS n, sha256(string_agg(d, '||' ORDER BY n)) AS d FROM a GROUP BY n//1024) SELECT sha256(string_agg(d, '||' ORDER BY n)) AS source_hash FROM b")
def _(s, sf):
    each = D.read(s, sf, "documents").select("doc_id", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "text"), 256).alias("source_hash"))
    return A.range_digest(each, "doc_id", "source_hash", levels=3)


@query("X20_impact", D.with_("edges") + ", n AS (SELECT target AS id, count(DISTINCT source) AS n FROM edges GROUP BY 1) SELECT id, CASE WHEN n>=50 THEN 'critical' WHEN n>=20 THEN 'high' WHEN n>=5 THEN 'medium' ELSE 'low' END AS impact FROM n")
def _(s, sf):
    return D.edges(s, sf).groupBy(F.col("target").alias("id")).agg(F.countDistinct("source").alias("n")).select("id", X.impact_tier(F.col("n")).alias("impact"))


@query("X22_access_grade", D.with_("edges", "registry") + "SELECT e.source, e.target, e.access, CASE WHEN r.state='released' THEN 'A' WHEN e.access='write' THEN 'D' ELSE 'C' END AS grade FROM edges e LEFT JOIN registry r ON r.name=e.target WHERE e.kind='uses-table'")
def _(s, sf):
    r = D.registry(s, sf).select(F.col("name").alias("target"), (F.col("state") == "released").alias("rel"))
    return D.edges(s, sf).where("kind = 'uses-table'").join(r, "target", "left").select("source", "target", "access", X.access_grade(F.col("access"), F.coalesce("rel", F.lit(False))).alias("grade"))


@query("X24_sap_dates", "SELECT o_orderkey, CASE WHEN o_orderkey%3=0 THEN NULL ELSE strftime(o_orderdate,'%Y-%m-%d') END AS iso FROM orders")
def _(s, sf):
    raw = F.when(F.col("o_orderkey") % 3 == 0, "20260231").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return D.read(s, sf, "orders").select("o_orderkey", X.sap_date(raw).alias("iso"))


@query("X26_disposition_hint", D.with_("findings") + "SELECT family, CASE WHEN family='abaplint' THEN 'style' WHEN family LIKE '%api%' THEN 'replace' WHEN family LIKE 'dep%' THEN 'migrate' ELSE 'style' END AS hint, count(*) AS n FROM findings GROUP BY 1,2")
def _(s, sf):
    hint = X.disposition_hint(F.lit(None).cast("string"), F.col("family"), [("api", "replace"), ("^dep", "migrate")])
    return D.findings(s, sf).groupBy("family", hint.alias("hint")).agg(F.count("*").alias("n"))


@query("X40_confidence", "SELECT o_custkey, floor(least(0.95::DOUBLE, 0.6::DOUBLE+0.15::DOUBLE*(count(*)-1))*100+0.5)/100::DOUBLE AS confidence FROM orders GROUP BY 1")
def _(s, sf):
    return D.read(s, sf, "orders").groupBy("o_custkey").agg(X.confidence(F.count("*")).alias("confidence"))


@query("G27_group_evidence", D.with_("edges") + "SELECT target AS grp, count(*) AS members, count(*) FILTER (source IN (SELECT source FROM edges WHERE kind='uses-table')) AS linked FROM edges WHERE kind='inherits' GROUP BY 1")
def _(s, sf):
    e = D.edges(s, sf)
    members = e.where("kind = 'inherits'").select(F.col("target").alias("grp"), F.col("source").alias("id"))
    return G.group_evidence(members, e.where("kind = 'uses-table'").select(F.col("source").alias("id")))


@query("G28_dropped_dependencies", D.with_("edges") + ", r AS (SELECT 'P'||p_partkey AS id FROM part WHERE p_partkey%13=0 UNION ALL SELECT 'S'||s_suppkey FROM supplier WHERE s_suppkey%4=0) SELECT DISTINCT source, target FROM edges WHERE target IN (SELECT id FROM r) AND source NOT IN (SELECT id FROM r)")
def _(s, sf):
    n = D.nodes(s, sf).withColumn("k", F.substring("id", 2, 20).cast("long"))
    return P.dropped_dependencies(D.edges(s, sf), n.where("(startswith(id, 'P') and k % 13 = 0) or (startswith(id, 'S') and k % 4 = 0)"))


@query("G29_released_dependents", D.with_("edges") + ", l AS (SELECT DISTINCT source, target FROM edges), d AS (SELECT 'S'||s_suppkey AS id FROM supplier WHERE s_suppkey%2=0), o AS (SELECT target AS id, count(*) n FROM l WHERE source NOT IN (SELECT id FROM d) GROUP BY 1), i AS (SELECT source AS id FROM l UNION SELECT target FROM l) SELECT i.id, coalesce(n,0)::BIGINT AS indegree, coalesce(n,0)=0 AS ready FROM i LEFT JOIN o ON o.id=i.id WHERE i.id NOT IN (SELECT id FROM d)")
def _(s, sf):
    done = D.read(s, sf, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"))
    return P.indegrees(D.edges(s, sf), done)


@query("C7_builtin_severity", "SELECT event_type, CASE event_type WHEN 'error' THEN 'p2' WHEN 'view' THEN 'p3' ELSE 'info' END AS severity, count(*) AS n FROM events GROUP BY 1,2")
def _(s, sf):
    given = F.when(F.col("event_type") == "error", "Error").when(F.col("event_type") == "view", "Warning").otherwise("Info")
    return D.read(s, sf, "events").groupBy("event_type", N.builtin_severity(F.col("event_type"), given).alias("severity")).agg(F.count("*").alias("n"))


@query("C12_dispositions", "SELECT p_partkey, CASE WHEN p_partkey%4=0 AND p_size%4=0 THEN 'retire' WHEN p_partkey%4=0 THEN 'park' WHEN p_size%4=3 THEN 'keep' WHEN p_size%4=2 AND p_size<20 THEN 'wrap' WHEN p_size%4=2 THEN 'refactor' WHEN p_size>40 THEN 'rearchitect' ELSE 'rebuild' END AS disposition FROM part")
def _(s, sf):
    grade = X.rank_level(F.col("p_size") % 4)
    return D.read(s, sf, "part").select("p_partkey", P.disposition(grade, F.col("p_partkey") % 4 != 0, F.col("p_size")).alias("disposition"))


@query("C15_needs_reasoning", "SELECT o_orderkey, o_totalprice%1<0.9 OR o_custkey%20>10 AS needs FROM orders".replace("o_totalprice%1<0.9", "o_shift<0.9").replace("FROM orders", "FROM (SELECT *, (o_orderkey%100)/100.0::DOUBLE AS o_shift FROM orders)"))
def _(s, sf):
    needs = P.needs_reasoning((F.col("o_orderkey") % 100) / 100.0, F.col("o_custkey") % 20, F.lit(1), F.lit(False))
    return D.read(s, sf, "orders").select("o_orderkey", needs.alias("needs"))


@query("D8_ratchet", "SELECT d.doc_id, CASE WHEN l.n IS NULL THEN 'no-evidence' WHEN d.doc_id%3=0 THEN 'no-baseline' WHEN l.n>0 THEN 'above-ceiling' ELSE 'pass' END AS gate FROM documents d LEFT JOIN (SELECT doc_id, sum(toxic)::BIGINT AS n FROM labels GROUP BY 1) l USING(doc_id)")
def _(s, sf):
    n = D.read(s, sf, "labels").groupBy("doc_id").agg(F.sum("toxic").alias("n"))
    rows = D.read(s, sf, "documents").select("doc_id").join(n, "doc_id", "left")
    return P.ratchet(rows, D.read(s, sf, "documents").where("doc_id % 3 <> 0").select("doc_id", F.lit(0).alias("ceiling")), "doc_id")


@query("D16_escalations", "SELECT substr(sha256(conv_id||'|'||role),1,12) AS id, min(turn) AS opened_at, max(turn) AS last FROM conversations GROUP BY conv_id, role")
def _(s, sf):
    c = D.read(s, sf, "conversations")
    return c.groupBy("conv_id", "role").agg(F.min("turn").alias("opened_at"), F.max("turn").alias("last")).select(F.substring(X.identity(F.col("conv_id"), F.col("role")), 1, 12).alias("id"), "opened_at", "last")


@query("D23_rule_gate", D.with_("findings") + "SELECT object, bool_or(severity='p1' AND rule_id IN ('RF','AF')) AS blocked FROM findings GROUP BY 1")
def _(s, sf):
    return P.rule_gate(D.findings(s, sf), ("RF", "AF"))


@query("J12_unbound_operations", "SELECT DISTINCT s_nationkey, s_suppkey % 997 AS operation FROM supplier WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_custkey % 997 = s_suppkey % 997)")
def _(s, sf):
    handlers = D.read(s, sf, "customer").select(F.col("c_nationkey").alias("s_nationkey"), (F.col("c_custkey") % 997).alias("operation"))
    return J.unbound(D.read(s, sf, "supplier").withColumn("operation", F.col("s_suppkey") % 997), handlers, ["s_nationkey", "operation"])


@query("J14_unmentioned", "SELECT p.n_name FROM nation p WHERE NOT EXISTS (SELECT 1 FROM pages WHERE contains(lower(html), lower(p.n_name)))")
def _(s, sf):
    names = J.unmentioned(D.read(s, sf, "nation").select(F.col("n_name").alias("name")), D.read(s, sf, "pages").select(F.col("html").alias("text")))
    return names.select(F.col("name").alias("n_name"))


@query("A28_member_summary", "SELECT p_brand AS node, ['D','C','B','A'][min(p_size%4)+1] AS worst, max(p_size)::INT AS complexity, sum(p_size)::BIGINT AS blast FROM part GROUP BY 1")
def _(s, sf):
    return A.weakest(D.read(s, sf, "part").select("*", X.rank_level(F.col("p_size") % 4).alias("level")), "p_brand").join(D.read(s, sf, "part").groupBy("p_brand").agg(F.max("p_size").alias("complexity"), F.sum("p_size").cast("long").alias("blast")), "p_brand").select(F.col("p_brand").alias("node"), F.col("level").alias("worst"), "complexity", "blast")
