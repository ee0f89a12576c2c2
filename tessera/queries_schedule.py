"""Queries by survey id: scheduling, gates, registers and verdicts of plan nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans import facts as P
from tessera.plans import schedule as S
from tessera.queries import query
from tessera.queries_facts import CALLS, ORACLES, QUERIES, calls
from tessera.sources import adapters as D

__all__ = ["ORACLES", "QUERIES"]

_STATES = ("PENDING", "GROUNDED", "GREEN", "PROVISIONAL_GATED", "BLOCK", "NEEDS_MANUAL_SEAM")
_NODES = """n AS (SELECT o_custkey AS run, o_orderkey AS id, (['PENDING','GROUNDED','GREEN','PROVISIONAL_GATED','BLOCK','NEEDS_MANUAL_SEAM'])[o_orderkey%6+1] AS status,
 (['refactor','re_architect','rebuild','replace','retire','seal'])[(o_orderkey//6)%6+1] AS disposition, o_orderkey%4 AS indegree, o_orderkey%31=0 AS ready, o_orderkey%17=0 AS arch_open, o_orderkey%19=0 AS parked,
 o_orderkey%23=0 AS sealed, o_orderkey%5=0 AS failed, o_orderkey%3=0 AS starved, o_orderstatus='F' AS complete FROM orders)"""


def _pick(xs, k):
    return F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))


def _flag(m):
    return F.col("o_orderkey") % m == 0


def nodes(s, sf):
    k = F.col("o_orderkey")
    return D.read(s, sf, "orders").select(
        F.col("o_custkey").alias("run"), k.alias("id"), _pick(_STATES, k).alias("status"), _pick(S.DISPOSITIONS, F.floor(k / 6)).alias("disposition"), (k % 4).alias("indegree"), _flag(31).alias("ready"), _flag(17).alias("arch_open"),
        _flag(19).alias("parked"), _flag(23).alias("sealed"), _flag(5).alias("failed"), _flag(3).alias("starved"), (F.col("o_orderstatus") == "F").alias("complete"),
    )


@query("D13_ladder", f"WITH {_NODES}, m AS (SELECT run, bool_and(complete) AS alldone, count(*) FILTER (disposition='retire' AND status IN ('PENDING','GROUNDED') AND indegree=0) AS r, count(*) FILTER (ready) AS g, count(*) FILTER (disposition IN ('re_architect','rebuild') AND arch_open) AS a, count(*) FILTER (parked OR status='NEEDS_MANUAL_SEAM' OR ((sealed OR disposition='seal') AND status='PENDING') OR (status='PROVISIONAL_GATED' AND failed)) AS h, count(*) FILTER (status IN ('PENDING','GROUNDED') AND NOT starved) AS b FROM n GROUP BY 1) SELECT run, CASE WHEN alldone THEN 'complete' WHEN r>0 THEN 'retire' WHEN g>0 THEN 'generate' WHEN a>0 THEN 'await_arch' WHEN h>0 THEN 'await_human' WHEN b>0 THEN 'blocked' ELSE 'provisional_complete' END AS action, CASE WHEN alldone THEN 0 WHEN r>0 THEN r WHEN g>0 THEN g WHEN a>0 THEN a WHEN h>0 THEN h ELSE b END AS n FROM m")
def _(s, sf):
    return S.ladder(nodes(s, sf)).select("run", "action", F.size("nodes").cast("long").alias("n"))


@query("D14_verdict_step", "WITH r AS (SELECT o_orderkey, o_orderkey%11=0 AS prov, list_filter([CASE WHEN o_orderkey%3=0 THEN 'auth-delta-unattested' END, CASE WHEN o_orderkey%5=0 THEN 'final-review-unanalysable:Z' END, CASE WHEN o_orderkey%7=0 THEN 'veto' END], lambda x: x IS NOT NULL) AS reasons, o_orderkey%4 AS cycle FROM orders) SELECT o_orderkey, CASE WHEN prov THEN 'decide' WHEN len(reasons)>0 AND NOT list_contains(reasons,'veto') THEN 'await_human' WHEN cycle>=3 THEN 'block' ELSE 'generate' END AS action, CASE WHEN prov OR len(reasons)=0 OR list_contains(reasons,'veto') THEN 0 ELSE len(reasons) END::INT AS n FROM r")
def _(s, sf):
    reasons = F.array_compact(F.array(F.when(_flag(3), "auth-delta-unattested"), F.when(_flag(5), "final-review-unanalysable:Z"), F.when(_flag(7), "veto")))
    action, kinds = S.verdict_step(_flag(11), reasons, F.col("o_orderkey") % 4)
    return D.read(s, sf, "orders").select("o_orderkey", action.alias("action"), F.size(kinds).alias("n"))


@query("D15_wave_risk", f"WITH {_NODES} SELECT run, indegree AS wave, CASE WHEN max(id%13)>=10 THEN 'REVIEW' ELSE 'AUTO' END AS disposition, count(*) FILTER (id%13>=10) AS flagged FROM n GROUP BY 1,2 HAVING bool_and(status NOT IN ('PENDING','GROUNDED'))")
def _(s, sf):
    return S.wave_risk(nodes(s, sf).withColumn("blast", F.col("id") % 13).withColumn("wave", F.col("indegree")), ["run", "wave"])


@query("D15_oscillations", f"WITH {_NODES} SELECT coalesce(CASE WHEN id%3>0 THEN 'r'||id%3 END,'unknown')||'|'||coalesce(CASE WHEN id%4>0 THEN 'd'||id%4 END,'unknown') AS root_signature, count(*)::INT AS n, min(id) AS first FROM n WHERE failed GROUP BY 1")
def _(s, sf):
    n = nodes(s, sf).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("r"), (F.col("id") % 3).cast("string"))).alias("rule"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("d"), (F.col("id") % 4).cast("string"))).alias("dependency"), F.col("failed").alias("oscillating"))
    return S.oscillation_clusters(n).select("root_signature", F.size("ids").alias("n"), F.array_min("ids").alias("first"))


@query("D12_node_states", "WITH r AS (SELECT user_id, event_type='purchase' AS p, coalesce(sum((event_type<>'purchase')::INT) OVER w,0) AS f, coalesce(sum((event_type='purchase')::INT) OVER w,0) AS won, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), g AS (SELECT user_id, count(*) FILTER (won=0 AND f<3 AND NOT p) AS attempts, bool_or(won=0 AND f<3 AND p) AS done, string_agg(CASE WHEN back<=5 THEN CASE WHEN p THEN 'P' ELSE 'F' END END, '' ORDER BY back DESC) AS series FROM r GROUP BY 1) SELECT user_id, CASE WHEN done THEN 'COMPLETE' WHEN attempts>=3 THEN 'PARKED' ELSE 'PENDING' END AS status, attempts, series FROM g")
def _(s, sf):
    return S.node_states(D.read(s, sf, "events").withColumn("passed", F.col("event_type") == "purchase"), "user_id", ["ts", "event_id"])


@query("D10_review_reasons", D.with_("findings") + "SELECT object, 'final-review-fix:'||rule_id||' ('||count(*)||CASE WHEN count(*)=1 THEN ' hit, first ' ELSE ' hits, first ' END||arg_min(file||':'||line, file||lpad(line::VARCHAR,9,'0'))||')' AS reason FROM findings GROUP BY object, rule_id")
def _(s, sf):
    return S.review_reasons(D.findings(s, sf), "object")


@query("D18_attestations", "WITH l AS (SELECT o_custkey AS sig, o_orderpriority AS kind, arg_max(o_orderstatus, strftime(o_orderdate,'%Y%m%d%H%M%S')||lpad(o_orderkey::VARCHAR,12,'0')) AS st, max_by(o_orderkey, strftime(o_orderdate,'%Y%m%d%H%M%S')||lpad(o_orderkey::VARCHAR,12,'0')) AS k FROM orders GROUP BY 1,2) SELECT sig, kind, 'u'||k AS resolved_by FROM l WHERE st='F' AND k%3=0 AND k%2=sig%2 AND k%5=sig%5")
def _(s, sf):
    o, k = D.read(s, sf, "orders"), F.col("o_orderkey")
    e = o.select(F.col("o_custkey").alias("sig"), F.col("o_orderpriority").alias("kind"), "o_orderdate", "o_orderkey", F.when(F.col("o_orderstatus") == "F", "RESOLVED").otherwise("OPEN").alias("status"), F.when(_flag(3), "ATTEST").otherwise("REJECT").alias("decision"), F.lit("r1").alias("run"), (k % 2).alias("epoch"), (k % 5).alias("generation"), F.concat(F.lit("u"), k.cast("string")).alias("resolved_by"))
    now = o.select(F.col("o_custkey").alias("sig")).distinct().select("sig", F.lit("r1").alias("run"), (F.col("sig") % 2).alias("epoch"), (F.col("sig") % 5).alias("generation"))
    return S.attested(e, ["sig", "kind"], ["o_orderdate", "o_orderkey"], now, "ATTEST")


@query("D19_parking", D.with_("registry") + "SELECT p.p_partkey AS id, r.name IS NOT NULL AS reentered, (p.p_partkey%3<>0)::INT+(p.p_partkey%4=0)::INT+(p.p_partkey%5=0)::INT AS errors FROM part p LEFT JOIN registry r ON r.name='P'||p.p_partkey AND r.level='A'")
def _(s, sf):
    k = F.col("p_partkey")
    errors = S.park_errors(F.when(k % 3 == 0, "NO_RELEASED_SUCCESSOR").otherwise("DEFECT"), F.when(k % 4 != 0, "someone"), F.when(k % 5 == 0, "").otherwise("since"), F.lit(False))
    parked = D.read(s, sf, "part").select(k.alias("id"), F.concat(F.lit(" p"), k.cast("string"), F.lit(" ")).alias("successor_probe"), F.size(errors).alias("errors"))
    return S.re_enter(parked, D.registry(s, sf).where("level = 'A'")).select("id", "reentered", "errors")


@query("D20_replan", "WITH b AS (SELECT p_partkey AS id, p_size AS wave FROM part WHERE p_partkey%7<>0), a AS (SELECT p_partkey AS id, CASE WHEN p_partkey%11=0 THEN p_size+1 ELSE p_size END AS wave FROM part WHERE p_partkey%5<>0), j AS (SELECT id, CASE WHEN b.wave IS NULL THEN 'added' WHEN a.wave IS NULL THEN 'removed' WHEN a.wave<>b.wave THEN 'moved' END AS change FROM b FULL JOIN a USING(id)) SELECT id, change, change<>'added' AND id%2=0 AS forces FROM j WHERE change IS NOT NULL")
def _(s, sf):
    p = D.read(s, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("wave"))
    return S.replan(p.where("id % 7 <> 0"), p.where("id % 5 <> 0").withColumn("wave", F.when(F.col("id") % 11 == 0, F.col("wave") + 1).otherwise(F.col("wave"))), p.where("id % 2 = 0"))


@query("D20_plan_hash", "WITH n AS (SELECT s_nationkey AS run, s_suppkey AS id, sha256('{\"id\":'||s_suppkey||',\"wave\":'||(s_suppkey%3)||'}') AS d FROM supplier), b AS (SELECT run, id//1024 AS id, sha256(string_agg(d,'|' ORDER BY id)) AS d FROM n GROUP BY run, id//1024), c AS (SELECT run, id//1024 AS id, sha256(string_agg(d,'|' ORDER BY id)) AS d FROM b GROUP BY run, id//1024) SELECT run, sha256(string_agg(d,'|' ORDER BY id)) AS plan_hash FROM c GROUP BY 1")
def _(s, sf):
    return S.plan_hash(D.read(s, sf, "supplier").select(F.col("s_nationkey").alias("run"), F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 3).alias("wave")), "run", ["wave", "id"])


_EVENTS = "e AS (SELECT o_custkey AS sig, o_orderkey AS seq, CASE WHEN o_orderkey%2=0 THEN 'DISPOSITION_REVIEW' WHEN o_orderkey%9=0 THEN 'OTHER' ELSE 'NO_TARGET_SHAPE' END AS kind, (['override','approve','shape'])[o_orderkey%3+1] AS verb, (['refactor','retire','seal'])[(o_orderkey//3)%3+1] AS value FROM orders WHERE o_orderstatus='F'), x AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY seq DESC) AS r, first(verb) OVER w AS lv, first(kind) OVER w AS lk FROM e WHERE kind<>'OTHER' WINDOW w AS (PARTITION BY sig ORDER BY seq DESC))"


def _decisions(s, sf):
    k = F.col("o_orderkey")
    return D.read(s, sf, "orders").select(F.col("o_custkey").alias("sig"), k.alias("at"), F.lit("r1").alias("run"), F.when(k % 2 == 0, "DISPOSITION_REVIEW").when(k % 9 == 0, "OTHER").otherwise("NO_TARGET_SHAPE").alias("kind"), F.when(F.col("o_orderstatus") == "F", "RESOLVED").otherwise("OPEN").alias("status"), _pick(("override", "approve", "shape"), k).alias("verb"), _pick(("refactor", "retire", "seal"), F.floor(k / 3)).alias("value"))


@query("D21_overrides", f"WITH {_EVENTS} SELECT sig, CASE WHEN verb='shape' THEN 're_architect' ELSE value END AS disposition FROM x WHERE r=1 AND verb IN ('override','shape')")
def _(s, sf):
    return S.overrides(_decisions(s, sf), "r1", ["at"])[0]


@query("D21_superseded", f"WITH {_EVENTS} SELECT sig, value AS disposition, lk AS superseded_by FROM x WHERE r>1 AND verb='override' AND lv<>'override'")
def _(s, sf):
    return S.overrides(_decisions(s, sf), "r1", ["at"])[1]


@query("D22_verdict_cache", "SELECT p_partkey AS fact, CASE WHEN p_partkey%3=0 THEN 'await' WHEN p_partkey%10=1 THEN 'tampered' ELSE 'cached' END AS status, CASE WHEN p_partkey%3<>0 AND p_partkey%10<>1 THEN p_brand END AS recommendation FROM part")
def _(s, sf):
    p = D.read(s, sf, "part").select(F.col("p_partkey").alias("fact"), F.lit("m").alias("model"), F.col("p_brand").alias("recommendation"))
    good = p.where("fact % 3 <> 0").withColumn("entry_hash", S.entry_hash("fact", "model", "recommendation"))
    cache = good.withColumn("entry_hash", F.when(F.col("fact") % 10 == 1, "0").otherwise(F.col("entry_hash")))
    return S.cached(p.select("fact", "model"), cache, ["fact", "model"], strict=False).select("fact", "status", "recommendation")


@query("X32_decisions", "SELECT o_orderkey, CASE WHEN o_orderkey%6 IN (0,1,3) THEN (['approve','override','','other'])[o_orderkey%6+1] END AS verb, CASE o_orderkey%6 WHEN 1 THEN 'retire' WHEN 3 THEN 'why: '||o_orderpriority END AS param FROM orders")
def _(s, sf):
    k = F.col("o_orderkey") % 6
    raw = F.when(k == 0, " approve ").when(k == 1, "override: retire").when(k == 2, "override:nothing").when(k == 3, F.concat(F.lit("other:why: "), "o_orderpriority")).when(k == 4, "other: ").otherwise("maybe")
    verb, param = S.decision(raw, ["approve"], ["other"], {"override": S.DISPOSITIONS})
    return D.read(s, sf, "orders").select("o_orderkey", verb.alias("verb"), param.alias("param"))


@query("X38_prompt_options", "SELECT p_partkey, CASE WHEN p_partkey%2=0 THEN 'refactor,retire,other' ELSE 'refactor,seal,retire,other' END AS options FROM part")
def _(s, sf):
    alternatives = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("retire"), F.lit("refactor"))).otherwise(F.array(F.lit("seal"), F.lit("retire")))
    return D.read(s, sf, "part").select("p_partkey", F.array_join(S.prompt_options(F.lit("refactor"), alternatives), ",").alias("options"))


@query("K8_dropped_features", "WITH r AS (SELECT o_orderkey AS sig, (['RETIRED','REBUILT_HANDOFF','GREEN'])[o_orderkey%3+1] AS status, CASE WHEN o_orderkey%7<>0 THEN 's' END AS signed, CASE WHEN o_orderkey%10<>0 THEN (['retire','rebuild'])[(o_orderkey//2)%2+1] END AS disposition FROM orders) SELECT sig, status, disposition, CASE WHEN disposition IS NULL THEN 'unknown-node' WHEN status='GREEN' THEN 'not-terminal' WHEN (status='RETIRED')<>(disposition='retire') THEN 'wrong-disposition' WHEN signed IS NULL THEN 'unsigned' END AS error FROM r")
def _(s, sf):
    k = F.col("o_orderkey")
    o = D.read(s, sf, "orders")
    register = o.select(k.alias("sig"), _pick(("RETIRED", "REBUILT_HANDOFF", "GREEN"), k).alias("status"), F.when(k % 7 != 0, "s").alias("signed_by"), F.lit("j").alias("justification"))
    return S.dropped_features(register, o.where(k % 10 != 0).select(k.alias("sig"), _pick(("retire", "rebuild"), F.floor(k / 2)).alias("disposition")), strict=False)


@query("C13_fit_to_standard", f"WITH {CALLS}, t AS (SELECT DISTINCT source FROM calls WHERE target='MARA'), a AS (SELECT source, string_agg(DISTINCT target, ',' ORDER BY target) AS apis FROM calls WHERE kind='calls' AND regexp_matches(target,'^(BAPI_|IDOC_INPUT_|MASTER_IDOC_)|^GUI_UPLOAD$') GROUP BY 1) SELECT 'S'||s_suppkey AS node, CASE WHEN t.source IS NULL THEN '' ELSE 'Material' END AS domains, coalesce(apis,'') AS apis, CASE WHEN t.source IS NULL AND apis IS NULL THEN 'build' ELSE 'verify_live' END AS action FROM supplier LEFT JOIN t ON t.source='S'||s_suppkey LEFT JOIN a ON a.source='S'||s_suppkey")
def _(s, sf):
    c = calls(s, sf).withColumnRenamed("source", "object")
    own = D.read(s, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("object")).withColumn("node", F.col("object"))
    out = S.fit_to_standard(c.where("kind = 'uses-table'"), c.where("kind = 'calls'").withColumn("released", F.col("target") == "GUI_UPLOAD"), own)
    return out.select("node", F.array_join("domains", ",").alias("domains"), F.array_join("apis", ",").alias("apis"), "action")


@query("C19_blueprint", "WITH o AS (SELECT s_suppkey AS sig, s_suppkey%4 AS shape FROM supplier), g AS (SELECT s_suppkey%6 AS id, CASE WHEN s_suppkey%2=0 THEN 'fiori_apps' ELSE 'services' END AS kind, s_suppkey*3//2 AS member FROM supplier) SELECT 'unknown-shape' AS tier, sig::VARCHAR AS item FROM o WHERE shape=3 UNION SELECT 'unknown-member', id||':'||member FROM g WHERE member NOT IN (SELECT sig FROM o) UNION SELECT 'unknown-group', sig||':'||(sig%8) FROM o WHERE sig%8>=6 UNION SELECT 'no-ui', id||':'||member FROM g JOIN o ON sig=member WHERE kind='fiori_apps' AND shape=1")
def _(s, sf):
    k = F.col("s_suppkey")
    p = D.read(s, sf, "supplier")
    o = p.select(k.cast("string").alias("sig"), (k % 4).alias("shape"), F.array((k % 8).cast("string")).alias("refs"))
    g = p.select((k % 6).cast("string").alias("id"), F.when(k % 2 == 0, "fiori_apps").otherwise("services").alias("kind"), F.floor(k * 3 / 2).cast("string").alias("member"))
    return S.blueprint_violations(o, g, s.createDataFrame([(0, True), (1, False), (2, True)], "shape long, ui boolean")).select("tier", "item")


_CHECKS = "c AS (SELECT l_suppkey AS k, CASE WHEN l_partkey%5>0 THEN 'O'||l_partkey%5 END AS object, l_linenumber AS f, l_tax>0.06 AS dummy, l_discount<0.09 AS checked, l_returnflag AS rf FROM lineitem)"


@query("D6_invariants", f"WITH {_CHECKS}, b AS (SELECT k, list_sort(list_distinct(list(object||'|'||f) FILTER (object IS NOT NULL AND NOT dummy))) AS o, count(*) FILTER (object IS NULL) AS n FROM c WHERE rf='A' GROUP BY 1), a AS (SELECT k, list_sort(list_distinct(list(object||'|'||f) FILTER (object IS NOT NULL AND NOT dummy))) AS o, count(*) FILTER (object IS NULL) AS n, bool_or(object IS NOT NULL AND NOT dummy AND NOT checked) AS u FROM c WHERE rf='R' GROUP BY 1), j AS (SELECT k, coalesce(b.o,[]) AS bo, coalesce(a.o,[]) AS ao, coalesce(b.n,0) AS bn, coalesce(a.n,0) AS an, coalesce(u,false) AS u FROM b FULL JOIN a USING(k)) SELECT k, concat_ws(',', CASE WHEN an<bn THEN 'P4b:commit-suppressed' END, CASE WHEN u THEN 'P4c:subrc-unchecked' END) AS violations, len(list_filter(bo, lambda x: NOT list_contains(ao,x)))::INT AS lost, bo<>ao AS auth_delta FROM j")
def _(s, sf):
    k = F.col("l_partkey") % 5
    c = D.read(s, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.when(k > 0, F.concat(F.lit("O"), k.cast("string"))).alias("object"), F.col("l_linenumber").cast("string").alias("field"), (F.col("l_tax") > 0.06).alias("dummy"), (F.col("l_discount") < 0.09).alias("checked"), "l_returnflag")
    out = S.invariant_diff(c.where("l_returnflag = 'A'"), c.where("l_returnflag = 'R'"), ["k"])
    return out.select("k", F.array_join("violations", ",").alias("violations"), F.size("lost").alias("lost"), "auth_delta")


@query("D7_checkpoint", D.with_("findings") + "SELECT 'S'||s_suppkey AS object, CASE WHEN s_suppkey%3<>0 THEN (SELECT count(*) FROM findings f WHERE f.object='S'||s_suppkey AND severity='p1' AND line=1) END AS p1, CASE WHEN s_suppkey%3<>0 THEN (SELECT count(*) FROM findings f WHERE f.object='S'||s_suppkey AND severity='p2') END AS p2 FROM supplier")
def _(s, sf):
    own = D.read(s, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("object"), "s_suppkey")
    return S.checkpoint_counts(own, D.findings(s, sf), own.where("s_suppkey % 3 <> 0"), "object")


@query("A30_manifest", f"WITH {_NODES} SELECT run, disposition, count(*) AS n, count(*) FILTER (ready) AS prompts FROM n GROUP BY GROUPING SETS ((run, disposition), (run))")
def _(s, sf):
    n = nodes(s, sf)
    return n.groupingSets([["run", "disposition"], ["run"]], "run", "disposition").agg(F.count("*").alias("n"), F.count_if("ready").alias("prompts"))


@query("G25_frontier")
def _(s, sf):
    p = D.read(s, sf, "part")
    ready = p.select(F.col("p_partkey").alias("id"), "p_size", F.substring("p_brand", -1, 1).alias("grade"))
    links = D.read(s, sf, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"))
    return S.frontier(ready, links, ready.select("id", F.floor(F.col("id") / 12).alias("key")), [P.grade_rank(F.col("grade")).alias("g"), (-F.col("p_size")).alias("s")])


@query("X27_plan_order", "WITH s AS (SELECT p_partkey%97 AS node, min(CASE p_brand[-1] WHEN '1' THEN 0 WHEN '2' THEN 1 ELSE 4 END) AS rank, max(p_size) AS complexity, max(p_partkey%50) AS blast FROM part GROUP BY 1) SELECT node, row_number() OVER (PARTITION BY node%5 ORDER BY rank, complexity DESC, blast DESC, node)::INT AS place FROM s")
def _(s, sf):
    from pyspark.sql import Window as W

    grade = F.when(F.substring("p_brand", -1, 1) == "1", "D").when(F.substring("p_brand", -1, 1) == "2", "c")
    n = D.read(s, sf, "part").groupBy((F.col("p_partkey") % 97).alias("node")).agg(F.min(P.grade_rank(grade)).alias("rank"), F.max("p_size").alias("complexity"), F.max(F.col("p_partkey") % 50).alias("blast"))
    return n.select("node", F.row_number().over(W.partitionBy(F.col("node") % 5).orderBy("rank", F.desc("complexity"), F.desc("blast"), "node")).alias("place"))
