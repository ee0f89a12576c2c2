"""Queries of the identity of findings, of the gate over verdict documents, and of types of references."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import joins as J
from tessera.plans import gate as Y
from tessera.plans import identity as I  # noqa: E741
from tessera.plans import types as T
from tessera.queries import query
from tessera.queries_sources import ORACLES, QUERIES
from tessera.sources import adapters as D

__all__ = ["ORACLES", "QUERIES"]

#: Units of documents: lines that start with two words open one, lines that end with a full stop close one; the rules that find something.
OPEN, CLOSE = r"^\s*([A-Z][a-z]+)\s+([a-z]+)", r"\.\s*$"
FOUND = [("number", "[0-9][0-9][0-9]"), ("address", "@[a-z]+"), ("caps", "[A-Z][A-Z][A-Z]")]

_UNITS = D.with_("lines") + r""",
steps AS (SELECT doc_id, line, raw, CASE WHEN regexp_matches(raw, '\.\s*$') THEN -1 WHEN regexp_matches(raw, '^\s*([A-Z][a-z]+)\s+([a-z]+)') THEN 1 ELSE 0 END AS step FROM lines),
sums AS (SELECT *, sum(step) OVER (PARTITION BY doc_id ORDER BY line) AS s FROM steps),
depths AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY line)) AS depth FROM sums),
opened AS (SELECT doc_id, depth, line AS at, lower(regexp_extract(raw, '^\s*([A-Z][a-z]+)\s+([a-z]+)', 1))||':'||lower(regexp_extract(raw, '^\s*([A-Z][a-z]+)\s+([a-z]+)', 2)) AS unit FROM depths WHERE step = 1),
hits AS (
  SELECT doc_id, line, raw, depth, rule_id FROM depths, (VALUES ('number', '[0-9][0-9][0-9]'), ('address', '@[a-z]+'), ('caps', '[A-Z][A-Z][A-Z]')) r(rule_id, p)
  WHERE regexp_matches(raw, p) AND NOT regexp_matches(raw, '^\s*[*"]')),
placed AS (SELECT h.*, CASE WHEN h.depth > 0 THEN o.unit END AS unit FROM hits h ASOF LEFT JOIN opened o ON h.doc_id = o.doc_id AND h.depth = o.depth AND h.line >= o.at),
named AS (
  SELECT *, 'D'||doc_id AS object, trim(array_to_string(list_transform(regexp_extract_all(raw, '''[^'']*''?|`[^`]*`?|\|[^|]*\|?|\s+|[^''`|\s]+'),
    lambda p: CASE WHEN regexp_matches(p, '^\s') THEN ' ' WHEN p[1] IN ('''', '`', '|') THEN p ELSE upper(replace(p, 'ß', 'SS')) END), ''), ' ') AS snippet FROM placed)
"""


def _findings(s, sf):
    docs = D.read(s, sf, "documents").select(F.col("doc_id").cast("string").alias("file"), F.col("text").alias("source"))
    hits = J.matched_rules(D.lines(s, sf), FOUND)
    return hits.select("rule_id", F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("object"), F.col("doc_id").cast("string").alias("file"), "line"), docs


@query("W7_enclosing_units", _UNITS + "SELECT doc_id::VARCHAR AS file, line, rule_id, coalesce(unit, object) AS enclosing_unit FROM named")
def _(s, sf):
    return I.identified(*_findings(s, sf), OPEN, CLOSE).select("file", "line", "rule_id", "enclosing_unit")


@query("X8_finding_identity", _UNITS + "SELECT sha256(rule_id||'|'||object||'|'||coalesce(unit, object)||'|'||snippet) AS finding_id, count(*) AS findings, min(line) AS first_line FROM named GROUP BY 1")
def _(s, sf):
    return I.identified(*_findings(s, sf), OPEN, CLOSE).groupBy("finding_id").agg(F.count("*").alias("findings"), F.min("line").alias("first_line"))


_GATE = """WITH last AS (SELECT o_custkey AS run, o_orderkey % 5 AS f, max(o_orderkey) AS k FROM orders GROUP BY 1, 2),
docs AS (SELECT l.run, l.f, l.k, CASE o_orderstatus WHEN 'F' THEN 'BLOCK' WHEN 'P' THEN 'WARN' ELSE 'PASS' END AS word FROM last l JOIN orders ON o_orderkey = l.k),
runs AS (SELECT DISTINCT run FROM docs), files(f, name) AS (VALUES (0, 'sap'), (1, 'clean-core'), (2, 'security'), (3, 'diff-review')),
told AS (
  SELECT r.run, f.f, 1 AS n, CASE WHEN k IS NULL THEN name||'-verdict.json: missing or unreadable (fail-closed)'
    WHEN f.f = 0 AND k % 11 = 0 THEN 'sap-verdict.json: invalid shape — sap-verdict bad clean_core_level: B'
    WHEN f.f > 0 AND k % 13 = 0 THEN name||'-verdict.json: invalid shape — '||name||'-verdict missing required field: summary'
    WHEN f.f = 0 AND word = 'BLOCK' THEN 'sap-verdict: BLOCK (failure_layer=atc)'
    WHEN f.f > 0 AND word = 'BLOCK' THEN name||'-verdict.json: pass=false' END AS block
  FROM runs r CROSS JOIN files f LEFT JOIN docs d ON d.run = r.run AND d.f = f.f
  UNION ALL SELECT run, 0, 2, 'sap-verdict: 1 priority-1 ATC finding(s)' FROM docs WHERE f = 0 AND k % 11 <> 0 AND k % 2 = 0
  UNION ALL SELECT run, 0, 3, 'sap-verdict: '||(k % 3)||' priority-2 ATC finding(s)' FROM docs WHERE f = 0 AND k % 11 <> 0 AND k % 3 > 0
  UNION ALL SELECT run, 4, 1, 'design-critique: BLOCK (P1/P4 model breach)' FROM docs WHERE f = 4 AND word = 'BLOCK'),
warned AS (SELECT DISTINCT run FROM docs WHERE f = 4 AND word = 'WARN')
SELECT run, count(block) = 0 AS pass, coalesce(string_agg(block, '; ' ORDER BY f, n) FILTER (WHERE block IS NOT NULL), '') AS blocks,
  CASE WHEN run IN (SELECT run FROM warned) THEN 'design-critique: WARN — needs human acknowledgement' ELSE '' END AS warnings
FROM told GROUP BY run"""


@query("A34_verdict_gate", _GATE)
def _(s, sf):
    """Every order is a verdict document of its customer's run; the last one of a file counts."""
    k, f, word = F.col("k"), F.col("f"), F.col("word")
    orders = D.read(s, sf, "orders").withColumns({"f": F.col("o_orderkey") % 5, "word": F.when(F.col("o_orderstatus") == "F", "BLOCK").when(F.col("o_orderstatus") == "P", "WARN").otherwise("PASS")})
    last = orders.groupBy(F.col("o_custkey").alias("run"), "f").agg(F.max_by(F.struct("o_orderkey", "word"), "o_orderkey").alias("x")).select("run", "f", F.col("x.o_orderkey").alias("k"), "x.word")
    text = lambda *names: [F.lit("t").alias(n) for n in names]
    some = lambda n, name: F.array_repeat(F.struct(F.lit("Z").alias("object")), n.cast("int")).alias(name)
    json = lambda *fields: F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    flags = F.struct(*[F.lit(False).alias(x) for x in Y.SAP_FLAGS]).alias("invariant_diff")
    atc = F.struct(some(1 - k % 2, "priority1"), some(k % 3, "priority2")).alias("atc")
    sap = json(word.alias("verdict"), *text("timestamp", "connection", "objects", "activation", "abap_unit", "ratchet"), atc, F.when(k % 11 == 0, "B").otherwise("A").alias("clean_core_level"), flags, F.when(word == "BLOCK", "atc").alias("failure_layer"))
    kept = F.struct(*text(*Y.SECURITY_FIELDS), F.lit(True).alias("baseline_established")).alias("invariants")
    passing = [(word != "BLOCK").alias("pass"), F.when(k % 13 != 0, "s").alias("summary")]
    core, security, diff = (json(F.lit(gate).alias("gate"), *passing, *more) for gate, more in (("clean-core", text("atc", "grounding")), ("security", [kept]), ("abap-diff-review", text("range", "acceptance_criteria_source"))))
    scores = F.struct(*[F.lit(8).alias(x) for x in Y.DESIGN_SCORES]).alias("scores")
    design = json(word.alias("verdict"), scores, *text(*(x for x in Y.DESIGN_FIELDS if x not in ("verdict", "scores"))))
    pick = lambda values: F.element_at(F.array(*values), (f + 1).cast("int"))
    docs = last.select("run", pick(map(F.lit, [*Y.HARD, Y.SOFT])).alias("file"), pick([sap, core, security, diff, design]).alias("doc"))
    return Y.gated(docs).select("run", "pass", F.array_join("blocks", "; ").alias("blocks"), F.array_join("warnings", "; ").alias("warnings"))


_TYPES = """WITH RECURSIVE vars AS (SELECT p_partkey AS v, p_size % 5 = 0 OR p_partkey < 2 AS known, p_size % 3 AS m FROM part),
types(v, t) AS (SELECT v, v % 97 FROM vars WHERE known UNION SELECT d.v, t.t FROM types t JOIN vars d ON d.v // 2 = t.v AND NOT d.known AND d.v <> t.v),
climb(t, m, o) AS (SELECT y.t, v.m, y.t FROM types y JOIN vars v ON v.v = y.v UNION SELECT t, m, o // 2 FROM climb WHERE (o + m) % 7 <> 0 AND o > 0),
owners AS (SELECT t, m, o AS owner FROM climb WHERE (o + m) % 7 = 0)
SELECT v AS source, owner, m AS method FROM vars JOIN types USING (v) JOIN owners USING (t, m)"""


@query("G2_reference_types", _TYPES)
def _(s, sf):
    """Every part is a variable: some are declared, the others are assigned from the part of half the number; classes inherit alike."""
    part = D.read(s, sf, "part").select(F.col("p_partkey").alias("var"), ((F.col("p_size") % 5 == 0) | (F.col("p_partkey") < 2)).alias("known"), (F.col("p_size") % 3).cast("long").alias("method"))
    declared = part.where("known").select("var", (F.col("var") % 97).alias("type"))
    flows = part.where("not known").select(F.floor(F.col("var") / 2).alias("src"), F.col("var").alias("dst"))
    classes = declared.select("type").union(declared.select(F.explode(F.array(*[F.floor(F.col("type") / 2**i) for i in range(8)])))).distinct()
    methods = classes.select("type", F.explode(F.array(*[F.lit(m).cast("long") for m in range(3)])).alias("method")).where("(type + method) % 7 = 0")
    inherits = classes.where("type > 0").select("type", F.floor(F.col("type") / 2).alias("super"))
    return T.resolved(part.select(F.col("var").alias("source"), "var", "method"), declared, flows, inherits, methods)
