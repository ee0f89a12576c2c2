"""Queries of runs: the reducer over events of orders, versions of parsed sources, statements by the table function."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.cuts import folder
from tessera.queries import query
from tessera.queries_gate import ORACLES, QUERIES
from tessera.sources import adapters as D
from tessera.sources import formats, versions
from tessera.streaming import reducer

__all__ = ["ORACLES", "QUERIES"]

_WALK = ("GENERATED", "SYNTAX_OK", "PUSHED", "ACTIVATED", "GATED")
#: What happens to the orders of each kind (key modulo 7): a verb with its status, a word or the verdict.
_DONE = [("verdict", "true"), ("outcome", "GREEN")]
_STORIES = {
    0: [("progress", "GENERATED"), ("progress", "SYNTAX_OK"), ("acquire", "")],
    1: [("progress", "GENERATED"), ("acquire", ""), ("outcome", "BLOCK")],
    2: [*[("progress", s) for s in _WALK], ("verdict", "false"), *[("progress", s) for s in _WALK], ("acquire", ""), *_DONE],
    3: [("acquire", ""), ("outcome", "RETIRED")],
    4: [*[("progress", s) for s in _WALK], ("acquire", ""), ("outcome", "GREEN")],
    5: [*[("progress", s) for s in _WALK], ("acquire", ""), *_DONE],
    6: [("acquire", ""), *[("progress", s) for s in _WALK], *_DONE],
}


def run_events(spark, sf):
    """A customer's orders are the nodes of a run; the order of rank r waits for that of rank r // 2, and shares a lock with those of equal key modulo 3."""
    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = D.read(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("run"), F.col("o_orderkey").cast("string").alias("node"), (F.col("o_orderkey") % 7).cast("int").alias("kind"), (F.col("o_orderkey") % 3).cast("string").alias("lock"), rank.cast("long").alias("rank"))
    o = o.withColumns({"plan_hash": F.lit("p"), "disposition": F.when(F.col("kind") == 3, "retire").otherwise("refactor")})
    up = o.select("run", (F.col("rank") * 1).alias("up"), F.col("node").alias("source"))
    links = o.where("rank > 1").withColumn("up", F.floor(F.col("rank") / 2)).join(up, ["run", "up"]).select("run", "source", F.col("node").alias("target"))
    told = F.create_map(*[x for k, story in _STORIES.items() for x in (F.lit(k), F.array(*[F.struct(F.lit(v).alias("verb"), F.lit(w).alias("word")) for v, w in [("dispatch", ""), *story]]))])
    e = o.select("*", F.posexplode(told[F.col("kind")]).alias("i", "e")).withColumns({"at": F.col("rank") * 100 + F.col("i"), "verb": F.col("e.verb"), "status": F.col("e.word"), "passed": F.col("e.word") == "true", "signed_by": F.lit("someone"), "justification": F.lit("known")})
    return reducer.planned(o, links).unionByName(reducer.shaped(e))


_RUN = """WITH RECURSIVE o AS (SELECT o_custkey AS run, o_orderkey AS node, o_orderkey % 7 AS kind, o_orderkey % 3 AS lock, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
ready(run, node, kind, r) AS (SELECT run, node, kind, r FROM o WHERE r = 1 UNION ALL SELECT o.run, o.node, o.kind, o.r FROM ready p JOIN o ON o.run = p.run AND o.r // 2 = p.r AND o.r > 1 WHERE p.kind IN (2, 3, 5, 6)),
told AS (SELECT o.*, y.node IS NOT NULL AS up FROM o LEFT JOIN ready y USING (run, node)),
held AS (SELECT *, coalesce(bool_or(kind IN (0, 4) OR (NOT up AND kind <> 1)) OVER (PARTITION BY run, lock ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS taken FROM told)
SELECT run::VARCHAR AS run, node::VARCHAR AS node, CASE WHEN kind = 1 THEN 'BLOCK' WHEN NOT up THEN 'PENDING' WHEN kind = 0 THEN 'SYNTAX_OK' WHEN kind = 3 THEN 'RETIRED' WHEN kind = 4 THEN 'GATED' ELSE 'GREEN' END AS status,
  CASE WHEN up AND kind = 2 THEN 1 ELSE 0 END AS cycle, NOT taken AS acquired,
  CASE WHEN up THEN (kind = 4)::INT ELSE [3, 2, 14, 2, 7, 8, 8][kind + 1] END AS refused FROM held"""


@query("D12_run_reducer", _RUN)
def _(s, sf):
    """Where each node of a run ends, whether it got its lock, and how many of its other events were refused."""
    a = reducer.folded(run_events(s, sf))
    last = F.max_by(F.struct("status", "cycle"), "at")
    g = a.groupBy("run", "node").agg(last.alias("x"), F.bool_or((F.col("verb") == "acquire") & (F.col("answer") == "ok")).alias("acquired"), F.count_if((F.col("verb") != "acquire") & (F.col("answer") != "ok")).alias("refused"))
    return g.select("run", "node", "x.status", "x.cycle", "acquired", "refused")


_VERSIONS = """WITH v AS (SELECT doc_id, sha256(text) AS a, sha256(CASE WHEN doc_id % 9 = 0 THEN text||' More.' ELSE text END) AS b FROM documents),
n AS (SELECT * FROM v WHERE doc_id % 10 > 0)
SELECT 1 AS version, count(*) AS files, count(DISTINCT a) AS parsed, 0 AS reused, 0 AS gone FROM v
UNION ALL SELECT 2, count(*), count(DISTINCT CASE WHEN b NOT IN (SELECT a FROM v) THEN b END), count(*) FILTER (b IN (SELECT a FROM v)), (SELECT count(*) FROM v WHERE doc_id % 10 = 0) FROM n"""


@query("D3_versions", _VERSIONS)
def _(s, sf):
    """All documents, then those that are left (nine of ten), some of them changed: what a second run parses."""
    name = F.col("doc_id").cast("string").alias("filename")
    first = D.read(s, sf, "documents").select("doc_id", name, F.col("text").alias("source"), name.alias("object"), F.lit("PROG").alias("object_type"))
    second = first.where("doc_id % 10 > 0").withColumn("source", F.when(F.col("doc_id") % 9 == 0, F.concat("source", F.lit(" More."))).otherwise(F.col("source")))
    store = f"{folder(s)}/versions-{uuid.uuid4().hex}"
    done = [versions.refresh(s, df, store) for df in (first, second)]
    return s.createDataFrame([(o.version, o.files, o.parsed, o.reused, o.gone) for o in done], "version int, files long, parsed long, reused long, gone long")


_SENTENCES = r"""WITH t AS (SELECT doc_id, regexp_replace(text, '["''`|:,*]', ' ', 'g') AS x FROM documents),
p AS (SELECT doc_id, unnest(string_split(regexp_replace(x, '\.(\s|$)', chr(1)||'\1', 'g'), chr(1))) AS s FROM t)
SELECT doc_id, count(*) AS statements, sum(length(s)) AS chars FROM (SELECT doc_id, trim(regexp_replace(s, '[\s\x{1c}-\x{1f}\x{85}\x{a0}]+', ' ', 'g')) AS s FROM p) WHERE s <> '' GROUP BY 1"""


@query("X37_statements_of", _SENTENCES)
def _(s, sf):
    """Statements of whole documents without quotes, colons and commas, by the table function in SQL."""
    formats.register(s)
    view = f"documents_{uuid.uuid4().hex}"
    D.read(s, sf, "documents").select("doc_id", F.regexp_replace("text", "[\"'`|:,*]", " ").alias("x")).createOrReplaceTempView(view)
    return s.sql(f"SELECT d.doc_id, count(*) AS statements, sum(length(s.text)) AS chars FROM {view} d, LATERAL statements_of(d.x) s GROUP BY d.doc_id")
