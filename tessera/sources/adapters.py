"""Canonical tables of a code estate (nodes, edges, registry, findings, statements, lines) out of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.cuts import dealt

#: Ranks of release levels, and the level of each registry state.
RANK = {"D": 0, "C": 1, "B": 2, "A": 3}
LEVEL = {"released": "A", "classicAPI": "B", "deprecated": "C", "notToBeReleased": "D", "noAPI": "D"}
STATES = ["released", "classicAPI", "deprecated", "notToBeReleased", "noAPI"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, key: str) -> F.Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """id, kind, object, namespace."""
    parts = [("region", "R", "r_regionkey", "cds", "sap"), ("nation", "N", "n_nationkey", "interface", "registered"), ("supplier", "S", "s_suppkey", "class", "Y"), ("customer", "C", "c_custkey", "report", "Z"), ("part", "P", "p_partkey", "table", "sap")]
    out = None
    for name, prefix, key, kind, space in parts:
        df = read(spark, sf, name).select(_id(prefix, key).alias("id"), F.lit(kind).alias("kind"), _id(prefix, key).alias("object"), F.lit(space).alias("namespace"))
        out = df if out is None else out.unionByName(df)
    return out


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """source, target, kind, access: an acyclic graph."""
    c, s, n, li = (read(spark, sf, t) for t in ("customer", "supplier", "nation", "lineitem"))
    none = F.lit(None).cast("string")
    pairs = dealt(li.select("l_suppkey", "l_partkey", F.when(F.col("l_returnflag") == "R", "write").otherwise("read").alias("access")), "l_suppkey", "l_partkey").distinct()
    uses = pairs.select(_id("S", "l_suppkey").alias("source"), _id("P", "l_partkey").alias("target"), F.lit("uses-table").alias("kind"), "access")
    return (
        c.select(_id("C", "c_custkey").alias("source"), _id("N", "c_nationkey").alias("target"), F.lit("calls").alias("kind"), none.alias("access"))
        .unionByName(s.select(_id("S", "s_suppkey").alias("source"), _id("N", "s_nationkey").alias("target"), F.lit("inherits").alias("kind"), none.alias("access")))
        .unionByName(n.select(_id("N", "n_nationkey").alias("source"), _id("R", "n_regionkey").alias("target"), F.lit("consumes-cds").alias("kind"), none.alias("access")))
        .unionByName(uses)
    )


def edges_at_most(spark: SparkSession, sf: str) -> int:
    """A bound of the number of edges, out of the files' own row counts."""
    return sum(read(spark, sf, t).count() for t in ("customer", "supplier", "nation", "lineitem"))


def cyclic_edges(spark: SparkSession, sf: str) -> DataFrame:
    """a, b: a tree over all parts, with local rings."""
    p = read(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("a"))
    tree = p.where("a >= 1").select("a", F.floor(F.col("a") / 2).cast("long").alias("b"))
    ring = p.where("a % 50 < 10").select("a", (10 * F.floor(F.col("a") / 10) + (F.col("a") + 1) % 10).cast("long").alias("b"))
    return tree.union(ring)


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """name, state, level, authoritative, successor."""
    p = read(spark, sf, "part").where("p_partkey % 7 <> 0")
    state = F.element_at(F.array(*map(F.lit, STATES)), (F.col("p_size") % 5 + 1).cast("int"))
    level = F.element_at(F.create_map(*[F.lit(x) for kv in LEVEL.items() for x in kv]), F.col("state"))
    return p.select(_id("P", "p_partkey").alias("name"), state.alias("state"), (F.col("p_partkey") % 3 == 0).alias("authoritative"), F.concat(F.lit("P"), (F.col("p_partkey") + 1).cast("string")).alias("successor")).withColumn("level", level)


def findings(spark: SparkSession, sf: str) -> DataFrame:
    """rule_id, severity, family, object, file, line, message."""
    li = read(spark, sf, "lineitem")
    ln = F.col("l_linenumber")
    family = F.when(F.col("l_quantity") <= 10, "released-api").when(F.col("l_quantity") <= 20, "deprecation").when(F.col("l_quantity") <= 30, "performance").when(F.col("l_quantity") <= 40, "modification").otherwise("abaplint")
    return li.select(
        F.concat("l_returnflag", "l_linestatus").alias("rule_id"), F.when(ln == 1, "p1").when(ln == 2, "p2").when(ln == 3, "p3").otherwise("info").alias("severity"), family.alias("family"),
        _id("S", "l_suppkey").alias("object"), _id("F", "l_orderkey").alias("file"), ln.cast("int").alias("line"), F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("message"),
    )


def statements(spark: SparkSession, sf: str) -> DataFrame:
    """file, seq (by time), kind, value."""
    kinds = {"signup": "Loop", "purchase": "EndLoop", "view": "Select", "error": "AuthorityCheck"}
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type")), F.lit("Other"))
    return read(spark, sf, "events").select(F.col("user_id").alias("file"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"), "value")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, line, raw: every line of every document."""
    d = read(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "raw")).select("doc_id", (F.col("p") + 1).cast("long").alias("line"), "raw")


#: The same tables as common table expressions of the SQL oracles.
SQL = {
    "nodes": """nodes AS (SELECT 'R'||r_regionkey AS id,'cds' AS kind,'R'||r_regionkey AS object,'sap' AS namespace FROM region
 UNION ALL SELECT 'N'||n_nationkey,'interface','N'||n_nationkey,'registered' FROM nation UNION ALL SELECT 'S'||s_suppkey,'class','S'||s_suppkey,'Y' FROM supplier
 UNION ALL SELECT 'C'||c_custkey,'report','C'||c_custkey,'Z' FROM customer UNION ALL SELECT 'P'||p_partkey,'table','P'||p_partkey,'sap' FROM part)""",
    "edges": """edges AS (SELECT 'C'||c_custkey AS source,'N'||c_nationkey AS target,'calls' AS kind,NULL::VARCHAR AS access FROM customer
 UNION ALL SELECT 'S'||s_suppkey,'N'||s_nationkey,'inherits',NULL FROM supplier UNION ALL SELECT 'N'||n_nationkey,'R'||n_regionkey,'consumes-cds',NULL FROM nation
 UNION ALL SELECT DISTINCT 'S'||l_suppkey,'P'||l_partkey,'uses-table',CASE WHEN l_returnflag='R' THEN 'write' ELSE 'read' END FROM lineitem)""",
    "cyc": """p AS (SELECT p_partkey::BIGINT AS a FROM part), cyc AS (SELECT a, a//2 AS b FROM p WHERE a>=1 UNION ALL SELECT a, 10*(a//10)+(a+1)%10 FROM p WHERE a%50<10)""",
    "registry": """registry0 AS (SELECT p_partkey, 'P'||p_partkey AS name, ['released','classicAPI','deprecated','notToBeReleased','noAPI'][p_size%5+1] AS state, p_partkey%3=0 AS authoritative, 'P'||(p_partkey+1) AS successor FROM part WHERE p_partkey%7<>0),
 registry AS (SELECT name,state,authoritative,successor,CASE state WHEN 'released' THEN 'A' WHEN 'classicAPI' THEN 'B' WHEN 'deprecated' THEN 'C' ELSE 'D' END AS level FROM registry0)""",
    "findings": """findings AS (SELECT l_returnflag||l_linestatus AS rule_id, CASE l_linenumber WHEN 1 THEN 'p1' WHEN 2 THEN 'p2' WHEN 3 THEN 'p3' ELSE 'info' END AS severity,
 CASE WHEN l_quantity<=10 THEN 'released-api' WHEN l_quantity<=20 THEN 'deprecation' WHEN l_quantity<=30 THEN 'performance' WHEN l_quantity<=40 THEN 'modification' ELSE 'abaplint' END AS family,
 'S'||l_suppkey AS object,'F'||l_orderkey AS file,l_linenumber::INT AS line,'m'||l_partkey AS message FROM lineitem)""",
    "statements": """statements AS (SELECT user_id AS file, ts, event_id AS seq, CASE event_type WHEN 'signup' THEN 'Loop' WHEN 'purchase' THEN 'EndLoop' WHEN 'view' THEN 'Select' WHEN 'error' THEN 'AuthorityCheck' ELSE 'Other' END AS kind, value FROM events)""",
    "lines": """lines AS (SELECT doc_id, i AS line, parts[i] AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10)))+1)) AS i FROM documents))""",
}


def with_(*names: str, recursive: bool = False) -> str:
    return "WITH " + "RECURSIVE " * recursive + ", ".join(SQL[n] for n in names) + " "
