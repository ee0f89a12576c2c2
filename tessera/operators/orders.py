"""Orders and top rows: every order is total, so reruns agree; limits are the feature of these operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.cuts import dealt


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def finding_key(*last: str) -> Column:
    """File, line as nine digits, rule, object and what follows, as one text."""
    return F.concat_ws("|", _text("file"), F.lpad(_text("line"), 9, "0"), _text("rule_id"), _text("object"), *map(_text, last))


def finding_order(findings: DataFrame, limit: int, *last: str) -> DataFrame:
    """K, n: the keys of the first findings and their places."""
    top = findings.select(finding_key(*last).alias("k")).orderBy("k").limit(limit)
    return top.withColumn("n", F.row_number().over(W.orderBy("k")).cast("long"))


def json_order(rows: DataFrame, key: str, *cols: str) -> DataFrame:
    """Key, digest of a group's rows as JSON texts in order of the texts.  A group's texts meet in one row: groups are objects' nodes or edges."""
    return rows.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct(*cols)))), ","), 256).alias("digest"))


def digest_objects(nodes: DataFrame, limit: int = 500) -> DataFrame:
    """Customer objects first, then by rank (n), name."""
    return nodes.orderBy(~F.col("namespace").isin("Z", "Y"), F.col("n").desc(), "id").limit(limit)


def digest_findings(findings: DataFrame, limit: int = 200) -> DataFrame:
    """T4: by severity, info last, then by what tells findings apart."""
    return findings.orderBy(F.col("severity") == "info", "severity", "rule_id", "object", "file", "line", "message").limit(limit)


def by_count(rows: DataFrame, count: str, name: str, limit: int) -> DataFrame:
    """The largest counts, names in order among equals."""
    return rows.orderBy(F.col(count).desc(), name).limit(limit)


def debt_order(rows: DataFrame, key: str, score: str, symbol: str) -> DataFrame:
    """Key, symbols of a group by falling score."""
    each = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(symbol).alias("x"))))
    return rows.groupBy(key).agg(F.array_join(each["x"].cast("array<string>"), ",").alias("symbols"))


#: Kinds in the order in which they are transported.
TRANSPORT = {"cds": 1, "interface": 2, "class": 3, "behavior": 4}


def transport_order(nodes: DataFrame) -> DataFrame:
    """Id, n: places by kind, then id; counted kind by kind, so no single task orders all nodes."""
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(r)) for k, r in TRANSPORT.items()], F.lit(99))
    rows = nodes.withColumn("k", rank)
    before = rows.groupBy("k").agg(F.count("*").alias("c")).withColumn("off", F.coalesce(F.sum("c").over(W.orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("c")
    return rows.join(F.broadcast(before), "k").select("id", (F.col("off") + F.row_number().over(W.partitionBy("k").orderBy("id"))).cast("long").alias("n"))


def worst_first(rows: DataFrame, level: str, limit: int | None = None) -> DataFrame:
    """Rows with their place n in their level: weakest rank, most complex, largest blast, id."""
    w = W.partitionBy(level).orderBy("rank", F.col("complexity").desc(), F.col("blast").desc(), "id")
    out = rows.withColumn("n", F.row_number().over(w).cast("long"))
    return out if limit is None else out.where(F.col("n") <= limit)


def best_shapes(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """Key, id, place of the shapes with the best score, ids in order among equals."""
    place = F.row_number().over(W.partitionBy(key).orderBy(F.col("score").desc(), "id"))
    return rows.select(key, "id", place.alias("place")).where(F.col("place") <= limit)


def hubs(links: DataFrame, total: int | None = None) -> DataFrame:
    """Id, hub: the neighbour with the most links, if more than one; the first by name among equals.

    total: a bound of the number of links, which is counted otherwise.
    """
    n = dealt(links.select("source", "target"), "source", "target", total=total).groupBy("source", "target").agg(F.count("*").alias("n")).where("n > 1")
    return n.groupBy(F.col("source").alias("id")).agg(F.min(F.struct((-F.col("n")).alias("m"), "target"))["target"].alias("hub"))


def sweep_order(nodes: DataFrame, statuses: Sequence[str], limit: int | None = None) -> DataFrame:
    """Nodes that wait and aren't swept, by wave and id."""
    out = nodes.where(F.col("status").isin(*statuses) & ~F.col("swept")).orderBy("wave", "id")
    return out if limit is None else out.limit(limit)
