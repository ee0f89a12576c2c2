"""Ends of lineages."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; a temporary one serves a single process only."""
    sc = spark.sparkContext
    if not (sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()):
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")


def cut(df: DataFrame, laid: bool = False) -> DataFrame:
    """End the lineage in that folder; laid: the rows' partitioning stays known, which is for tables that no round makes anew.

    A checkpoint keeps the size that Spark guessed from the plan before it, and a join's size is the product of two: over rounds the number
    gets twice as long each time, until planning takes the driver's time and memory; a guess too small sends the rows through the driver by broadcast.
    So the rows become a table of unknown size, which Spark measures when it runs.
    """
    spark = df.sparkSession
    folder(spark)
    kept = df.checkpoint()
    return kept if laid else DataFrame(spark._jsparkSession.createDataFrame(kept._jdf.toDF().toJavaRDD(), kept._jdf.schema()), spark)


def met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by a shuffle, whatever the size: tables that rounds make anew would go through the driver by broadcast each time, as long as they are packed small."""
    return left.join(right.hint("merge"), on, how)


#: Rows of a task of dealt().
SHARE = 500_000


def dealt(rows: DataFrame, *keys: str, total: int | None = None) -> DataFrame:
    """rows by keys, about SHARE to a task; total: their number or a bound of it, which is counted otherwise.

    Left alone, Spark merges parts by their packed bytes until a task holds millions of unpacked rows.
    """
    total = rows.count() if total is None else total
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // SHARE)), *keys)
