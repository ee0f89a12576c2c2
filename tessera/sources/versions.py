"""Parsed sources in versions: a run parses the texts that no earlier version has, and a stopped run leaves the version before.

Below the store: `parsed/added=<n>` holds the statements of the texts that were new in version n, by the text's digest; `manifest/version=<n>` the files
of version n, each with its digest and the version that parsed it; `CURRENT` the number of the version that counts.  It is replaced by one rename
after all tables are written, so readers see a whole version or the one before.  A number that a stopped run has used is written anew.
The store is any folder that Spark's file systems reach.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.bundle import statements

PARSED = "digest string, seq long, row long, kind string, text string"
MANIFEST = "filename string, object string, object_type string, digest string, added long"


@dataclass(frozen=True)
class Outcome:
    """What a run did: files of the version, texts parsed, files whose text an earlier version had, files that are gone."""

    version: int
    files: int
    parsed: int
    reused: int
    gone: int


def _hadoop(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, conf, where, where.getFileSystem(conf)


def current(spark: SparkSession, store: str) -> int:
    """The version that counts; 0 if there is none."""
    _, _, where, fs = _hadoop(spark, f"{store}/CURRENT")
    if not fs.exists(where):
        return 0
    with_ = fs.open(where)
    try:
        return int(bytes(with_.readAllBytes()).decode())
    finally:
        with_.close()


def _point(spark: SparkSession, store: str, version: int) -> None:
    jvm, conf, beside, fs = _hadoop(spark, f"{store}/.CURRENT-{version}")
    out = fs.create(beside, True)
    out.write(str(version).encode())
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(beside), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{store}/CURRENT")), options)


def manifest(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """filename, object, object_type, digest, added of a version, of the current one unless it is named."""
    n = current(spark, store) if version is None else version
    return spark.read.schema(MANIFEST).parquet(f"{store}/manifest/version={n}") if n else spark.createDataFrame([], MANIFEST)


def refresh(spark: SparkSession, files: DataFrame, store: str) -> Outcome:
    """Writes the next version of files (filename, source, object, object_type); equal texts are parsed once, whatever their files are called.

    One run at a time may write to a store.  A null source counts as an empty one; of several rows with one name all stay.
    """
    before = current(spark, store)
    n = before + 1
    old = manifest(spark, store, before)
    told = files.select("filename", F.coalesce("source", F.lit("")).alias("source"), "object", "object_type").withColumn("digest", F.sha2("source", 256))
    known = old.groupBy("digest").agg(F.min("added").alias("was"))
    fresh = told.select("digest", "source").join(known, "digest", "left_anti").groupBy("digest").agg(F.min("source").alias("source"))
    named = fresh.select(F.col("digest").alias("filename"), "source", F.lit("").alias("object"), F.lit("").alias("object_type"))
    statements(named).select(F.col("filename").alias("digest"), "seq", "row", "kind", "text").write.mode("overwrite").parquet(f"{store}/parsed/added={n}")
    rows = told.drop("source").join(known, "digest", "left").select("filename", "object", "object_type", "digest", F.coalesce("was", F.lit(n)).cast("long").alias("added"))
    rows.write.mode("overwrite").parquet(f"{store}/manifest/version={n}")
    now = manifest(spark, store, n)
    seen = now.agg(F.count("*").alias("files"), F.count_distinct(F.when(F.col("added") == n, F.col("digest"))).alias("parsed"), F.count_if(F.col("added") < n).alias("reused")).first()
    gone = old.select("filename").distinct().join(now.select("filename"), "filename", "left_anti").count()
    _point(spark, store, n)
    return Outcome(n, seen["files"], seen["parsed"], seen["reused"], gone)


def parsed(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """filename, object, object_type, seq, row, kind, text of a version; folders of versions that it has no texts of aren't read."""
    files = manifest(spark, store, version)
    versions = [r["added"] for r in files.select("added").distinct().collect()]
    if not versions:
        return spark.createDataFrame([], "filename string, object string, object_type string, seq long, row long, kind string, text string")
    texts = spark.read.schema(PARSED + ", added long").option("basePath", f"{store}/parsed").parquet(*[f"{store}/parsed/added={v}" for v in versions])
    return files.join(texts, ["digest", "added"]).select("filename", "object", "object_type", "seq", "row", "kind", "text")


def compact(spark: SparkSession, store: str) -> int:
    """Writes the current version as one that has all its texts in a folder of its own; needed when few of the texts of old folders are still used."""
    n = current(spark, store) + 1
    files = manifest(spark, store, n - 1)
    used = files.select("digest", "added").distinct()
    versions = [r["added"] for r in used.select("added").distinct().collect()]
    if not versions:
        return n - 1
    texts = spark.read.schema(PARSED + ", added long").option("basePath", f"{store}/parsed").parquet(*[f"{store}/parsed/added={v}" for v in versions])
    texts.join(used, ["digest", "added"], "left_semi").drop("added").write.mode("overwrite").parquet(f"{store}/parsed/added={n}")
    files.withColumn("added", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{store}/manifest/version={n}")
    _point(spark, store, n)
    return n
