"""Rows of reports, registries and logs brought to canonical form, and what is written from findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def canonical(files: DataFrame) -> DataFrame:
    """Files with LF line ends; their order is a matter of whoever writes them."""
    return files.withColumn("source", F.regexp_replace("source", r"\r\n?", "\n"))


def priority(value: Column) -> Column:
    """1, 2 or 3, as number or text, becomes priority-n; all else is info."""
    text = F.trim(value.cast("string"))
    return F.when(text.isin("1", "2", "3"), F.concat(F.lit("priority-"), text)).otherwise("info")


def check_rows(rows: DataFrame) -> DataFrame:
    """Priority, check, object, message of check results; what a row lacks has a default."""
    given = lambda c, d: F.coalesce(F.col(c), F.lit(d)).alias(c) if c in rows.columns else F.lit(d).alias(c)
    return rows.select(priority(F.col("priority")).alias("priority"), given("check", "atc"), given("object", "unknown"), given("message", ""))


def object_sources(files: DataFrame) -> DataFrame:
    """Object (first part of the file name, upper case), digest of its sources in order of their names, one line end between two.

    An object has few files, each within the byte cap: a group is bounded by them, whatever the estate's size.
    """
    rows = F.array_sort(F.collect_list(F.struct("filename", "source")))
    return files.groupBy(F.upper(F.substring_index("filename", ".", 1)).alias("object")).agg(F.sha2(F.array_join(rows["source"], "\n"), 256).alias("digest"))


def registry_index(entries: DataFrame, order: str) -> DataFrame:
    """One row of each name (upper case) and source of its state, the first in order; a null state fails open: it is no entry."""
    rest = [c for c in entries.columns if c not in ("name", "authoritative")]
    rows = entries.where("state is not null").withColumn("name", F.upper("name"))
    return rows.groupBy("name", "authoritative").agg(F.min_by(F.struct(*rest), order).alias("e")).select("name", "authoritative", "e.*")


def provenance(contents: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Name, matches_sidecar: whether a content has the noted digest; null without a note."""
    noted = sidecar.select("name", F.lower("sha256").alias("noted"))
    return contents.select("name", F.sha2("content", 256).alias("sha")).join(noted, "name", "left").select("name", (F.col("sha") == F.col("noted")).alias("matches_sidecar"))


def always_off(objects: DataFrame, functions: DataFrame) -> DataFrame:
    """Object, bf of the objects whose business function is always off."""
    return objects.join(functions.where("state = 'always-off'").select("bf"), "bf", "left_semi")


def usage_rows(rows: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(object_type, object_name, exec_count, last_used of the good rows, the rows that are refused with a reason).

    Counts are whole numbers without sign, dates yyyyMMdd or none; of a repeated object the first row in order stays.
    """
    day = F.try_to_timestamp("last_used", F.lit("yyyyMMdd"))
    why = F.when(~F.coalesce(F.col("exec_count").rlike(r"^[0-9]+\z"), F.lit(False)), "count").when(F.col("last_used").isNotNull() & day.isNull(), "date")
    keys = ["object_type", "object_name"]
    checked = rows.withColumn("why", why).withColumn("again", F.when(F.col("why").isNull(), F.row_number().over(W.partitionBy(*keys, F.col("why").isNull()).orderBy(order)) > 1))
    good = checked.where("why is null and not again").select(*keys, F.col("exec_count").cast("long").alias("exec_count"), F.date_format(day, "yyyy-MM-dd").alias("last_used"))
    return good, checked.where("why is not null or again").withColumn("why", F.coalesce("why", F.lit("repeated"))).drop("again")


def dataset(usage: DataFrame, changes: DataFrame) -> DataFrame:
    """Usage and changes of each object; either half may be missing."""
    return usage.join(changes, "object", "full")


#: Levels and security severities of grades in the exchange format.
LEVELS = {"blocker": ("error", "9.0"), "warning": ("warning", "6.0"), "advisory": ("note", "3.0")}


def sarif_rules(findings: DataFrame) -> DataFrame:
    """K3: rule_id, message of its first finding (by file, line, message), number of results."""
    place = F.concat("file", F.lpad(F.col("line").cast("string"), 9, "0"), "message")
    return findings.groupBy("rule_id").agg(F.min_by("message", place).alias("first_message"), F.count("*").alias("results"))


def sarif_results(findings: DataFrame, grade: Column) -> DataFrame:
    """K3: one result document a finding, as JSON."""
    pick = lambda i: F.coalesce(*[F.when(grade == g, F.lit(v[i])) for g, v in LEVELS.items()], F.lit(LEVELS["advisory"][i]))
    where = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.lit(1), F.col("line")).alias("startLine")).alias("region")).alias("physicalLocation"))
    doc = F.struct(F.col("rule_id").alias("ruleId"), pick(0).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(where).alias("locations"), F.struct(pick(1).alias("security-severity")).alias("properties"))
    return findings.select("rule_id", F.to_json(doc).alias("result"))


def source_lines(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings (file, line) with the raw line they point at; empty if there is none."""
    return findings.join(lines.select("file", "line", "raw"), ["file", "line"], "left").withColumn("raw", F.coalesce("raw", F.lit("")))


def file_owners(findings: DataFrame, index: DataFrame) -> DataFrame:
    """Findings with the owner of their file: the index's object, else the file's base name up to the first dot, upper case."""
    base = F.upper(F.substring_index(F.substring_index("file", "/", -1), ".", 1))
    return findings.join(index.select("file", F.col("object").alias("known")), "file", "left").withColumn("owner", F.coalesce("known", base)).drop("known")


def coverage_note(**counts: Column) -> Column:
    """What was left out, as one note."""
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{name}: "), n.cast("string")) for name, n in counts.items()])


def digest_objects(objects: DataFrame) -> DataFrame:
    """the four keys of an object in a digest."""
    return objects.select("object", "kind", "grade", "rank")


def digest_findings(findings: DataFrame) -> DataFrame:
    """the five keys of a finding in a digest."""
    return findings.select("object", "rule_id", "severity", "family", "message")
