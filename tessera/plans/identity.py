"""What a finding is known by from run to run: rule, object, enclosing unit and the statement's text, not its line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.scalars import identity

#: How a unit starts (its kind and name) and ends.
UNIT, END = r"(?i)^\s*(METHOD|FORM|FUNCTION|MODULE)\s+([A-Za-z0-9_~<>/]+)", r"(?i)^\s*END(METHOD|FORM|FUNCTION|MODULE)\b"
_PARTS = r"'[^']*'?|`[^`]*`?|\|[^|]*\|?|\s+|[^'`|\s]+"


def snippet(line: Column) -> Column:
    """Upper case and single spaces outside literals; an open literal runs to the end."""
    part = lambda p: F.when(p.rlike(r"^\s"), F.lit(" ")).when(p.rlike("^['`|]"), p).otherwise(F.upper(p))
    return F.trim(F.array_join(F.transform(F.regexp_extract_all(F.coalesce(line, F.lit("")), F.lit(_PARTS), F.lit(0)), part), ""))


def placed(findings: DataFrame, files: DataFrame, unit: str = UNIT, end: str = END) -> DataFrame:
    """file, line, enclosing_unit, snippet of the distinct places of findings(file, line) in files(file, source).

    Lines that open or close a unit and lines with findings are one sequence a file.  The unit that a line is in is the last one that was opened to the
    depth that the line has: sums and last values over the sequence, no pairs of findings and units.  A line that
    closes a unit is outside, one that opens it is inside; closers without an opener don't count.
    """
    wanted = findings.where("file is not null and line is not null").select("file", F.col("line").cast("long").alias("line")).distinct().withColumn("wanted", F.lit(True))
    lines = files.select("file", F.posexplode(F.split(F.regexp_replace(F.coalesce("source", F.lit("")), r"\r\n?", "\n"), "\n")).alias("p", "raw")).select("file", (F.col("p") + 1).cast("long").alias("line"), "raw")
    step = F.when(F.col("raw").rlike(end), -1).when(F.col("raw").rlike(unit), 1).otherwise(0)
    rows = lines.withColumn("step", step).join(wanted, ["file", "line"], "left").where("step <> 0 or wanted")
    name = F.lower(F.concat(F.regexp_extract("raw", unit, 1), F.lit(":"), F.regexp_extract("raw", unit, 2)))
    so_far = W.partitionBy("file").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("sum", F.sum("step").over(so_far)).withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(so_far)))
    same = W.partitionBy("file", "depth").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    opened = F.last(F.when(F.col("step") == 1, name), ignorenulls=True).over(same)
    return rows.withColumn("unit", F.when(F.col("depth") > 0, opened)).where("wanted").select("file", "line", F.col("unit").alias("enclosing_unit"), snippet(F.col("raw")).alias("snippet"))


def identified(findings: DataFrame, files: DataFrame, unit: str = UNIT, end: str = END) -> DataFrame:
    """findings(rule_id, object, file, line, ...) with enclosing_unit, snippet and finding_id.

    A finding without a line, or of an unknown file, is in the unit of its object and has an empty snippet.
    Findings of one rule in equal statements of one unit have one id.
    """
    places = placed(findings, files, unit, end)
    known = findings.drop("enclosing_unit", "snippet", "finding_id").withColumn("_line", F.col("line").cast("long")).join(places.withColumnRenamed("line", "_line"), ["file", "_line"], "left").drop("_line")
    named = known.withColumns({"enclosing_unit": F.coalesce("enclosing_unit", "object", F.lit("")), "snippet": F.coalesce("snippet", F.lit(""))})
    return named.withColumn("finding_id", identity(F.col("rule_id"), F.col("object"), F.col("enclosing_unit"), F.col("snippet")))
