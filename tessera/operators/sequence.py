"""Operators over ordered statements; a file's statements are one window partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ORDER = ("ts", "seq")


def _w(start: int | None = None, end: int | None = None) -> W:
    w = W.partitionBy("file").orderBy(*ORDER)
    return w if end is None else w.rowsBetween(W.unboundedPreceding if start is None else start, end)


def depth_before(stmts: DataFrame) -> DataFrame:
    """Nesting depth before each statement; closes never take it below zero."""
    step = F.when(F.col("kind") == "Loop", 1).when(F.col("kind") == "EndLoop", -1).otherwise(0)
    d = stmts.withColumn("d", F.sum(step).over(_w(None, 0)))
    floor = F.least(F.lit(0), F.min("d").over(_w(None, 0)))
    return d.withColumn("after", F.col("d") - floor).withColumn("depth", F.coalesce(F.lag("after").over(_w()), F.lit(0)).cast("long")).drop("d", "after")


def checked_soon(stmts: DataFrame, of: str, by: str, ahead: int) -> DataFrame:
    """Statements of a kind, and whether another kind follows within a few."""
    hit = F.max((F.col("kind") == by).cast("int")).over(_w(1, ahead))
    return stmts.withColumn("hit", F.coalesce(hit, F.lit(0))).where(F.col("kind") == of).select("file", "seq", (F.col("hit") == 1).alias("checked"))


def three_way(stmts: DataFrame, of: str, hit: str, write: str, end: str, ahead: int) -> DataFrame:
    """Ok, after-write or missing: the first of a hit, a write and an end within a few statements."""
    n = stmts.withColumn("n", F.row_number().over(_w()))
    first = lambda k: F.min(F.when(F.col("kind") == k, F.col("n"))).over(_w(1, ahead))
    far = F.lit(1 << 30)
    x = n.withColumns({"h": F.coalesce(first(hit), far), "w": F.coalesce(first(write), far), "e": F.coalesce(first(end), far)})
    verdict = F.when((F.col("h") >= far) | (F.col("h") > F.col("e")), "missing").when(F.col("w") < F.col("h"), "after-write").otherwise("ok")
    return x.where(F.col("kind") == of).select("file", "seq", verdict.alias("verdict"))


def guarded(stmts: DataFrame, of: str, guard: str, back: int) -> DataFrame:
    """Statements of a kind, and the value of the latest guard within the few before (null: none)."""
    last = F.last(F.when(F.col("kind") == guard, F.col("value")), ignorenulls=True).over(_w(-back, -1))
    return stmts.withColumn("guard", last).where(F.col("kind") == of).select("file", "seq", "guard")


def scope(stmts: DataFrame, opener: str, closer: str) -> DataFrame:
    """The statement that opened the scope a statement is in; a closer ends it."""
    mark = F.when(F.col("kind") == opener, F.col("seq")).when(F.col("kind") == closer, F.lit(-1))
    return stmts.withColumn("m", F.last(mark, ignorenulls=True).over(_w(None, 0))).select("file", "seq", F.when(F.col("m") >= 0, F.col("m")).alias("scope"))


def first_in_session(stmts: DataFrame, opener: str, of: str) -> DataFrame:
    """The first statement of a kind after each opener."""
    s = stmts.withColumn("session", F.sum((F.col("kind") == opener).cast("int")).over(_w(None, 0))).where((F.col("session") > 0) & (F.col("kind") == of))
    rank = F.row_number().over(W.partitionBy("file", "session").orderBy(*ORDER))
    return s.withColumn("r", rank).where("r = 1").select("file", F.col("session").cast("long").alias("session"), "seq")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of a key by its order."""
    return rows.groupBy(key).agg(F.max(F.struct(*order)).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in order])


def flips(stmts: DataFrame, good: str, last: int = 5) -> DataFrame:
    """Changes of the verdict among the last few statements of a file, and whether it oscillates."""
    back = W.partitionBy("file").orderBy(*[F.col(c).desc() for c in ORDER])
    tail = stmts.withColumn("r", F.row_number().over(back)).where(F.col("r") <= last).withColumn("v", (F.col("kind") == good).cast("int"))
    change = F.lag("v").over(W.partitionBy("file").orderBy("r"))
    return tail.withColumn("c", (F.col("v") != change).cast("int")).groupBy("file").agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("flips")).withColumn("oscillating", F.col("flips") >= 2)


def first_fill(rows: DataFrame, key: str, order: str, *cols: str) -> DataFrame:
    """First non-null value of each column by order."""
    return rows.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols])


def first_row(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_r = 1").drop("_r")


def key_after_other(rows: DataFrame, part: str, order: list[str], is_key: F.Column) -> DataFrame:
    """Key rows that follow a row that is none."""
    w = W.partitionBy(part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("_o", F.max((~is_key).cast("int")).over(w)).where(is_key & (F.col("_o") == 1)).drop("_o")


def surplus(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of after beyond the number of equal rows before, by count."""
    b = before.groupBy(*keys).agg(F.count("*").alias("b"))
    a = after.groupBy(*keys).agg(F.count("*").alias("a"))
    return a.join(b, keys, "left").select(*keys, (F.col("a") - F.coalesce("b", F.lit(0))).alias("extra")).where("extra > 0")


def heavy_loops(stmts: DataFrame, opener: str, of: str, least: int) -> DataFrame:
    """Openers with many statements of a kind before the next opener."""
    s = stmts.withColumn("session", F.sum((F.col("kind") == opener).cast("int")).over(_w(None, 0))).where("session > 0")
    return s.groupBy("file", F.col("session").cast("long").alias("session")).agg(F.count_if(F.col("kind") == of).alias("n")).where(F.col("n") >= least)


def declared_before(stmts: DataFrame, decl: str, use: str) -> DataFrame:
    """Uses, and the number of declarations before them."""
    n = F.count_if(F.col("kind") == decl).over(_w(None, -1))
    return stmts.withColumn("n", F.coalesce(n, F.lit(0))).where(F.col("kind") == use).select("file", "seq", "n")


def repeated_blocks(lines: DataFrame, size: int = 6) -> DataFrame:
    """Per document the first block of `size` lines that repeats without overlap: its two places."""
    own = F.regexp_replace(F.trim("raw"), r"[ \t]+", " ")
    rows = lines.withColumn("x", own).where("x <> ''")
    w = W.partitionBy("doc_id").orderBy("line")
    block = F.collect_list("x").over(w.rowsBetween(0, size - 1))
    rows = rows.withColumn("b", block).withColumn("end", F.max("line").over(w.rowsBetween(0, size - 1)))
    rows = rows.where((F.size("b") == size) & (F.col("end") == F.col("line") + size - 1)).select("doc_id", "line", F.sha2(F.concat_ws("\n", "b"), 256).alias("k"))
    first = F.min("line").over(W.partitionBy("doc_id", "k"))
    hit = rows.withColumn("first", first).where(F.col("line") >= F.col("first") + size)
    return hit.groupBy("doc_id").agg(F.min(F.struct("line", "first")).alias("x")).select("doc_id", F.col("x.first").alias("first"), F.col("x.line").alias("second"))


def last_series(rows: DataFrame, key: str, order: list[str], value: F.Column, kept: int = 5) -> DataFrame:
    """Key, series: the last few values of each group, the latest last."""
    latest = rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*[F.col(c).desc() for c in order]))).where(F.col("_r") <= kept)
    return latest.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("_v")))), lambda x: x["_v"]).alias("series"))
