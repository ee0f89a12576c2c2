"""Types of references, and the methods that calls through them reach.

A variable with a declaration has that class; one without takes the classes of what is assigned to it, through any
number of assignments.  Classes spread by their newest pairs only until none is new.  A call reaches the method of the first class,
from the reference's own upwards, that defines it; all (class, method) pairs climb together, each until it is defined.
Assignments in a circle and classes that inherit from themselves end, as no pair is taken twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.cuts import cut, met


def spread(declared: DataFrame, flows: DataFrame) -> DataFrame:
    """var, type of all variables: declared(var, type), and flows(src, dst) into variables that have no declaration."""
    known = front = cut(declared.select("var", "type").distinct())
    open_ = cut(met(flows.select("src", "dst").distinct(), declared.select(F.col("var").alias("dst")).distinct(), "dst", "left_anti"))
    while True:
        front = met(front.withColumnRenamed("var", "src"), open_, "src").select(F.col("dst").alias("var"), "type").distinct()
        front = cut(met(front, known, ["var", "type"], "left_anti"))
        if front.isEmpty():
            return known
        known = known.unionByName(front)


def defined(wanted: DataFrame, inherits: DataFrame, methods: DataFrame) -> DataFrame:
    """type, method, owner of wanted(type, method): the first class upwards along inherits(type, super) that methods(type, method) has it for."""
    own = cut(methods.select(F.col("type").alias("at"), "method").distinct())
    up = cut(inherits.select(F.col("type").alias("at"), "super").distinct())
    front = cut(wanted.select("type", "method").distinct().withColumn("at", F.col("type")))
    seen, done = front, None
    while True:
        found = cut(met(front, own, ["at", "method"]).select("type", "method", F.col("at").alias("owner")))
        done = found if done is None else done.unionByName(found)
        rest = met(met(front, own, ["at", "method"], "left_anti"), up, "at").select("type", "method", F.col("super").alias("at")).distinct()
        front = cut(met(rest, seen, ["type", "method", "at"], "left_anti"))
        if front.isEmpty():
            return done
        seen = seen.unionByName(front)


def resolved(calls: DataFrame, declared: DataFrame, flows: DataFrame, inherits: DataFrame, methods: DataFrame) -> DataFrame:
    """source, owner, method of calls(source, var, method) whose variable has a class that defines or inherits the method."""
    typed = met(calls, spread(declared, flows), "var").select("source", "type", "method").distinct()
    typed = cut(typed)
    return met(typed, defined(typed, inherits, methods), ["type", "method"]).select("source", "owner", "method").distinct()


def instance_edges(statements: DataFrame) -> DataFrame:
    """source (object), target (class.method), kind of the calls through references in statements.

    A variable is known within its method; what a method doesn't declare is looked up among the attributes of its class.
    """
    t, name = F.upper("text"), r"[A-Z_/][A-Z0-9_/]*"
    pick = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    order = W.partitionBy("filename").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    k = F.col("kind")
    within = F.last(F.when(k == "MethodImplementation", pick(rf"^METHOD ({name})")).when(k.isin("EndMethod", "EndClass", "ClassDefinition"), F.lit("")), ignorenulls=True).over(order)
    s = cut(statements.withColumns({"t": t, "at": F.coalesce(within, F.lit("")), "class": F.upper("object")}).select("class", "at", "kind", "t", "seq"))
    t = F.col("t")
    var = lambda at, v: F.concat_ws(".", "class", at, v)
    here, none = F.col("at"), F.lit("")
    data = s.where(F.col("kind").isin("Data", "ClassData")).select(var(here, pick(rf"^(?:CLASS-)?DATA:? ({name}) TYPE REF TO ")).alias("var"), pick(rf" TYPE REF TO ({name})").alias("type"))
    inline = s.select(var(here, pick(rf"^DATA\(({name})\) = NEW ")).alias("var"), pick(rf" = NEW ({name})\(").alias("type"))
    created = s.where("kind = 'CreateObject'").select(var(here, pick(rf"^CREATE OBJECT ({name}) TYPE ")).alias("var"), pick(rf" TYPE ({name})").alias("type"))
    heads = s.where("kind = 'MethodDef'").select("class", pick(rf"METHODS ({name})").alias("m"), F.explode(F.regexp_extract_all(t, F.lit(rf"({name}) TYPE REF TO {name}"), F.lit(0))).alias("p"))
    params = heads.select(var(F.col("m"), F.substring_index("p", " ", 1)).alias("var"), F.element_at(F.split("p", " "), -1).alias("type"))
    own = s.where("kind = 'ClassDefinition'").select(F.col("class").alias("type"), pick(rf" INHERITING FROM ({name})").alias("super"))
    implemented = s.where("kind = 'MethodImplementation'").select(F.col("class").alias("type"), pick(rf"^METHOD ({name})").alias("method"))
    declared = data.union(inline).union(created).union(params).where("type is not null").distinct()
    declared = cut(declared)
    sides = s.select("class", "at", pick(rf"^(?:DATA\()?({name})\)? = {name}$").alias("dst"), pick(rf"^(?:DATA\()?{name}\)? = ({name})$").alias("src")).where("dst is not null and src is not null")
    flows = sides.select(var(here, F.col("src")).alias("src"), var(here, F.col("dst")).alias("dst"))
    flows = flows.union(sides.where("at <> ''").select(var(none, F.col("src")).alias("src"), var(here, F.col("dst")).alias("dst")))
    each = s.select("class", "at", F.explode(F.regexp_extract_all(t, F.lit(rf"(?<![A-Z0-9_>])({name})->({name})\("), F.lit(0))).alias("c")).withColumns({"ref": F.substring_index("c", "->", 1), "method": F.regexp_extract("c", rf"->({name})", 1)})
    local = each.select(F.col("class").alias("source"), var(here, F.col("ref")).alias("var"), "method")
    missing = each.where("at <> ''").withColumn("var", var(here, F.col("ref"))).join(declared.select("var").union(flows.select("dst")).distinct(), "var", "left_anti")
    outer = missing.select(F.col("class").alias("source"), var(none, F.col("ref")).alias("var"), "method")
    me = each.where("ref = 'ME'").select(F.col("class").alias("source"), F.concat(F.col("class"), F.lit(".ME")).alias("var"), "method")
    selves = me.select("var", F.col("source").alias("type")).distinct()
    found = resolved(local.union(outer).union(me), declared.union(selves), flows, own.where("super is not null"), implemented.where("method is not null"))
    return found.select("source", F.concat_ws(".", "owner", "method").alias("target"), F.lit("call-method").alias("kind"))
