"""Descriptors of user interfaces: their JSON as a variant, one predicate for each rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules with their severities.
RULES = {
    "fe-manifest-invalid-json": "error", "fe-manifest-invalid": "error", "fe-manifest-no-sap-app": "error", "fe-manifest-no-sap-ui5": "error", "fe-no-odata-datasource": "error", "fe-model-no-datasource": "warning",
    "fe-model-datasource-unresolved": "error", "fe-datasource-wrong-service": "error", "fe-no-list-report": "error", "fe-no-object-page": "error", "fe-no-entityset": "error", "fe-entityset-projection-mismatch": "error",
}
_SOURCE, _TARGET = "struct<type:string,uri:string>", "struct<name:string,options:struct<settings:struct<entitySet:string,contextPath:string>>>"


def _at(path: str, kind: str) -> Column:
    return F.try_variant_get("v", path, kind)


def checked(manifests: DataFrame) -> DataFrame:
    """The rows of manifests(manifest, entity, service) with `rules`, the rules that a descriptor breaks; entity and service may be null.

    Text that is no JSON breaks one rule only, and so does JSON that is no object.
    """
    m = manifests.withColumn("v", F.try_parse_json("manifest"))
    m = m.withColumns({
        "_app": _at("$['sap.app']", "map<string,variant>"), "_ui": _at("$['sap.ui5']", "map<string,variant>"), "_sources": F.coalesce(_at("$['sap.app'].dataSources", f"map<string,{_SOURCE}>"), F.create_map().cast(f"map<string,{_SOURCE}>")),
        "_model": F.nullif(_at("$['sap.ui5'].models['']['dataSource']", "string"), F.lit("")), "_targets": F.map_values(F.coalesce(_at("$['sap.ui5'].routing.targets", f"map<string,{_TARGET}>"), F.create_map().cast(f"map<string,{_TARGET}>"))),
    })
    odata = F.filter(F.map_values("_sources"), lambda x: F.upper(x["type"]) == "ODATA")
    template = lambda name: F.exists("_targets", lambda x: F.coalesce(F.lower(x["name"]).contains(f"sap.fe.templates.{name}".lower()), F.lit(False)))
    settings = F.filter(F.transform("_targets", lambda x: x["options"]["settings"]), lambda x: F.coalesce(x["entitySet"], x["contextPath"], F.lit("")) != "")
    segments = F.transform(settings, lambda x: F.filter(F.split(F.trim(F.coalesce(x["contextPath"], F.lit(""))), "/"), lambda p: p != ""))
    named = F.zip_with(settings, segments, lambda x, p: F.when(F.coalesce(x["entitySet"], F.lit("")) != "", F.struct(x["entitySet"].alias("name"), F.lit(True).alias("sure"))).when(F.size(p) > 0, F.struct(F.element_at(p, -1).alias("name"), (F.size(p) == 1).alias("sure"))))
    named = F.filter(named, lambda x: x.isNotNull())
    m = m.withColumns({"_odata": odata, "_named": named})
    has = F.size("_odata") > 0
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    broken = {
        "fe-manifest-no-sap-app": F.col("_app").isNull(), "fe-manifest-no-sap-ui5": F.col("_ui").isNull(), "fe-no-odata-datasource": ~has, "fe-model-no-datasource": has & F.col("_model").isNull(),
        "fe-model-datasource-unresolved": has & F.col("_model").isNotNull() & ~F.map_contains_key("_sources", F.coalesce("_model", F.lit(""))),
        "fe-datasource-wrong-service": has & F.col("service").isNotNull() & ~F.exists("_odata", lambda x: F.coalesce(F.contains(F.lower(x["uri"]), F.lower("service")), F.lit(False))),
        "fe-no-list-report": ~template("ListReport"), "fe-no-object-page": ~template("ObjectPage"), "fe-no-entityset": F.size("_named") == 0,
        "fe-entityset-projection-mismatch": F.col("entity").isNotNull() & F.exists("_named", lambda x: x["sure"] & (F.lower(x["name"]) != F.lower("entity"))),
    }
    rules = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in broken.items()]))
    one = F.when(F.col("v").isNull(), F.array(F.lit("fe-manifest-invalid-json"))).when(~is_object, F.array(F.lit("fe-manifest-invalid"))).otherwise(rules)
    return m.withColumn("rules", one).select(*manifests.columns, "rules")


def findings(manifests: DataFrame) -> DataFrame:
    """The rows of manifests once for each rule they break: rule_id, severity."""
    severity = F.coalesce(*[F.when(F.col("rule_id") == r, F.lit(s)) for r, s in RULES.items()])
    return checked(manifests).withColumn("rule_id", F.explode("rules")).drop("rules", "manifest").withColumn("severity", severity)
