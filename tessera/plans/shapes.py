"""Target shapes: which designs fit a node, by signals of its facts; scores and what is missing for the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.predicates import shape_gaps, shape_holds, shape_score

UI = ("consumption:ui_salv", "consumption:ui_dynpro", "rule:talos-cloud-014-classic-dynpro", "rule:talos-s4-004-screen-flow", "rule:talos-s4-005-web-dynpro")
BARE, OWNING = "persistence:no_persistence_evidence", ("persistence:owns_customer_table", "persistence:writes_via_sap_api", "persistence:writes_sap_table")
OBJECT = ("cds_interface", "cds_projection", "bdef_managed", "behavior_pool", "dcl")
#: Shapes with the signals that must all hold, of which one must hold, of which none may; and their components.
SHAPES: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "rap_bo_headless": ((), ("disposition:re_architect", "disposition:rebuild", "target:RAP Business Object"), ("consumption:ui_salv", "consumption:ui_dynpro", "consumption:remote_rfc", "consumption:remote_bapi", "consumption:remote_idoc", "consumption:no_surface_evidence", "consumption:classic_api_surface", BARE, *UI[2:]), (*OBJECT, "test_class")),
    "rap_bo_odata": (("object_kind:function",), ("consumption:remote_rfc", "consumption:remote_bapi"), (BARE,), (*OBJECT, "service_def", "service_binding", "test_class")),
    "rap_bo_fiori": (("persistence:owns_customer_table",), UI, (), (*OBJECT, "service_def", "service_binding", "metadata_ext", "test_class")),
    "fiori_list_report": ((), UI, (BARE, *OWNING), ("cds_interface", "cds_projection", "service_def", "service_binding", "metadata_ext", "test_class")),
    "rap_bo_events": ((), ("consumption:remote_idoc_outbound",), (BARE,), (*OBJECT, "rap_business_events", "test_class")),
    "rap_bo_message_driven": ((), ("consumption:remote_idoc_inbound", "consumption:remote_idoc"), ("consumption:remote_idoc_outbound", BARE), (*OBJECT, "test_class")),
    "analytical_cds": ((), ("family:analytics", "target:CDS View", "target:CDS View Entity"), ("consumption:no_surface_evidence",), ("cds_analytical_cube", "cds_analytical_query")),
    "value_help_cds": ((), ("family:value-help", "family:search-help"), (), ("cds_value_help",)),
    "custom_entity_query": ((), ("hint:os_exec", "consumption:remote_rfc"), OWNING, ("custom_entity", "query_provider_class")),
    "released_replace": ((), ("disposition:replace",), (), ("released_standard_wiring",)),
}
#: Types of signals by the fact they look at: a list, or one value.
LISTS = {"consumption": "consumption", "persistence": "persistence", "hint": "hints", "rule": "rules", "family": "families"}
SINGLE = {"disposition": "disposition", "target": "target", "object_kind": "kind"}


def signal(text: str) -> Column:
    """Whether a signal, type:value, holds for a row of facts; an unknown type is an error."""
    kind, _, value = text.partition(":")
    if kind in LISTS:
        return F.array_contains(LISTS[kind], value)
    if kind in SINGLE:
        return F.col(SINGLE[kind]) == value
    raise ValueError(f"unknown type of signal: {text}")


def _parts(shape: str) -> list[dict[str, Column]]:
    return [{s: signal(s) for s in group} for group in SHAPES[shape][:3]]


def matched(facts: DataFrame, key: str) -> DataFrame:
    """C17: key, id, score of the shapes that fit: how many of the wanted signals hold."""
    fits = [F.when(shape_holds(*_parts(s)), F.struct(F.lit(s).alias("id"), shape_score(*_parts(s)[:2]).alias("score"))) for s in SHAPES]
    return facts.select(key, F.explode(F.array_compact(F.array(*fits))).alias("x")).select(key, "x.id", "x.score")


def explained(facts: DataFrame, key: str) -> DataFrame:
    """key, id, unmet_all, unmet_any, violated_none of the shapes that don't fit."""
    gaps = [F.when(~shape_holds(*_parts(s)), F.struct(F.lit(s).alias("id"), shape_gaps(*_parts(s)).alias("gaps"))) for s in SHAPES]
    return facts.select(key, F.explode(F.array_compact(F.array(*gaps))).alias("x")).select(key, "x.id", "x.gaps.*")


def components() -> list[tuple[str, list[str]]]:
    """The shapes with their components, as rows for contracts."""
    return [(s, list(parts[3])) for s, parts in SHAPES.items()]
