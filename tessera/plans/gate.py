"""Verdict documents of a run, their validation, and the gate over them, fail-closed.

A run has four hard verdicts and a soft one, each a JSON document under a file name.  A hard verdict that is missing, unreadable or
invalid blocks, as do BLOCK, `pass: false` and findings of the first and second priority; the soft one blocks by its own BLOCK only and
warns by WARN.  Documents are read as variants, so a check of a type sees the type that the document has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Files and kinds of verdicts, the fields they need, the words they may hold, and the texts of errors and blocks.
HARD = {"sap-verdict.json": "sap", "clean-core-verdict.json": "clean-core", "security-verdict.json": "security", "diff-review-verdict.json": "diff-review"}
SOFT = "design-critique.json"
VERDICTS = ("PASS", "WARN", "BLOCK")
LEVELS = ("BLOCK", "WARN", "INFO")
LAYERS = ("activation", "atc", "atc-unavailable", "abapunit", "invariant", "infrastructure")
CORE_LEVELS = ("A", "not-A")
SAP_FIELDS = ("verdict", "timestamp", "connection", "objects", "activation", "atc", "abap_unit", "clean_core_level", "invariant_diff", "ratchet")
SAP_FLAGS = ("authority_check_weakened", "commit_work_suppressed", "commit_entities_suppressed", "sy_subrc_check_dropped")
DESIGN_FIELDS = ("story_id", "iteration", "timestamp", "scores", "weighted_average", "threshold", "verdict", "failing_criteria", "grounding", "critique")
DESIGN_SCORES = ("cds_modelling", "rap_behavior", "extensibility_tier", "released_api", "namespace", "blast_radius")
PASS_GATES = {"clean-core": ("clean-core", ("atc", "grounding", "summary")), "security": ("security", ("invariants", "summary")), "diff-review": ("abap-diff-review", ("range", "acceptance_criteria_source", "summary"))}
SECURITY_FIELDS = ("authority_check", "commit_work", "commit_entities", "sy_subrc")
LABELS = {"sap": "sap-verdict", "clean-core": "clean-core-verdict", "security": "security-verdict", "diff-review": "diff-review-verdict", "design-critique": "design-critique"}


class Document:
    """A JSON document as a column; paths start below its top."""

    def __init__(self, doc: Column):
        self.value = F.try_parse_json(doc)

    def at(self, path: str, kind: str = "variant") -> Column:
        return F.try_variant_get(self.value, f"$.{path}", kind)

    def type(self, path: str) -> Column:
        """BOOLEAN, STRING, ARRAY<...>, ...; VOID for a null; none where nothing is."""
        return F.schema_of_variant(self.at(path))

    def absent(self, path: str) -> Column:
        return F.coalesce(self.type(path) == "VOID", F.lit(True))

    def array(self, path: str) -> Column:
        return F.coalesce(self.type(path).startswith("ARRAY"), F.lit(False))

    def boolean(self, path: str) -> Column:
        return F.coalesce(self.type(path) == "BOOLEAN", F.lit(False))

    def size(self, path: str) -> Column:
        return F.when(self.array(path), F.size(self.at(path, "array<variant>"))).otherwise(0)


def _if(condition: Column, *message: Column | str) -> Column:
    """The message as an array, if the condition holds."""
    text = F.concat(*[F.lit(m) if isinstance(m, str) else m for m in message])
    return F.when(condition, F.array(text)).otherwise(F.array().cast("array<string>"))


def _enum(d: Document, path: str, allowed: tuple[str, ...], label: str) -> Column:
    value = d.at(path, "string")
    return _if(~d.absent(path) & ~F.coalesce(value.isin(*allowed), F.lit(False)), f"{label}: ", F.coalesce(value, F.lit("")))


def _bad_level(label: str) -> Callable[[Column, Column], Column]:
    level = lambda f: F.try_variant_get(f, "$.level", "string")
    return lambda f, i: F.when(level(f).isNotNull() & ~level(f).isin(*LEVELS), F.concat(F.lit(f"{label} findings["), i.cast("string"), F.lit("] bad level: "), level(f)))


def verdict_errors(kind: Column, doc: Column) -> Column:
    """V3: what is wrong with a verdict document of a kind; an unknown kind is an error."""
    d = Document(doc)
    need = lambda label, fields: [_if(d.absent(f), f"{label} missing required field: {f}") for f in fields]
    sap = [*need("sap-verdict", SAP_FIELDS), _enum(d, "verdict", VERDICTS, "sap-verdict bad verdict"), _if(d.type("failure_layer").isNull(), "sap-verdict missing required field: failure_layer"), _enum(d, "failure_layer", LAYERS, "sap-verdict bad failure_layer"), _enum(d, "clean_core_level", CORE_LEVELS, "sap-verdict bad clean_core_level")]
    sap += [_if(~d.absent("atc") & ~d.array(f"atc.{p}"), f"sap-verdict atc.{p} must be an array") for p in ("priority1", "priority2")]
    sap += [_if(~d.absent("invariant_diff") & ~d.boolean(f"invariant_diff.{k}"), f"sap-verdict invariant_diff.{k} must be a boolean") for k in SAP_FLAGS]
    sap.append(_if(~d.absent("published_services") & ~d.array("published_services"), "sap-verdict published_services must be an array"))
    service = lambda s, i: F.array_compact(F.array(*[F.when(F.coalesce(F.schema_of_variant(F.try_variant_get(s, f"$.{k}", "variant")), F.lit("VOID")) == "VOID", F.concat(F.lit("sap-verdict published_services["), i.cast("string"), F.lit(f"].{k} is required"))) for k in ("service_binding", "service_url")], F.when(F.coalesce(F.schema_of_variant(F.try_variant_get(s, "$.metadata_reachable", "variant")) != "BOOLEAN", F.lit(True)), F.concat(F.lit("sap-verdict published_services["), i.cast("string"), F.lit("].metadata_reachable must be a boolean")))))
    elements = lambda path: F.coalesce(F.when(d.array(path), d.at(path, "array<variant>")), F.array().cast("array<variant>"))
    sap.append(F.flatten(F.transform(elements("published_services"), service)))
    design = [*need("design-critique", DESIGN_FIELDS), _enum(d, "verdict", VERDICTS, "design-critique bad verdict")]
    number = lambda k: d.type(f"scores.{k}").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & d.at(f"scores.{k}", "double").between(1, 10)
    design += [_if(~d.absent("scores") & ~F.coalesce(number(k), F.lit(False)), f"design-critique scores.{k} must be an integer 1-10") for k in DESIGN_SCORES]
    out = F.when(kind == "sap", F.flatten(F.array(*sap))).when(kind == "design-critique", F.flatten(F.array(*design)))
    for k, (gate, fields) in PASS_GATES.items():
        label = LABELS[k]
        own = [_if(F.coalesce(d.at("gate", "string") != gate, F.lit(True)), f'{label} gate must be "{gate}"'), _if(~d.boolean("pass"), f"{label} pass must be a boolean"), _if(~d.absent("findings") & ~d.array("findings"), f"{label} findings must be an array"), F.array_compact(F.transform(elements("findings"), _bad_level(label))), *need(label, fields)]
        if k == "security":
            own += [_if(~d.absent("invariants") & d.absent(f"invariants.{f}"), f"{label} invariants.{f} is required") for f in SECURITY_FIELDS]
            own.append(_if(~d.absent("invariants") & ~d.boolean("invariants.baseline_established"), f"{label} invariants.baseline_established must be a boolean"))
        out = out.when(kind == k, F.flatten(F.array(*own)))
    return out.otherwise(F.array(F.concat(F.lit("unknown verdict kind: "), F.coalesce(kind, F.lit("")))))


def gated(verdicts: DataFrame) -> DataFrame:
    """Run, pass, blocks, warnings of verdicts(run, file, doc), one row a run and file.

    Files of other names don't count.  A run is there if one of its rows is.
    """
    files = [*HARD, SOFT]
    rows = verdicts.groupBy("run").agg(*[F.max(F.when(F.col("file") == f, F.col("doc"))).alias(f"doc{i}") for i, f in enumerate(files)])
    blocks, warnings = [], F.array().cast("array<string>")
    for i, file in enumerate(files):
        doc = F.col(f"doc{i}")
        d, kind = Document(doc), HARD.get(file, "design-critique")
        rows = rows.withColumn(f"errors{i}", verdict_errors(F.lit(kind), doc))
        valid = F.size(f"errors{i}") == 0
        if kind == "design-critique":
            on = lambda word, valid=valid, d=d: F.coalesce(d.value.isNotNull() & valid & (d.at("verdict", "string") == word), F.lit(False))
            blocks.append(_if(on("BLOCK"), "design-critique: BLOCK (P1/P4 model breach)"))
            warnings = _if(on("WARN"), "design-critique: WARN — needs human acknowledgement")
            continue
        if kind == "sap":
            count = lambda p, d=d: d.size(f"atc.{p}")
            layer = F.coalesce(d.at("failure_layer", "string"), F.lit("null"))
            own = [_if(d.at("verdict", "string") == "BLOCK", "sap-verdict: BLOCK (failure_layer=", layer, ")")]
            own += [_if(count(p) > 0, "sap-verdict: ", count(p).cast("string"), f" priority-{p[-1]} ATC finding(s)") for p in ("priority1", "priority2")]
        else:
            own = [_if(d.at("pass", "boolean") == F.lit(False), f"{file}: pass=false")]
        gone = F.array(F.lit(f"{file}: missing or unreadable (fail-closed)"))
        wrong = F.array(F.concat(F.lit(f"{file}: invalid shape — "), F.array_join(f"errors{i}", "; ")))
        blocks.append(F.when(d.value.isNull(), gone).when(~valid, wrong).otherwise(F.flatten(F.array(*own))))
    return rows.select("run", F.flatten(F.array(*blocks)).alias("blocks"), warnings.alias("warnings")).select("run", (F.size("blocks") == 0).alias("pass"), "blocks", "warnings")


def folder(spark: SparkSession, path: str) -> DataFrame:
    """run, file, doc of the JSON files of a folder; without files, one row that stands for the run."""
    found = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.lit(path).alias("run"), F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("value").alias("doc"))
    return found.unionByName(spark.createDataFrame([(path, None, None)], "run string, file string, doc string"))
