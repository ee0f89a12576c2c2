"""The gate over verdict documents and the identity of findings."""

import json

import pytest
from pyspark.sql import functions as F
from tessera.plans import gate, identity

FLAGS = dict.fromkeys(gate.SAP_FLAGS, False)
GOOD = {
    "sap-verdict.json": {**dict.fromkeys(gate.SAP_FIELDS, "t"), "verdict": "PASS", "failure_layer": None, "clean_core_level": "A", "atc": {"priority1": [], "priority2": []}, "invariant_diff": FLAGS},
    "clean-core-verdict.json": {"gate": "clean-core", "pass": True, "atc": {}, "grounding": {}, "summary": {}, "findings": []},
    "security-verdict.json": {"gate": "security", "pass": True, "summary": {}, "invariants": {**dict.fromkeys(gate.SECURITY_FIELDS, "ok"), "baseline_established": True}},
    "diff-review-verdict.json": {"gate": "abap-diff-review", "pass": True, "range": "r", "acceptance_criteria_source": "s", "summary": {}},
    "design-critique.json": {**dict.fromkeys(gate.DESIGN_FIELDS, "t"), "verdict": "PASS", "scores": dict.fromkeys(gate.DESIGN_SCORES, 8)},
}
CASES = [
    ({}, [], 0),
    ({"sap-verdict.json": {"verdict": "BLOCK", "failure_layer": "atc"}}, ["sap-verdict: BLOCK (failure_layer=atc)"], 0),
    ({"sap-verdict.json": {"atc": {"priority1": [{}], "priority2": [{}, {}]}}}, ["sap-verdict: 1 priority-1 ATC finding(s)", "sap-verdict: 2 priority-2 ATC finding(s)"], 0),
    ({"security-verdict.json": {"pass": False}}, ["security-verdict.json: pass=false"], 0),
    ({"sap-verdict.json": None}, ["sap-verdict.json: missing or unreadable (fail-closed)"], 0),
    ({"clean-core-verdict.json": "{not json"}, ["clean-core-verdict.json: missing or unreadable (fail-closed)"], 0),
    ({"diff-review-verdict.json": {"pass": "true", "findings": [{"level": "INFO"}, {"level": "LOUD"}]}}, ["diff-review-verdict.json: invalid shape — diff-review-verdict pass must be a boolean; diff-review-verdict findings[1] bad level: LOUD"], 0),
    ({"design-critique.json": {"verdict": "WARN"}}, [], 1),
    ({"design-critique.json": {"verdict": "BLOCK"}}, ["design-critique: BLOCK (P1/P4 model breach)"], 0),
    ({"design-critique.json": {"verdict": "BLOCK", "scores": {}}}, [], 0),
    ({"design-critique.json": None}, [], 0),
]


def test_gate(spark):
    rows = []
    for i, (changes, *_) in enumerate(CASES):
        for file, doc in GOOD.items():
            new = changes.get(file, {})
            if new is not None:
                rows.append((i, file, new if isinstance(new, str) else json.dumps({**doc, **new})))
    got = {r["run"]: r for r in gate.gated(spark.createDataFrame(rows + [(99, "readme.json", "{}")], "run int, file string, doc string")).collect()}
    for i, (_, blocks, warnings) in enumerate(CASES):
        assert (got[i]["blocks"], len(got[i]["warnings"]), got[i]["pass"]) == (blocks, warnings, not blocks), i
    assert len(got[99]["blocks"]) == 4 and gate.gated(spark.createDataFrame([], "run int, file string, doc string")).count() == 0


def test_folder(spark, tmp_path):
    for file, doc in GOOD.items():
        (tmp_path / file).write_text(json.dumps(doc, indent=1))
    assert gate.gated(gate.folder(spark, str(tmp_path))).first()["pass"] is True
    (tmp_path / "sap-verdict.json").write_text("")
    assert gate.gated(gate.folder(spark, str(tmp_path))).first()["blocks"] == ["sap-verdict.json: missing or unreadable (fail-closed)"]


def test_errors(spark):
    docs = [("security", '{"gate":"security","pass":true,"invariants":{},"summary":"s"}'), ("security", '{"gate":"x","pass":1}'), ("none", "{}"), ("sap", None), ("sap", '{"published_services":[{"service_url":1}]}')]
    got = [r[0] for r in spark.createDataFrame(docs, "k string, d string").select(gate.verdict_errors(F.col("k"), F.col("d"))).collect()]
    assert len(got[0]) == 5 and 'security-verdict gate must be "security"' in got[1] and got[2] == ["unknown verdict kind: none"] and len(got[3]) >= 10
    assert {"sap-verdict published_services[0].service_binding is required", "sap-verdict published_services[0].metadata_reachable must be a boolean"} <= set(got[4])


CODE = """REPORT z.
METHOD one.
  a = 1.
  Method inner.
    b = 2.
  ENDMETHOD.
  c = 3.
ENDMETHOD.
d = 4.
ENDFORM.
  form  f_x.
e = 5."""


def plain(lines, n, fallback):
    """A scan upwards that skips closed units."""
    import re

    depth = 0
    for line in reversed(lines[:n]):
        if re.match(identity.END, line):
            depth += 1
        elif m := re.match(identity.UNIT, line):
            if not depth:
                return f"{m[1]}:{m[2]}".lower()
            depth -= 1
    return fallback


def test_units(spark):
    files = spark.createDataFrame([("a", CODE.replace("\n", "\r\n")), ("b", ""), ("c", None)], "file string, source string")
    lines = CODE.split("\n")
    rows = [("r", "Z", "a", n) for n in range(1, len(lines) + 1)] + [("r", "Z", "b", 1), ("r", "Z", "c", 3), ("r", "Z", None, 1), ("r", "Z", "a", None), ("r", "Z", "a", 99), ("r", "Z", "a", 3)]
    got = identity.identified(spark.createDataFrame(rows, "rule_id string, object string, file string, line long"), files).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain(lines, r["line"], "Z") if r["file"] == "a" and r["line"] and r["line"] <= len(lines) else "Z"
        assert r["enclosing_unit"] == want, (r["line"], want)


def test_ids_stay(spark):
    """Lines added above, other spaces and other case leave an id as it is; another name or literal doesn't."""
    before = "METHOD m.\n  SELECT * FROM mara WHERE a = 'x Y'.\nENDMETHOD."
    after = ['* new\n\nMETHOD m.\n"\n  select  *\tFROM mara where a = \'x Y\'.\nENDMETHOD.', before.replace("mara", "marc"), before.replace("x Y", "x y"), before.replace("METHOD m", "METHOD n")]
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate([before, *after])], "file string, source string")
    rows = [("r", "Z", "0", 2), ("r", "Z", "1", 5), ("r", "Z", "2", 2), ("r", "Z", "3", 2), ("r", "Z", "4", 2)]
    ids = {r["file"]: r["finding_id"] for r in identity.identified(spark.createDataFrame(rows, "rule_id string, object string, file string, line long"), files).collect()}
    assert ids["0"] == ids["1"] and len({ids[k] for k in "0234"}) == 4


@pytest.mark.parametrize("line", ["  move   a to 'b  c'.", "x = `q r`  & |s t|", "open 'lit", "", "  ", "a'b''c' d"])
def test_snippet(spark, line):
    from tessera.sources import artifacts

    assert spark.createDataFrame([(line,)], "l string").select(identity.snippet(F.col("l"))).first()[0] == artifacts.snippet(line)
