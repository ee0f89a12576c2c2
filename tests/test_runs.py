"""From a folder of sources to findings, a plan, a page and answers."""

import json

import pytest
from tessera import cli
from tessera.plans import packs, runs

FILES = {
    "zcl_a.clas.abap": "CLASS zcl_a DEFINITION INHERITING FROM zcl_b.\nPUBLIC SECTION.\nMETHODS run.\nENDCLASS.\nCLASS zcl_a IMPLEMENTATION.\nMETHOD run.\nLOOP AT lt INTO ls.\nSELECT * FROM mara INTO TABLE lt2 WHERE matnr = ls-a.\nENDLOOP.\nUPDATE mara SET a = 1.\nENDMETHOD.\nENDCLASS.\n",
    "zcl_b.clas.abap": "CLASS zcl_b DEFINITION FINAL INHERITING FROM zcl_c.\nENDCLASS.\n",
    "zcl_c.clas.abap": "CLASS zcl_c DEFINITION FINAL INHERITING FROM zcl_b.\nENDCLASS.\n",
    "zi_x.ddls.asddls": "define view zi_x as select from mara { key matnr }",
    "zp.prog.abap": "WRITE 'x'.\n",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("estate")
    for name, text in FILES.items():
        (d / name).write_text(text)
    return str(d)


@pytest.fixture(scope="module")
def report(spark, folder):
    def boom():
        raise RuntimeError("no such thing")

    return runs.analyse(spark, folder, more={"boom": boom, "late": lambda: spark.sql("select raise_error('at run time') as rule_id")})


def test_findings(report):
    hits = {(r["rule_id"], r["object"]) for r in report.findings.collect()}
    assert {("talos-select-in-loop", "ZCL_A"), ("talos-cloud-021-direct-table-write", "ZCL_A"), ("talos-dependency-cycle", "ZCL_B"), ("talos-dependency-cycle", "ZCL_C"), ("talos-missing-test-class", "ZCL_A"), ("talos-cds-missing-access-control", "ZI_X")} <= hits
    assert ("talos-dependency-cycle", "ZCL_A") not in hits


def test_a_failing_rule_is_a_row(report):
    assert [name for name, _ in report.failed] == ["boom", "late"] and "no such thing" in dict(report.failed)["boom"]
    assert {r["rule_id"] for r in report.findings.where("family = 'engine'").collect()} == {"boom", "late"}


def test_plan(report):
    nodes = {tuple(r["members"]): r["wave"] for r in runs.planned(report).collect()}
    assert set(nodes) == {("ZCL_A",), ("ZCL_B", "ZCL_C"), ("ZI_X",), ("ZP",)}
    assert nodes[("ZCL_A",)] > nodes[("ZCL_B", "ZCL_C")]


def test_summary_gate_and_page(report, tmp_path):
    summary = {r["metric"]: r["value"] for r in report.summary().collect()}
    assert summary["objects"] == 5 and summary["findings_p1"] >= 2
    assert runs.blocked(report)[0] is True
    assert all(r["delta"] == 0 for r in runs.compared(report, report).collect())
    text = cli.page(report)
    assert "ZCL_A" in text and "</script>" in text and text.count("<script") == 1
    report.write(str(tmp_path / "out"))
    assert (tmp_path / "out" / "findings" / "_SUCCESS").exists()


def test_requests(spark, folder, tmp_path):
    ask = lambda method, **params: cli.handle(spark, {"id": 1, "method": method, "params": params}, str(tmp_path))
    lint = {r["rule_id"] for r in ask("lint_abap_cloud", path=folder)["result"]["findings"]}
    assert {"gf-cloud-no-write", "gf-cds-classic-view", "gf-perf-select-in-loop", "gf-cloud-select-star"} <= lint
    done = ask("analyse_bundle", path=folder, out="a/b")["result"]
    assert done["failed"] == [] and {r["metric"] for r in ask("get_report", out="a/b")["result"]["summary"]} == {r["metric"] for r in done["summary"]}
    pages = [ask("get_report", out="a/b", offset=i, limit=2)["result"] for i in range(0, done["total"]["findings"], 2)]
    assert [r for p in pages for r in p["findings"]] == ask("get_report", out="a/b")["result"]["findings"] and pages[0]["total"] == done["total"]
    assert "not below" in ask("analyse_bundle", path=folder, out="../up")["error"]["message"]
    assert ask("nothing")["error"]["code"] == -32601 and "error" in ask("lint_abap_cloud")
    assert ask("validate_fe_descriptor", manifest={"sap.app": 1})["result"]["findings"]
    assert ask("ground_released_apis", registry=[{"name": "VBAK", "state": "noAPI"}], files=[{"object": "Z", "file": "z", "source": "select from vbak"}])["result"]["findings"][0]["rule_id"] == "gf-ground-no-api"


def test_commands(folder, capsys, monkeypatch, tmp_path):
    monkeypatch.chdir(tmp_path)
    assert cli.main(["gate", str(tmp_path)]) == 1
    assert len(json.loads(capsys.readouterr().out)["blocks"]) == 4
    assert cli.main(["lint", folder, "--offset", "1", "--limit", "2"]) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert len(rows) == 3 and rows[-1]["total"] > 3 and rows[-1]["offset"] == 1
    assert cli.main(["analyse", folder, "--html", "r.html", "--sarif", "s"]) == 0 and (tmp_path / "r.html").exists()
    (tmp_path / "m.json").write_text("{")
    assert cli.main(["descriptor", "m.json"]) == 0 and "fe-manifest-invalid-json" in capsys.readouterr().out
    with pytest.raises(ValueError):
        cli.below(str(tmp_path), "../x")


def test_isolated(spark):
    good, bad = packs.isolated({"ok": lambda: spark.range(3), "no": lambda: spark.range(3).select("nothing")})
    assert [df.count() for df in good] == [3] and [n for n, _ in bad] == ["no"]
