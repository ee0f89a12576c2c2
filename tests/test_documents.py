"""Canonical JSON, validators, sinks, seals, feedback arcs on small inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F
from tessera.operators.strong import searched as _searched
from tessera.plans import documents as D
from tessera.sources import bundle


def test_canonical():
    assert D.canonical({"b": [1, -0.0, 1.5, 1e-7, 1e21, 2.5e-5, None, True], "a": "é\n"}) == '{"a":"é\\n","b":[1,0,1.5,1e-7,1e+21,0.000025,null,true]}'
    for bad in (float("nan"), float("inf")):
        with pytest.raises(ValueError):
            D.canonical(bad)
    with pytest.raises(TypeError):
        D.canonical({"x": object()})


def test_canonical_round_trip(spark):
    rng = random.Random(2)
    docs = [json.dumps({str(rng.randrange(9)): rng.uniform(-1, 1) * 10 ** rng.randrange(-9, 25), "k": [rng.random()]}) for _ in range(200)]
    got = spark.createDataFrame([(d,) for d in docs], "d string").select("d", D.canonical_json("d").alias("c")).collect()
    assert all(json.loads(r["c"]) == json.loads(r["d"]) for r in got)


def test_validators(spark):
    kind = "digest_version string, package string, source_system string, object_count int, finding_count int, objects array<struct<object:string,grade:string,effort_tier:string>>, findings array<struct<object:string,rule_id:string,severity:string,message:string>>"
    rows = [("1", "p", "s", 1, 0, [("A", "A", "retire")], []), ("1", "p", "s", 0, 0, [("A", "X", None)], None)]
    got = [r[0] for r in spark.createDataFrame(rows, kind).select(D.digest_errors()).collect()]
    assert got[0] == [] and {"missing required top-level field: findings", "objects bad grade", "objects missing effort_tier", "more objects than object_count"} <= set(got[1])
    head = '"schema_version":"1","system":"s","generated_at":"g"'
    signals = [f'{{{head},"usage":{{"source":"SCMON","rows":[{{"object_type":"PROG","object_name":"Z","exec_count":3}}]}}}}', f'{{{head},"usage":{{"rows":[{{"object_type":"PROG","exec_count":-1}}]}}}}', "{}"]
    got = [r[0] for r in spark.createDataFrame([(d,) for d in signals], "d string").select(D.signal_errors(F.col("d"))).collect()]
    assert got[0] == [] and got[1] == ["usage.rows missing object_name", "usage.rows exec_count must be a number >= 0"] and len(got[2]) == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    bad = lambda limit: F.when(F.col("x") > limit, F.array(F.lit("big"))).otherwise(F.array().cast("array<string>"))
    D.write_valid(df, bad(5), str(tmp_path / "a"))
    assert spark.read.json(str(tmp_path / "a")).count() == 2
    with pytest.raises(Exception, match="invalid document: big"):
        D.write_valid(df, bad(1), str(tmp_path / "b"))
    D.append_log(df, str(tmp_path / "a"))
    assert spark.read.json(str(tmp_path / "a")).count() == 4
    with pytest.raises(Exception, match="free of pipes"):
        df.select(D.node_id(F.lit("a|b"), F.lit("c"), F.lit("d"))).collect()


CODE = """DATA lo TYPE REF TO zcl_h.
* CALL FUNCTION lv.
CALL FUNCTION 'X'. CALL FUNCTION lv_name.
SET HANDLER lo->on_click me->(x) FOR go.
PERFORM late ON COMMIT.
SELECT * FROM (lv_tab) INTO TABLE lt.
* ENHANCEMENT-POINT zz
WRITE 'PERFORM (x)'.
"""


def test_seals(spark):
    d = D.dynamics(CODE)
    assert {(s["kind"], s["line"]) for s in d["seals"]} == {("dynamic-construct", 3), ("dynamic-construct", 4), ("dynamic-target", 4), ("dynamic-construct", 6), ("enhancement-marker", 7), ("dynamic-construct", 8)}
    assert {(e["target"], e["kind"]) for e in d["edges"]} == {("ZCL_H=>ON_CLICK", "set-handler"), ("LATE", "perform-on-commit")}
    from tessera.sources import artifacts as A

    scanned = A.parsed(spark.createDataFrame([("P", CODE), ("Q", "PERFORM other ON COMMIT."), ("R", "x = 1.")], "object string, source string"), "dynamics", D.dynamics, D.DYNAMICS)
    members = spark.createDataFrame([("P", "LATE"), ("ZCL_H", "ON_CLICK"), ("Q", "F"), ("R", "G")], "object string, member string")
    edges, sealed = D.adapted(scanned, members)
    assert {tuple(r) for r in edges.collect()} == {("P", "ZCL_H", "set-handler")} and {r[0] for r in sealed.collect()} == {"P", "Q"}


def test_feedback_arcs(spark):
    rng = random.Random(3)
    links = {(rng.randrange(20), rng.randrange(20)) for _ in range(45)} | {(100 + i, 100 + (i + 1) % 7) for i in range(7)}
    for budget in (1, 4):
        cutting = {(r["source"], r["target"]) for r in D.feedback_arcs(spark.createDataFrame(sorted(links), "a long, b long"), budget).collect()}
        assert cutting <= links
        left = _searched(sorted(e for e in links - cutting if e[0] != e[1]))
        assert max(list(left.values()).count(r) for r in set(left.values())) <= budget
        assert sum(a >= 100 for a, _ in cutting) == 1


def test_dangling_symbols(spark):
    code = "METHOD m.\nLOOP AT t ASSIGNING FIELD-SYMBOL(<a>).\n<a>-x = 1.\nENDLOOP.\n<a>-x = 2.\n<a>-x = 3.\nENDMETHOD.\nMETHOD n.\nLOOP AT t ASSIGNING <b>.\nENDLOOP.\nUNASSIGN <b>.\n<b> = 1.\n<a>-x = 2.\nENDMETHOD.\n"
    files = spark.createDataFrame([("f", code, "F", "CLAS")], "filename string, source string, object string, object_type string")
    assert [tuple(r) for r in D.dangling_symbols(bundle.statements(files)).collect()] == [("f", 5, "<A>")]


def test_baseline_pair(tmp_path):
    D.write_baseline(str(tmp_path), "one", "1")
    D.write_baseline(str(tmp_path), "two", "2")
    read = lambda n: (tmp_path / n).read_text()
    assert (read("baseline.json"), read("baseline.sha256"), read("previous.baseline.json"), read("previous.baseline.sha256")) == ("two", "2", "one", "1")
    assert sorted(x.name for x in tmp_path.iterdir()) == ["baseline.json", "baseline.sha256", "previous.baseline.json", "previous.baseline.sha256"]


def test_back_edges():
    assert D.back_edges([1, 2, 3, 4], {(1, 2), (4, 1), (3, 1), (4, 2), (2, 3)}) == [(4, 1), (3, 1), (4, 2)]
    assert D.back_edges([1, 2, 3, 4], {(4, 1), (3, 1)}, 1) == [(4, 1)]
