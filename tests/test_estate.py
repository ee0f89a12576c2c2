"""The source front end, rules, edges and the streaming state machine on hand-written inputs."""

import pytest
from tessera.operators import graph
from tessera.plans import rules
from tessera.sources import bundle
from tessera.streaming import runs

CODE = """* first line is a comment. LOOP AT x.
CLASS zcl_a DEFINITION INHERITING FROM zcl_base.
ENDCLASS.
FORM f.
  DATA: a TYPE i, b TYPE string VALUE 'x. y'. " LOOP AT z.
  SELECT SINGLE * FROM mara INTO ls.
  LOOP AT lt INTO ls.
    SELECT * FROM vbak INTO TABLE lt2 WHERE vbeln = ls-vbeln.
    IF ls-a = 1. COMMIT WORK. ENDIF.
  ENDLOOP.
  SELECT * FROM ekko INTO ls WHERE a = 1.
    WRITE |a. { b } c\\||.
  ENDSELECT.
  UPDATE zorders SET a = 1.
  DELETE FROM zlog WHERE a = 1.
  CALL FUNCTION 'ENQUEUE_EZ'.
  AUTHORITY-CHECK OBJECT 'S_TCODE' ID 'TCD' FIELD x.
  a = 1.
ENDFORM.
"""


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("bundle")
    (d / "sub").mkdir()
    (d / "zcl_a.clas.abap").write_bytes(CODE.replace("\n", "\r\n").encode())
    (d / "sub" / "zi_x.ddls.asddls").write_text("define view entity zi_x as select from mara { key matnr }")
    (d / "readme.md").write_text("no source")
    return bundle.scan(spark, str(d))


def test_scan(files):
    assert {(r["filename"], r["object"], r["object_type"]) for r in files.collect()} == {("zcl_a.clas.abap", "ZCL_A", "CLAS"), ("zi_x.ddls.asddls", "ZI_X", "DDLS")}
    small, notes = bundle.admitted(files, 100)
    assert small.count() == 1 and notes.count() == 1
    assert files.where("contains(source, '\\r')").count() == 0


def test_statements(files):
    rows = [(r["row"], r["kind"]) for r in bundle.statements(files).where("object = 'ZCL_A'").orderBy("seq").collect()]
    assert rows[:6] == [(2, "ClassDefinition"), (3, "EndClass"), (4, "Form"), (5, "Data"), (5, "Data"), (6, "Select")]
    kinds = [k for _, k in rows]
    assert kinds.count("SelectLoop") == 1 and kinds.count("Loop") == 1 and kinds.count("Select") == 2 and "Write" in kinds


def test_long_sources_take_linear_time():
    import time

    began = time.time()
    bundle.split_statements("x = '" + "a." * 200_000 + "\n" + "/* " * 100_000 + ".\n" + "y = 1. " * 20_000)
    assert time.time() - began < 10


def test_rules(files):
    s = bundle.statements(files)
    hits = {(r["rule_id"], r["line"]) for r in rules.findings(s).collect()}
    assert {("talos-select-in-loop", 8), ("talos-commit-in-loop", 9), ("talos-select-single-no-where", 6), ("talos-endselect-no-package-size", 11), ("talos-enqueue-no-wait", 16), ("gf-cloud-no-write", 12), ("talos-cloud-005-class-final-abstract", 2), ("gf-clean-no-form", 4)} <= hits
    assert ("talos-select-in-loop", 6) not in hits and ("talos-select-in-loop", 11) not in hits
    assert rules.unchecked_authority(s).count() == 1


def test_edges(files):
    got = {(r["target"], r["kind"], r["access"]) for r in rules.edges(bundle.statements(files)).collect()}
    assert {("MARA", "uses-table", "read"), ("ZORDERS", "uses-table", "write"), ("ZLOG", "uses-table", "write"), ("ENQUEUE_EZ", "call-function", None), ("S_TCODE", "authority-check", None), ("ZCL_BASE", "inherits", None)} <= got
    assert [r["cyclomatic"] for r in rules.cyclomatic(bundle.statements(files)).collect()] == [4]


def test_levels_reject_cycles(spark):
    with pytest.raises(ValueError):
        graph.levels(spark.createDataFrame([("a", "b"), ("b", "a")], "source string, target string"))


def test_strong_components_random(spark):
    import random

    rng = random.Random(9)
    e = [(rng.randrange(40), rng.randrange(40)) for _ in range(60)]
    reach = {x: {x} for p in e for x in p}
    for _ in range(40):
        for a, b in e:
            reach[a] |= reach[b]
    want = {x: min(y for y in reach[x] if x in reach[y]) for x in reach}
    assert {r["id"]: r["root"] for r in graph.strong_components(spark.createDataFrame(e, "a long, b long")).collect()} == want


def test_state_machine():
    now = (0, "", "PENDING")
    for p in (False, False, True, False):
        now = runs.step(*now, p)
    assert now == (2, "FFPF", "COMPLETE")
    now = (0, "", "PENDING")
    for _ in range(4):
        now = runs.step(*now, False)
    assert now == (3, "FFFF", "PARKED")


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("n1", 1, False), ("n1", 2, True), ("n2", 1, False)], "node string, at long, passed boolean").write.parquet(src)
    stream = runs.node_states(spark.readStream.schema("node string, at long, passed boolean").parquet(src))
    q = stream.writeStream.outputMode("update").format("memory").queryName("node_states").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["node"], r["status"], r["attempts"]) for r in spark.table("node_states").collect()} == {("n1", "COMPLETE", 1), ("n2", "PENDING", 1)}


def test_frontier_is_the_greedy_choice(spark):
    import random

    from pyspark.sql import functions as F
    from tessera.plans import schedule

    rng = random.Random(4)
    ids = list(range(60))
    rank = {i: rng.randrange(5) for i in ids}
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(50)]
    keys = [(i, rng.randrange(15)) for i in ids]
    taken: list[int] = []
    for i in sorted(ids, key=lambda i: (rank[i], i)):
        near = {b for a, b in links if a == i} | {a for a, b in links if b == i}
        if not near - {i} & set(taken) and not {k for n, k in keys if n == i} & {k for n, k in keys if n in taken}:
            taken.append(i)
    args = spark.createDataFrame([(i, rank[i]) for i in ids], "id long, r long"), spark.createDataFrame(links, "source long, target long"), spark.createDataFrame(keys, "id long, key long")
    assert {r["id"] for r in schedule.frontier(*args, [F.col("r")]).collect()} == set(taken)
    assert {r["id"] for r in schedule.frontier(*args, [F.col("r")], cap=5).collect()} == set(taken[:5])


def test_seed_rules(spark):
    rows = [(s.id, "CLAS", f"{s.id}:{kind}", text) for s in rules.SEEDS for kind, text in (("hit", s.example), ("miss", s.counter))]
    files = spark.createDataFrame(rows, "object string, object_type string, file string, source string")
    got = {(r["rule_id"], r["file"]) for r in rules.seed_findings(files).collect()}
    for s in rules.SEEDS:
        assert (s.id, f"{s.id}:hit") in got and (s.id, f"{s.id}:miss") not in got, s.id


def test_loop_patterns(spark):
    code = "LOOP AT lt INTO ls.\nDELETE lt WHERE a = 1.\nlo->send( ).\nlv = lv + 1.\nCALL FUNCTION 'FISCAL_YEAR'.\nENDLOOP.\nDATA lt TYPE TABLE OF x WITH KEY a WITH KEY b WITH KEY c WITH KEY d.\nlv = lv + 1.\n"
    files = spark.createDataFrame([("z.prog.abap", code, "Z", "PROG")], "filename string, source string, object string, object_type string")
    got = [(r["rule_id"], r["line"]) for r in rules.findings(bundle.statements(files)).collect()]
    assert {("talos-itab-fulltable-op-in-loop", 2), ("talos-sync-http-in-loop", 3), ("talos-window-function-candidate", 4), ("talos-scalar-fn-in-loop", 5), ("talos-excessive-secondary-keys", 7)} <= set(got)
    assert ("talos-window-function-candidate", 8) not in got


def test_escalations(spark, tmp_path):
    from tessera.streaming import escalations

    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, "raise"), ("a", 2, "raise"), ("a", 3, "resolve"), ("a", 4, "raise"), ("b", 1, "resolve"), ("b", 2, "raise")], "id string, at long, action string").write.parquet(src)
    stream = escalations.escalations(spark.readStream.schema("id string, at long, action string").parquet(src), None)
    q = stream.writeStream.outputMode("append").format("memory").queryName("escalated").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    ended = q.awaitTermination(60)
    q.stop()
    assert ended
    assert {tuple(r) for r in spark.table("escalated").collect()} == {("a", 1, "OPEN"), ("a", 3, "RESOLVED"), ("a", 4, "OPEN"), ("b", 2, "OPEN")}
