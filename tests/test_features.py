"""Features, diffs, native SQL, call edges and plan assembly on hand-written inputs."""

import pytest
from tessera.plans import features as P
from tessera.sources import bundle

CODE = """AUTHORITY-CHECK OBJECT 'A1' ID 'X' FIELD y.
IF sy-subrc <> 0. RETURN. ENDIF.
AUTHORITY-CHECK OBJECT 'A2' ID 'X' FIELD y.
COMMIT WORK.
IF sy-subrc = 0. ENDIF.
zcl_b=>run( ).
zcl_unknown=>go( ).
PERFORM f IN PROGRAM zb.
EXEC SQL.
SELECT a FROM ztab WHERE x = 1.
DELETE ztwo.
SELECT a FROM s.ztab.
ENDEXEC.
SELECT * FROM mara INTO TABLE lt.
"""


@pytest.fixture(scope="module")
def statements(spark):
    rows = [("za.prog.abap", CODE, "ZA", "PROG")]
    return bundle.statements(spark.createDataFrame(rows, "filename string, source string, object string, object_type string"))


def test_features(spark, statements):
    r = P.imperative(statements).first()
    assert r["auth"] == ["A1:true", "A2:false"] and (r["commit_work"], r["max_nesting"]) == (1, 1)
    assert {tuple(x) for x in P.native_edges(statements).collect()} == {("ZA", "ZTAB", "read"), ("ZA", "ZTWO", "write")}
    known = spark.createDataFrame([("ZA",), ("ZCL_B",), ("ZB",)], "object string")
    assert {tuple(x) for x in P.call_edges(statements, known).collect()} == {("ZA", "ZCL_B.RUN", "call-method"), ("ZA", "ZA.GO", "call-method"), ("ZA", "ZB.F", "calls")}


def test_diff(spark):
    kind = "object string, auth array<string>, kinds array<string>, client_specified long, exception_paths long, cfg_branches long, max_nesting long, artifacts long"
    before = spark.createDataFrame([("P", ["A1:true"], ["If:1"], 0, 2, 3, 1, 0), ("Q", ["A:true"], [], 0, 2, 0, 0, 0)], kind)
    after = spark.createDataFrame([("P", [], ["If:2"], 1, 1, 3, 1, 0), ("Q", ["A:false"], [], 0, 0, 0, 0, 2)], kind)
    p, q = P.bundle_diff(before, after, "object").orderBy("object").collect()
    assert p["auth_vanished"] and p["auth_object_changed"] and p["exception_path_dropped"] and p["client_specified_delta"] and p["statement_kind_changes"] == 2 and not p["cfg_branch_regression"]
    assert q["paradigm_shift"] and not q["exception_path_dropped"] and not q["auth_object_changed"]


def test_assembly_and_contracts(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 5)], "a long, b long")
    plan = P.assembled(e, spark.createDataFrame([(1,), (2,), (4,), (5,)], "id long"), spark.createDataFrame([(1, 2, 7, False), (2, 0, 1, True), (4, 3, 0, False)], "id long, rank int, blast int, sealed boolean"))
    assert {r["id"]: (r["members"], r["rank"], r["blast"], r["sealed"], r["dependencies"]) for r in plan.collect()} == {1: ([1, 2], 0, 7, True, [4]), 4: ([4], 3, 0, False, [5]), 5: ([5], None, None, None, [])}
    patterns = spark.createDataFrame([("s", ["x", "y"], ["i"])], "shape string, components array<string>, invariants array<string>")
    nodes = lambda shape: spark.createDataFrame([("n", "Z", "rebuild", shape)], "id string, object string, disposition string, shape string")
    one, two = P.contract(nodes("s"), patterns).first(), P.contract(nodes("s"), patterns).first()
    assert one["objects"] == 2 and one["contract_hash"] == two["contract_hash"]
    with pytest.raises(Exception, match="outside the patterns"):
        P.contract(nodes("t"), patterns).collect()


def test_live_files_and_rules(spark, tmp_path):
    rows = [("/ACME/A", "CLAS", "x"), ("B", "XXXX", "x"), ("C", "PROG", " ")]
    files, skipped = P.live_files(spark.createDataFrame(rows, "name string, type string, source string"))
    assert [r["filename"] for r in files.collect()] == ["#acme#a.clas.abap"] and {tuple(r) for r in skipped.collect()} == {("B", "unsupported type"), ("C", "empty source")}
    (tmp_path / "r.json").write_text('[{"id": "a", "pattern": "x"}, {"id": "b"}]')
    (tmp_path / "bad.json").write_text("nothing")
    assert P.rule_rows(spark, str(tmp_path / "r.json")).count() == 2 and P.rule_rows(spark, str(tmp_path / "bad.json")).count() == 0
    assert P.config_text({"b": 1, "a": [2]}) == '{"a":[2],"b":1}'


def test_cache_and_bundle(spark, statements):
    files = spark.createDataFrame([("ZA", CODE), ("ZV", "view"), ("ZN", None)], "object string, source string")
    none = spark.createDataFrame([], "object string, source_hash string, n long")
    hits, misses = P.by_cache(files, none)
    assert hits.count() == 0 and misses.count() == 3
    cache = misses.select("object", "source_hash").limit(3).selectExpr("object", "source_hash", "1L as n")
    changed = spark.createDataFrame([("ZA", CODE), ("ZV", "new view")], "object string, source string")
    hits, misses = P.by_cache(changed, cache)
    assert [r["object"] for r in hits.collect()] == ["ZA"] and [r["object"] for r in misses.collect()] == ["ZV"]
    decl = spark.createDataFrame([("ZV", 2, ["E"])], "object string, artifacts long, auth array<string>")
    rows = {r["object"]: r for r in P.bundle(P.imperative(statements), decl, P.by_cache(files, none)[1]).collect()}
    assert (rows["ZA"]["commit_work"], rows["ZA"]["artifacts"], rows["ZV"]["auth"], rows["ZN"]["kinds"]) == (1, 0, ["E"], [])


def test_check_only_document(spark):
    f = spark.createDataFrame([("A", "p1"), ("A", "p3"), ("B", "p3"), ("C", "p2")], "object string, severity string")
    assert tuple(P.check_only_document(f).first())[:4] == (3, 1, 1, 33.0)
    assert tuple(P.check_only_document(f.limit(0)).first())[:4] == (0, 0, 0, 100.0)
