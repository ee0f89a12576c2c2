"""Parsers of declarative artifacts on hand-written sources."""

import random
import time

import pytest
from tessera.sources import artifacts as A

VIEW = """@AccessControl.authorizationCheck: #NOT_REQUIRED
// define view entity zi_no
define root view entity ZI_Order as select from zorders
  association [0..*] to ZI_Item as _Item on $projection.Id = _Item.OrderId /* { */
{
  key order_id as Id,
  @Semantics.amount: 'x'
  cast( total as abap.dec(10,2) ) as Total,
  case when a = 1 then 'x, y' else 'z' end as Flag,
  status,
  _Item
}
"""
ITEM = "define view entity zi_item as select from zitems { name, key order_id as OrderId }"
BDEF = """managed with additional save implementation in class zbp_order unique;
define behavior for ZI_Order alias Order
authorization master ( instance, global )
{ create; update; field ( readonly ) id; association _Item { create; } action ( features : instance ) approve result [1] $self; }
define behavior for ZI_Item alias Item
lock dependent by _Order authorization dependent by _Order
{ update; delete; }
"""
DCL = """define role r { grant select on ZI_Order where (a) = aspect pfcg_auth( S_ORD, X );
grant select on ZI_Item where inheriting conditions from entity ZI_Order; grant select on ZI_Free; }"""


def test_view():
    v = A.view(VIEW)
    assert (v["entity"], v["source"], v["keys"]) == ("ZI_Order", "zorders", ["Id"])
    assert [f["name"] for f in v["fields"]] == ["Id", "Total", "Flag", "status"] and v["fields"][1]["type"] == "abap.dec(10,2)"
    assert v["associations"] == [{"name": "_Item", "target": "ZI_Item", "cardinality": "0..*"}]
    assert v["annotations"][0] == {"name": "AccessControl.authorizationCheck", "value": "#NOT_REQUIRED"}
    assert A.view("")["entity"] is None and A.view("define view entity x as select from y {")["fields"] == []


def test_behavior_and_access():
    b = A.behavior(BDEF)
    assert (b["implementation"], b["needs_saver"], b["class"]) == ("managed with additional save", True, "ZBP_ORDER")
    order, item = b["entities"]
    assert (order["entity"], order["authorization"], order["scope"], order["compositions"]) == ("ZI_ORDER", "master", ["INSTANCE", "GLOBAL"], ["ITEM"])
    assert "approve" in order["operations"] and (item["lock"], item["scope"]) == ("ORDER", ["_ORDER"])
    assert [(g["entity"], g["form"], g["objects"]) for g in A.access(DCL)] == [("ZI_ORDER", "pfcg_auth", ["S_ORD"]), ("ZI_ITEM", "inheriting", []), ("ZI_FREE", "unconditional", [])]
    assert A.behavior("projection;\ndefine behavior for C {}")["implementation"] == "projection" and A.behavior("")["entities"] == []


def test_comments_snippets_and_xml():
    assert A.without_comments("a 'x // y' // c\nb /* d\n */ e") == "a 'x // y' \nb  \n e"
    assert A.without_comments("* c\nw |a \"{ b }\\| \"|. \" d", '"', block=False, star=True) == "\nw |a \"{ b }\\| \"|. "
    assert A.snippet("  a  = 'b  c' &&\t`d e` \n") == "A = 'b  c' && `d e`"
    xml = '<r xmlns:q="u"><q:DD02V id="1"><TABNAME>ZT</TABNAME><X><Y/></X></q:DD02V></r>'
    assert A.elements(xml, "DD02V") == [{"@_id": "1", "TABNAME": "ZT"}] and A.elements("<a", "a") == []
    began = time.time()
    A.without_comments("/* " * 300_000), A.view("{" * 200_000), A.snippet("'" * 200_001)
    assert time.time() - began < 10


def test_split_top_round_trip():
    rng = random.Random(1)
    for _ in range(200):
        parts = ["".join(rng.choice(["x", "(a,b)", "[c,{d,e}]", "'f,g'", " "]) for _ in range(5)) + "z" for _ in range(rng.randrange(1, 5))]
        assert A.split_top(",".join(parts)) == parts


@pytest.fixture(scope="module")
def files(spark):
    rows = [("zi_order.ddls.asddls", "ZI_ORDER", VIEW), ("zi_item.ddls.asddls", "ZI_ITEM", ITEM), ("zi_order.bdef.asbdef", "ZI_ORDER", BDEF), ("empty", "E", None)]
    return spark.createDataFrame(rows, "filename string, object string, source string")


def test_tables(spark, files):
    views = A.parsed(files, "view", A.view, A.VIEW)
    assert views.count() == 4
    assert {(r["source"], r["target"]) for r in A.view_edges(views).collect()} == {("ZI_ORDER", "ZORDERS"), ("ZI_ORDER", "ZI_ITEM"), ("ZI_ITEM", "ZITEMS")}
    hits = {(r["object"], r["rule_id"]) for r in A.structure_findings(views).collect()}
    assert ("ZI_ORDER", "talos-cds-auth-not-required") in hits and ("ZI_ITEM", "talos-cds-field-order") in hits and ("ZI_ITEM", "talos-cds-missing-access-control") in hits
    assert ("ZI_ORDER", "talos-cds-field-order") not in hits
    assert [tuple(r) for r in A.lost_reciprocals(views).collect()] == [("ZI_ORDER", "ZI_ITEM")]
    b = A.parsed(files.where("filename like '%asbdef'"), "behavior", A.behavior, A.BEHAVIOR)
    assert {(r["target"], r["kind"]) for r in A.behavior_edges(b).collect()} == {("ZI_ORDER", "consumes-cds"), ("ZI_ITEM", "consumes-cds"), ("ZBP_ORDER", "calls")}
    assert A.parsed(files, "grants", A.access, A.ACCESS).count() == 4
    xml = spark.createDataFrame([("<a><T><N>1</N></T></a>",)], "source string")
    assert A.parsed(xml, "t", lambda s: A.elements(s, "T"), A.XML).first()["t"] == [{"N": "1"}]


def test_listing_and_csv(spark, tmp_path):
    docs = ['{"objects": [{"name": "A", "type": "CLAS"}]}', '{"items": [{"OBJECT_NAME": "B", "OBJECT_TYPE": "PROG"}]}', '{"nodes": [{"objectName": "C"}]}', "broken", "{}"]
    got = A.listing(spark, spark.createDataFrame([(d,) for d in docs], "value string")).collect()
    assert {tuple(r) for r in got} == {("A", "CLAS"), ("B", "PROG"), ("C", None)}
    (tmp_path / "u.csv").write_text("OBJECT_TYPE;OBJECT_NAME;EXEC_COUNT;LAST_USED\nPROG;ZA;12;20260231\nPROG;ZB;1e3;20260228\n")
    assert [(r["object_name"], r["exec_count"], r["last_used"]) for r in A.usage_csv(spark, str(tmp_path / "u.csv")).collect()] == [("ZA", 12, None), ("ZB", None, "2026-02-28")]
