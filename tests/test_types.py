"""Types of references and the methods behind calls."""

import pytest
from tessera.plans import types
from tessera.sources import bundle

FILES = {
    "zcl_base.clas.abap": "CLASS zcl_base DEFINITION.\nPUBLIC SECTION.\nMETHODS run.\nENDCLASS.\nCLASS zcl_base IMPLEMENTATION.\nMETHOD run.\nENDMETHOD.\nENDCLASS.\n",
    "zcl_kid.clas.abap": "CLASS zcl_kid DEFINITION INHERITING FROM zcl_base.\nENDCLASS.\nCLASS zcl_kid IMPLEMENTATION.\nMETHOD own.\nme->run( ).\nENDMETHOD.\nENDCLASS.\n",
    "zcl_use.clas.abap": """CLASS zcl_use DEFINITION.
DATA mo TYPE REF TO zcl_kid.
METHODS go IMPORTING io TYPE REF TO zcl_base iv TYPE i.
ENDCLASS.
CLASS zcl_use IMPLEMENTATION.
METHOD go.
DATA(lo) = NEW zcl_kid( ).
DATA(l2) = lo.
l3 = l2.
l3->own( ).
io->run( iv ).
nothing->run( ).
ENDMETHOD.
METHOD other.
mo->own( ).
DATA mo TYPE REF TO zcl_none.
lo->run( ).
ENDMETHOD.
METHOD third.
x = mo->run( ) + mo->own( ).
ENDMETHOD.
ENDCLASS.
""",
}


def test_edges(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
    got = {(r["source"], r["target"]) for r in types.instance_edges(bundle.statements(bundle.scan(spark, str(tmp_path)))).collect()}
    assert got == {("ZCL_KID", "ZCL_BASE.RUN"), ("ZCL_USE", "ZCL_KID.OWN"), ("ZCL_USE", "ZCL_BASE.RUN")}


def test_circles_end(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    declared, flows = table([("a", "K")], "var string, type string"), table([("a", "b"), ("b", "c"), ("c", "b"), ("c", "a"), ("d", "d")], "src string, dst string")
    assert {tuple(r) for r in types.spread(declared, flows).collect()} == {("a", "K"), ("b", "K"), ("c", "K")}
    up, methods = table([("K", "L"), ("L", "K"), ("M", "M")], "type string, super string"), table([("L", "m")], "type string, method string")
    calls = table([("s", "c", "m"), ("s", "c", "n"), ("s", "d", "m")], "source string, var string, method string")
    assert [tuple(r) for r in types.resolved(calls, declared, flows, up, methods).collect()] == [("s", "L", "m")]


@pytest.mark.parametrize("n", [0])
def test_empty(spark, n):
    empty = lambda *names: spark.createDataFrame([], ", ".join(f"{x} string" for x in names))
    assert types.resolved(empty("source", "var", "method"), empty("var", "type"), empty("src", "dst"), empty("type", "super"), empty("type", "method")).count() == n
