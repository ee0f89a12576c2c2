"""Thousands of rules at once against one expression after the other."""

import re

import pytest
from tessera.operators import patterns
from tessera.queries_rest import many_rules


@pytest.mark.parametrize(("pattern", "want"), [
    ("abc", {"abc"}), (r"\bselect\s+from\b", {"select"}), ("a|b", None), ("(foo|ba[rz])x", {"foo", "ba"}), ("(foo)?bar+", {"ba"}), ("(abc){2,}", {"abc"}), ("[a-z]+", None),
    ("(?i)Select", {"select"}), ("x(?=abcdef)yz", {"yz"}), (r"\Qa.b\E", None), ("(", None), ("(?iu)straße", None), ("ab|", None), (r"^\s*EXEC\s+SQL", {"exec"}), ("ab.cdef", {"cdef"}), ("(?!abc)de", {"de"}), (r"a\.b\z", {"a.b"}),
])
def test_factors(pattern, want):
    assert patterns.factors(pattern) == (frozenset(want) if want else None)


def test_factors_are_in_every_match():
    texts = ["SELECT * FROM x", "foobar", "ba", "barx bazx foox", "abcabcabc", "yz", "", "a.b", "exec  sql", "de abc", "Ünïcode SELECT", "x|y"]
    for p in ["(foo|ba[rz])x", "(foo)?bar+", "(abc){2,}", "(?i)select", "(?i)exec\\s+sql", "ab|ba", "(?:fo{2}|se)b?", "x\\|y", "[xs].?y|abca", "(?i)(ünï)code"]:
        best = patterns.factors(p)
        for t in texts:
            assert not (re.search(p, t) and best) or any(f in patterns.folded(t) for f in best), (p, t)


def test_against_one_by_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()] + [(-1, None), (-2, ""), (-3, "* the th\n the th er.\n\"the\nTHERE, (there)\r\n\n"), (-4, "x" * 50_000 + " there."), (-3, "there.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rules = many_rules(150) + [("caps", "[A-Z][A-Z][A-Z]"), ("any", "(?i)THER?E"), ("two", "(ing|ion)[ ,.]"), ("end", "er\\.?$")]
    got = sorted(tuple(r) for r in patterns.scanned(df, rules).collect())
    want = []
    for i, t in rows:
        for n, line in enumerate(t.split("\n") if t is not None else [], 1):
            if not re.match(r'\s*[*"]', line):
                want += [(i, n, name) for name, p in rules if re.search(p, line)]
    assert got == sorted(want) and len({r for *_, r in got}) > 40
    assert patterns.scanned(df.limit(0), rules).count() == 0 and patterns.scanned(df, []).count() == 0
    starred = patterns.scanned(df.where("doc_id = -3"), [("the", "the")], comments=True)
    assert sorted(tuple(r) for r in starred.collect()) == [(-3, 1, "the"), (-3, 1, "the"), (-3, 2, "the"), (-3, 3, "the"), (-3, 4, "the")]


def test_plan_reads_text_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = patterns.scanned(docs, many_rules(2000))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
