"""The statement scanner against one that goes character by character, and kinds against one pattern after the other."""

import random
import re

from tessera.sources import bundle


def plain(source):
    """Row and text of each statement, character by character."""
    out = []
    part = []
    prefix, row, start, quote, i, n = "", 1, 0, "", 0, len(source)

    def end():
        nonlocal part, start
        text = (prefix + " " + "".join(part)).strip() if prefix else "".join(part).strip()
        if "".join(part).strip():
            out.append((start or row, re.sub(r"\s+", " ", text)))
        part, start = [], 0

    line_start = True
    while i < n:
        c = source[i]
        if quote:
            part.append(c)
            if quote == "|" and c == "\\" and i + 1 < n:
                i += 1
                part.append(source[i])
            elif c == quote:
                quote = ""
        elif c == '"' or (line_start and c == "*"):
            while i < n and source[i] != "\n":
                i += 1
            continue
        elif c in "'`|":
            quote = c
            start = start or row
            part.append(c)
        elif c == "." and (i + 1 >= n or source[i + 1].isspace()):
            end()
            prefix = ""
        elif c == ":" and not prefix and (i + 1 >= n or source[i + 1].isspace()):
            prefix, part = "".join(part).strip(), []
        elif c == "," and prefix:
            end()
        else:
            if not c.isspace():
                start = start or row
            part.append(c)
        if c == "\n":
            row += 1
            line_start = True
            if quote in ("'", "`"):
                quote = ""  # literals end with their line
        else:
            line_start = False
        i += 1
    end()
    return out


def test_random_sources():
    rng = random.Random(7)
    parts = ["'", "`", "|", '"', "*", ".", ":", ",", "\n", " ", "\t", "a", "DATA", "x = 1", "SELECT", ". ", ": ", "{ b }", "\\|", "é", "->", "\n* c. d\n", "LOOP AT t."]
    for _ in range(20_000):
        source = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        assert [(r, t) for r, _, t in bundle.split_statements(source)] == plain(source), repr(source)


def test_kinds():
    texts = ["LOOP AT x", "loop at x", "DOx", "DO 3 TIMES", "WITH a AS ( b ) SELECT c", "CLASS z DEFINITION", "CLASS-METHODS m", "METHOD m", "INSERT INTO t VALUES x", "INSERT t FROM x INTO TABLE y", "x = 1", "a->b ?= c", "MODIFY ENTITIES", "MODIFY t FROM x", "DELETE lt", "BREAK-POINT", "nothing", "IF a = b"]
    for t in texts:
        want = next((k for p, k in bundle.KINDS if re.compile(p, re.IGNORECASE | re.DOTALL).match(t)), "Other")
        assert [k for _, k, _ in bundle.split_statements(t + ".")] == [want], t


def test_method_rules_split_the_sources_once(spark):
    """Every further use of the statements would split all sources again."""
    from tessera.plans import linter

    files = spark.createDataFrame([("Z", "CLAS", "z.clas.testclasses.abap", "CLASS z IMPLEMENTATION.\nMETHOD a.\nx = 1.\nENDMETHOD.\nENDCLASS.\nCLASS y DEFINITION.\nMETHODS a FOR TESTING.\nENDCLASS.")], "object string, object_type string, filename string, source string")
    out = linter.method_rules(bundle.statements(files))
    assert [(r["rule_id"], r["line"]) for r in out.collect()] == [("gf-hardy-test-no-assert", 2)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_code_of_a_small_table_is_dealt_out(spark):
    from tessera import queries_packs

    assert queries_packs.files(spark, "/root/testdata/sf0.001", [], ".abap", "PROG").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_joins_of_statements_are_no_guessed_broadcasts(spark):
    """The code is thousands of times larger than the parts that Spark's guess starts from."""
    from tessera import queries_packs
    from tessera.plans import packs

    both = queries_packs.files(spark, "/root/testdata/sf0.001", queries_packs.TESTS, ".clas.testclasses.abap", "CLAS").unionByName(queries_packs.files(spark, "/root/testdata/sf0.001", queries_packs.PUBLIC, ".clas.abap", "CLAS"))
    assert "Broadcast" not in packs.test_quality(bundle.statements(both))._jdf.queryExecution().executedPlan().toString()


def test_files_are_split_some_bytes_at_a_time():
    import pyarrow as pa

    rows = pa.RecordBatch.from_pydict({"source": ["x" * 300_000] * 20 + [None]})
    parts = list(bundle.slices(iter([rows, rows.slice(0, 0)])))
    assert sum(p.num_rows for p in parts) == 21 and max(p.num_rows for p in parts) <= 4
