"""Versions of parsed sources."""

import pytest
from pyspark.sql import functions as F
from tessera.sources import bundle as B
from tessera.sources import versions as V


def bundle(spark, texts):
    return spark.createDataFrame([(n, t, n.upper(), "PROG") for n, t in texts.items()], "filename string, source string, object string, object_type string")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def store(tmp_path):
    return str(tmp_path / "store")


TEXTS = {"a": "WRITE 1.", "b": "DATA x. WRITE x.", "c": "WRITE 1.", "empty": "", "null": None}


def test_only_new_texts_are_parsed(spark, store):
    assert V.current(spark, store) == 0 and V.parsed(spark, store).count() == 0
    assert V.refresh(spark, bundle(spark, TEXTS), store) == V.Outcome(1, 5, 3, 0, 0)
    later = {**TEXTS, "b": "DATA y.", "d": "WRITE 1."}
    del later["c"]
    files = bundle(spark, later)
    assert V.refresh(spark, files, store) == V.Outcome(2, 5, 1, 4, 1)
    assert spark.read.parquet(f"{store}/parsed/added=2").select("digest").distinct().count() == 1
    assert rows(V.parsed(spark, store)) == rows(B.statements(files))
    assert rows(V.parsed(spark, store, 1)) == rows(B.statements(bundle(spark, TEXTS)))


def test_a_stopped_run_leaves_the_version_before(spark, store):
    files = bundle(spark, TEXTS)
    V.refresh(spark, files, store)
    late = F.when(F.col("filename") == "b", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.concat("source", F.lit(" WRITE 2.")))
    with pytest.raises(Exception, match="lost"):
        V.refresh(spark, files.withColumn("source", late), store)
    assert V.current(spark, store) == 1 and rows(V.parsed(spark, store)) == rows(B.statements(files))
    assert V.refresh(spark, files.where("filename <> 'a'"), store) == V.Outcome(2, 4, 0, 4, 1)


def test_stopped_before_the_pointer_moves(spark, store, monkeypatch):
    V.refresh(spark, bundle(spark, TEXTS), store)
    changed = bundle(spark, {**TEXTS, "a": "WRITE 3."})
    with monkeypatch.context() as m:
        m.setattr(V, "_point", lambda *a: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            V.refresh(spark, changed, store)
    assert V.manifest(spark, store).where("added = 2").count() == 0
    assert V.refresh(spark, changed, store).parsed == 1
    assert rows(V.parsed(spark, store)) == rows(B.statements(changed))


def test_compact_and_empty(spark, store):
    assert V.refresh(spark, bundle(spark, TEXTS).where("false"), store) == V.Outcome(1, 0, 0, 0, 0)
    assert V.compact(spark, store) == 1
    V.refresh(spark, bundle(spark, TEXTS), store)
    V.refresh(spark, bundle(spark, {**TEXTS, "a": "WRITE 3."}), store)
    before = rows(V.parsed(spark, store))
    assert V.compact(spark, store) == 4 and rows(V.parsed(spark, store)) == before
    assert [r["added"] for r in V.manifest(spark, store).select("added").distinct().collect()] == [4]
