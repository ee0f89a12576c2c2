"""Data source, sink, table function and log sink."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F
from tessera.sources import bundle as B
from tessera.sources import formats
from tessera.streaming import logs

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark, tmp_path):
    formats.register(spark)
    d = tmp_path / "in"
    (d / "sub").mkdir(parents=True)
    (d / "zcl_a.clas.abap").write_bytes(b"DATA a.\r\nWRITE a.\rWRITE 'x.'.")
    (d / "sub" / "zi_x.ddls.asddls").write_text("define view zi_x")
    (d / "sub" / "empty.abap").write_text("")
    (d / "notes.txt").write_text("no source")
    (d / "_hidden.abap").write_text("WRITE 1.")
    return str(d)


def test_reader_equals_scan(spark, folder):
    got = spark.read.format("tessera-sources").load(folder)
    cols = ["filename", "source", "object", "object_type"]
    assert sorted(map(tuple, got.where("size > 0").select(cols).collect())) == sorted(map(tuple, B.scan(spark, folder).select(cols).collect()))
    assert got.count() == 3
    assert spark.read.format("tessera-sources").option("partitionbytes", "1").load(folder).rdd.getNumPartitions() == 3
    assert spark.read.format("tessera-sources").load(os.path.join(folder, "nothing")).count() == 0


def test_stream_takes_new_and_changed_files(spark, folder, tmp_path):
    seen = []

    def run():
        stream = spark.readStream.format("tessera-sources").option("settledms", "0").load(folder)
        q = stream.writeStream.foreachBatch(lambda df, i: seen.append(sorted(r["filename"] for r in df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    run()
    time.sleep(0.05)
    with open(os.path.join(folder, "new.abap"), "w") as f:
        f.write("WRITE 2.")
    os.utime(os.path.join(folder, "zcl_a.clas.abap"))
    run()
    run()
    assert [s for s in seen if s] == [["empty.abap", "zcl_a.clas.abap", "zi_x.ddls.asddls"], ["new.abap", "zcl_a.clas.abap"]]


def test_writer_refuses_invalid_documents(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    docs = spark.range(0, 100, 1, 4).select("id", F.when(F.col("id") == 3, F.lit(None)).otherwise("x").alias("name"), F.array().cast("array<string>").alias("errors"))
    docs.write.format("tessera-documents").mode("append").save(out)
    lines = [json.loads(x) for n in os.listdir(out) if n.endswith(".json") for x in open(os.path.join(out, n))]
    assert sorted(x["id"] for x in lines) == list(range(100)) and all("errors" not in x for x in lines) and {"id": 3} in lines
    before = sorted(os.listdir(out))
    bad = docs.withColumn("errors", F.when(F.col("id") == 77, F.array(F.lit("no name"))).otherwise(F.array().cast("array<string>")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="1 of 100 documents are invalid, first: no name"):
            bad.write.format("tessera-documents").mode(mode).save(out)
        assert sorted(os.listdir(out)) == before
    docs.where("id < 5").write.format("tessera-documents").mode("overwrite").save(out)
    assert spark.read.json(out).count() == 5


def test_statements_in_sql_equal_the_batch_parser(spark, folder):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").cast("string").alias("filename"), F.col("text").alias("source"))
    docs = docs.union(spark.createDataFrame([("null", None), ("empty", ""), ("same", "a = 1. WRITE: b, c.")], "filename string, source string"))
    docs.createOrReplaceTempView("sources_")
    got = spark.sql("SELECT f.filename, s.seq, s.row, s.kind, s.text FROM sources_ f, LATERAL statements_of(f.source) s")
    want = B.statements(docs.withColumns({"object": F.lit("o"), "object_type": F.lit("t")})).select("filename", "seq", "row", "kind", "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert spark.sql("SELECT s.text FROM sources_ f, LATERAL statements_of(f.source, 'Write') s WHERE f.filename = 'same'").count() == 2
    with pytest.raises(Exception, match="takes a string"):
        spark.sql("SELECT * FROM statements_of(1)").collect()


def test_a_batch_played_again_adds_nothing(spark, tmp_path):
    log, write = str(tmp_path / "log"), logs.appender(str(tmp_path / "log"), "a")
    for number, ids in ((0, [1, 2]), (1, [3]), (1, [3]), (0, [1, 2])):
        write(spark.createDataFrame([(i,) for i in ids], "id long"), number)
    logs.appender(log, "b")(spark.createDataFrame([(9,)], "id long"), 0)
    assert sorted(map(tuple, logs.read_log(spark, log, "id long").collect())) == [(1, "a", 0), (2, "a", 0), (3, "a", 1), (9, "b", 0)]


def test_a_stopped_stream_goes_on(spark, tmp_path):
    src, log = tmp_path / "src", str(tmp_path / "log2")
    src.mkdir()
    stops = [True]

    def fails_late(df, i):
        logs.appender(log)(df, i)
        if stops.pop() if stops else False:
            raise RuntimeError("lost after the write")

    for i in range(2):
        (src / f"{i}.json").write_text(json.dumps({"id": i}))
        q = spark.readStream.schema("id long").json(str(src)).writeStream.foreachBatch(fails_late).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
        try:
            q.awaitTermination(120)
        except Exception as e:
            assert i == 0 and "lost after the write" in str(e)
    assert sorted(r["id"] for r in logs.read_log(spark, log, "id long").collect()) == [0, 1]
