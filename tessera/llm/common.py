"""Shared pieces of the training-data operators.

Conventions kept by every operator here:

* a null text is an empty text; a null id is kept as a null id;
* repeated rows are separate rows unless the operator is about ids;
* an input may carry any further columns: operators select the ones they need by
  name first, so clashing extra names never reach a join;
* an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on: bounds a worker's temporary arrays.
STEP_BYTES = 1 << 20
#: A key with more than one HOT-th of all rows is joined by broadcast: there are fewer than HOT such keys.
HOT = 4096
#: Bytes of text of each class that a training sample holds at most.
TOTAL = 32 << 20
#: Small rows for which a task and a file are worth it.
FILE_ROWS = 1 << 14


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Unset, a temporary one serves where all is one process; on a cluster that is an error.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


_WRITTEN: dict[str, list[str]] = {}


def few(df: DataFrame, rows: int, each: int = FILE_ROWS) -> DataFrame:
    """df in no more parts than one for `each` of its `rows` rows; nothing is shuffled, and parts that are fewer stay.

    Without Hadoop's native library every file and folder of a task costs its executor a process (chmod).
    """
    return df.coalesce(max(1, -(-rows // each)))


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so a lost executor costs no recomputation.

    rows: about how many small rows there are, if that is known; they get no more files than few() leaves.
    """
    spark = df.sparkSession
    df = df if rows is None else few(df, rows)
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete what written() has left in this application; results that aren't saved yet can't be read afterwards."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), then the named further columns."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def id_type(df: DataFrame, name: str = "doc_id") -> str:
    """The type of the id column, for the schema of what an operator returns."""
    return df.schema[name].dataType.simpleString()


def fold(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id written as text, modulo 5; 0 marks the held-out rows."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 5, F.lit(0))


def hot_join(rows: DataFrame, right: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join with right(keys, k, ...), k being the rows of a key among the total: keys with many rows don't meet in one task."""
    hot = F.col("k") > max(1, total // HOT)
    large = F.broadcast(right.where(hot))
    return rows.join(large, keys).unionByName(rows.join(F.broadcast(right.where(hot).select(*keys)), keys, "left_anti").join(right.where(~hot), keys))


def steps(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about STEP_BYTES of text each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + STEP_BYTES, side="right")))
            yield batch.slice(at, to - at)
            at = to


def by_text(fn: Callable[[list[str]], pa.Array], kind: str, text: str = "text") -> F.Column:
    """A column of fn's values for the texts (null: empty), some STEP_BYTES of text at a time.

    Only the text goes to the workers and only fn's values come back; all other columns stay in the JVM.
    """

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            batch = pa.RecordBatch.from_arrays([column.fill_null("")], ["text"])
            yield pa.concat_arrays([fn(b.column(0).to_pylist()) for b in steps(iter([batch]))] or [fn([])])

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)(F.col(text))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one byte array and the n+1 offsets of its rows."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Weighted ridge logistic regression by damped Newton steps; the last column is the intercept."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + (penalty * v * v).sum() / 2)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        g = x.T @ (weight * (p - y)) + penalty * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(penalty)
        d, rate = np.linalg.solve(h, g), 1.0
        while rate > 1e-4 and loss(w - rate * d) > now:
            rate /= 2
        if rate <= 1e-4:
            break
        w, before = w - rate * d, now
        now = loss(w)
        if before - now < 1e-9 * max(1, abs(before)):
            break
    return w


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int, total: int = TOTAL) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """A bounded training sample: per class at most per_class labelled texts, the first by a hash of the id.

    Learns from rows outside the held-out fold only.  Texts above max_bytes are no training rows,
    and no class has more than `total` bytes of text: what the driver gets is bounded whatever the rows are like.
    Conflicting or repeated labels of one id: the largest counts.  Also returns all rows by class.
    """
    rated = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in rated.groupBy("y").agg(F.count("*").alias("n")).collect()}
    spark, picked = docs.sparkSession, []
    for y in sorted(counts):
        top = rated.where(F.col("y") == y).select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked += [(r["doc_id"], r["y"]) for r in top.collect()]
    if not picked:
        return [], counts
    ids = F.broadcast(spark.createDataFrame(picked, rated.select("doc_id", "y").schema))
    rows = written(texts(docs).where(F.octet_length("text").between(1, max_bytes)).join(ids, "doc_id").select("doc_id", "text", "y"), "sample")
    order = [F.xxhash64("doc_id"), "doc_id", "text"]
    running = F.sum(F.octet_length("text")).over(Window.partitionBy("y").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("total", running).where(F.col("total") <= total).select("doc_id", "text", "y").collect()
    return sorted({r["doc_id"]: (r["text"], r["y"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))}.values()), counts
