"""An append log of events as a sink of streams: a batch that is played again replaces itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def appender(path: str, stream: str = "events") -> Callable[[DataFrame, int], None]:
    """K7: for `writeStream.foreachBatch`: JSON lines below stream=<name>/batch=<id>.

    A batch has one folder that is its own, so what a stopped run left of it is replaced when the batch comes again, and never counted twice.
    Each stream that writes into one log needs a name of its own, and keeps it together with its checkpoint.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/stream={stream}/batch={number}")

    return write


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The events with the stream and batch they came by."""
    return spark.read.schema(f"{schema}, stream string, batch long").option("basePath", path).json(path)
