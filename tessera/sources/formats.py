"""A folder of sources as a Spark data source, validated documents as a sink, and the statement parser as a table function.

`register(spark)` makes them known:

* `spark.read.format("tessera-sources").load(folder)`: filename, source, object, object_type, size of every source file, empty ones too (`bundle.scan` leaves those out); files are dealt to partitions
  of about `partitionbytes` (64 MB), so many small files are few tasks, and one larger than that is a task of its own.
* `spark.readStream.format("tessera-sources").load(folder)`: the files that are new or changed since the last batch.
* `df.write.format("tessera-documents").save(folder)`: JSON lines.  A row whose `errors` (array of strings) isn't empty refuses the whole write: no file stays.
* `LATERAL statements_of(source)`: seq, row, kind, text of each statement.

The folder must be mounted alike on the driver and all workers.  For object stores use `bundle.scan`, which reads by the file systems that Spark knows.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tessera.sources.bundle import SUFFIXES, split_statements

SCHEMA = "filename string, source string, object string, object_type string, size long"
#: Bytes of sources that one task reads, unless a single file has more.
TASK_BYTES = 64 << 20
#: Nanoseconds that a file must have rested before a stream takes it: clocks tick more slowly than files change.
SETTLED = 2_000_000_000


def _listed(folder: str) -> list[tuple[int, str, int]]:
    """Time of change, path and size of every source file below a folder, in order; hidden files and folders are left out, as Spark does."""
    out = []
    for top, below, names in os.walk(folder):
        below[:] = [b for b in below if not b.startswith(("_", "."))]
        for name in names:
            if name.endswith(SUFFIXES) and not name.startswith(("_", ".")):
                path = os.path.join(top, name)
                try:
                    stat = os.stat(path)
                except FileNotFoundError:
                    continue  # gone since the folder was listed
                out.append((stat.st_mtime_ns, path, stat.st_size))
    return sorted(out)


@dataclass
class Files(InputPartition):
    paths: list[str]


def _dealt(files: list[tuple[int, str, int]], task_bytes: int) -> list[Files]:
    out: list[Files] = []
    held = task_bytes + 1
    for _, path, size in files:
        if held + size > task_bytes:
            out.append(Files([]))
            held = 0
        out[-1].paths.append(path)
        held += size
    return out


def _rows(part: Files) -> Iterator[tuple[str, str, str, str, int]]:
    for path in part.paths:
        raw = Path(path).read_bytes()
        name = os.path.basename(path)
        bits = name.split(".")
        yield name, re.sub(r"\r\n?", "\n", raw.decode("utf-8", "replace")), bits[0].upper(), bits[1].upper() if len(bits) > 1 else "", len(raw)


class _Reader(DataSourceReader):
    def __init__(self, folder: str, task_bytes: int) -> None:
        self.folder, self.task_bytes = folder, task_bytes

    def partitions(self) -> list[Files]:
        return _dealt(_listed(self.folder), self.task_bytes) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(partition)


class _Stream(DataSourceStreamReader):
    """An offset is the time of the youngest file taken; files that change while they rest in one batch come once more in the next."""

    def __init__(self, folder: str, task_bytes: int, settled: int) -> None:
        self.folder, self.task_bytes, self.settled = folder, task_bytes, settled
        self.at = -1

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        import time

        rested = time.time_ns() - self.settled
        self.at = max([self.at, *[at for at, _, _ in _listed(self.folder) if at <= rested]])
        return {"at": self.at}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return _dealt([f for f in _listed(self.folder) if start["at"] < f[0] <= end["at"]], self.task_bytes) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(partition)

    def commit(self, end: dict) -> None:
        pass


class Sources(DataSource):
    """Options: path; partitionbytes; settledms (streams only)."""

    @classmethod
    def name(cls) -> str:
        return "tessera-sources"

    def schema(self) -> str:
        return SCHEMA

    def _bytes(self) -> int:
        return int(self.options.get("partitionbytes", TASK_BYTES))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self._bytes())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options["path"], self._bytes(), int(self.options.get("settledms", SETTLED // 1_000_000)) * 1_000_000)


@dataclass
class Staged(WriterCommitMessage):
    path: str | None
    rows: int
    invalid: int
    first: str


class _Writer(DataSourceWriter):
    """Tasks write beside the target; the driver moves the files of the attempts that count, once no row of any task is invalid."""

    def __init__(self, folder: str, columns: list[str], overwrite: bool) -> None:
        self.folder, self.columns, self.overwrite = folder, columns, overwrite
        self.stage = os.path.join(folder, f"_staged-{uuid.uuid4().hex}")

    def write(self, rows: Iterator[Row]) -> Staged:
        task = TaskContext.get()
        os.makedirs(self.stage, exist_ok=True)
        path = os.path.join(self.stage, f"part-{task.partitionId():05d}-{task.taskAttemptId()}.json")
        kept = [c for c in self.columns if c != "errors"]
        n = invalid = 0
        first = ""
        with open(path, "w", encoding="utf-8") as f:
            for row in rows:
                errors = row["errors"] if "errors" in self.columns else None
                n += 1
                if errors:
                    invalid += 1
                    first = first or "; ".join(errors)
                elif not invalid:
                    values = row.asDict(recursive=True)
                    f.write(json.dumps({c: values[c] for c in kept if values[c] is not None}, ensure_ascii=False, default=str) + "\n")
        if invalid or not n:
            os.unlink(path)
        return Staged(None if invalid or not n else path, n, invalid, first)

    def commit(self, messages: list[Staged | None]) -> None:
        done = [m for m in messages if m is not None]
        invalid = sum(m.invalid for m in done)
        if invalid:
            shutil.rmtree(self.stage, ignore_errors=True)
            raise ValueError(f"{invalid} of {sum(m.rows for m in done)} documents are invalid, first: {next(m.first for m in done if m.invalid)}")
        before = [p for p in Path(self.folder).glob("*.json") if p.is_file()] if self.overwrite else []
        tag = uuid.uuid4().hex[:8]
        os.makedirs(self.folder, exist_ok=True)
        for m in done:
            if m.path:
                os.replace(m.path, os.path.join(self.folder, f"{Path(m.path).stem}-{tag}.json"))
        for p in before:
            p.unlink()
        Path(self.folder, "_SUCCESS").touch()
        shutil.rmtree(self.stage, ignore_errors=True)

    def abort(self, messages: list[Staged | None]) -> None:
        shutil.rmtree(self.stage, ignore_errors=True)


class Documents(DataSource):
    """Option: path.  Nulls are left out of the JSON, as Spark's own writer does; `errors` is never written."""

    @classmethod
    def name(cls) -> str:
        return "tessera-documents"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema.fieldNames(), overwrite)


class StatementsOf:
    """One row a statement; an optional second argument, a constant, names the one kind that is wanted.  A null source has no statements."""

    @staticmethod
    def analyze(source: AnalyzeArgument, kind: AnalyzeArgument | None = None) -> AnalyzeResult:
        if source.dataType.typeName() != "string":
            raise ValueError("statements_of takes a string")
        if kind is not None and not kind.isConstantExpression:
            raise ValueError("the kind of statements_of must be a constant")
        return AnalyzeResult(schema=StructType().add("seq", LongType()).add("row", LongType()).add("kind", StringType()).add("text", StringType()))

    def eval(self, source: str | None, kind: str | None = None) -> Iterator[tuple]:
        for i, (row, what, text) in enumerate(split_statements(source or "")):
            if kind is None or what == kind:
                yield i, row, what, text


def register(spark: SparkSession) -> None:
    from pyspark.sql.functions import udtf

    spark.dataSource.register(Sources)
    spark.dataSource.register(Documents)
    spark.udtf.register("statements_of", udtf(StatementsOf, useArrow=True))
