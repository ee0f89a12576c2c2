"""Source bundles: files, objects and ordered statements of ABAP-like sources."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File suffixes of a bundle, the default byte cap, node kinds of object types.
SUFFIXES = (".abap", ".asddls", ".asbdef", ".asdcls", ".acds", ".asddlx", ".asdbtab", ".srvd", ".srvb")
BYTE_CAP = 2_000_000
NODE_KINDS = {"CLAS": "class", "INTF": "interface", "PROG": "report", "FUGR": "function", "FUNC": "function", "DDLS": "cds", "TABL": "table", "BDEF": "behavior"}


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Filename, source (LF line ends), object, object_type of every source file below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    text = F.regexp_replace(F.decode("content", "UTF-8"), r"\r\n?", "\n")
    files = raw.select(name.alias("filename"), text.alias("source")).where(F.col("filename").rlike("(" + "|".join(map(re.escape, SUFFIXES)) + r")\z"))
    part = F.split("filename", r"\.")
    return files.select("filename", "source", F.upper(part[0]).alias("object"), F.upper(F.coalesce(F.get(part, 1), F.lit(""))).alias("object_type"))


def admitted(files: DataFrame, cap: int = BYTE_CAP) -> tuple[DataFrame, DataFrame]:
    """S3: the files within the byte cap, and a note for each other one."""
    size = F.octet_length("source")
    return files.where(size <= cap), files.where(size > cap).select(F.concat(F.col("filename"), F.lit(": larger than the byte cap")).alias("note"))


def node_kind(object_type: F.Column) -> F.Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in NODE_KINDS.items() for x in kv]), object_type)


# ------------------------------------------------------------ statements

#: Statement kinds by their leading words, the first that fits.
KINDS = (
    (r"LOOP\s+AT\b", "Loop"), (r"ENDLOOP\b", "EndLoop"), (r"WHILE\b", "While"), (r"ENDWHILE\b", "EndWhile"), (r"DO\b(?!\w)", "Do"), (r"ENDDO\b", "EndDo"), (r"ENDSELECT\b", "EndSelect"), (r"(WITH\b.*\b)?SELECT\b", "Select"),
    (r"IF\b", "If"), (r"ELSEIF\b", "ElseIf"), (r"ELSE\b", "Else"), (r"ENDIF\b", "EndIf"), (r"CASE\b", "Case"), (r"ENDCASE\b", "EndCase"), (r"WHEN\s+OTHERS\b", "WhenOthers"), (r"WHEN\b", "When"), (r"TRY\b", "Try"), (r"ENDTRY\b", "EndTry"), (r"CATCH\b", "Catch"),
    (r"CLASS\b.*\bDEFINITION\b", "ClassDefinition"), (r"CLASS\b.*\bIMPLEMENTATION\b", "ClassImplementation"), (r"ENDCLASS\b", "EndClass"), (r"INTERFACE\b", "Interface"), (r"INTERFACES\b", "InterfaceDef"), (r"(CLASS-)?METHODS\b", "MethodDef"), (r"METHOD\b", "MethodImplementation"), (r"ENDMETHOD\b", "EndMethod"),
    (r"FORM\b", "Form"), (r"ENDFORM\b", "EndForm"), (r"FUNCTION\b", "FunctionModule"), (r"ENDFUNCTION\b", "EndFunction"), (r"PERFORM\b", "Perform"), (r"CALL\s+FUNCTION\b", "CallFunction"), (r"CALL\s+TRANSACTION\b", "CallTransaction"), (r"CALL\s+SCREEN\b", "CallScreen"), (r"SET\s+SCREEN\b", "SetScreen"), (r"CALL\s+METHOD\b", "Call"),
    (r"AUTHORITY-CHECK\b", "AuthorityCheck"), (r"COMMIT\s+ENTITIES\b", "CommitEntities"), (r"COMMIT\b", "Commit"), (r"MODIFY\s+ENTIT", "ModifyEntities"), (r"READ\s+ENTIT", "ReadEntities"), (r"READ\s+TABLE\b", "ReadTable"), (r"READ\s+REPORT\b", "ReadReport"), (r"SORT\b", "Sort"),
    (r"INSERT\s+(INTO\s+)?@?\w+\s+(FROM|VALUES)\b(?!.*\bINTO\s+TABLE\b)", "InsertDatabase"), (r"UPDATE\s+\w+\b", "UpdateDatabase"), (r"MODIFY\s+\w+\s+FROM\b", "ModifyDatabase"), (r"DELETE\s+FROM\b", "DeleteDatabase"), (r"DELETE\b", "DeleteInternal"),
    (r"EXEC\s+SQL\b", "ExecSQL"), (r"ENDEXEC\b", "EndExec"), (r"INCLUDE\s+\w", "Include"), (r"GET\s+BADI\b", "GetBadi"), (r"GET\s+REFERENCE\b", "GetReference"), (r"TABLES\b", "Tables"), (r"WRITE\b", "Write"), (r"MESSAGE\b", "Message"), (r"CREATE\s+OBJECT\b", "CreateObject"), (r"CONCATENATE\b", "Concatenate"), (r"DESCRIBE\b", "Describe"),
    (r"BREAK(-POINT)?\b", "Break"), (r"LEAVE\b", "Leave"), (r"ENHANCEMENT-POINT\b", "EnhancementPoint"), (r"ENHANCEMENT-SECTION\b", "EnhancementSection"), (r"ENHANCEMENT\b", "Enhancement"), (r"ENDENHANCEMENT\b", "EndEnhancement"), (r"CHECK\b", "Check"), (r"ASSERT\b", "Assert"), (r"RAISE\b", "Raise"), (r"COMPUTE\b", "Compute"), (r"FIELD-SYMBOLS?\b", "FieldSymbol"),
    (r"CLASS-DATA\b", "ClassData"), (r"DATA\b", "Data"), (r"TYPES\b", "Types"), (r"MOVE\b", "Move"), (r"[\w<>~\->]+\s*\??=[^>]", "Move"),
)
_kind = re.compile("|".join(f"(?P<k{i}>{p})" for i, (p, _) in enumerate(KINDS)), re.IGNORECASE | re.DOTALL)
#: What isn't plain text: literals (those in quotes end with their line), templates, comments, ends of statements and of parts of a chain.
_marks = re.compile(r"""'[^'\n]*'?|`[^`\n]*`?|\|(?:\\.|[^|\\])*\|?|"[^\n]*|^\*[^\n]*|\.(?=\s|\Z)|:(?=\s|\Z)|,""", re.MULTILINE | re.DOTALL)
_solid = re.compile(r"\S")


def split_statements(source: str) -> list[tuple[int, str, str]]:
    """Row, kind and text of each statement, in one pass from mark to mark: literals and templates hold periods, comments go, chains after a colon are taken apart."""
    lines = [m.start() for m in re.finditer("\n", source)]
    out: list[tuple[int, str]] = []
    part: list[str] = []
    prefix, start, at = "", 0, 0

    def take(a: int, b: int) -> None:
        nonlocal start
        if a < b:
            if not start and (m := _solid.search(source, a, b)):
                start = bisect_left(lines, m.start()) + 1
            part.append(source[a:b])

    def end(place: int) -> None:
        nonlocal start
        text = "".join(part).strip()
        if text:
            out.append((start or bisect_left(lines, place) + 1, " ".join(f"{prefix} {text}".split())))
        part.clear()
        start = 0

    for m in _marks.finditer(source):
        a, b = m.span()
        take(at, a)
        at, c = b, source[a]
        if c == ".":
            end(a)
            prefix = ""
        elif c == ":" and not prefix:
            prefix = "".join(part).strip()
            part.clear()
        elif c == "," and prefix:
            end(a)
        elif c not in '"*':
            take(a, b)
    take(at, len(source))
    end(len(source))
    found = [_kind.match(t) for _, t in out]
    kinds = [KINDS[int(m.lastgroup[1:])][1] if m else "Other" for m in found]
    loops = [0] * len(out)
    open_: list[int] = []
    for j, k in enumerate(kinds):  # a SELECT is a loop if an ENDSELECT follows for it
        if k == "Select":
            open_.append(j)
        elif k == "EndSelect" and open_:
            loops[open_.pop()] = 1
    return [(r, "SelectLoop" if f else k, t) for (r, t), k, f in zip(out, kinds, loops, strict=True)]


#: Bytes of files that are split at once: bounds what a worker holds as Python objects.
STEP = 1 << 20


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about STEP bytes, a row at least."""
    for b in batches:
        n = max(1, b.num_rows * STEP // max(1, b.nbytes))
        yield from (b.slice(i, n) for i in range(0, b.num_rows, n))


def statements(files: DataFrame) -> DataFrame:
    """filename, object, object_type, seq, row, kind, text.

    Statements are many times larger than Spark guesses from the files, so joins of them must not go through the driver by broadcast: hence the hint.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [(f, o, t, i, r, k, x) for f, s, o, t in zip(*(b.column(c).to_pylist() for c in ("filename", "source", "object", "object_type")), strict=True) for i, (r, k, x) in enumerate(split_statements(s or ""))]
            if rows:
                kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["filename", "object", "object_type", "seq", "row", "kind", "text"])

    return files.select("filename", "source", "object", "object_type").mapInArrow(run, "filename string, object string, object_type string, seq long, row long, kind string, text string").hint("merge")
