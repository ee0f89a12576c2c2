"""Parsers of declarative artifacts (views, behaviours, access control, service bindings, dictionary XML) as row-to-struct functions.

Each runs in Arrow batches next to the scan, a file's text never shuffles, and any text gives a row: what isn't found is null or empty.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = r"[\w/]+"


def without_comments(source: str, line: str = "//", block: bool = True, star: bool = False) -> str:
    """The source without comments, in one pass; quotes, backticks and templates hold what looks like one.

    `line` opens a comment to the end of the line; `star`: so does an asterisk in the first column; a literal in quotes or backticks ends with its line.
    Line ends stay, so line numbers hold.
    """
    out: list[str] = []
    i, n, quote, first = 0, len(source), "", True
    while i < n:
        c = source[i]
        if quote:
            out.append(c)
            if quote == "|" and c == "\\" and i + 1 < n:
                i += 1
                out.append(source[i])
            elif c == quote or (c == "\n" and quote != "|"):
                quote = ""
        elif (star and first and c == "*") or source.startswith(line, i):
            end = source.find("\n", i)
            i = n if end < 0 else end
            continue
        elif block and source.startswith("/*", i):
            end = source.find("*/", i + 2)
            gone = source[i : n if end < 0 else end + 2]
            out.append(" " + "\n" * gone.count("\n"))
            i += len(gone)
            first = False
            continue
        else:
            if c in ("'", "`") or (c == "|" and star):
                quote = c
            out.append(c)
        first = c == "\n"
        i += 1
    return "".join(out)


def snippet(line: str) -> str:
    """Upper case and single spaces outside literals; an open literal runs to the end."""
    parts = re.findall(r"'[^']*'?|`[^`]*`?|\|[^|]*\|?|\s+|[^'`|\s]+", line.replace("\r\n", "\n"))
    return "".join(" " if p.isspace() else p if p[0] in "'`|" else p.upper() for p in parts).strip(" ")


def body(source: str) -> str:
    """What the first balanced pair of braces holds; an open one runs to the end."""
    at = source.find("{")
    if at < 0:
        return ""
    depth = 0
    for m in re.finditer(r"[{}]", source[at:]):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return source[at + 1 : at + m.start()]
    return source[at + 1 :]


def split_top(text: str) -> list[str]:
    """Parts at commas outside brackets and literals."""
    out, depth, last = [], 0, 0
    for m in re.finditer(r"'[^']*'|[()\[\]{},]", text):
        if m[0][0] == "'":
            continue
        if m[0] == ",":
            if not depth:
                out.append(text[last : m.start()])
                last = m.end()
        else:
            depth += 1 if m[0] in "([{" else -1
    return out + ([text[last:]] if text[last:].strip() else [])


def alias(expr: str) -> tuple[str, str | None]:
    """An element and its name after a top-level `as`."""
    depth = 0
    for m in re.finditer(r"[()\[\]{}]|\sas\s", expr, re.IGNORECASE):
        if len(m[0]) == 1:
            depth += 1 if m[0] in "([{" else -1
        elif not depth:
            return expr[: m.start()].strip(), expr[m.end() :].strip()
    tail = re.search(r"(\w+)\s*\Z", expr)
    return expr.strip(), tail[1] if tail else None


def _one(pattern: str, text: str) -> str | None:
    m = re.search(pattern, text, re.IGNORECASE)
    return m[1] if m else None


def view(source: str) -> dict:
    """Entity, source, keys, fields (name, element, type), associations (name, target, cardinality), annotations (name, value)."""
    s = without_comments(source)
    links = [{"name": m[3], "target": m[2], "cardinality": (m[1] or "").strip() or None} for m in re.finditer(rf"association(?:\s*\[([^\]]*)\])?\s+(?:of\s+)?to\s+({NAME})\s+as\s+(\w+)", s, re.IGNORECASE)]
    known = {a["name"] for a in links}
    keys, fields = [], []
    for part in split_top(body(s)):
        expr = "\n".join(x for x in part.split("\n") if not x.lstrip().startswith("@")).strip()
        is_key = re.match(r"key\s+", expr, re.IGNORECASE)
        expr = expr[is_key.end() :].strip() if is_key else expr
        if not expr or (re.fullmatch(r"\w+", expr) and (expr in known or expr.startswith("_"))):
            continue
        element, name = alias(expr)
        if name:
            fields.append({"name": name, "element": element, "type": _one(r"\bas\s+([\w.]+(?:\s*\([^)]*\))?)\s*\)\s*\Z", element) if element.lower().startswith("cast") else None})
            keys += [name] * bool(is_key)
    notes = [{"name": m[1], "value": m[2].strip()} for m in re.finditer(r"@([\w.]+)\s*:\s*([^\n,]+)", s)]
    return {
        "entity": _one(rf"define\s+(?:root\s+)?view\s+entity\s+({NAME})", s), "source": _one(rf"\bselect(?:\s+distinct)?\s+from\s+({NAME})", s),
        "keys": keys, "fields": fields, "associations": links, "annotations": notes,
    }


VIEW = "entity string, source string, keys array<string>, fields array<struct<name:string,element:string,type:string>>, associations array<struct<name:string,target:string,cardinality:string>>, annotations array<struct<name:string,value:string>>"


def behavior(source: str) -> dict:
    """Kind of implementation, saver, class, and the entities (name, alias, authorization and its scope, lock, compositions, operations)."""
    s = without_comments(source)
    head = re.split(r"\bdefine\s+behavior\b", s, maxsplit=1, flags=re.IGNORECASE)[0]
    m = re.search(r"\b(managed|unmanaged)\b(?:\s+with\s+(additional|unmanaged)\s+save)?", head, re.IGNORECASE)
    kind = "projection" if re.search(r"\bprojection\s*;", head, re.IGNORECASE) else "unknown"
    if m:
        kind = m[1].lower() + (f" with {m[2].lower()} save" if m[2] and m[1].lower() == "managed" else "")
    marks = list(re.finditer(rf"define\s+behavior\s+for\s+({NAME})(?:\s+alias\s+(\w+))?", s, re.IGNORECASE))
    entities = []
    for i, d in enumerate(marks):
        part = s[d.start() : marks[i + 1].start() if i + 1 < len(marks) else len(s)]
        a = re.search(r"\bauthorization\s+(master|dependent)\b\s*(?:\(([^)]*)\)|by\s+(_\w+))?", part, re.IGNORECASE)
        scope = [x.strip().upper() for x in ((a[2] or a[3] or "") if a else "").split(",")]
        entities.append({
            "entity": d[1].upper(), "alias": d[2].upper() if d[2] else None, "authorization": a[1].lower() if a else None, "scope": [x for x in scope if x], "lock": (_one(r"\block\s+dependent\s+by\s+_(\w+)", part) or "").upper() or None,
            "compositions": [x.upper() for x in re.findall(r"\bassociation\s+_(\w+)", part, re.IGNORECASE)],
            "operations": sorted({x.lower() for x in re.findall(r"(?:^|[;{}])\s*(?:internal\s+)?(create|update|delete)\b", body(part), re.IGNORECASE | re.MULTILINE)}) + re.findall(r"\b(?:action|function)\b(?:\s*\([^)]*\))?\s+(\w+)", body(part), re.IGNORECASE),
        })
    return {"implementation": kind, "needs_saver": kind == "unmanaged" or " with " in kind, "class": (_one(rf"implementation\s+in\s+class\s+({NAME})", s) or "").upper() or None, "entities": entities}


BEHAVIOR = "implementation string, needs_saver boolean, class string, entities array<struct<entity:string,alias:string,authorization:string,scope:array<string>,lock:string,compositions:array<string>,operations:array<string>>>"


def access(source: str) -> list[dict]:
    """The grants (entity, form, objects) of an access control file."""
    out = []
    for part in without_comments(source).split(";"):
        entity = _one(rf"\bgrant\s+select\s+on\s+({NAME})", part)
        if entity:
            low = part.lower()
            form = "pfcg_auth" if re.search(r"aspect\s+pfcg_auth", low) else "inheriting" if re.search(r"inheriting\s+conditions", low) else "condition" if re.search(r"\bwhere\b", low) else "unconditional"
            out.append({"entity": entity.upper(), "form": form, "objects": [x.upper() for x in re.findall(rf"aspect\s+pfcg_auth\s*\(\s*({NAME})", part, re.IGNORECASE)]})
    return out


ACCESS = "array<struct<entity:string,form:string,objects:array<string>>>"


def elements(source: str, name: str) -> list[dict[str, str]]:
    """The leaf values below every element of a local name, whatever its namespace; broken XML gives none.  Attributes carry a prefix."""
    if "<!DOCTYPE" in source or "<!ENTITY" in source:
        return []
    try:
        root = ElementTree.fromstring(source)
    except ElementTree.ParseError:
        return []
    local = lambda t: t.rsplit("}", 1)[-1]
    return [{**{"@_" + local(k): v for k, v in e.attrib.items()}, **{local(c.tag): (c.text or "").strip() for c in e if not len(c)}} for e in root.iter() if isinstance(e.tag, str) and local(e.tag) == name]


XML = "array<map<string,string>>"


def parsed(files: DataFrame, name: str, parse: Callable[[str], object], kind: str) -> DataFrame:
    """The files with a column of what a parser finds in their source (null: empty)."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    spark_type = _parse_datatype_string(kind)
    arrow, out = to_arrow_type(spark_type), StructType([*files.schema.fields, StructField(name, spark_type)])
    pairs = kind == XML

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [parse(x or "") for x in b.column("source").to_pylist()]
            values = [[list(e.items()) for e in r] for r in rows] if pairs else rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, arrow)], [*b.schema.names, name])

    return files.mapInArrow(run, out)


def view_edges(views: DataFrame) -> DataFrame:
    """Source, target, kind out of parsed views: what they select from and associate."""
    to = F.concat(F.array("view.source"), F.col("view.associations.target"))
    return views.where("view.entity is not null").select(F.upper("view.entity").alias("source"), F.explode(F.array_compact(to)).alias("target")).select("source", F.upper("target").alias("target"), F.lit("consumes-cds").alias("kind")).distinct()


def behavior_edges(files: DataFrame) -> DataFrame:
    """Behaviours consume the entities they are for and call the class that implements them."""
    b = files.select(F.col("object").alias("source"), "behavior")
    uses = b.select("source", F.explode("behavior.entities.entity").alias("target"), F.lit("consumes-cds").alias("kind"))
    return uses.union(b.select("source", F.col("behavior.class"), F.lit("calls")).where("class is not null")).distinct()


def structure_findings(views: DataFrame) -> DataFrame:
    """W17 and the structure rules on parsed views: rule_id, object."""
    v = F.col("view")
    names = v["fields"]["name"]
    at = F.transform(v["keys"], lambda k: F.array_position(names, k))
    rules = F.array_compact(F.array(
        F.when(F.size(v["keys"]) == 0, F.lit("gf-x-cds-node-no-key")),
        F.when((F.size(at) > 0) & (F.array_max(at) > F.size(at)), F.lit("talos-cds-field-order")),
        F.when(~F.exists(v["annotations"], lambda a: a["name"] == "AccessControl.authorizationCheck"), F.lit("talos-cds-missing-access-control")),
        F.when(F.exists(v["annotations"], lambda a: (a["name"] == "AccessControl.authorizationCheck") & a["value"].contains("#NOT_REQUIRED")), F.lit("talos-cds-auth-not-required")),
        F.when(F.size(F.filter(v["fields"], lambda f: F.lower(f["element"]).startswith("case"))) >= 3, F.lit("talos-cds-business-logic")),
    ))
    return views.where("view.entity is not null").select("object", F.explode(rules).alias("rule_id"))


def lost_reciprocals(views: DataFrame) -> DataFrame:
    """Parent, child of associations to a view that has none back."""
    e = views.select(F.upper("view.entity").alias("parent"), F.explode("view.associations.target").alias("c")).select("parent", F.upper("c").alias("child")).distinct()
    back = e.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    return e.join(views.select(F.upper("view.entity").alias("child")).distinct(), "child", "left_semi").join(back, ["parent", "child"], "left_anti").select("parent", "child")


def listing(spark, lines: DataFrame) -> DataFrame:  # noqa: ANN001
    """Name, type of every entry of listing documents (value: JSON), whichever of three containers and key names they use."""
    item = "array<map<string,string>>"
    doc = F.from_json("value", f"struct<objects:{item},items:{item},nodes:{item}>")
    rows = lines.select(doc.alias("d")).select(F.explode(F.coalesce("d.objects", "d.items", "d.nodes")).alias("m"))
    get: Callable[[str], Column] = lambda k: F.try_element_at("m", F.lit(k))
    return rows.select(F.coalesce(get("name"), get("OBJECT_NAME"), get("objectName")).alias("name"), F.coalesce(get("type"), get("OBJECT_TYPE"), get("objectType")).alias("type")).where("name is not null")


def usage_csv(spark, path: str):  # noqa: ANN001, ANN201
    """object_type, object_name, package and the log's other columns of a CSV file with semicolons or commas; dates become ISO, impossible ones null, counts that aren't whole null."""
    head = spark.read.text(path).first()
    sep = ";" if head and ";" in head[0] else ","
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    for c in df.columns:
        low = c.strip().lower()
        x = F.trim(F.col(f"`{c}`"))
        if low.endswith("_used") or low.endswith("_on"):
            x = F.date_format(F.try_to_timestamp(x, F.lit("yyyyMMdd")), "yyyy-MM-dd")
        elif low.endswith("_count"):
            x = F.when(x.rlike(r"^[0-9]+\z"), x.cast("long"))
        df = df.withColumn(c, x).withColumnRenamed(c, low)
    return df
