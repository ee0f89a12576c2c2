"""Result documents: canonical JSON and its digests, validators, sinks that refuse invalid rows, seals of dynamic code, feedback arcs."""

from __future__ import annotations

import json
import math
import os
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.cuts import cut, met
from tessera.operators.strong import searched
from tessera.plans.facts import condensed
from tessera.sources.artifacts import without_comments

#: Vocabularies of the documents.
GRADES, TIERS = ("A", "B", "C", "D", "unknown"), ("keep-and-clean", "re-platform", "retire", "unknown")
PRIORITIES = ("priority-1", "priority-2", "priority-3", "info")
SOURCES = ("SCMON", "SUSG", "UPL", "ST03", "SMODILOG")

# ------------------------------------------------------------ canonical JSON


def _number(x: float) -> str:
    if not math.isfinite(x):
        raise ValueError("canonical JSON has no infinite or undefined numbers")
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    digits, _, exp = f"{x!r}".replace("e", "E").partition("E")
    if not exp:
        return digits
    if -7 < int(exp) < 0:
        return _plain(digits, int(exp))
    return f"{digits.removesuffix('.0')}e{'+' if int(exp) > 0 else '-'}{abs(int(exp))}"


def _plain(digits: str, exp: int) -> str:
    sign, digits = ("-", digits[1:]) if digits.startswith("-") else ("", digits)
    return sign + "0." + "0" * (-exp - 1) + digits.replace(".", "").rstrip("0")


def canonical(value: object) -> str:
    """JSON with sorted keys and no spaces; numbers in their shortest form, -0 as 0; anything without a canonical form is an error."""
    if value is None or isinstance(value, (bool, str)):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, int):
        return str(value) if abs(value) < 1 << 53 else _number(float(value))
    if isinstance(value, float):
        return _number(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, dict) and all(isinstance(k, str) for k in value):
        units = lambda k: k.encode("utf-16-be", "surrogatepass")
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + canonical(value[k]) for k in sorted(value, key=units)) + "}"
    raise TypeError(f"canonical JSON has no form for {type(value).__name__}")


def canonical_json(text: Column | str) -> Column:
    """X12 of a JSON text; null stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else canonical(json.loads(t)))

    return run(text)


def content_hash(text: Column) -> Column:
    """The digest of a JSON text's canonical form."""
    return F.sha2(canonical_json(text), 256)


def node_id(rule: Column, entity: Column, seam: Column) -> Column:
    """X11: the digest of three parts; an empty part or one with a pipe is an error."""
    ok = F.lit(True)
    for p in (rule, entity, seam):
        ok = ok & (F.coalesce(p, F.lit("")) != "") & ~F.coalesce(p, F.lit("")).contains("|")
    return F.when(ok, F.sha2(F.concat_ws("|", rule, entity, seam), 256)).otherwise(F.raise_error("a node's parts must be filled and free of pipes").cast("string"))


# ------------------------------------------------------------ validators


def _errors(*checks: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(m)) for c, m in checks]))


def _null(field: str) -> Callable[[Column], Column]:
    return lambda x: x[field].isNull()


def digest_errors() -> Column:
    """V2: errors of planner digests (digest_version, package, source_system, object_count, finding_count, objects, findings); element errors carry no index."""
    top = [(F.col(c).isNull(), f"missing required top-level field: {c}") for c in ("digest_version", "package", "source_system", "object_count", "finding_count", "objects", "findings")]
    n = [(F.coalesce(F.col(c), F.lit(0)) < 0, f"{c} must be a non-negative integer") for c in ("object_count", "finding_count")]
    o, f = F.coalesce("objects", F.array()), F.coalesce("findings", F.array())
    any_ = lambda xs, p: F.coalesce(F.exists(xs, p), F.lit(False))
    each = [(any_(o, _null(k)), f"objects missing {k}") for k in ("object", "grade", "effort_tier")]
    each += [(any_(f, _null(k)), f"findings missing {k}") for k in ("object", "rule_id", "severity", "message")]
    each += [(any_(o, lambda x: ~x["grade"].isin(*GRADES)), "objects bad grade"), (any_(o, lambda x: ~x["effort_tier"].isin(*TIERS)), "objects bad effort_tier"), (any_(f, lambda x: ~x["severity"].isin(*PRIORITIES)), "findings bad severity")]
    more = [(F.coalesce(F.size("objects") > F.col("object_count"), F.lit(False)), "more objects than object_count"), (F.coalesce(F.size("findings") > F.col("finding_count"), F.lit(False)), "more findings than finding_count")]
    return _errors(*top, *n, *each, *more)


def signal_errors(doc: Column) -> Column:
    """V4: errors of runtime signal documents (JSON)."""
    row = "array<struct<object_type:string,object_name:string,exec_count:double,modified_by:string,modified_on:string>>"
    d = F.from_json(doc, f"struct<schema_version:string,system:string,generated_at:string,usage:struct<source:string,rows:{row}>,modifications:struct<source:string,rows:{row}>>")
    checks = [(d[c].isNull(), f"missing required header field: {c}") for c in ("schema_version", "system", "generated_at")]
    for part, needs in (("usage", ("object_type", "object_name")), ("modifications", ("object_name", "object_type", "modified_by", "modified_on"))):
        p = d[part]
        bad = lambda c: F.coalesce(c, F.lit(False))
        checks += [(bad(~p["source"].isin(*SOURCES)), f"{part}.source"), (p.isNotNull() & p["rows"].isNull(), f"{part}.rows must be an array")]
        checks += [(bad(F.exists(p["rows"], _null(k))), f"{part}.rows missing {k}") for k in needs]
    checks.append((F.coalesce(F.exists(d["usage"]["rows"], lambda r: ~(F.coalesce(r["exec_count"], F.lit(-1.0)) >= 0)), F.lit(False)), "usage.rows exec_count must be a number >= 0"))
    return _errors(*checks)


# ------------------------------------------------------------ sinks


def write_valid(docs: DataFrame, errors: Column, path: str) -> None:
    """K1, K2: writes the documents as JSON lines; a document with errors fails the job before its files are committed."""
    bad = F.raise_error(F.concat(F.lit("invalid document: "), F.array_join("_errors", "; "))).cast("boolean")
    docs.withColumn("_errors", errors).where(F.when(F.size("_errors") > 0, bad).otherwise(F.lit(True))).drop("_errors").write.mode("overwrite").json(path)


def append_log(events: DataFrame, path: str) -> None:
    """K7: appends events as JSON lines."""
    events.write.mode("append").json(path)


def write_durable(path: str, text: str) -> None:
    """K6: a small file as a whole or not at all: written beside its place, flushed to disk, then moved there."""
    target = Path(path)
    beside = target.with_name(f".{target.name}.{os.getpid()}.tmp")
    with open(beside, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(beside, target)


def write_baseline(folder: str, document: str, digest: str) -> None:
    """K6: a baseline and its digest; the pair before stays as previous, and a reader that finds a digest that doesn't fit takes that one."""
    for name in ("baseline.json", "baseline.sha256"):
        if (Path(folder) / name).exists():
            write_durable(f"{folder}/previous.{name}", (Path(folder) / name).read_text(encoding="utf-8"))
    write_durable(f"{folder}/baseline.json", document)
    write_durable(f"{folder}/baseline.sha256", digest)


def terminal_report(findings: DataFrame, rows: int = 10) -> list[str]:
    """K5: tallies by severity, and the first findings; a top-k report."""
    tally = [f"{r['severity']}: {r['n']}" for r in findings.groupBy("severity").agg(F.count("*").alias("n")).orderBy("severity").collect()]
    return tally + [f"{r['object']} {r['rule_id']} {r['file']}:{r['line']}" for r in findings.orderBy("severity", "object", "rule_id", "file", "line").limit(rows).collect()]


# ------------------------------------------------------------ dynamic code

#: Heads of statements whose callee may not be known before run time, and what their operand must look like for that:
#: a name (no literal), something in parentheses, a name in parentheses, or anything.
HEADS = {
    "CALL FUNCTION": "name", "CALL TRANSACTION": "name", "LEAVE TO TRANSACTION": "name",
    "CALL METHOD": "(", "PERFORM": "(", "SET HANDLER": "(", "SUBMIT": "(", "CALL TRANSFORMATION": "(", "INSERT INTO": "(", "IN PROGRAM": "(",
    "FROM": "(name)", "UPDATE": "(name)", "INSERT": "(name)", "MODIFY": "(name)", "DELETE": "(name)",
    "GENERATE SUBROUTINE POOL": "any", "INSERT REPORT": "any", "CALL CUSTOMER-FUNCTION": "any", "GET BADI": "any", "CALL BADI": "any",
}
#: Names that dispatch by tables.
DISPATCHERS = ("OPEN_FI_PERFORM", "FQEVENTS", "BTE_", "SWE_EVENT_CREATE")
_TOKEN = re.compile(r"'[^']*'?|`[^`]*`?|->|=>|[^\s'`()=>-]+(?:-(?!>)[^\s'`()=>-]+)*|\S")
_HEADS = [(tuple(h.split()), kind) for h, kind in HEADS.items()]


def _tokens(line: str) -> list[str]:
    return [t.upper() if t[0] not in "'`" else t for t in _TOKEN.findall(line)]


def _is_name(token: str) -> bool:
    return bool(token) and (token[0].isalnum() or token[0] in "_/~<")


def _dynamic(t: list[str]) -> bool:
    """Whether one of a line's statements has a callee that isn't in the text."""
    at = lambda i: t[i].rstrip(".,") if i < len(t) else ""
    for i, token in enumerate(t):
        if token[0] in "'`":  # rather too many seals than too few: code may stand in a literal
            if len(token) > 2 and _dynamic(_tokens(token[1:].rstrip(token[0]))):
                return True
            continue
        if token in ("->", "=>") and at(i + 1) == "(" or any(token.startswith(d) or f"_{d}" in token for d in DISPATCHERS):
            return True
        if token == "TYPE" and at(i + 1) == "(" and tuple(t[max(0, i - 3) : i - 1]) == ("CREATE", "OBJECT"):
            return True
        for head, kind in _HEADS:
            if tuple(t[i : i + len(head)]) != head:
                continue
            j = i + len(head)
            operand = at(j)
            if kind == "any" or kind == "(" and operand == "(" or kind == "name" and operand and operand[0] != "'" or kind == "(name)" and operand == "(" and _is_name(at(j + 1)) and at(j + 2) == ")":
                return True
            if head == ("PERFORM",) and "COMMIT" in [x.rstrip(".,") for x in t[j:]] and (at(j + 1) == "(" or t[j + 1 : j + 3] == ["IN", "PROGRAM"]):
                return True  # a late call into another program
    return False


def _enhanced(raw: str) -> bool:
    """Whether a raw line, comment or not, marks an enhancement."""
    parts = raw.upper().replace("*", " ", 1).split() if raw.lstrip().startswith("*") else raw.upper().split()
    first, second = (parts + ["", ""])[:2]
    mark = first in ("ENHANCEMENT-POINT", "ENHANCEMENT-SECTION") and second or first == "ENHANCEMENT" and second[:1].isdigit() or first.rstrip(".") == "END-ENHANCEMENT"
    return bool(mark) or any(x.strip(".,:()") == "ENHSPOT" for x in parts) or " ".join(raw.upper().split()).replace('"{ ', '"{').find('"{BEGIN ENHO') >= 0


def _typed(t: list[str]) -> list[tuple[str, str]]:
    """Variables and the classes that a line's declarations give them."""
    out = []
    for i in range(len(t)):
        if t[i] == "DATA" and t[i + 2 : i + 5] == ["TYPE", "REF", "TO"] and i + 5 < len(t):
            out.append((t[i + 1], t[i + 5].rstrip(".,")))
        if t[i : i + 2] == ["CREATE", "OBJECT"] and t[i + 3 : i + 4] == ["TYPE"] and i + 4 < len(t) and _is_name(t[i + 4]):
            out.append((t[i + 2], t[i + 4].rstrip(".,")))
    return out


def _late(t: list[str]) -> list[tuple[str, str]]:
    """Targets of a line's calls at commit and of its handlers; a handler's object and method are one target."""
    out = []
    for i in range(len(t)):
        if t[i] == "PERFORM" and [x.rstrip(".,") for x in t[i + 2 : i + 4]] == ["ON", "COMMIT"]:
            out.append((t[i + 1], "perform-on-commit"))
        if t[i : i + 2] == ["SET", "HANDLER"] and "FOR" in t[i + 2 :]:
            part, now, depth = t[i + 2 : t.index("FOR", i + 2)], "", 0
            for j, x in enumerate(part):
                now += x
                depth += (x == "(") - (x == ")")
                if not depth and x not in ("->", "=>") and part[j + 1 : j + 2] not in (["->"], ["=>"]):
                    out.append((now, "set-handler"))
                    now = ""
    return out


def dynamics(source: str) -> dict:
    """C20: seals (kind, line, snippet of 200 characters) and late-bound edges (target, kind) of one source; handlers resolve through local types."""
    code = [_tokens(line) for line in without_comments(source, '"', block=False, star=True).split("\n")]
    types = {name: kind for t in code for name, kind in _typed(t)}
    seals, edges = [], []
    for i, (raw, t) in enumerate(zip(source.split("\n"), code, strict=True), 1):
        found = {"enhancement-marker"} if _enhanced(raw) else set()
        for target, kind in _late(t):
            if "(" in target:
                found.add("dynamic-target")
                continue
            owner, arrow, member = target.partition("->")
            edges.append({"target": f"{types[owner]}=>{member}" if arrow and owner in types else target, "kind": kind})
        if _dynamic(t):
            found.add("dynamic-construct")
        seals += [{"kind": k, "line": i, "snippet": raw.strip()[:200]} for k in sorted(found)]
    return {"seals": seals, "edges": edges}


DYNAMICS = "seals array<struct<kind:string,line:long,snippet:string>>, edges array<struct<target:string,kind:string>>"


def adapted(scanned: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between objects (source, target, kind), and the sealed objects: those with seals, and those with a target that no object holds.

    scanned: object, dynamics; members: object, member.
    """
    late = scanned.select(F.col("object").alias("source"), F.explode("dynamics.edges").alias("e")).select("source", "e.target", "e.kind").distinct()
    named = F.when(F.col("target").contains("=>"), F.substring_index("target", "=>", 1)).when(F.col("target").contains("."), F.substring_index("target", ".", 1))
    own = members.select(F.col("object").alias("source"), F.col("member").alias("target"), F.col("object").alias("home")).distinct()
    x = late.withColumn("named", named).join(own, ["source", "target"], "left").withColumn("to", F.coalesce("named", "home"))
    x = x.join(members.select(F.col("object").alias("to")).distinct().withColumn("known", F.lit(True)), "to", "left")
    edges = x.where("known and to <> source").select("source", F.col("to").alias("target"), "kind").distinct()
    sealed = scanned.where(F.size("dynamics.seals") > 0).select("object").union(x.where("known is null").select("source")).distinct()
    return edges, sealed


# ------------------------------------------------------------ feedback arcs


def back_edges(order: list[int], links: set[tuple[int, int]], most: int = 16) -> list[tuple[int, int]]:
    """Of the links that run against an order, those that span most of it, the first by their ends among equals."""
    place = {n: i for i, n in enumerate(order)}
    against = [(a, b) for a, b in links if place[a] > place[b]]
    return sorted(against, key=lambda e: (place[e[1]] - place[e[0]], e))[:most]


def _order(nodes: list[int], links: set[tuple[int, int]]) -> list[int]:
    """A vertex order with few back edges: sinks to the end, sources to the front, else the node that gives most more than it takes."""
    out: dict[int, set[int]] = {n: set() for n in nodes}
    back: dict[int, set[int]] = {n: set() for n in nodes}
    for a, b in links:
        out[a].add(b)
        back[b].add(a)
    left, front, end = set(nodes), [], []
    while left:
        sinks = [n for n in left if not out[n]]
        sources = [n for n in left if not back[n] and out[n]]
        pick = sorted(sinks) or sorted(sources) or [min(left, key=lambda n: (len(back[n]) - len(out[n]), n))]
        for n in pick:
            (end if sinks else front).append(n)
            left.discard(n)
            for x in out.pop(n):
                back[x].discard(n)
            for x in back.pop(n):
                out[x].discard(n)
    return front + end[::-1]


def _cuts(nodes: list[int], links: set[tuple[int, int]], budget: int, tried: int = 16) -> list[tuple[int, int, float]]:
    links = {(a, b) for a, b in links if a != b}
    seams = []
    while True:
        root = searched(sorted(links) + [(n, n) for n in nodes])
        groups: dict[int, list[int]] = {}
        for n, r in root.items():
            groups.setdefault(r, []).append(n)
        big = sorted((g for g in groups.values() if len(g) > budget), key=lambda g: (-len(g), min(g)))
        if not big:
            return seams
        inside = {(a, b) for a, b in links if root[a] == root[b] == min(big[0])}
        order = _order(sorted(big[0]), inside)
        pos = {n: i for i, n in enumerate(order)}
        best = None
        for a, b in back_edges(order, inside, tried):
            sizes: dict[int, int] = {}
            for r in searched(sorted(inside - {(a, b)}) + [(n, n) for n in big[0]]).values():
                sizes[r] = sizes.get(r, 0) + 1
            key = (max(sizes.values()), pos[b] - pos[a], (a, b))
            best = min(best or key, key)
        seams.append((*best[2], round((len(big[0]) - best[0]) / len(big[0]), 2)))
        links.discard(best[2])


def feedback_arcs(edges: DataFrame, budget: int) -> DataFrame:
    """Source, target, rank, confidence of the edges to cut until no strong component has more than `budget` nodes (a, b: longs).

    Components of more nodes than that are found on the cluster; each is cut in one task, as the choice of a cut depends on those before it.
    """
    members = cut(condensed(edges)[0])
    large = members.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > budget)
    m = cut(met(members, large.select("root"), "root", "left_semi"))
    ends = met(edges.select("a", "b").distinct(), m.select(F.col("id").alias("a"), "root"), "a")
    inside = met(ends, m.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b").where("root = rb").select("root", "a", "b")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        links = set(zip(t.column("a").to_pylist(), t.column("b").to_pylist(), strict=True))
        rows = _cuts(sorted({x for e in links for x in e}), links, budget)
        return pa.table({"source": pa.array([r[0] for r in rows], pa.int64()), "target": pa.array([r[1] for r in rows], pa.int64()), "rank": pa.array(range(1, len(rows) + 1), pa.int64()), "confidence": pa.array([r[2] for r in rows], pa.float64())})

    return inside.groupBy("root").applyInArrow(run, "source long, target long, rank long, confidence double")


def dangling_symbols(statements: DataFrame) -> DataFrame:
    """Filename, row of the first use of a field symbol that a loop assigned, after that loop, without an unassign or a check; methods start afresh."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = []
            for f, rows in zip(b.column("filename").to_pylist(), b.column("rows").to_pylist(), strict=True):
                open_: list[set[str]] = []
                risky: set[str] = set()
                for r in rows:
                    text, names = r["text"].upper(), set(re.findall(r"<\w+>", r["text"].upper()))
                    if r["kind"] == "EndMethod":
                        open_, risky = [], set()
                    elif r["kind"] == "Loop":
                        new = set(re.findall(r"ASSIGNING\s+(?:FIELD-SYMBOL\()?(<\w+>)", text))
                        open_.append(new)
                        risky -= new
                    elif r["kind"] == "EndLoop":
                        risky |= open_.pop() if open_ else set()
                    elif re.match(r"UNASSIGN\b", text) or "IS ASSIGNED" in text or re.search(r"\bASSIGN(ING)?\b", text):
                        risky -= names
                    else:
                        hits += [(f, r["row"], n) for n in sorted(names & risky)]
                        risky -= names
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*hits, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], ["filename", "row", "symbol"])

    files = statements.groupBy("filename").agg(F.array_sort(F.collect_list(F.struct("seq", "row", "kind", "text"))).alias("rows"))
    return files.mapInArrow(run, "filename string, row long, symbol string")
