"""Commands and requests: python -m tessera.cli analyse|compare|lint|plan|gate|descriptor ...; handle() answers the same as JSON requests."""

from __future__ import annotations

import argparse
import html
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import severity_grade
from tessera.operators import orders
from tessera.operators.cuts import cut
from tessera.plans import descriptor, documents, gate, linter, runs
from tessera.sources import records

#: Rows of one page of an answer, unless a request asks for another number; every answer tells how many there are in all.
SHOWN = 200


def below(root: str, out: str) -> str:
    """An output path, which must lie below the root."""
    base, path = Path(root).resolve(), (Path(root) / out).resolve()
    if base != path and base not in path.parents:
        raise ValueError(f"{out} is not below {root}")
    return str(path)


def session() -> SparkSession:
    return SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _rows(df: DataFrame, params: dict | None = None) -> list[dict]:
    """The page of an ordered table that the params ask for: `limit` rows after `offset`."""
    params = params or {}
    return [r.asDict(recursive=True) for r in df.offset(int(params.get("offset", 0))).limit(int(params.get("limit", SHOWN))).collect()]


def _paged(params: dict, **tables: DataFrame) -> dict:
    """A page of each table by the same offset and limit, and how many rows each has."""
    tables = {name: cut(df) for name, df in tables.items()}
    return {name: _rows(df.orderBy(*_order(df)), params) for name, df in tables.items()} | {"total": {name: df.count() for name, df in tables.items()}, "offset": int(params.get("offset", 0))}


def _order(df: DataFrame) -> list:
    """A total order: known columns first, then the whole row."""
    first = [c for c in ("wave", "rank", "severity", "rule_id", "object", "file", "line", "metric", "id") if c in df.columns]
    return [*first, F.to_json(F.struct(*df.columns))]


def page(report: runs.Report) -> str:
    """K4: the first objects and findings as one page; the data stands in it as an island, counts of dependencies as a table."""
    import tessera.operators.graph as G

    data = {"summary": _rows(report.summary().orderBy("metric")), "findings": _rows(orders.digest_findings(report.findings.withColumn("message", F.lit("")), SHOWN).drop("message"))}
    needs = _rows(orders.by_count(G.object_graph(report.edges, report.nodes).groupBy(F.col("source_owner").alias("object")).agg(F.countDistinct("target_owner").alias("needs")), "needs", "object", 120))
    island = json.dumps(data).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")
    line = lambda cells, tag="td": "<tr>" + "".join(f"<{tag}>{html.escape(str(c))}</{tag}>" for c in cells) + "</tr>"
    tables = [
        "<table>" + line(("metric", "value"), "th") + "".join(line((r["metric"], r["value"])) for r in data["summary"]) + "</table>",
        "<table>" + line(("object", "needs"), "th") + "".join(line((r["object"], r["needs"])) for r in needs) + "</table>",
        "<table>" + line(("severity", "rule", "object", "file", "line"), "th") + "".join(line((r["severity"], r["rule_id"], r["object"], r["file"], r["line"])) for r in data["findings"]) + "</table>",
    ]
    return f'<!doctype html><meta charset="utf-8"><title>report</title>{"".join(tables)}<script type="application/json" id="data">{island}</script>'


def handle(spark: SparkSession, request: dict, root: str = ".") -> dict:
    """One request {id, method, params}: a result or an error, never an exception."""
    params = request.get("params") or {}
    try:
        method = METHODS.get(request.get("method"))
        if method is None:
            return {"id": request.get("id"), "error": {"code": -32601, "message": "unknown method"}}
        return {"id": request.get("id"), "result": method(spark, params, root)}
    except Exception as e:  # noqa: BLE001 - the caller gets the error as an answer
        return {"id": request.get("id"), "error": {"code": -32000, "message": f"{type(e).__name__}: {e}"[:500]}}


def _analyse(spark: SparkSession, params: dict, root: str) -> dict:
    report = runs.analyse(spark, params["path"])
    if params.get("out"):
        report.write(below(root, params["out"]))
    return _paged(params, summary=report.summary(), findings=report.findings) | {"failed": report.failed}


def _report(spark: SparkSession, params: dict, root: str) -> dict:
    path = below(root, params["out"])
    return _paged(params, **{name: spark.read.json(f"{path}/{name}") for name in ("summary", "findings")})


def _lint(spark: SparkSession, params: dict, root: str) -> dict:
    found, failed = runs.linted(spark, params["path"])
    return _paged(params, findings=found) | {"failed": failed}


def _ground(spark: SparkSession, params: dict, root: str) -> dict:
    registry = spark.createDataFrame([(r["name"], r["state"]) for r in params["registry"]], "name string, state string")
    files = spark.createDataFrame([(f["object"], f["file"], f["source"]) for f in params["files"]], "object string, file string, source string")
    return _paged(params, findings=linter.grounding(files, registry))


def _descriptor(spark: SparkSession, params: dict, root: str) -> dict:
    text = params["manifest"] if isinstance(params["manifest"], str) else json.dumps(params["manifest"])
    rows = spark.createDataFrame([(text, params.get("entity"), params.get("service"))], "manifest string, entity string, service string")
    return _paged(params, findings=descriptor.findings(rows).select("rule_id", "severity"))


def _plan(spark: SparkSession, params: dict, root: str) -> dict:
    return _paged(params, nodes=runs.planned(runs.analyse(spark, params["path"])))


def _gate(spark: SparkSession, params: dict, root: str) -> dict:
    return _paged(params, runs=gate.gated(gate.folder(spark, params["path"])))


METHODS = {"analyse_bundle": _analyse, "get_report": _report, "lint_abap_cloud": _lint, "ground_released_apis": _ground, "validate_fe_descriptor": _descriptor, "plan": _plan, "gate": _gate}


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="tessera")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("analyse", "lint", "plan", "gate"):
        p = sub.add_parser(name)
        p.add_argument("path")
        p.add_argument("--out")
        p.add_argument("--offset", type=int, default=0)
        p.add_argument("--limit", type=int, default=SHOWN)
        if name == "analyse":
            p.add_argument("--fail-on", action="store_true", help="exit 1 for findings of the first priority and failed packs")
            p.add_argument("--html")
            p.add_argument("--sarif")
    p = sub.add_parser("compare")
    p.add_argument("before")
    p.add_argument("after")
    p = sub.add_parser("descriptor")
    p.add_argument("path")
    p.add_argument("--entity")
    p.add_argument("--service")
    args, spark = top.parse_args(argv), session()
    show = lambda rows: print("\n".join(json.dumps(r, default=str) for r in rows))

    def shown(df: DataFrame) -> None:
        answer = _paged(vars(args), rows=df)
        show([*answer["rows"], {"total": answer["total"]["rows"], "offset": answer["offset"]}])

    if args.command == "descriptor":
        show(_descriptor(spark, {"manifest": Path(args.path).read_text(encoding="utf-8"), "entity": args.entity, "service": args.service}, ".")["findings"])
        return 0
    if args.command == "compare":
        show(_rows(runs.compared(runs.analyse(spark, args.before), runs.analyse(spark, args.after)).orderBy("metric")))
        return 0
    if args.command == "lint":
        found, _failed = runs.linted(spark, args.path)
        if args.out:
            found.write.mode("overwrite").json(below(".", args.out))
        shown(found)
        return 0
    if args.command == "gate":
        row = gate.gated(gate.folder(spark, args.path)).first()
        show([row.asDict()])
        return int(not row["pass"])
    report = runs.analyse(spark, args.path)
    if args.command == "plan":
        nodes = cut(runs.planned(report))
        if args.out:
            nodes.write.mode("overwrite").json(below(".", args.out))
        shown(nodes)
        return 0
    if args.out:
        report.write(below(".", args.out))
    if args.html:
        Path(below(".", args.html)).write_text(page(report), encoding="utf-8")
    if args.sarif:
        text = report.findings.withColumn("message", F.col("rule_id"))
        records.sarif_results(text, severity_grade(F.col("severity"))).write.mode("overwrite").json(below(".", args.sarif))
    show(documents.terminal_report(report.findings))
    return int(args.fail_on and runs.blocked(report)[0])


if __name__ == "__main__":
    sys.exit(main())
