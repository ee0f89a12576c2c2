"""J9, F1, 2.12.1: thousands of line rules at once.

Every match of an expression holds one of its factors: strings that are read off its syntax (the best run of literals of a sequence, those of
all branches, those of what is repeated at least once).  One automaton over the factors of all rules goes through each text once, whatever their
number, and leaves the lines and rules to look at; there the engine's own expression decides.  An expression without a factor of
SHORTEST characters, or in a syntax that the reader here doesn't know, is tried on every line.
"""

from __future__ import annotations

import re
import re._constants as C
import re._parser as reader
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the shortest factor that an expression is looked up by, and the most factors of one expression.
SHORTEST, MOST = 2, 64


def folded(text: str) -> str:
    """A-Z in lower case; all other characters as they are, so places stay."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _better(sets: list[frozenset[str] | None]) -> frozenset[str] | None:
    """The set whose shortest string is the longest; of those, the smallest."""
    good = [s for s in sets if s and len(s) <= MOST]
    return max(good, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def _of(tree) -> frozenset[str] | None:
    run, found = "", []
    for op, arg in tree:
        if op is C.LITERAL:
            run += chr(arg)
            continue
        if op is C.AT:
            continue  # takes no character
        found.append(frozenset([run]) if run else None)
        run = ""
        if op is C.SUBPATTERN:
            found.append(_of(arg[3]))
        elif op is C.ATOMIC_GROUP:
            found.append(_of(arg))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] > 0:
            found.append(_of(arg[2]))
        elif op is C.BRANCH:
            parts = [_of(x) for x in arg[1]]
            found.append(None if None in parts else frozenset().union(*parts))
    found.append(frozenset([run]) if run else None)
    return _better(found)


def factors(pattern: str) -> frozenset[str] | None:
    """Strings, folded, one of which is in every text (folded) that matches; None if there are none to rely on."""
    if re.search(r"\(\?\w*[ux]", pattern):  # other rules of case, or of spaces
        return None
    try:
        best = _of(reader.parse(pattern.replace(r"\z", r"\Z")))
    except (re.error, OverflowError):
        return None
    best = frozenset(map(folded, best)) if best else None
    return best if best and min(map(len, best)) >= SHORTEST else None


def candidates(docs: DataFrame, found: Sequence[frozenset[str] | None], key: str, text: str) -> DataFrame:
    """key, line (from 1), raw, rules: the lines that hold a factor, with the numbers of the rules to try there."""
    index: dict[str, list[int]] = {}
    for i, strings in enumerate(found):
        for s in strings or ():
            index.setdefault(s, []).append(i)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for s, rules in shared.value.items():
            automaton.add_word(s, rules)
        automaton.make_automaton()
        for b in batches:
            at: list[int] = []
            line: list[int] = []
            raw: list[str] = []
            rules: list[list[int]] = []
            for row, value in enumerate(b.column(1).to_pylist()):
                hits: dict[int, set[int]] = {}
                lines = value.split("\n")
                ends = list(accumulate(len(x) + 1 for x in lines))
                for end, own in automaton.iter(folded(value)):
                    hits.setdefault(bisect_right(ends, end), set()).update(own)
                at += [row] * len(hits)
                line += [i + 1 for i in hits]
                raw += [lines[i] for i in hits]
                rules += map(sorted, hits.values())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(line, pa.int64()), pa.array(raw, pa.string()), pa.array(rules, pa.list_(pa.int32()))], [key, "line", "raw", "rules"])

    rows = docs.select(key, text).where(F.col(text).isNotNull())
    if not index:
        return rows.select(key, F.lit(0).cast("long").alias("line"), F.lit("").alias("raw"), F.array().cast("array<int>").alias("rules")).limit(0)
    return rows.mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, line long, raw string, rules array<int>")


def scanned(docs: DataFrame, rules: Sequence[tuple[str, str]], key: str = "doc_id", text: str = "text", comments: bool = False) -> DataFrame:
    """key, line, rule_id of every line of every text and rule (name, expression) that matches it, as one `rlike` a rule and line would tell.

    A null text has no lines; comment lines (first character * or ") are left out unless asked for.
    """
    found = [factors(p) for _, p in rules]
    spark = docs.sparkSession
    table = spark.createDataFrame([(i, name, p) for i, (name, p) in enumerate(rules)], "rule int, rule_id string, pattern string")
    code = F.lit(True) if comments else ~F.col("raw").rlike(r"^\s*[*\"]")
    some = candidates(docs, found, key, text).where(code).select(key, "line", "raw", F.explode("rules").alias("rule"))
    hits = some.join(F.broadcast(table), "rule").where(F.rlike("raw", F.col("pattern"))).select(key, "line", "rule_id")  # the rules came from the driver
    rest = [rules[i] for i, x in enumerate(found) if x is None]
    if not rest:
        return hits
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("p", "raw")).where(code)
    tried = F.array_compact(F.array(*[F.when(F.col("raw").rlike(p), F.lit(name)) for name, p in rest]))
    return hits.unionByName(lines.select(key, (F.col("p") + 1).cast("long").alias("line"), F.explode(tried).alias("rule_id")))
