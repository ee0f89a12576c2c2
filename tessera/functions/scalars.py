"""Column functions: rounding, tiers, ranks, ramps, identity hashes, text guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    k = 10.0**digits
    return F.floor(x * k + 0.5) / k


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def ramp(x: Column, lo: float, hi: float) -> Column:
    """0 at lo, 1 at hi; null stays null."""
    return F.when(x.isNotNull(), clamp01((x - lo) / (hi - lo)))


def tiers(x: Column, *steps: tuple[float, str], otherwise: str) -> Column:
    """The name of the first bound that x does not exceed."""
    out = F.lit(otherwise)
    for bound, name in reversed(steps):
        out = F.when(x <= bound, name).otherwise(out)
    return out


def impact_tier(n: Column) -> Column:
    return F.when(n >= 50, "critical").when(n >= 20, "high").when(n >= 5, "medium").otherwise("low")


def effort_tier(debt: Column, statements: Column) -> Column:
    return F.when((debt > 0.7) | (statements > 200), "XL").when((debt > 0.5) | (statements > 100), "L").when((debt > 0.3) | (statements > 50), "M").otherwise("S")


def migration_complexity(dynamic: Column, cyclomatic: Column, nesting: Column, debt: Column) -> Column:
    return (dynamic > 0.3).cast("int") + (cyclomatic > 10).cast("int") + (nesting > 5).cast("int") + (debt > 0.6).cast("int")


def maintainability(volume: Column, complexity: Column, loc: Column, comment_share: Column) -> Column:
    one = F.lit(1.0)
    raw = 171 - 5.2 * F.log(F.greatest(volume, one)) - 0.23 * F.greatest(complexity, one) - 16.2 * F.log(F.greatest(loc, one)) + 50 * F.sin(F.sqrt(2.4 * comment_share))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw * 100 / 171))


def priority(rank: Column) -> Column:
    return F.when(rank > 0.8, "P1").when(rank > 0.5, "P2").otherwise("P3")


def namespace(name: Column) -> Column:
    n = F.trim(name)
    return F.when((n == "") | n.isNull(), "sap").when(n.startswith("/"), "registered").when(n.startswith("Z"), "Z").when(n.startswith("Y"), "Y").otherwise("sap")


def level_rank(level: Column) -> Column:
    return F.when(level == "D", 0).when(level == "C", 1).when(level == "B", 2).when(level == "A", 3)


def rank_level(rank: Column) -> Column:
    return F.when(rank == 0, "D").when(rank == 1, "C").when(rank == 2, "B").when(rank == 3, "A")


def severity_grade(severity: Column) -> Column:
    return F.when(severity == "p1", "blocker").when(severity == "p2", "warning").otherwise("advisory")


def grade_priority(grade: Column) -> Column:
    return F.when(grade == "blocker", "P1").when(grade == "warning", "P2").when(grade == "advisory", "P3").otherwise("none")


def access_grade(access: Column, released: Column) -> Column:
    return F.when(released, "A").when(access == "write", "D").otherwise("C")


def activity(days: Column, active: int, idle: int) -> Column:
    return F.when(days.isNull(), "unknown").when(days <= active, "active").when(days <= idle, "idle").otherwise("stale")


def identity(*parts: Column) -> Column:
    """SHA-256 of the parts joined by a pipe; a null part is empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def code_part(raw: Column) -> Column:
    """A line without its trailing comment; double quotes within literals don't count."""
    return F.regexp_extract(raw, r"^((?:[^'\"]|'(?:[^']|'')*(?:'|\z))*)", 1)


def is_comment(raw: Column) -> Column:
    return raw.rlike(r"^\s*[*\"]")


def escape_xml(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def token_after(text: Column, keyword: str) -> Column:
    words = F.split(text, " ")
    at = F.array_position(words, keyword)
    return F.when(at > 0, F.get(words, at.cast("int")))


def sap_date(s: Column) -> Column:
    return F.date_format(F.try_to_timestamp(s, F.lit("yyyyMMdd")), "yyyy-MM-dd")


def confidence(n: Column) -> Column:
    """0.6 for the first resolution, 0.15 more for each further one, 0.95 at most."""
    return round_half_up(F.least(F.lit(0.95), 0.6 + 0.15 * (n - 1)), 2)


def ident(name: Column) -> Column:
    """Names are told in upper case."""
    return F.upper(name)


def strip_quotes(s: Column, marks: str = "'\"`") -> Column:
    """A text without the given marks."""
    return F.translate(s, marks, "")


def capture(s: Column, pattern: str, group: int = 1) -> Column:
    """The first capture; empty if there is none."""
    return F.regexp_extract(s, pattern, group)


def captures(s: Column, pattern: str, group: int = 1) -> Column:
    """All captures."""
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(group))


def escape_pattern(s: Column) -> Column:
    """A text as a pattern that matches it and nothing else."""
    return F.regexp_replace(s, r"([.*+?^$(){}|\[\]\\])", r"\\$1")


def sha256_hex(s: Column) -> Column:
    """X7."""
    return F.sha2(s, 256)


def disposition_hint(tag: Column, family: Column, hints: list[tuple[str, str]]) -> Column:
    """The tag if there is one; style for style rules; else the hint of the first pattern that a family matches, style without any."""
    out = F.when(tag.isNotNull(), tag).when(family == "abaplint", "style")
    for pattern, hint in hints:
        out = out.when(family.rlike(pattern), hint)
    return out.otherwise("style")


def island(json: Column) -> Column:
    """JSON that may stand within a script element of a page."""
    return F.replace(F.replace(F.replace(json, F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e")), F.lit("&"), F.lit("\\u0026"))


def evidence_union(*lists: Column) -> Column:
    """Distinct values of several lists, in order; a null list is empty."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[F.coalesce(x, F.array()) for x in lists]))))


def counter_get(counter: Column, key: str) -> Column:
    """A map's value of a key, zero without one."""
    return F.coalesce(F.try_element_at(counter, F.lit(key)), F.lit(0))
