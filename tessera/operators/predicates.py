"""Predicates as data: statement patterns, signal shapes with their explanations, blockers, guards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    """Fits rows of the kinds (all if none) whose text matches `has` and not `lacks`."""

    id: str
    kinds: tuple[str, ...] = ()
    has: str = ""
    lacks: str = ""

    def fits(self, kind: Column, text: Column) -> Column:
        out = kind.isin(*self.kinds) if self.kinds else F.lit(True)
        out = out & text.rlike(self.has) if self.has else out
        return out & ~text.rlike(self.lacks) if self.lacks else out


def pattern_hits(rows: DataFrame, patterns: Sequence[Pattern], kind: str = "kind", text: str = "text") -> DataFrame:
    """the rows with the id of every pattern that fits, one predicate each in a single pass."""
    hits = F.array_compact(F.array(*[F.when(p.fits(F.col(kind), F.col(text)), F.lit(p.id)) for p in patterns]))
    return rows.withColumn("rule_id", F.explode(hits))


def text_hits(rows: DataFrame, patterns: Sequence[tuple[str, str]], text: str) -> DataFrame:
    """The rows with the id of every expression their text matches."""
    return pattern_hits(rows.withColumn("_any", F.lit("")), [Pattern(name, has=p) for name, p in patterns], "_any", text).drop("_any")


Signals = Mapping[str, Column]


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def shape_score(all_: Signals, any_: Signals) -> Column:
    """F8: signals that hold, of those that should."""
    out = F.lit(0)
    for c in (*all_.values(), *any_.values()):
        out = out + _true(c).cast("int")
    return out


def shape_holds(all_: Signals, any_: Signals, none: Signals) -> Column:
    """F8: all hold, one of any (if there are some), none of none."""
    out = F.lit(True)
    for c in all_.values():
        out = out & _true(c)
    if any_:
        out = out & F.greatest(*[_true(c) for c in any_.values()], F.lit(False))
    for c in none.values():
        out = out & ~_true(c)
    return out


def shape_gaps(all_: Signals, any_: Signals, none: Signals) -> Column:
    """unmet_all, unmet_any (only if none of them holds) and violated_none, each a list of names."""
    names = lambda s, bad: F.array_compact(F.array(*[F.when(bad(c), F.lit(n)) for n, c in s.items()])) if s else F.array().cast("array<string>")
    unmet = lambda c: ~_true(c)
    one = F.greatest(*[_true(c) for c in any_.values()], F.lit(False)) if any_ else F.lit(True)
    return F.struct(names(all_, unmet).alias("unmet_all"), F.when(one, F.array().cast("array<string>")).otherwise(names(any_, unmet)).alias("unmet_any"), names(none, _true).alias("violated_none"))


def s4_blocker(family: Column, grade: Column) -> Column:
    """what blocks the next release of the platform."""
    return family.isin("deprecation", "modification") | ((family == "released-api") & grade.isin("blocker", "warning"))


def cloud_blocker(family: Column, families: Sequence[str]) -> Column:
    """what blocks the cloud: findings of some families."""
    return family.isin(*families)


def transformation(family: Column) -> Column:
    """findings that tell what to transform: of a family, but not of the style rules."""
    return family.isNotNull() & (family != "abaplint")


def search_allowed(query: Column) -> Column:
    """names with wildcards, at most a hundred characters."""
    return query.rlike(r"^[A-Za-z0-9*_]{1,100}\z")


def search_limit(top: Column, most: int = 500) -> Column:
    """the number of rows asked for, within 1 and the most there are."""
    return F.least(F.lit(most), F.greatest(F.lit(1), top)).cast("int")
