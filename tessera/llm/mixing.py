"""7. Mixing sources to target weights by fitting subset sums.

Targets share the words of all documents by weight; a target stops at `repeats` times its source's
words, and the excess is shared again until none is above.  A source whose target holds its words k whole
times takes every document k times; the rest of the target is a budget of words for one more pass.
Documents are counted by exact length; of each length a share is taken (rounded down), the budget left over
is filled from the longest length down, and what is left of it is fitted by a bounded-knapsack programme over the
remaining documents.  Which documents of a length are taken is decided by seeded hashes of their ids and texts.

Nothing but lengths, sources and hashes is shuffled.  One row for each length and source reaches the fitting of a source (lengths
are at most as many as the words of the longest document).  A hot length is dealt by hash: whole hash ranges are taken by their counts,
rows are ranked within the one range where the count is reached.

Null text: no words.  Null source: a source of its own, after all others.  Rows without words take no budget and are taken
`floor` times like any other.  If no document has words, all targets are 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import written

WEIGHTS, REPEATS, SEED = (1, 2, 3), 3, 20240229
#: Hash ranges of one length, and the largest budget that goes to the knapsack programme.
RANGES, KNAPSACK = 256, 1 << 16


def sizes(text: str = "text") -> F.Column:
    """Words of a text between ASCII white space."""
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\f\r", "     ")
    return F.size(F.array_remove(F.split(plain, " "), "")).cast("long")


def targets(totals: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> dict[str | None, float]:
    """Words that each source should give."""
    order = sorted((s for s, _ in totals if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * any(s is None for s, _ in totals)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    size = dict(totals)
    out: dict[str | None, float] = {}
    left, free = float(sum(size.values())), list(order)
    while free:
        unit = left / sum(weight[s] for s in free)
        above = [s for s in free if unit * weight[s] > repeats * size[s]]
        if not above:
            out |= {s: unit * weight[s] for s in free}
            break
        for s in above:
            out[s] = float(repeats * size[s])
            left -= out[s]
        free = [s for s in free if s not in set(above)]
    return out


def fitted(length: np.ndarray, count: np.ndarray, budget: int, knapsack: int = KNAPSACK) -> np.ndarray:
    """How many of each length to take so that their sum comes as near to the budget as can be."""
    order = np.argsort(length)
    size, have = length[order].astype(object), count[order].astype(object)
    total = int((size * have).sum())
    take = np.array([int(h) * budget // total if total else 0 for h in have], dtype=object)
    left = budget - int((take * size).sum())
    for i in range(len(size) - 1, -1, -1):  # longest first, while more is left than the programme holds
        if left <= knapsack:
            break
        if size[i]:
            more = min(int(have[i] - take[i]), (left - knapsack) // int(size[i]))
            take[i] += more
            left -= more * int(size[i])
    cap = min(left, knapsack)
    # reachable sums as bits of one number; parts of 1, 2, 4, ... documents bound the number of a length
    reach, steps = 1, []
    most = 2 * cap
    mask = (1 << (most + 1)) - 1
    for i in range(len(size) - 1, -1, -1):
        s, rest = int(size[i]), int(have[i] - take[i])
        rest = min(rest, most // s) if s else 0
        k = 1
        while rest > 0 and not reach >> cap & 1:
            n = min(k, rest)
            new = (reach << (n * s)) & mask & ~reach
            if new:
                steps.append((i, n, new))
                reach |= new
            rest -= n
            k *= 2
        if reach >> cap & 1:
            break
    below = (reach & ((1 << (cap + 1)) - 1)).bit_length() - 1
    above = reach >> (cap + 1)
    above = cap + (above & -above).bit_length() if above else most + cap + 1
    at = below if cap - below <= above - cap else above
    for i, n, new in reversed(steps):
        if at and new >> at & 1:
            take[i] += n
            at -= n * int(size[i])
    out = np.zeros(len(length), np.int64)
    out[order] = take.astype(np.int64)
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies of every document; reruns agree."""
    spark = docs.sparkSession
    h = F.xxhash64(F.lit(seed), "doc_id", "text", "source")
    rows = written(docs.select("doc_id", "source", sizes().alias("size"), h.alias("h")), "sizes")
    cells = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    cells = written(cells, "lengths")
    totals = [(r["source"], int(r["words"])) for r in cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()]
    want = targets(totals, weights, repeats)
    plan = [(s, w, float(want[s]), min(repeats, int(want[s] // w)) if w else 0) for s, w in totals]
    plan = [(s, w, t, k, int(round(t - k * w)) if k < repeats else 0) for s, w, t, k in plan]
    schema = "source string, source_size long, target double, whole long, budget long"
    sources = F.broadcast(spark.createDataFrame(plan, schema))  # a row for each source

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        return group.assign(take=fitted(group["size"].to_numpy(), group["n"].to_numpy(), int(group["budget"].iloc[0])))

    open_ = cells.join(sources, cells["source"].eqNullSafe(sources["source"])).select(cells["source"], "size", "n", "budget").where("budget > 0")
    take = open_.groupBy("source").applyInPandas(fit, "source string, size long, n long, budget long, take long").where("take > 0").select("source", "size", "n", "take")
    take = written(take, "takes")
    # one flagged copy of each row: lengths of which all or none are taken need no rank
    flagged = rows.join(take.withColumnRenamed("source", "s").withColumnRenamed("size", "z"), rows["source"].eqNullSafe(F.col("s")) & (rows["size"] == F.col("z")), "left").select("doc_id", "source", rows["size"], "h", F.coalesce("take", F.lit(0)).alias("take"), F.coalesce("n", F.lit(0)).alias("n"))
    flagged = written(flagged.withColumn("part", F.pmod(F.shiftright("h", 40), F.lit(RANGES))), "flagged")
    some = flagged.where("take > 0 and take < n")
    key = ["source", "size"]
    ranges = some.groupBy(*key, "part", "take").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(W.partitionBy(*key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = ranges.withColumn("first", F.col("take") - before).where("first > 0").select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("p"), "first", "m")
    reached = some.join(first, some["source"].eqNullSafe(F.col("s")) & (some["size"] == F.col("z")) & (some["part"] == F.col("p")))
    rank = F.row_number().over(W.partitionBy(*key, "part").orderBy("h", "doc_id"))
    out = ["doc_id", "source", "size", "more"]
    ranked = reached.where("first < m").withColumn("r", rank).withColumn("more", (F.col("r") <= F.col("first")).cast("long"))
    whole = reached.where("first >= m").withColumn("more", F.lit(1).cast("long"))
    beyond = some.join(first, some["source"].eqNullSafe(F.col("s")) & (some["size"] == F.col("z")) & (some["part"] == F.col("p")), "left_anti").withColumn("more", F.lit(0).cast("long"))
    sure = flagged.where("take = 0 or take >= n").withColumn("more", (F.col("take") > 0).cast("long"))
    dealt = sure.select(*out).union(ranked.select(*out)).union(whole.select(*out)).union(beyond.select(*out))
    return dealt.join(sources, dealt["source"].eqNullSafe(sources["source"])).select("doc_id", dealt["source"], "size", "source_size", "target", ((F.col("whole") + F.col("more")) * F.col("size")).alias("taken"), (F.col("whole") + F.col("more")).alias("copies"))
