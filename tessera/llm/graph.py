"""Connected components of a link table, by large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import few, hot_join, written

#: Links that a task contracts at once.
CHUNK = 1 << 18


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; label leads every row to the smallest of its set."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _contracted(links: DataFrame, chunk: int) -> DataFrame:
    """Some `chunk` links of a task at a time become one link from each node to the smallest that these links reach."""

    def stars(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b") for b in kept])
        nodes, at = np.unique(ends, return_inverse=True)
        label = np.arange(len(nodes))
        union(label, at[: len(at) // 2], at[len(at) // 2 :])
        own = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[own], pa.int64()), pa.array(nodes[label[own]], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            kept.append(batch)
            if sum(b.num_rows for b in kept) >= chunk:
                yield stars(kept)
                kept = []
        if kept:
            yield stars(kept)

    return links.mapInArrow(run, "a long, b long")


def _large_star(links: DataFrame, n: int) -> DataFrame:
    """Each node hands its larger neighbours to the smallest of its neighbourhood."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k")).select("a", F.least("a", "m").alias("m"), "k")
    return hot_join(both, low, ["a"], 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame, n: int) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the smallest of them."""
    down = links.where("a > b")
    low = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k"))
    moved = hot_join(down, low, ["a"], n).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, chunk: int = CHUNK, nodes: int | None = None) -> DataFrame:
    """node, root for every node of links(a, b), whole numbers; root is the smallest node of its component.

    Every task contracts its own links first; as soon as `chunk` links at most are left, one task contracts them and no
    round is needed.  With more, rounds go on until every node has one link, to a node without a smaller one; each makes the
    sum of all ends smaller, and about `chunk` links meet in a task.  Their number grows with the logarithm of the nodes; every
    round is written to the shared folder.  No row reaches the driver.
    The links of a node that has many don't meet in one task: it joins by broadcast.
    nodes: about how many there are, if that is known; small tables then lie in few parts.
    """
    first = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(_contracted(first if nodes is None else few(first, nodes), chunk), "links")
    while True:
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(now.select("b", F.lit(0)))
        each = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("low"))
        n, open_ = each.agg(F.sum("up"), F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("low") == 0)))).first()
        if not open_:
            break
        if n <= chunk:
            now = written(_contracted(now.coalesce(1), chunk), "links")
            break
        star = written(_large_star(now, n), "star", n)
        now = written(_contracted(few(_small_star(star, n), n, chunk), chunk), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
