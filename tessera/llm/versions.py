"""8. Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut at line ends and after sentence ends; each piece (with the count of
its earlier repeats) is hashed to a digest, and each digest goes to HASHES cells
of a sketch (signed count, xor of digests, xor of checks).  The sketch of one version less
that of the other holds their differing digests only; peeling pure cells
recovers them.  If cells are left over, both sketches are built larger, from what
the failed one tells about the number of differences, until peeling ends.

Likeness: 1 - differing / all digests (1 of two empty texts).  Equal texts have
equal fingerprints.  Null text: empty.  The next document of the last one is the first;
of a single document, itself.  Rows of one id are ordered by their texts.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import STEP_BYTES, texts

CELLS, HASHES = 16, 3
#: Ranges of ids that a corpus is cut into at most: their bounds go into the plan.
MOST = 20_000


def digests(text: str) -> np.ndarray:
    """Sorted distinct digests of the pieces, repeats told apart by their number."""
    seen: Counter[str] = Counter()
    out = []
    for piece in text.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n"):
        if piece:
            n = seen[piece]
            seen[piece] += 1
            out.append(xxhash.xxh3_64_intdigest(piece.encode("utf-8", "surrogatepass"), n))
    return np.unique(np.array(out, dtype=np.uint64))


def _check(keys: np.ndarray) -> np.ndarray:
    h = keys * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)


def _cells(keys: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Cells of each digest, one in each of HASHES parts of `part` cells."""
    spread = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xFF51AFD7ED558CCD], dtype=np.uint64)[:, None]
    h = keys[None, :] * spread
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    part = part.astype(np.uint64)
    return ((h >> np.uint64(32)) % part + np.arange(HASHES, dtype=np.uint64)[:, None] * part).astype(np.int64)


@dataclass
class Sketches:
    """Sketches of many texts, end to end: sketch i has HASHES * part[i] cells from start[i] on."""

    part: np.ndarray
    start: np.ndarray
    count: np.ndarray
    total: np.ndarray
    check: np.ndarray

    @classmethod
    def of(cls, sets: list[np.ndarray], part: np.ndarray) -> Sketches:
        start = np.concatenate(([0], np.cumsum(HASHES * part)))
        keys = np.concatenate([np.zeros(0, np.uint64), *sets])
        owner = np.repeat(np.arange(len(sets)), [len(k) for k in sets])
        at = (_cells(keys, part[owner]) + start[owner]).ravel()
        total, check = np.zeros(start[-1], np.uint64), np.zeros(start[-1], np.uint64)
        np.bitwise_xor.at(total, at, np.tile(keys, HASHES))
        np.bitwise_xor.at(check, at, np.tile(_check(keys), HASHES))
        return cls(part, start, np.bincount(at, minlength=start[-1]).astype(np.int64), total, check)

    def less(self, other: Sketches) -> Sketches:
        """Sketches of the same sizes subtract cell by cell."""
        return Sketches(self.part, self.start, self.count - other.count, self.total ^ other.total, self.check ^ other.check)

    def one(self, i: int) -> str:
        """A sketch as text: count, digests and checks of its cells."""
        x = slice(self.start[i], self.start[i + 1])
        return base64.b64encode(self.count[x].astype("<i4").tobytes() + self.total[x].astype("<u8").tobytes() + self.check[x].astype("<u4").tobytes()).decode()

    def guesses(self) -> np.ndarray:
        """Differing digests of each sketch, about: each adds HASHES to the mean sum of squared counts."""
        return np.add.reduceat(self.count**2, self.start[:-1]) // HASHES

    def peeled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each recovered digest its sketch, itself and its side (1 or -1); for each sketch, whether peeling ended."""
        count, total, check = self.count.copy(), self.total.copy(), self.check.copy()
        owner = np.repeat(np.arange(len(self.part)), HASHES * self.part)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        look = np.arange(len(count))
        while len(look):
            pure = look[np.abs(count[look]) == 1]
            pure = pure[_check(total[pure]) == check[pure]]
            if not len(pure):
                break
            keys, mine = total[pure], owner[pure]
            at = _cells(keys, self.part[mine]) + self.start[mine]
            same = (total[at] == keys) & (np.abs(count[at]) == 1) & (check[at] == _check(keys))
            first = np.where(same, at, len(count)).min(axis=0) == pure  # a digest may be alone in several cells
            pure, keys, mine, at = pure[first], keys[first], mine[first], at[:, first]
            side = count[pure]
            found.append((mine, keys, side))
            np.subtract.at(count, at.ravel(), np.tile(side, HASHES))
            np.bitwise_xor.at(total, at.ravel(), np.tile(keys, HASHES))
            np.bitwise_xor.at(check, at.ravel(), np.tile(_check(keys), HASHES))
            look = np.unique(at)
        left = np.add.reduceat(((count != 0) | (total != 0)).astype(np.int64), self.start[:-1])
        return *(np.concatenate(x) for x in zip(*found, strict=True)), left == 0


def differing(a: list[np.ndarray], b: list[np.ndarray], small: Sketches | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of digest sets the digests only in a, only in b: sketches grow until they peel.

    small: the differences of sketches that there are already, tried first.
    """
    out: list = [None] * len(a)
    open_ = np.arange(len(a))
    less = small
    part = np.full(len(a), CELLS // HASHES)
    while len(open_):
        if less is None:
            less = Sketches.of([a[i] for i in open_], part).less(Sketches.of([b[i] for i in open_], part))
        mine, keys, side, ended = less.peeled()
        order = np.argsort(mine, kind="stable")
        mine, keys, side = mine[order], keys[order], side[order]
        edge = np.searchsorted(mine, np.arange(len(open_) + 1))
        for j in np.flatnonzero(ended):
            k, s = keys[edge[j] : edge[j + 1]], side[edge[j] : edge[j + 1]]
            out[open_[j]] = (k[s > 0], k[s < 0])
        both = np.array([len(a[i]) + len(b[i]) for i in open_])  # no more can differ
        part = np.maximum(2 * less.part, np.minimum(less.guesses(), both) * 2 // HASHES + 3)[~ended]
        open_, less = open_[~ended], None
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray], small: Sketches | None = None) -> list[float]:
    both = [len(x) + len(y) for x, y in zip(a, b, strict=True)]
    return [1 - (len(x) + len(y)) / n if n else 1.0 for (x, y), n in zip(differing(a, b, small), both, strict=True)]


def sketched(sets: list[np.ndarray]) -> Sketches:
    return Sketches.of(sets, np.full(len(sets), CELLS // HASHES))


def rows_of(pairs: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    """Result rows of (id, text, next text)."""
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for _, t, n in pairs]
    known: dict[str, np.ndarray] = {}  # a next text is a text of its own mostly
    get = lambda x: known[x] if x in known else known.setdefault(x, digests(x))
    sets = [[get(x) for x in part] for part in ([t for _, t, _ in pairs], edited, [n for _, _, n in pairs])]
    own, new, other = map(sketched, sets)
    name = lambda k, s: [f"{len(x)}:{s.one(i)}" for i, x in enumerate(k)]
    cols = [
        [i for i, _, _ in pairs], [len(t) for _, t, _ in pairs], [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited],
        name(sets[0], own), name(sets[1], new), likeness(sets[0], sets[1], own.less(new)), likeness(sets[0], sets[2], own.less(other)),
    ]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def with_next(docs: DataFrame, per_bucket: int = 20_000) -> DataFrame:
    """bucket, doc_id, text, key, head: rows to be read in order of (bucket, key, head, text).

    Buckets are ranges of ids, one to a task, MOST at most (a task reads its bucket as a stream).  Each ends in a copy of the first row of the next one (head), so a row's next
    document is the row after it.  The driver holds one id for each bucket.
    """
    rows = texts(docs).withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    spark = docs.sparkSession
    n = max(1, min(MOST, rows.count() // per_bucket), int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = [i / n for i in range(1, n)]
    bounds = sorted({int(b) for b in rows.select("key").approxQuantile("key", at, min(0.01, 0.2 / n))}) if at else []
    # binary search for the number of bounds that are not above the key
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    bucket = F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0),
        lambda p, s: F.when((p + s <= len(bounds)) & (F.get(F.lit(bounds), p + s - 1) <= F.col("key")), p + s).otherwise(p),
    ) if bounds else F.lit(0)
    rows = rows.select(bucket.alias("bucket"), "doc_id", "text", "key")
    first = sorted((r["key"], r["bucket"]) for r in rows.groupBy("bucket").agg(F.min("key").alias("key")).collect())
    heads = [(key, first[i - 1][1]) for i, (key, _) in enumerate(first)]
    lead = F.broadcast(spark.createDataFrame(heads, "key long, into int"))
    copies = rows.join(lead, "key").groupBy("into", "key").agg(F.min(F.struct("text", "doc_id")).alias("x"))
    heads_df = copies.select(F.col("into").alias("bucket"), "x.doc_id", "x.text", "key", F.lit(True).alias("head"))
    both = rows.withColumn("head", F.lit(False)).unionByName(heads_df)
    return both.repartitionById(n, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "head", "key", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """The result of op8: see the module's docstring."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        pairs: list[tuple[int | None, str, str]] = []
        chars = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "text", "head")), strict=True):
                if now is not None and now[0] == row[0] and not now[3]:
                    pairs.append((now[1], now[2], row[2]))
                    chars += len(now[2]) + len(row[2])
                    if len(pairs) >= 256 or chars > STEP_BYTES:
                        yield rows_of(pairs)
                        pairs, chars = [], 0
                now = row
        if pairs:
            yield rows_of(pairs)

    return with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
