"""4. Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are compared as lower-cased bytes without ASCII punctuation and
white space.  An item of m bytes that occurs with at most k edits shares at least
m + 1 - (k + 1) q of its q-grams with the place, on diagonals (place less offset) that spread over k at most.
Shared q-grams are counted in bands of 2 (k + 1) diagonals that overlap by half, so
every such spread lies in one of them; bands that reach the bound are verified by an alignment within the band.

k is `edits` of an item's length, and less for items so short that the bound would be
below one.  Items shorter than q are found as whole words, those shorter than LEAST leak nowhere (a single
letter is in every text).  An item leaks into a document if it occurs there within k edits.  Null or blank items leak nowhere;
null texts hold none.  Repeated rows are judged each; repeated items are one; an id on several items names each of them.

The benchmark goes to all workers in blocks of BLOCK bytes at most (an index takes 16 bytes for each); documents aren't
shuffled.  Hits are counted HITS at a time, so a text of one repeated string doesn't lay out all its pairs with an item.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import by_text, id_type, steps, texts

Q, EDITS, LEAST = 8, 0.1, 4
#: Bytes of benchmark text that are searched for in one pass, and hits that are counted at once.
BLOCK, HITS = 4 << 20, 1 << 20
_FILTER = 23
_drop = bytes(c for c in range(128) if not chr(c).isalnum())
_part = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def squeezed(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(None, _drop)


def spaced(text: str) -> bytes:
    """The words of a text, one space around each."""
    return b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_part).split()) + b" "


def grams(data: np.ndarray) -> np.ndarray:
    """All 8-byte strings as numbers."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    two = data[:-1].astype(np.uint16) | (data[1:].astype(np.uint16) << np.uint16(8))
    four = two[:-2].astype(np.uint32) | (two[2:].astype(np.uint32) << np.uint32(16))
    return four[:-4].astype(np.uint64) | (four[4:].astype(np.uint64) << np.uint64(32))


def _slot(code: np.ndarray) -> np.ndarray:
    return (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _FILTER)


@dataclass
class Index:
    """The q-grams of benchmark items: sorted codes, and item and offset of each."""

    ids: list
    items: list[bytes]
    edits: np.ndarray
    bound: np.ndarray
    codes: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    filter: np.ndarray
    short: list[tuple[int, bytes]]

    @classmethod
    def of(cls, rows: list[tuple], rate: float = EDITS) -> Index:
        words = [spaced(t) for _, t in rows if len(squeezed(t or "")) >= LEAST]
        rows = [(i, s) for i, t in rows if len(s := squeezed(t or "")) >= LEAST]
        size = np.array([len(s) for _, s in rows], np.int64)
        edits = np.maximum(0, np.minimum((size * rate).astype(np.int64), size // Q - 1))
        parts = [grams(np.frombuffer(s, np.uint8)) for _, s in rows]
        codes = np.concatenate([np.zeros(0, np.uint64), *parts])
        item = np.repeat(np.arange(len(rows), dtype=np.int32), [len(p) for p in parts])
        offset = np.concatenate([np.zeros(0, np.int32), *(np.arange(len(p), dtype=np.int32) for p in parts)])
        order = np.argsort(codes, kind="stable")
        present = np.zeros(1 << _FILTER, bool)
        present[_slot(codes)] = True
        return cls([i for i, _ in rows], [s for _, s in rows], edits, np.maximum(1, size + 1 - (edits + 1) * Q), codes[order], item[order], offset[order], present, [(j, words[j]) for j, (_, x) in enumerate(rows) if len(x) < Q])


def aligned(patterns: list[bytes], edits: np.ndarray, places: list[bytes], width: int) -> np.ndarray:
    """Fewest edits of each pattern anywhere in its place, along the first `width` diagonals."""
    n, most = len(patterns), max(map(len, patterns))
    size = np.array([len(p) for p in patterns])
    pat = np.zeros((n, most), np.int16)
    txt = np.full((n, most + width), -1, np.int16)
    for i, (p, t) in enumerate(zip(patterns, places, strict=True)):
        pat[i, : len(p)] = np.frombuffer(p, np.uint8)
        t = t[: most + width]
        txt[i, : len(t)] = np.frombuffer(t, np.uint8)
    ramp = np.arange(width, dtype=np.int32)
    now = np.zeros((n, width), np.int32)
    out = np.full(n, 1 << 20, np.int64)
    for i in range(most):
        step = now + (txt[:, i : i + width] != pat[:, i, None])
        step[:, :-1] = np.minimum(step[:, :-1], now[:, 1:] + 1)
        now = np.minimum.accumulate(step - ramp, axis=1) + ramp
        done = size == i + 1
        if done.any():
            out[done] = now[done].min(axis=1)
    return out


def banded(lo: np.ndarray, n: np.ndarray, place: np.ndarray, row: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, item and band of the bands whose hits reach the bound.

    The q-gram at a place of a row (rows in order) is that of n entries of the index from lo on.
    """
    who, key, count = (np.zeros(0, np.int64) for _ in range(3))
    ends = np.cumsum(n)
    first = 0
    while first < len(n):
        to = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + HITS, side="right")))
        m = n[first:to]
        which = np.repeat(lo[first:to], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        item = index.item[which].astype(np.int64)
        band = (np.repeat(place[first:to], m) - index.offset[which]) // (index.edits[item] + 1)
        both = np.repeat(row[first:to], m) * len(index.items) + item
        # both bands of a hit, with the counts so far
        who = np.concatenate((who, both, both))
        key = np.concatenate((key, band, band - 1))
        count = np.concatenate((count, np.ones(2 * len(both), np.int64)))
        order = np.lexsort((key, who))
        who, key, count = who[order], key[order], count[order]
        new = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (key[1:] != key[:-1]))))
        who, key, count = who[new], key[new], np.add.reduceat(count, new)
        first = to
        done = row[first] if first < len(n) else None  # rows before it are counted whole
        weak = (who // len(index.items) != done) & (count < index.bound[who % len(index.items)])
        who, key, count = who[~weak], key[~weak], count[~weak]
    row, item = np.divmod(who, len(index.items))
    return row, item, key


def leaks(rows: list[str], index: Index) -> list[tuple[int, int, int]]:
    """row, item, edits of every leak."""
    clean = [squeezed(t) for t in rows]
    size = np.array([len(c) for c in clean])
    start = np.concatenate(([0], np.cumsum(size)))
    raw = b"".join(clean)
    out = []
    if index.short:
        words = [spaced(t) for t in rows]
        out = [(i, j, 0) for j, s in index.short for i, w in enumerate(words) if s in w]
    code = grams(np.frombuffer(raw, np.uint8))
    at = np.flatnonzero(index.filter[_slot(code)])
    if not len(at) or not len(index.codes):
        return out
    lo = np.searchsorted(index.codes, code[at])
    hi = np.searchsorted(index.codes, code[at], side="right")
    row = np.searchsorted(start, at, side="right") - 1
    ok = (hi > lo) & (at + Q <= start[row + 1])
    at, lo, n, row = at[ok], lo[ok], (hi - lo)[ok], row[ok]
    if not len(at):
        return out
    row, item, band = banded(lo, n, at - start[row], row, index)
    best: dict[tuple[int, int], int] = {}
    by_size = np.argsort([len(index.items[j]) for j in item], kind="stable")
    longest = max(map(len, index.items))
    for k in range(0, len(by_size), 256):
        part = by_size[k : k + 256]
        e = index.edits[item[part]]
        first = band[part] * (e + 1) - e  # an edit before the first shared q-gram shifts the place
        width = int((4 * e + 3).max())
        places = []
        for i, f in zip(row[part], first, strict=True):
            c = clean[i]
            head = b"\x00" * max(0, -int(f))  # diagonals before the text begins; no text has the byte zero
            places.append(head + c[max(0, int(f)) : max(0, int(f) + width + longest)])
        found = aligned([index.items[j] for j in item[part]], e, places, width)
        for i, j, d, most in zip(row[part].tolist(), item[part].tolist(), found.tolist(), e.tolist(), strict=True):
            if d <= most:
                best[i, j] = min(d, best.get((i, j), d))
    return out + [(i, j, d) for (i, j), d in sorted(best.items())]


def _indexes(benchmark: DataFrame, rate: float) -> Iterator[Index]:
    rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK)
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        yield Index.of([tuple(r) for r in part.distinct().orderBy("item_id").collect()], rate)


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = EDITS) -> DataFrame:
    """doc_id, item_id, edits of every leak."""
    spark = docs.sparkSession
    schema = f"doc_id {id_type(docs)}, item_id {id_type(benchmark, 'item_id')}, edits int"
    item_type = benchmark.schema["item_id"].dataType
    out = spark.createDataFrame([], schema)
    for index in _indexes(benchmark, rate):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in steps(batches):
                if found := leaks(b.column("text").to_pylist(), shared.value):
                    rows, items, edits = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows)), pa.array([shared.value.ids[j] for j in items], to_arrow_type(item_type)), pa.array(edits, pa.int32())], ["doc_id", "item_id", "edits"])

        part = texts(docs).mapInArrow(run, schema)
        out = out.unionByName(part)
    return out


def drop_leaky(docs: DataFrame, benchmark: DataFrame, rate: float = EDITS) -> DataFrame:
    """The documents into which no item leaks, with all their columns.  Only texts go to the workers and only yes or no comes back."""

    def clean(shared) -> F.Column:
        def run(rows: list[str]) -> pa.Array:
            keep = np.ones(len(rows), bool)
            keep[[i for i, _, _ in leaks(rows, shared.value)]] = False
            return pa.array(keep, pa.bool_())

        return by_text(run, "boolean")

    for index in _indexes(benchmark, rate):
        docs = docs.where(clean(docs.sparkSession.sparkContext.broadcast(index)))
    return docs
