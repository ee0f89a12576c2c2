"""6. Repeated passages by longest-previous-factor arrays.

A byte goes if a string of `length` bytes that covers it starts elsewhere too.  One
suffix array of a whole corpus fits no machine, so the corpus is first dealt out
without loss: every window of `length` bytes takes as its anchor the KEY-byte string in it
with the smallest hash.  Equal windows have equal anchors at equal places, so
windows need comparing only where anchors are equal.  Neighbouring windows with the
same anchor are one run; a run's context is the bytes of its windows.

Runs whose anchor occurs once have no equal elsewhere.  Runs with equal contexts are copies of one
another; a longest previous factor of a later one is all of it.  What is left are anchors with several
different contexts: one of each context goes to a suffix array (prefix doubling),
LCP values from the ranks of its rounds, and the longest previous factor of a position
from the previous and next smaller positions in suffix order, with the least
LCP on the way.  Mirrored positions give the longest next factor.

No group is too large for that: a window that holds a string of e bytes holds at least half of its other
length - e bytes on one side of it.  So a group with more than CROWD contexts (a common line in many different places) is
dealt again by the bytes on that side, each window to one new group, with a longer
common string.  After eight such steps the common string is the window itself, and one count of the group tells.

keep_first=True removes what has an earlier copy (ids, then texts' hashes, then places) and keeps the first;
keep_first=False removes every copy.

A row is known by its id and a hash of its text, so ids may be null (they come first) or stand on several rows:
rows of one id with different texts are different documents, and equal rows are copies of each other (keep_first: one document).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import HOT, flat, hot_join, id_type, steps, texts, written

LENGTH, KEY = 200, 32
#: Bytes of contexts that go into one suffix array, and contexts of one group that do; larger groups are dealt again.
BLOCK, CROWD = 1 << 20, 3_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of every string of `size` bytes (its bytes as a polynomial, mixed)."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    up = np.full(len(data), _BASE, np.uint64)
    up[0] = 1
    up = np.cumprod(up)
    down = np.full(len(data), _BACK, np.uint64)
    down[0] = 1
    down = np.cumprod(down)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down)))
    h = (total[size:] - total[:-size]) * up[: len(data) - size + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """The smallest of every `size` neighbours, from smallest-so-far values of blocks in both directions."""
    n = len(x) - size + 1
    if n <= 0:
        return x[:0]
    pad = np.concatenate((x, np.full(-len(x) % size, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, size)
    left = np.minimum.accumulate(pad, axis=1).ravel()
    right = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[size - 1 : size - 1 + n])


def runs(data: np.ndarray, offsets: np.ndarray, length: int, key: int) -> tuple[np.ndarray, ...]:
    """row, first window, windows, anchor's hash, hash of context and anchor's place, of every run of the rows."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, empty
    h = rolling(data, key)
    place = np.arange(len(h), dtype=np.uint64)
    best = sliding_min((h & ~np.uint64(0xFFFFFFFF)) | place, length - key + 1)  # leftmost of the smallest
    anchor = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    whole = np.arange(len(anchor)) + length <= offsets[row + 1]
    at = np.flatnonzero(whole)
    if not len(at):
        return empty, empty, empty, empty, empty
    new = np.concatenate(([True], (anchor[at[1:]] != anchor[at[:-1]]) | (row[at[1:]] != row[at[:-1]])))
    first = at[new]
    n = np.diff(np.concatenate((np.flatnonzero(new), [len(at)])))
    a, r = anchor[first], row[first]
    raw, digest = data.tobytes(), xxhash.xxh3_64_intdigest
    context = np.array([digest(raw[s:e], s0) for s, e, s0 in zip(first.tolist(), (first + n - 1 + length).tolist(), (a - first).tolist(), strict=True)], dtype=np.uint64)
    return r, first - offsets[r], n, h[a].view(np.int64), context.view(np.int64)


# ---------------------------------------------------------------- suffix array


def suffix_array(data: np.ndarray, reach: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order of their first `reach` bytes at least, and the ranks by 8, 16, ... bytes.

    Past the end counts as a byte that is smaller than all others.
    """
    n = len(data)
    pad = np.concatenate((data.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)))
    code = np.zeros(n, np.uint64)
    for i in range(7):  # 7 bytes of 9 bits
        code = (code << np.uint64(9)) | pad[i : i + n]
    order = np.argsort(code)
    ranks = []

    def ranked(order: np.ndarray, code: np.ndarray) -> np.ndarray:
        s = code[order]
        out = np.empty(n, np.int64)
        out[order] = np.concatenate(([0], np.cumsum(s[1:] != s[:-1])))
        return out

    ranks.append(ranked(order, code))
    have = 7
    while have < reach and int(ranks[-1].max(initial=0)) < n - 1:
        r = ranks[-1]
        ahead = np.concatenate((r[have:] + 1, np.zeros(min(have, n), np.int64)))[:n]
        code = r * (n + 2) + ahead
        order = np.argsort(code)
        ranks.append(ranked(order, code))
        have *= 2
    return order, ranks


def lcp_of(data: np.ndarray, a: np.ndarray, b: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Common leading bytes of suffixes a[i] and b[i], from the ranks and the last few bytes: counted to the last round's reach."""
    n = len(data)
    a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        same = (a < n) & (b < n) & (ranks[k][np.minimum(a, n - 1)] == ranks[k][np.minimum(b, n - 1)])
        step = np.where(same, 7 << k, 0)
        a, b, out = a + step, b + step, out + step
    same = np.ones(len(a), bool)
    for _ in range(6):
        same &= (a < n) & (b < n) & (data[np.minimum(a, n - 1)] == data[np.minimum(b, n - 1)])
        a, b, out = a + same, b + same, out + same
    return out


def previous_factor(position: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """For suffixes in order, the longest match (if `least` or more) at a smaller position.

    position: of each suffix.  lcp[i]: of suffixes i - 1 and i.  The previous smaller position is found by jumps over
    larger ones, all suffixes at once; the least LCP on the way is the length of the match.
    """
    n = len(position)
    out = np.zeros(n, np.int64)
    for way in (1, -1):  # previous, then next smaller position
        pos, gap = position[::way], (lcp if way == 1 else np.concatenate(([0], lcp[:0:-1])))
        jump = np.arange(-1, n - 1)
        low = gap.copy()
        while True:
            go = np.flatnonzero((jump >= 0) & (low >= least) & (pos[np.maximum(jump, 0)] >= pos))
            if not len(go):
                break
            over = jump[go]
            low_new, jump_new = np.minimum(low[go], low[over]), jump[over]
            low[go], jump[go] = low_new, jump_new
        match = np.where((jump >= 0) & (low >= least), low, 0)
        out = np.maximum(out, match[::way])
    return out


def repeated(contexts: list[bytes], groups: np.ndarray, length: int, both: bool) -> list[np.ndarray]:
    """For each context, which of its windows start at an earlier place too (both: at any other place).

    Contexts are in order of their places.  Windows of different groups differ by their anchors.
    """
    size = np.array([len(c) for c in contexts])
    start = np.concatenate(([0], np.cumsum(size)))
    data = np.frombuffer(b"".join(contexts), np.uint8)
    owner = np.repeat(np.arange(len(contexts)), size)
    order, ranks = suffix_array(data, length)
    room = start[owner + 1] - np.arange(len(data))
    order = order[room[order] >= length]  # only whole windows
    lcp = np.zeros(len(order), np.int64)
    if len(order):
        lcp[1:] = np.minimum(lcp_of(data, order[:-1], order[1:], ranks), np.minimum(room[order[:-1]], room[order[1:]]))
    hit = np.zeros(len(data), bool)
    for sign in (1, -1) if both else (1,):
        hit[order] |= previous_factor(sign * order, lcp, length) >= length
    return [hit[start[i] : start[i] + size[i] - length + 1] for i in range(len(contexts))]


# ---------------------------------------------------------------- operator


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), text."""
    return texts(docs).select("doc_id", F.xxhash64("text").alias("h"), "text")


def anchor_place(context: bytes, length: int, key: int) -> int:
    """Where the anchor of a context's windows is."""
    return int(np.argmin(rolling(np.frombuffer(context[:length], np.uint8), key) & ~np.uint64(0xFFFFFFFF)))


def halves(data: bytes, start: int, size: int, lo: int, hi: int, length: int) -> list[tuple[int, int, int, int, bytes]]:
    """Windows lo to hi, which hold the `size` bytes at start, dealt by half of their other bytes: start, size, lo, hi, bytes at start."""
    half = -(-(length - size) // 2)
    out = []
    if lo <= start - half:
        out.append((start - half, size + half, lo, min(hi, start - half), data[start - half : start + size]))
    if max(lo, start - half + 1) <= hi:
        out.append((start, size + half, max(lo, start - half + 1), hi, data[start : start + size + half]))
    return out


def repeated_windows(docs: DataFrame, length: int = LENGTH, key: int = KEY, keep_first: bool = False, crowd: int = CROWD) -> DataFrame:
    """doc_id, h, at, n, flags: runs of windows of which some go; flags null: all n of them, else one bit each."""
    kind = id_type(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            row, at, n, anchor, context = runs(*flat(b.column("text")), length, key)
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(row), b.column("h").take(row), pa.array(at), pa.array(n.astype(np.int16)), pa.array(anchor), pa.array(context)], ["doc_id", "h", "at", "n", "anchor", "context"])

    all_runs = written(keyed(docs).mapInArrow(cut, f"doc_id {kind}, h long, at long, n short, anchor long, context long"), "runs")
    # anchors that occur again, with the number of different contexts told as one or several
    again = all_runs.groupBy("anchor").agg(F.count("*").alias("k"), F.min("context").alias("lo"), F.max("context").alias("hi")).where("k > 1")
    again = written(again.select("anchor", "k", (F.col("lo") != F.col("hi")).alias("mixed")), "again")
    found = written(hot_join(all_runs, again, ["anchor"], all_runs.count()).drop("k"), "repeats")
    place = F.struct("doc_id", "h", "at", "n")
    kinds = written(found.groupBy("anchor", "context", "mixed").agg(F.count("*").alias("k"), F.min(place).alias("first")), "contexts")

    # one of each context of the anchors that have several: fetch its bytes, and compare
    wanted = kinds.where("mixed").groupBy(F.col("first.doc_id").alias("id"), F.col("first.h").alias("hash")).agg(F.collect_list(F.struct("anchor", "context", "first.at", "first.n", "k")).alias("want"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            out: list[tuple] = []
            rows: list[int] = []
            for i, (text, want) in enumerate(zip(b.column("text").to_pylist(), b.column("want").to_pylist(), strict=True)):
                raw = text.encode("utf-8", "surrogatepass")
                out += [(w["anchor"], w["context"], w["at"], w["k"], raw[w["at"] : w["at"] + w["n"] - 1 + length]) for w in want]
                rows += [i] * len(want)
            cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(),) * 4 + (pa.binary(),), strict=True)]
            yield pa.RecordBatch.from_arrays([*cols[:2], b.column("doc_id").take(pa.array(rows)), b.column("h").take(pa.array(rows)), *cols[2:]], ["anchor", "context", "doc_id", "h", "at", "k", "bytes"])

    source = keyed(docs)
    contexts = source.join(wanted, source["doc_id"].eqNullSafe(F.col("id")) & (source["h"] == F.col("hash"))).select("doc_id", "h", "text", "want")
    contexts = contexts.mapInArrow(fetch, f"anchor long, context long, doc_id {kind}, h long, at long, k long, bytes binary")

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        """rows: group, anchor, context, first window, bytes, in order of their places."""
        flags = repeated([r[4] for r in rows], np.array([r[0] for r in rows]), length, not keep_first)
        cols = [[r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], [len(f) for f in flags], [_bits(f) for f in flags]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["anchor", "context", "lo", "n", "flags"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        total = 0
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("group", "anchor", "context", "lo", "bytes")), strict=True):
                if total >= BLOCK and r[0] != rows[-1][0]:
                    yield solve(rows)
                    rows, total = [], 0
                if not rows or rows[-1][:4] != r[:4]:  # equal rows fetch the same bytes
                    rows.append(r)
                    total += len(r[4])
        if rows:
            yield solve(rows)

    schema = "anchor long, context long, lo int, n int, flags binary"
    where = ["doc_id", "h", "at"]
    columns = ["group", "anchor", "context", "lo", *where, "bytes"]
    solved = lambda rows: rows.select(*columns).repartition("group").sortWithinPartitions("group", *where, "anchor", "context", "lo").mapInArrow(compare, schema)
    rows = contexts.withColumn("lo", F.lit(0))
    large = kinds.where("mixed").groupBy("anchor").agg(F.count("*").alias("k")).where(F.col("k") > crowd)
    large = written(large, "crowded")
    parts = None
    if large.isEmpty():
        flags = solved(rows.withColumn("group", F.col("anchor")))
    else:
        rows = written(rows, "crowd")
        in_large = lambda part, by: part.join(F.broadcast(large.select(by)) if large.count() <= HOT else large.select(by), by, "left_semi")
        flags = solved(rows.join(F.broadcast(large) if large.count() <= HOT else large, "anchor", "left_anti").withColumn("group", F.col("anchor")))
        more, parts = _dealt(in_large(rows, "anchor").dropDuplicates(["anchor", "context"]), length, key, crowd, keep_first, solved)
        parts = parts.unionByName(more) if more is not None else parts
    if parts is not None:

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for pieces in b.column("pieces").to_pylist():
                    flag = np.zeros(max(p["lo"] + p["n"] for p in pieces), bool)
                    for p in pieces:
                        flag[p["lo"] : p["lo"] + p["n"]] |= np.unpackbits(np.frombuffer(p["flags"], np.uint8))[: p["n"]].astype(bool)
                    out.append((0, len(flag), _bits(flag)))
                cols = [pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([b.column("anchor"), b.column("context"), *cols], ["anchor", "context", "lo", "n", "flags"])

        packed = parts.groupBy("anchor", "context").agg(F.collect_list(F.struct("lo", "n", "flags")).alias("pieces")).mapInArrow(pack, schema)
        flags = flags.unionByName(packed)
    known = kinds.join(flags.select("anchor", "context", F.col("flags").alias("bits")), ["anchor", "context"], "left")
    rows, total = found.drop("mixed"), found.count()
    if keep_first:
        later = hot_join(rows, written(known.select("anchor", "context", "k", "first", "bits"), "known"), ["anchor", "context"], total)
        later = later.withColumn("lead", place.eqNullSafe(F.col("first")))
        return later.where("not lead or bits is not null").select("doc_id", "h", "at", "n", F.when(F.col("lead"), F.col("bits")).alias("flags"))
    known = written(known.where("k > 1 or bits is not null").select("anchor", "context", "k", "bits"), "known")
    return hot_join(rows, known, ["anchor", "context"], total).select("doc_id", "h", "at", "n", F.when(F.col("k") == 1, F.col("bits")).alias("flags"))


def _dealt(rows: DataFrame, length: int, key: int, crowd: int, keep_first: bool, solved) -> tuple[DataFrame | None, DataFrame]:
    """Flags of windows of contexts whose group is too large for one suffix array: (of groups of one window, of the others)."""
    kind = id_type(rows)
    schema = f"group string, anchor long, context long, doc_id {kind}, h long, at long, lo int, hi int, start int, size int, bytes binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = b.to_pydict()
            out: list[tuple] = []
            for i, data in enumerate(cols["bytes"]):
                if "start" in cols:
                    start, size, lo, hi = (cols[c][i] for c in ("start", "size", "lo", "hi"))
                else:
                    start, size, lo, hi = anchor_place(data, length, key), key, 0, len(data) - length
                for s, e, a, z, common in halves(data, start, size, lo, hi, length):
                    out.append((i, f"{'L' if s < start else 'R'}{xxhash.xxh3_128_hexdigest(common)}", a, z, s, e, data))
            take = pa.array([o[0] for o in out], pa.int64())
            new = [pa.array([o[j] for o in out], k) for j, k in ((1, pa.string()), (2, pa.int32()), (3, pa.int32()), (4, pa.int32()), (5, pa.int32()), (6, pa.binary()))]
            old = [b.column(c).take(take) for c in ("anchor", "context", "doc_id", "h", "at")]
            yield pa.RecordBatch.from_arrays([new[0], *old, *new[1:]], ["group", "anchor", "context", "doc_id", "h", "at", "lo", "hi", "start", "size", "bytes"])

    parts = None
    while True:
        rows = written(rows.mapInArrow(deal, schema), "dealt")
        large = written(rows.groupBy("group").agg(F.count("*").alias("k")).where(F.col("k") > crowd), "large")
        none = large.isEmpty()
        small = rows if none else rows.join(F.broadcast(large.select("group")) if large.count() <= HOT else large.select("group"), "group", "left_anti")
        cut = small.withColumn("bytes", F.expr(f"substring(bytes, lo + 1, hi - lo + {length})"))
        mine = solved(cut)
        parts = mine if parts is None else parts.unionByName(mine)
        if none:
            return None, parts
        rows = rows.join(F.broadcast(large.select("group")) if large.count() <= HOT else large.select("group"), "group", "left_semi")
        if rows.select("size").first()[0] >= length:  # the group's common string is its one window
            spot = F.struct("doc_id", "h", "at", "lo")
            first = written(rows.groupBy("group").agg(F.min(spot).alias("first")), "first")
            first = F.broadcast(first) if first.count() <= HOT else first
            later = rows.join(first, "group").where(~spot.eqNullSafe(F.col("first")) if keep_first else F.lit(True))
            return later.select("anchor", "context", "lo", F.lit(1).alias("n"), F.lit(b"\x80").alias("flags")), parts


def spans(windows: list[tuple[int, int, bytes | None]], length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges that windows to be removed cover."""
    out: list[list[int]] = []
    for at, n, flags in sorted(windows, key=lambda w: w[0]):
        if flags is None:
            parts = [(at, at + n - 1)]
        else:
            on = np.flatnonzero(np.unpackbits(np.frombuffer(flags, np.uint8))[:n])
            if not len(on):
                continue
            cuts = np.flatnonzero(np.diff(on) > 1)
            parts = list(zip(at + on[np.concatenate(([0], cuts + 1))], at + on[np.concatenate((cuts, [len(on) - 1]))], strict=True))
        for a, b in parts:
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], int(b) + length)
            else:
                out.append([int(a), int(b) + length])
    return [(a, b) for a, b in out]


def repeated_spans(docs: DataFrame, length: int = LENGTH, key: int = KEY, keep_first: bool = False, crowd: int = CROWD) -> DataFrame:
    """doc_id, h, windows of the documents that lose something; spans(windows) are their removed byte ranges."""
    rows = repeated_windows(docs, length, key, keep_first, crowd)
    return rows.groupBy("doc_id", "h").agg(F.collect_set(F.struct("at", "n", "flags")).alias("windows"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, key: int = KEY, keep_first: bool = False, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.  Ids may be null or repeated; null text: empty.

    keep_first: rows that are equal in id and text count as one, so each of them keeps what the first one keeps.
    """
    kind = id_type(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            out = []
            for text, windows in zip(b.column("text").to_pylist(), b.column("windows").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                gone = spans([(w["at"], w["n"], w["flags"]) for w in windows or ()], length)
                digest, at = hashlib.sha256(), 0
                for s, e in gone:
                    digest.update(raw[at:s])
                    at = e
                digest.update(raw[at:])
                out.append((len(raw), sum(e - s for s, e in gone), len(gone), digest.hexdigest()))
            kinds = (pa.int64(),) * 3 + (pa.string(),)
            cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    lost = written(repeated_spans(docs, length, key, keep_first, crowd), "spans").withColumnsRenamed({"doc_id": "id", "h": "hash"})
    source = keyed(docs)
    both = source.join(lost, source["doc_id"].eqNullSafe(F.col("id")) & (source["h"] == F.col("hash")), "left").select("doc_id", "text", "windows")
    return both.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
