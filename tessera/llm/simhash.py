"""5. SimHash near-duplicates by a binary trie self-join.

Two 64-bit fingerprints that differ in at most `budget` bits agree in at least one
of budget + 1 blocks of their bits.  Rows are dealt by (block, value of the block);
within a bucket the remaining bits form a binary trie, joined with itself: pairs
of nodes go down together, add up differing bits, and end when the budget is
exceeded.  A pair of whole subtrees that are already one component is dropped, so
a dense bucket gives a forest, not all pairs.  Buckets above `split` fingerprints are dealt
again by a second block of the remaining bits, which loses no pair either.

Equal fingerprints are one node before any of this.  Links are then joined to
components in rounds on tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import few, hot_join, steps, texts, written
from tessera.llm.graph import components
from tessera.llm.graph import union as _union

BUDGET = 4
#: Fingerprints of one bucket above which it is dealt again.
SPLIT = 20_000
#: Pairs of trie nodes that are held at once, rows of buckets joined at once, and leaf pairs compared directly.
HELD, ROWS, LEAVES = 1 << 20, 1 << 18, 64
_LOW = np.uint64((1 << 52) - 1)


def words(text: str) -> list[bytes]:
    """Words of a text: A-Z lower-cased, cut at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(parts: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, repeats included; of the whole sequence if it is shorter."""
    if len(parts) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), 42)] if parts else [], dtype=np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-size] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[s:e], 42) for s, e in zip(starts, ends[size - 1 :].tolist(), strict=True)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes; zero of none."""
    if not len(hashes):
        return np.uint64(0)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0]


def fingerprint(text: str, size: int = 4) -> np.uint64:
    return majority(shingle_hashes(words(text), size))


# ---------------------------------------------------------------- trie join


def trie_forest(group: np.ndarray, rest: np.ndarray, budget: int = BUDGET, held: int = HELD) -> np.ndarray:
    """For rows sorted by (group, rest), the first row of each row's component within its group.

    rest: at most 52 bits.  At most 4096 groups.
    """
    key = (group.astype(np.uint64) << np.uint64(52)) | rest.astype(np.uint64)
    label = np.arange(len(key), dtype=np.int64)
    edges = np.flatnonzero(np.diff(group)) + 1
    lo = np.concatenate(([0], edges)).astype(np.int64)
    hi = np.concatenate((edges, [len(key)])).astype(np.int64)
    many = hi - lo > 1
    stack = [(51, lo[many], hi[many], lo[many], hi[many], np.zeros(int(many.sum()), np.int8))]
    while stack:
        bit, lo1, hi1, lo2, hi2, diff = stack.pop()
        if len(lo1) > held:  # go down part by part; what is one component meanwhile needs no visit
            same = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
            keep = (same[lo1] != same[hi1 - 1]) | (same[lo2] != same[hi2 - 1]) | (label[lo1] != label[lo2])
            parts = [x[keep] for x in (lo1, hi1, lo2, hi2, diff)]
            half = len(parts[0]) // 2
            if len(parts[0]) > held:
                stack += [(bit, *(x[half:] for x in parts)), (bit, *(x[:half] for x in parts))]
                continue
            lo1, hi1, lo2, hi2, diff = parts
        n1, n2 = hi1 - lo1, hi2 - lo2
        small = n1 * n2 <= LEAVES if bit >= 0 else np.ones(len(lo1), bool)
        at = np.flatnonzero(small)
        for part in np.array_split(at, max(1, -(-int((n1[at] * n2[at]).sum()) // (LEAVES * held // 8)))) if len(at) else ():
            size = n1[part] * n2[part]
            which = np.repeat(part, size)
            k = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            a, b = lo1[which] + k // n2[which], lo2[which] + k % n2[which]
            near = (a < b) & (np.bitwise_count(key[a] ^ key[b]) <= budget)
            _union(label, a[near], b[near])
        if small.all():
            continue
        lo1, hi1, lo2, hi2, diff = (x[~small] for x in (lo1, hi1, lo2, hi2, diff))
        one = np.uint64(1 << bit)
        below = np.uint64((1 << (bit + 1)) - 1)
        mid1 = np.searchsorted(key, (key[lo1] & ~below) | one)
        mid2 = np.searchsorted(key, (key[lo2] & ~below) | one)
        own = lo1 == lo2
        kids = [(lo1, mid1, lo2, mid2, diff), (mid1, hi1, mid2, hi2, diff), (lo1, mid1, mid2, hi2, diff + 1), (mid1[~own], hi1[~own], lo2[~own], mid2[~own], diff[~own] + 1)]
        down = [np.concatenate(x) for x in zip(*kids, strict=True)]
        alive = (down[0] < down[1]) & (down[2] < down[3]) & (down[4] <= budget)
        if alive.any():
            stack.append((bit - 1, *(x[alive] for x in down)))
    return label


def _blocks(bits: int, parts: int) -> list[tuple[int, int]]:
    """First bit (from the top) and width of each part."""
    width = [bits // parts + (i < bits % parts) for i in range(parts)]
    return [(sum(width[:i]), w) for i, w in enumerate(width)]


def _turned(x: np.ndarray, bits: int, start: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of x's low `bits` bits that starts `start` bits from the top, and the other bits."""
    full = np.uint64((1 << bits) - 1)
    turn = ((x << np.uint64(start)) | (x >> np.uint64(bits - start))) & full if start else x & full
    return turn >> np.uint64(bits - width), turn & np.uint64((1 << (bits - width)) - 1)


def dealt(prints: DataFrame, budget: int, hot: set[int]) -> DataFrame:
    """bucket, rest, node: each fingerprint once for each block (for buckets in hot: for each pair of blocks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            kind = batch.column("kind").to_numpy(zero_copy_only=False).astype(np.int64)
            node = batch.column("node").to_numpy(zero_copy_only=False)
            for j, (start, width) in enumerate(_blocks(64, budget + 1)):
                value, rest = _turned(x, 64, start, width)
                bucket = ((kind * 16 + j) << 16) | value.astype(np.int64)
                split = np.isin(bucket, list(hot)) if hot else np.zeros(len(bucket), bool)
                parts = [(bucket[~split], rest[~split], node[~split])]
                for i, (s, w) in enumerate(_blocks(64 - width, budget + 1) if split.any() else ()):
                    v, r = _turned(rest[split], 64 - width, s, w)
                    parts.append(((bucket[split] << 20) | (1 << 19) | (i << 14) | v.astype(np.int64), r, node[split]))
                for b, r, n in parts:
                    if len(b):
                        yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(r.view(np.int64)), pa.array(n)], ["bucket", "rest", "node"])

    return prints.select("kind", "fp", "node").mapInArrow(run, "bucket long, rest long, node long")


def trie_links(prints: DataFrame, budget: int = BUDGET, split: int = SPLIT) -> DataFrame:
    """Links a, b between nodes of prints(kind, fp, node) that join what the pairs within the budget join.

    The budget is 4 bits at most: with more blocks the bits that are left would not fit a trie's key beside its group.
    Fingerprints are compared within their kind.  One node may have many.
    """
    if not 1 <= budget <= BUDGET:
        raise ValueError(f"a budget of {budget} bits: 1 to {BUDGET} are possible")
    hot: set[int] = set()
    if prints.count() > split:  # at most (budget + 1) * 2**13 buckets of each kind
        hot = {r["bucket"] for r in dealt(prints, budget, hot).groupBy("bucket").count().where(F.col("count") > split).collect()}

    def flush(buckets: np.ndarray, rest: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        group = np.cumsum(np.concatenate(([0], np.diff(buckets) != 0)))
        at = 0
        while at < len(group):
            to = int(np.searchsorted(group, group[at] + 4096))
            label = trie_forest(group[at:to] - group[at], rest[at:to].view(np.uint64), budget)
            own = np.flatnonzero(label != np.arange(len(label)))
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(node[at:to][own]), pa.array(node[at:to][label[own]])], ["a", "b"])
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            kept.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "rest", "node")))
            if sum(len(x[0]) for x in kept) >= ROWS:
                whole = [np.concatenate(x) for x in zip(*kept, strict=True)]
                end = int(np.searchsorted(whole[0], whole[0][-1]))  # the last bucket may go on
                yield from flush(*(x[:end] for x in whole))
                kept = [tuple(x[end:] for x in whole)]
        if kept:
            yield from flush(*(np.concatenate(x) for x in zip(*kept, strict=True)))

    rows = dealt(prints, budget, hot).repartition("bucket").sortWithinPartitions("bucket", "rest")
    return rows.mapInArrow(run, "a long, b long")


# ---------------------------------------------------------------- operators


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed number) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            fps = np.array([fingerprint(t, size) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def simhash_components(docs: DataFrame, size: int = 4, budget: int = BUDGET, split: int = SPLIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document.

    Fewer words than a shingle: the whole sequence is the shingle; no word: fingerprint
    zero, linked like any other.  A null id takes no part in the smallest id.
    """
    prints = written(fingerprints(docs, size), "prints")
    total = prints.count()
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("k")), "fingerprints", total)
    linked = components(trie_links(nodes.select(F.lit(0).alias("kind"), "fp", F.col("fp").alias("node")), budget, split), nodes=total)
    roots = written(nodes.join(linked, nodes["fp"] == linked["node"], "left").select("fp", "k", "low", F.coalesce("root", "fp").alias("root")), "roots", total)
    low = roots.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("k"))
    named = written(hot_join(roots.select("fp", "root", F.col("k").alias("copies")), low, ["root"], total).select("fp", F.col("copies").alias("k"), "component_id"), "named", total)
    return few(hot_join(prints, named, ["fp"], total), total).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near copies share this much of their shingles.
NEAR = 0.8
#: Bands of minima that make candidates, minima of a band, and equal minima (of all) without which a pair is not looked at.
BANDS, DEEP, AGREE = 16, 4, 38
#: Rows of a bucket whose pairs are all candidates at once; rows of a block of a larger one; rows of buckets met at once.
FEW, BLOCK, MET = 32, 512, 1 << 16
#: Ids that are sent to all workers; more are joined by a shuffle.
SENT = 2_000_000
_TURNS = np.array([xxhash.xxh64_intdigest(b"%d" % i, 42) for i in range(BANDS * DEEP)], dtype=np.uint64)


def _mixed(h: np.ndarray, turn: np.ndarray) -> np.ndarray:
    h = (h ^ turn) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of the hashes under each of BANDS * DEEP orders."""
    low = np.full(len(_TURNS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        low = np.minimum(low, _mixed(hashes[None, at : at + (1 << 12)], _TURNS[:, None]).min(axis=1))
    return low


def sketch(text: str, size: int = 5) -> tuple[bytes, list[int], bytes]:
    """Digest of the words, key of each band of minima of the shingles (none of an empty text), last byte of each minimum."""
    parts = words(text)
    low = minima(shingle_hashes(parts, size)).astype("<u8")
    keys = [xxhash.xxh64_intdigest(low[j * DEEP : (j + 1) * DEEP].tobytes(), j) for j in range(BANDS)] if parts else []
    return xxhash.xxh3_128_digest(b" ".join(parts)), np.array(keys, np.uint64).view(np.int64).tolist(), low.view(np.uint8)[::8].tobytes()


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard likeness of two sets of shingles (sorted, distinct hashes)."""
    if min(len(x), len(y)) < NEAR * max(len(x), len(y)):  # below NEAR whatever they share
        return 0.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def met(bucket: np.ndarray, node: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by bucket: the candidate pairs (a, b), and the rows of buckets with more than FEW.

    Those have been paired with one row of their bucket only.
    """
    edges = np.flatnonzero(np.diff(bucket)) + 1
    lo = np.concatenate(([0], edges))
    n = np.diff(np.concatenate((lo, [len(bucket)])))
    few = (n > 1) & (n <= FEW)
    size = n[few] ** 2
    k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    first, each = np.repeat(lo[few], size), np.repeat(n[few], size)
    a, b = first + k // each, first + k % each
    pairs, rest = [(a[a < b], b[a < b])], [np.zeros(0, np.int64)]
    for s, m in zip(lo[n > FEW].tolist(), n[n > FEW].tolist(), strict=True):
        rows = np.arange(s, s + m)
        hub = s + int(np.argmin(_mixed(node[rows].view(np.uint64), bucket[rows].view(np.uint64))))  # another one in each bucket
        pairs.append((np.full(m, hub), rows))
        rest.append(rows)
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    near = (node[a] != node[b]) & ((tags[a] == tags[b]).sum(axis=1) >= AGREE)
    a, b = node[a[near]], node[b[near]]
    return np.minimum(a, b), np.maximum(a, b), np.concatenate(rest)


def block_links(node: np.ndarray, root: np.ndarray, chunk: np.ndarray, tags: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join what the near pairs of rows of different roots join; rows of one chunk are paired only if there is no other."""
    root, out, own = root.copy(), [], len(np.unique(chunk)) == 1
    for i in range(len(node)):
        j = i + 1 + np.flatnonzero((root[i + 1 :] != root[i]) & (own | (chunk[i + 1 :] != chunk[i])))
        j = j[(tags[j] == tags[i]).sum(axis=1) >= AGREE]
        for k in j.tolist():
            if root[k] != root[i] and likeness(sets[i], sets[k]) >= NEAR:
                out.append((int(node[i]), int(node[k])))
                root[root == root[k]] = root[i]
    return out


def _in_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups of the keys the batches are sorted by: about `rows` rows, or one group."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        kept.append(batch)
        if sum(b.num_rows for b in kept) < rows:
            continue
        whole = pa.Table.from_batches(kept).combine_chunks()
        same = np.ones(whole.num_rows, bool)
        for k in keys:
            x = whole[k].to_numpy()
            same &= x == x[-1]
        end = int(np.argmax(same))  # the last group may go on
        if end:
            yield whole.slice(0, end)
        kept = whole.slice(end).to_batches()
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def _tags(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BANDS * DEEP)


def near_duplicates(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, keeper of every document: keeper is the smallest id of its group of near copies.

    Near copies share NEAR of their five-word shingles, counted on the whole sets; groups are what pairs of near copies join.
    Candidates agree in one band of DEEP minima out of BANDS (a pair of likeness 0.8 does with probability 0.9998, wherever its
    edits are) and in AGREE of all minima (0.9999).  No pair is united unless it is near itself.  Rows of a bucket above
    FEW are first paired with one of them; what that leaves apart is paired in blocks, so a large group costs no square.
    Texts of equal words are one group whatever their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            rows = [sketch(t, size) for t in b.column("text").to_pylist()]
            cols = [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "digest", "keys", "tag"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _in_groups(batches, ["bucket"], MET):
            bucket, node = t["bucket"].to_numpy(), t["node"].to_numpy()
            a, b, rest = met(bucket, node, _tags(t["tag"]))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], ["bucket", "a", "b"])
            yield pa.RecordBatch.from_arrays([pa.array(bucket[rest]), pa.array(node[rest]), pa.nulls(len(rest), pa.int64())], ["bucket", "a", "b"])

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            parts = [words(t) for t in b.column("text").to_pylist()]
            sets = [np.unique(shingle_hashes(p, size)) for p in parts]
            digests = pa.array([xxhash.xxh3_128_digest(b" ".join(p)) for p in parts], pa.binary())
            tags = pa.array([minima(s).astype("<u8").view(np.uint8)[::8].tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), digests, tags, pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["node", "digest", "tag", "shingles"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)
            keep = pa.array([likeness(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) >= NEAR for x, y in pairs], pa.bool_())
            yield b.select(["a", "b"]).filter(keep)

    def join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["bucket", "lo", "hi"]
        for t in _in_groups(batches, keys, 1):
            where = np.concatenate(([0], np.flatnonzero(np.any([np.diff(t[k].to_numpy()) != 0 for k in keys], axis=0)) + 1, [t.num_rows]))
            for s, e in zip(where[:-1].tolist(), where[1:].tolist(), strict=True):
                g = t.slice(s, e - s)
                sets = [np.frombuffer(x, "<u8") for x in g["shingles"].to_pylist()]
                links = block_links(g["node"].to_numpy(), g["root"].to_numpy(), g["chunk"].to_numpy(), _tags(g["tag"]), sets)
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    prints = written(texts(docs).mapInArrow(run, "doc_id long, digest binary, keys array<long>, tag binary"), "prints")
    total = prints.count()
    nodes = prints.where("doc_id is not null").groupBy("digest").agg(F.min_by(F.struct("doc_id", "keys", "tag"), "doc_id").alias("x"))
    rows = nodes.select(F.explode("x.keys").alias("bucket"), F.col("x.doc_id").alias("node"), "x.tag").repartition("bucket").sortWithinPartitions("bucket", "node")
    found = written(rows.mapInArrow(meet, "bucket long, a long, b long"), "found")
    pairs = found.where("b is not null").select("a", "b").distinct()
    rest = found.where("b is null").select("bucket", F.col("a").alias("node")).distinct()
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).union(rest.select("node")).distinct(), "ids", total)
    ids = F.broadcast(ids) if ids.count() <= SENT else ids.hint("merge")
    sets = written(texts(docs).join(ids, "doc_id", "left_semi").mapInArrow(shingled, "node long, digest binary, tag binary, shingles binary").dropDuplicates(["node", "digest"]), "sets")
    sides = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    links = written(sides.select("a", "b", "x", "y").mapInArrow(confirm, "a long, b long"), "links")
    linked = components(links, nodes=total)
    if not rest.isEmpty():
        open_ = written(rest.join(linked, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root")), "open", BANDS * total)
        many = open_.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket", F.ceil(F.col("n") / BLOCK).alias("k"))
        dealt_ = open_.join(many, "bucket").withColumn("chunk", F.pmod(F.xxhash64("node", "bucket"), F.col("k")))
        dealt_ = dealt_.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
        dealt_ = dealt_.select("bucket", "node", "root", "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))
        blocks = dealt_.join(sets.select("node", "tag", "shingles"), "node").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "node")
        linked = components(links.union(blocks.mapInArrow(join_blocks, "a long, b long")), nodes=total)
    first = prints.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("k"))
    keeper = written(first.join(linked, "node", "left").select("digest", "k", F.coalesce("root", "node").alias("keeper")), "keeper", total)
    return few(hot_join(prints, keeper, ["digest"], total), total).select("doc_id", "keeper")


def keep_one(docs: DataFrame, size: int = 5) -> DataFrame:
    """The documents that are the first of their component of fingerprints and of their group of near copies, with all their columns.

    The components are those of `simhash_components`: fingerprints, blocks of bits, tries.  Near copies whose fingerprints lie farther
    apart than the budget, as edits of five-word shingles make them, are found by `near_duplicates` besides.
    Rows without an id stay.  Of several rows with one id that are kept, the one with the first text stays.
    """
    linked = written(simhash_components(docs), "linked")
    keepers = written(near_duplicates(docs, size), "keepers")
    later = linked.where("doc_id <> component_id").select("doc_id").union(keepers.where("doc_id <> keeper").select("doc_id"))
    gone = written(later.distinct(), "gone", linked.count())
    gone = F.broadcast(gone) if gone.count() <= SENT else gone.hint("merge")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if keepers.groupBy("doc_id").count().where("count > 1 and doc_id is not null").isEmpty():
        return kept
    columns = F.struct(*docs.columns)
    once = kept.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min_by(columns, F.struct("text", F.xxhash64(*docs.columns))).alias("row")).select("row.*")
    return once.unionByName(kept.where("doc_id is null"))
