"""13. Byte-level BPE: encoding and decoding by a two-tier lookup.

A text is cut into pre-tokens by the splitter.  First tier: a minimal perfect hash over the vocabulary
(hash and displace: every entry has a slot of its own, no slot is empty) tells whether a whole pre-token is an entry;
one comparison of bytes confirms it.  Second tier, the misses: the pre-token's bytes form a linked list, all neighbours that
may be merged lie in a heap by (rank, place), and the best valid one is merged until none is left.
Both tiers' answers are remembered by the worker, up to a fixed number.

The splitter's classes of letters and numbers are those of the library whose results count: characters that the
installed expression module puts into another class stand as a symbol while the text is cut.  Texts are cut in pieces
before a white space that follows another character, where a pre-token ends in any case, so memory is bounded by
the longest pre-token, not by the text.

Null text: empty, no ids.  Special strings are ordinary text.  Repeated rows are encoded each; null ids and
ids of any type are kept; further columns of the input don't matter.  An empty table gives an empty result.
Decoding takes an id that the vocabulary lacks as an error.  The vocabulary is sent to all workers: its size is fixed.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_type, steps, texts

#: Pre-tokens that a worker remembers, the longest that it remembers, characters that are cut at once.
REMEMBERED, LONGEST, PIECE = 800_000, 64, 1 << 18
#: Displacements that are tried at once, entries a bucket on average.
TRIED, PER_BUCKET = 128, 2

#: Fixed value: the splitter of the rank files, and the same for texts of ASCII characters only.
SPLITTER = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_white = " \\t\\n\\v\\f\\r"
_ascii = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^{_white}A-Za-z0-9]+|[{_white}]+(?![^{_white}])|[{_white}]+")
_split = regex.compile(SPLITTER)
_end = re.compile(r"(?<=\S)(?=[ \n])")
_PLACE = 40


# ---------------------------------------------------------------- splitting


def _odd_characters() -> np.ndarray:
    """For each code point whether the expression module takes it for a letter or number and the encoding library doesn't, or the other way round."""
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    single = {bytes([i]): i for i in range(256)}
    odd: set[str] = set()
    for kind in (r"\p{L}", r"\p{N}"):
        theirs = bytes(tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()
        odd |= set(theirs) ^ set(regex.findall(kind, every))
    out = np.zeros(0x110000, bool)
    out[list(map(ord, odd))] = True
    return out


_odd: list[np.ndarray] = []


def pre_tokens(text: str) -> list[str]:
    """The splitter's matches; they make up the text."""
    if text.isascii():
        return _ascii.findall(text)
    if not _odd:
        _odd.append(_odd_characters())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    odd = _odd[0][points]
    if not odd.any():
        return _split.findall(text)
    shown = np.where(odd, np.uint32(0xFFFD), points).tobytes().decode("utf-32-le", "surrogatepass")
    return [text[m.start() : m.end()] for m in _split.finditer(shown)]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about `size` characters that are split as the whole is."""
    at = 0
    while len(text) - at > size and (m := _end.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


# ---------------------------------------------------------------- minimal perfect hash


def _digests(keys: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64)


def _place(h: np.ndarray, turn: np.ndarray, n: int) -> np.ndarray:
    x = (h ^ (turn * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) % np.uint64(n)


class PerfectHash:
    """A slot for each of n distinct keys, 0 to n-1 without gaps; any other key gets some slot too."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = max(1, -(-n // PER_BUCKET))
        h = _digests(keys)
        if len(np.unique(h)) < n:
            raise ValueError("repeated keys")
        of = (h >> np.uint64(32)) % np.uint64(self.buckets)
        order = np.argsort(of, kind="stable")
        count = np.bincount(of.astype(np.int64), minlength=self.buckets)
        start = np.cumsum(count) - count
        free = np.ones(n, bool)
        turns = np.zeros(self.buckets, np.int64)
        for b in np.argsort(-count, kind="stable").tolist():
            if count[b] < 2:
                break
            own = h[order[start[b] : start[b] + count[b]]][:, None]
            first = 0
            while True:
                at = _place(own, np.arange(first, first + TRIED, dtype=np.uint64)[None], n).astype(np.int64)
                low = np.sort(at, axis=0)
                fits = np.flatnonzero(free[at].all(axis=0) & (low[1:] != low[:-1]).all(axis=0))
                if len(fits):
                    turns[b] = first + fits[0]
                    free[at[:, fits[0]]] = False
                    break
                first += TRIED
        single = np.flatnonzero(count == 1)
        turns[single] = -1 - np.flatnonzero(free)[: len(single)]  # a key alone takes any slot that is left
        self.turns = turns

    def slots(self, keys: list[bytes]) -> np.ndarray:
        h = _digests(keys)
        turn = self.turns[((h >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(turn < 0, -1 - turn, _place(h, turn.view(np.uint64), max(1, self.n)).astype(np.int64))


# ---------------------------------------------------------------- merging


def merge(keys: list[bytes], ranks: dict[bytes, int], pairs: np.ndarray) -> list[tuple[int, ...]]:
    """The ids of each pre-token: of all neighbours that may be merged the one of the lowest rank, the first of those, until none may.

    All keys lie one behind the other in one linked list of bytes; each has a heap of its own.
    pairs: the rank of each pair of bytes, or -1.
    """
    data = b"".join(keys)
    x = np.frombuffer(data, np.uint8)
    ends = np.cumsum(list(map(len, keys)))
    first = np.append(pairs[x[:-1], x[1:]], -1)
    first[ends - 1] = -1
    due, own = first.tolist(), [ranks[bytes([v])] for v in range(256)]
    own = np.array(own)[x].tolist()
    after, before = list(range(1, len(x) + 1)), list(range(-1, len(x) - 1))
    at = np.flatnonzero(first >= 0)
    of = np.searchsorted(ends, at, side="right")
    entries = ((first[at] << _PLACE) | at)[np.lexsort((at, first[at], of))].tolist()  # in order, so each key's part is a heap
    parts = np.searchsorted(of, np.arange(len(keys) + 1)).tolist()
    low, rank = (1 << _PLACE) - 1, ranks.get
    start = 0
    for key, end in enumerate(ends.tolist()):
        heap = entries[parts[key] : parts[key + 1]]
        while heap:
            best = heappop(heap)
            i = best & low
            if due[i] != best >> _PLACE:
                continue  # one of the two has been merged meanwhile
            own[i] = due[i]
            j = after[i]
            after[i] = k = after[j]
            due[j] = own[j] = -1
            if k < end:
                before[k] = i
                due[i] = r = rank(data[i : after[k]], -1)
                if r >= 0:
                    heappush(heap, r << _PLACE | i)
            else:
                due[i] = -1
            if i > start:
                p = before[i]
                due[p] = r = rank(data[p:k], -1)
                if r >= 0:
                    heappush(heap, r << _PLACE | p)
        start = end
    left = np.array(own, np.int64)
    sizes = np.diff(np.concatenate(([0], np.cumsum(left >= 0)[ends - 1]))).tolist() if len(keys) else []
    ids = iter(left[left >= 0].tolist())
    return [tuple(islice(ids, n)) for n in sizes]


class Coder:
    """A vocabulary of ranks with its perfect hash; what a worker makes of it stays with the worker."""

    def __init__(self, ranks: dict[bytes, int]):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"no entry for the bytes {missing[:5]}")
        self.ranks = ranks
        entries = list(ranks)
        self.hash = PerfectHash(entries)
        at = self.hash.slots(entries)
        self.by_slot: list[bytes] = [b""] * len(entries)
        for slot, entry in zip(at.tolist(), entries, strict=True):
            self.by_slot[slot] = entry
        self._blank()

    def _blank(self) -> None:
        """What is made anew in each process."""
        self._known: tuple[dict[str, tuple[int, ...]], dict[str, tuple[int, ...]]] = ({}, {})
        self._entries: list[bytes | None] = []
        self._of_two: np.ndarray | None = None

    def __getstate__(self):
        return self.by_slot, [self.ranks[x] for x in self.by_slot], self.hash

    def __setstate__(self, state):
        self.by_slot, ids, self.hash = state
        self.ranks = dict(zip(self.by_slot, ids, strict=True))
        self._blank()

    def learn(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """The ids of distinct pre-tokens."""
        keys = [w.encode("utf-8", "surrogatepass") for w in words]
        whole = [self.by_slot[slot] == key for slot, key in zip(self.hash.slots(keys).tolist(), keys, strict=True)]
        out = {w: (self.ranks[k],) for w, k, hit in zip(words, keys, whole, strict=True) if hit}
        rest = [(w, k) for w, k, hit in zip(words, keys, whole, strict=True) if not hit]
        out.update(zip((w for w, _ in rest), merge([k for _, k in rest], self.ranks, self._pairs()), strict=True) if rest else ())
        return out

    def _pairs(self) -> np.ndarray:
        if self._of_two is None:
            self._of_two = np.array([[self.ranks.get(bytes((a, b)), -1) for b in range(256)] for a in range(256)])
        return self._of_two

    def encode(self, rows: list[str]) -> list[list[int]]:
        """The ids of each text; the short ones look their new pre-tokens up together."""
        short = [pre_tokens(r) if len(r) <= PIECE else None for r in rows]
        ids = iter(self._words(list(chain.from_iterable(w for w in short if w))))
        whole = lambda r: chain.from_iterable(self._words(pre_tokens(p)) for p in pieces(r))
        return [list(chain.from_iterable(islice(ids, len(w)) if w is not None else whole(r))) for r, w in zip(rows, short, strict=True)]

    def _words(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of each pre-token.  What was asked since the cache was half full stays remembered."""
        known, earlier = self._known
        got = list(map(known.get, words))
        if None in got:
            new = {w for w, x in zip(words, got, strict=True) if x is None}
            found = {w: earlier[w] for w in new if w in earlier}
            found.update(self.learn(list(new - found.keys())))
            got = [found[w] if x is None else x for w, x in zip(words, got, strict=True)]
            if len(known) > REMEMBERED // 2:
                self._known = known, earlier = {}, known
            known.update((w, x) for w, x in found.items() if len(w) <= LONGEST)
        return got

    def decode(self, ids: list[int]) -> bytes:
        if not self._entries:
            self._entries = [None] * (max(self.ranks.values()) + 1)
            for entry, i in self.ranks.items():
                self._entries[i] = entry
        if ids and min(ids) < 0:
            raise ValueError(f"no entry has the id {min(ids)}")
        return b"".join(map(self._entries.__getitem__, ids))


def coder(path: str) -> Coder:
    """The vocabulary of a rank file: a base64 entry and its rank in each line."""
    with open(path, "rb") as lines:
        return Coder({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


# ---------------------------------------------------------------- operators


def _lists(rows: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(rows), np.int32, int(ends[-1]))))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array) of every document."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(coder(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists(vocabulary.value.encode(b.column("text").to_pylist()))], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, f"doc_id {id_type(docs)}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, bytes (binary) of every row of (doc_id, ids); null ids: no bytes."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(coder(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([vocabulary.value.decode(x or []) for x in b.column("ids").to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type(encoded)}, bytes binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array), bytes (binary, decoded from the ids) of every document, in one pass."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(coder(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for b in steps(batches):
            ids = v.encode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists(ids), pa.array(map(v.decode, ids), pa.binary())], ["doc_id", "ids", "bytes"])

    return texts(docs).mapInArrow(run, f"doc_id {id_type(docs)}, ids array<int>, bytes binary")


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of (doc_id, ids, bytes)."""
    line = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(line, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
