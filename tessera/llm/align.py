"""11. Cross-tokenizer alignment by label strings.

Two tokenizers cut the same bytes: A, a byte-level model, reads a space and the text; B, a sentencepiece model,
adds that space itself.  Every byte gets a label: 0 where no token ends, 1 where one of A ends, 2 one of B, 3 both.
A regular expression finds the spans up to each 3; the labels in a span count its tokens, which are a group.
At the end of a group one token of each side ends: the link of that group.

Texts are cut into runs before the spaces that both tokenizers start a token at in any case (a space after another character; no
piece of B holds a space behind another character, else texts stay whole).  The labels of a run are those of the text
there, and workers remember the groups of runs, up to a fixed number.

The links of an id pair are counted over the whole corpus, pre-aggregated by document and by task.  The counts of the HOT_PAIRS most frequent
pairs go to all workers (at most that many, whatever the corpus); the links of other pairs meet their counts by a
shuffle, in which no pair can be frequent.

Null and empty texts, and texts whose tokens' bytes don't make up space and text on both sides (B may
normalise, or the text holds B's space sign), have no tokens: zeros and an empty string.  Repeated rows are rows of their own and count
as often as they occur; null ids and ids of any type are kept; further columns don't matter.  An empty table gives an empty result.
Ties: all pairs with their B id's highest count are best ones.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import accumulate, chain, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.common import id_type, steps, texts, written

#: Runs that a worker remembers, and the longest that it remembers.
REMEMBERED, LONGEST = 300_000, 64
#: Pairs whose counts are sent to all workers: 17 bytes each.
HOT_PAIRS = 2_000_000

_spans = re.compile(rb"[0-2]*3")
_apart = re.compile(r"(?<=\S)(?= +[^ ])")
_glued = re.compile(r"\s \s| $")
_B = 32  # bits of an id in a pair


def _byte_level() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: itself where printable, else 256 and up in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class SideA:
    """A byte-level tokenizer: ids of strings, and each id's bytes."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))
        if (model["pre_tokenizer"] or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path} is no byte-level tokenizer")
        byte = _byte_level()
        vocab = model["model"]["vocab"]
        self.entries = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.entries[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.cuts = tokens._cuts(model)
        quick = tokens._quick(path)  # the same merges in the quicker library, if its ids are the same
        if quick:
            self.encode = lambda rows: [quick.encode_ordinary(r) for r in rows]
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        library.encode_special_tokens = True
        self.encode = lambda rows: [x.ids for x in library.encode_batch(rows, add_special_tokens=False)]


class SideB:
    """A sentencepiece model: ids of strings without the space it adds, and each id's bytes with it."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.entries = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.encode = lambda rows: model.encode(rows) if rows else []


class Aligner:
    """Both sides, and what a worker remembers of runs: (tokens of A, tokens of B, groups, their line, their links), or None if the bytes differ."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = SideA(path_a), SideB(path_b)
        self.cuts = self.a.cuts and self.b.cuts
        self.size = tuple(np.array(list(map(len, s.entries)), np.int64) for s in (self.a, self.b))
        self.name = list(map(str, range(max(len(self.a.entries), len(self.b.entries)))))
        self._known: tuple[dict[str, tuple | None], dict[str, tuple | None]] = ({}, {})

    def runs(self, text: str) -> list[str]:
        """The runs of a text, each without the space before it."""
        if not self.cuts or not text:
            return [text]
        if text[0] != " " and "  " not in text and not _glued.search(text):
            return text.split(" ")
        return [r[1:] for r in _apart.split(" " + text)]

    def labels(self, a: list[list[int]], b: list[list[int]]) -> bytes:
        """The label of each byte of the concatenated runs."""
        ends = [np.cumsum(size[np.fromiter(chain.from_iterable(ids), np.int64)]) for size, ids in zip(self.size, (a, b), strict=True)]
        label = np.full(int(ends[0][-1]) if len(ends[0]) else 0, ord("0"), np.uint8)
        label[ends[0] - 1] += 1
        label[ends[1] - 1] += 2
        return label.tobytes()

    def learn(self, runs: list[str]) -> dict[str, tuple | None]:
        """The groups of distinct runs."""
        whole = [f" {r}" for r in runs]
        ids = list(zip(self.a.encode(whole), self.b.encode(runs), strict=True))
        of_a, of_b = self.a.entries.__getitem__, self.b.entries.__getitem__
        data = [w.encode("utf-8", "surrogatepass") for w in whole]
        fits = [b"".join(map(of_b, b)) == d and b"".join(map(of_a, a)) == d for d, (a, b) in zip(data, ids, strict=True)]
        out: dict[str, tuple | None] = {r: None for r, ok in zip(runs, fits, strict=True) if not ok}
        good = [(r, len(d), a, b) for r, d, (a, b), ok in zip(runs, data, ids, fits, strict=True) if ok]
        label = self.labels([x[2] for x in good], [x[3] for x in good])
        name = self.name.__getitem__
        start = 0
        for run, size, a, b in good:
            at_a = at_b = 0
            lines, links = [], []
            for span in _spans.findall(label[start : start + size]):
                to_a, to_b = at_a + 1 + span.count(b"1"), at_b + 1 + span.count(b"2")
                lines.append(f"{','.join(map(name, a[at_a:to_a]))}|{','.join(map(name, b[at_b:to_b]))}")
                links.append(a[to_a - 1] << _B | b[to_b - 1])
                at_a, at_b = to_a, to_b
            out[run] = (len(a), len(b), len(lines), ";".join(lines), tuple(links))
            start += size
        return out

    def aligned(self, rows: list[str]) -> list[tuple | None]:
        """For each text: tokens of A, of B, groups, their line, and the links' pairs with the times of each; None without tokens."""
        each = [self.runs(r) for r in rows]
        every = list(chain.from_iterable(each))
        known, earlier = self._known
        got = list(map(known.get, every, every))  # a run itself stands for one that isn't known
        new = {r for r, x in zip(every, got, strict=True) if x is r}
        if new:
            found = {r: earlier[r] for r in new if r in earlier}
            found.update(self.learn([r for r in new if r not in found]))
            got = [found[r] if x is r else x for r, x in zip(every, got, strict=True)]
            if len(known) > REMEMBERED // 2:
                self._known = known, earlier = {}, known
            known.update((r, x) for r, x in found.items() if len(r) <= LONGEST)
        out, rest = [], iter(got)
        for row, runs in zip(rows, each, strict=True):
            own = list(islice(rest, len(runs)))
            if not row or None in own:
                out.append(None)
                continue
            a, b, groups, lines, links = zip(*own, strict=True)
            pairs, times = np.unique(np.fromiter(chain.from_iterable(links), np.int64), return_counts=True)
            out.append((sum(a), sum(b), sum(groups), ";".join(lines), pairs, times))
        return out


_worker: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """This process's own."""
    if (path_a, path_b) not in _worker:
        _worker[path_a, path_b] = Aligner(path_a, path_b)
    return _worker[path_a, path_b]


# ---------------------------------------------------------------- operators


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = pa.array([0, *accumulate(map(len, rows))], pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*rows, np.zeros(0, np.int64)]), kind))


def align(docs: DataFrame, path_a: str, path_b: str, *more: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups (a1,a2|b1;a3|b2: ids of A and B, in order), pairs and times of the links of each document.

    A pair is the id of A, shifted by 32 bits, and that of B.  more: further columns to keep.
    The models' files must be where the workers find them, as any installed file.
    """
    names = ["n_a", "n_b", "n_groups", "groups", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, none = aligner(path_a, path_b), (0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
        for b in steps(batches):
            rows = [x or none for x in own.aligned(b.column("text").to_pylist())]
            columns = [list(map(itemgetter(i), rows)) for i in range(6)]
            arrays = [*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()), _lists(columns[4], pa.int64()), _lists(columns[5], pa.int32())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", *more)), *arrays], ["doc_id", *more, *names])

    rows = texts(docs, *more)
    kept = "".join(f", {c} {id_type(rows, c)}" for c in more)
    return rows.mapInArrow(run, f"doc_id {id_type(rows)}{kept}, n_a long, n_b long, n_groups long, groups string, pairs array<long>, times array<int>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (its links in the corpus), best (whether no pair of its B id has more)."""
    links = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("k"))
    counts = links.groupBy("pair").agg(F.sum("k").alias("n"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND((1 << _B) - 1))  # as many rows as A has ids at most
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(of_b)).alias("best"))


def linked(aligned: DataFrame, key: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """The rows of aligned(key, pairs, times, ...), a written table, with n_best and count_sum instead of pairs and times; key tells rows apart."""
    counts = written(pair_counts(aligned), "pairs")
    least, total = 0, counts.count()
    while total > hot_pairs:
        least = 2 * least + 1
        total = counts.where(F.col("n") > least).count()
    hot = counts.where(F.col("n") > least).toArrow()
    order = np.argsort(hot["pair"].to_numpy())
    table = aligned.sparkSession.sparkContext.broadcast(tuple(hot[c].to_numpy()[order] for c in ("pair", "n", "best")))

    def found(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Of each link pair of the batch: its row, itself, its times, whether it is hot, its place in the table."""
        pairs, times = batch.column("pairs"), batch.column("times")
        n = np.diff(pairs.offsets.to_numpy())
        row, flat, k = np.repeat(np.arange(len(n)), n), pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        known = table.value[0]
        at = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
        return row, flat, k, known[at] == flat if len(known) else np.zeros(len(flat), bool), at

    def summed(row: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
        ends = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        edge = np.searchsorted(row, np.arange(n + 1))
        return pa.array(ends[edge[1:]] - ends[edge[:-1]], pa.int64())

    kept = [c for c in aligned.columns if c not in ("pairs", "times")]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, n, best = table.value
        for b in batches:
            row, _, k, hit, at = found(b)
            row, k, at = row[hit], k[hit], at[hit]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), summed(row, k * best[at], b.num_rows), summed(row, k * n[at], b.num_rows)], [*kept, "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, flat, k, hit, _ = found(b)
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(row[~hit])), pa.array(flat[~hit]), pa.array(k[~hit])], [key, "pair", "k"])

    out = aligned.mapInArrow(look, ", ".join(f"{c} {id_type(aligned, c)}" for c in kept) + ", n_best long, count_sum long")
    if not least:
        return out
    rare = aligned.select(key, "pairs", "times").mapInArrow(others, f"{key} {id_type(aligned, key)}, pair long, k long").join(counts.where(F.col("n") <= least).hint("merge"), "pair")
    rare = rare.groupBy(key).agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("more_best"), F.sum(F.col("k") * F.col("n")).alias("more_sum"))
    plus = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    return out.join(rare, key, "left").select(*kept, plus("n_best", "more_best"), plus("count_sum", "more_sum"))


def link_figures(docs: DataFrame, path_a: str, path_b: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    numbered = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    rows = written(align(numbered, path_a, path_b, "row").select("doc_id", "row", "n_a", "n_b", "n_groups", digest, "pairs", "times"), "aligned")
    out = linked(rows, "row", hot_pairs)
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
