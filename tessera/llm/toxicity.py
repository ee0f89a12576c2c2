"""1. Toxicity by compression distance.

Three zstandard dictionaries are trained: one for ordinary text, one for toxic passages that tell alone, and one for those that tell by
their number.  zstandard's trainer makes TRAINED bytes of each from the passages that are typical of the class: runs of strings of several lengths that
rows of the class hold more often than the other's, beyond chance (likelihood ratio).
The most frequent of these passages follow whole, since the trainer keeps parts of them only, and at the end comes a
base of ordinary passages, trained once and shared, so common strings cost the same with each.
A window is shorter under a toxic dictionary only as far as it holds toxic strings.

A text's score is a logistic function of how its windows' lengths differ under each toxic dictionary (sum, largest, number of windows beyond each
of several byte thresholds, all of that by length), fitted on labelled rows that the dictionaries
haven't seen, weighted to the true share of toxic rows.  0.5 is the threshold.

Learns from labelled rows outside the held-out fold, at most PER_CLASS of each class,
none above MAX_BYTES and TOTAL bytes a class (a bounded sample); every document is scored by its
whole text, whatever type its id has.  Labels, language, source and id are no inputs of a score.
Empty and null texts get the score of no windows.  Without labels of both classes all scores are 0.
Repeated rows are scored each; equal texts score alike.  A null id counts as held out (fold 0) and has no label.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tessera.llm.common import by_text, fit_sample, flat, fold, id_type, newton, steps, texts

PER_CLASS, MAX_BYTES, TOTAL = 4_000, 100_000, 8 << 20
WINDOW, OVERLAP = 48, 16
#: Bytes of the strings that tell a class's passages; how many times as often as in the other class's rows they stand in rows of the class, for the dictionary
#: of strings that tell alone and for that of strings that tell by their number.
GRAMS, ALONE, TOGETHER = (5, 6, 8), (40, float("inf")), (4, 40)
#: Bytes of the shared base, of each class's trained part and of its whole passages; length of the trainer's segments.
BASE, TRAINED, TYPICAL, SEGMENT = 6_000, 2_000, 24_000, 16
#: Rows whose strings are counted at once; parts of all strings (a power of two) that are counted one after another, and the factor that deals them.
BLOCK, PARTS, _SPREAD = 200, 4, np.uint64(0x9E3779B97F4A7C15)
#: Bytes put before each window.
LEAD = 28
#: Saved bytes beyond which a window counts.
BEYOND = (0, 1, 2, 4, 8)


def folded(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(bytes.maketrans(b"\n\r\t", b"   "))


def _codes(data: bytes, gram: int) -> np.ndarray:
    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    if len(x) < gram:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(x) - gram + 1, np.uint64)
    for i in range(gram):
        out = (out << np.uint64(8)) | x[i : len(x) - gram + 1 + i]
    return out


def _frequencies(rows: list[bytes], gram: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings of `gram` bytes of one part of PARTS and the number of rows with each; some rows at a time, so only distinct strings are held."""
    codes, counts = np.zeros(0, np.uint64), np.zeros(0)
    for at in range(0, len(rows), BLOCK):
        new = []
        for r in rows[at : at + BLOCK]:
            x = _codes(r, gram)
            new.append(np.unique(x[(x * _SPREAD) >> np.uint64(32) & np.uint64(PARTS - 1) == part]))
        new = np.concatenate(new)
        codes, place = np.unique(np.concatenate((codes, new)), return_inverse=True)
        counts = np.bincount(place, np.concatenate((counts, np.ones(len(new)))), len(codes))
    return codes, counts


def _of(codes: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    if not len(table[0]):
        return np.zeros(len(codes), np.int64)
    at = np.minimum(np.searchsorted(table[0], codes), len(table[0]) - 1)
    return np.where(table[0][at] == codes, table[1][at], 0)


def _ratios(mine: tuple[np.ndarray, np.ndarray], n: int, other: tuple[np.ndarray, np.ndarray], m: int, times: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """The strings that rows of this class hold so many times as often as the other's, and their likelihood ratios."""
    a, b = mine[1].astype(float), _of(mine[0], other).astype(float)
    often = a * m / ((b + 0.5) * max(1, n))
    often = (often > times[0]) & (often <= times[1])
    codes, a, b = mine[0][often], a[often], b[often]
    p = (a + b) / max(1, n + m)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda k, of, q: np.where(k > 0, k * np.log(k / (of * q)), 0)
        return codes, 2 * (part(a, n, p) + part(b, m, p) + part(n - a, n, 1 - p) + part(m - b, m, 1 - p))


def _telling(of: dict[int, list[bytes]], gram: int, cases: list[tuple[int, tuple[float, float]]]) -> list[np.ndarray]:
    """For each case (class, times) the strings that its rows hold so many times as often, beyond what the best of so many strings reaches by chance.

    The strings are counted in PARTS parts, one after another, once for all cases: a part's tables are all that is held.
    """
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in cases]
    distinct = {0: 0, 1: 0}
    for p in range(PARTS):
        table = {v: _frequencies(of[v], gram, p) for v in of}
        for v in of:
            distinct[v] += len(table[v][0])
        for k, (v, times) in enumerate(cases):
            found[k].append(_ratios(table[v], len(of[v]), table[1 - v], len(of[1 - v]), times))
    return [np.concatenate([codes[ratio > 2 * np.log(max(2, distinct[v]))] for codes, ratio in x]) for x, (v, _) in zip(found, cases, strict=True)]


def _typical(rows: list[bytes], good: dict[int, np.ndarray]) -> list[list[bytes]]:
    """Each row's passages that telling strings (good, by their length) make up; passages of one row only are left out."""
    out = []
    for r in rows:
        step = np.zeros(len(r) + 1, np.int64)
        for g, strings in good.items():
            at = np.flatnonzero(np.isin(_codes(r, g), strings))
            step[at] += 1
            step[at + g] -= 1
        on = np.concatenate(([0], np.cumsum(step) > 0)).astype(np.int8)
        edge = np.flatnonzero(np.diff(on))
        out.append([r[a:b][:64] for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
    seen = Counter(p for x in out for p in set(x))
    return [[p for p in x if seen[p] > 1] for x in out]


def _trained(parts: list[bytes], size: int, **options: int) -> bytes:
    """A dictionary by zstandard's trainer; the last of the text itself if that is too little to train on."""
    try:
        return zstandard.train_dictionary(size, [p.ljust(8, b"\xff") for p in parts], **options).as_bytes()
    except zstandard.ZstdError:
        return b"\xff".join(parts)[-size:]


def _content(passages: list[list[bytes]]) -> bytes:
    """A class's dictionary: the trained part, then its most frequent passages, the most frequent last."""
    whole, used = [], 0
    seen = Counter(p for x in passages for p in set(x))
    for passage, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0])):
        if used + len(passage) + 1 > TYPICAL:
            break
        whole.append(passage)
        used += len(passage) + 1
    return _trained([b"\xff".join(x) for x in passages if x], TRAINED, k=SEGMENT, d=6, f=20, accel=1) + b"\xff" + b"\xff".join(reversed(whole)) + b"\xff"


def _base(rows: list[bytes]) -> bytes:
    """Frequent ordinary passages."""
    return _trained([r[i : i + WINDOW] for r in rows for i in range(0, len(r), 8 * WINDOW)], BASE)


class Dictionaries:
    """The ordinary dictionary and the toxic ones as compressors."""

    def __init__(self, ordinary: bytes, *toxic: bytes):
        self.content = (ordinary, *toxic)
        self.lead = ordinary[-LEAD:]
        self._made: list | None = None

    def __getstate__(self):
        return self.content

    def __setstate__(self, content):
        self.__init__(*content)

    def lengths(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Compressed bytes of each window under each dictionary."""
        if self._made is None:
            self._made = []
            for content in self.content:
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                p = zstandard.ZstdCompressionParameters(compression_level=3, window_log=17, min_match=5, target_length=16, search_log=4, chain_log=15, hash_log=15, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
                d.precompute_compress(compression_params=p)
                self._made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p))
        # each window follows some bytes that all dictionaries know: alone it may be too little to compress, and told raw
        lead = np.frombuffer(self.lead, np.uint8)
        windows = np.empty((len(start), len(lead) + WINDOW), np.uint8)
        windows[:, : len(lead)] = lead
        windows[:, len(lead) :] = data[np.minimum(start[:, None] + np.arange(WINDOW), len(data) - 1)]
        places = np.column_stack((np.arange(len(start)) * windows.shape[1], size + len(lead))).astype("<u8").tobytes()
        out = []
        for c in self._made:
            frames = c.multi_compress_to_buffer(zstandard.BufferWithSegments(windows.tobytes(), places), threads=1)
            out.append(np.fromiter((len(frames[i]) for i in range(len(frames))), np.int64, len(frames)))
        return np.stack(out)


def described(rows: list[str], known: Dictionaries) -> np.ndarray:
    """Features of each text: what its windows' lengths under each toxic dictionary tell."""
    data, offsets = flat(pa.array(list(map(folded, rows)), pa.large_binary()))
    size = np.diff(offsets)
    n = np.maximum(1, -(-(size - OVERLAP) // (WINDOW - OVERLAP)))
    n[size == 0] = 0
    row = np.repeat(np.arange(len(rows)), n)
    start = offsets[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * (WINDOW - OVERLAP)
    length = np.minimum(WINDOW, offsets[row + 1] - start)
    each = 4 + 2 * len(BEYOND)
    kilo = np.maximum(size, 100) / 1000
    x = np.zeros((len(rows), each * (len(known.content) - 1) + 1))
    if len(row):
        ordinary, *toxic = known.lengths(data, start, length)
        for k, b in enumerate(toxic):
            own = x[:, k * each : (k + 1) * each]
            d = ordinary - b
            gain = np.maximum(d, 0)
            total = np.bincount(row, gain, len(rows))
            np.maximum.at(own[:, 1], row, gain)
            own[:, 0] = np.log1p(total)
            own[:, 1] = np.log1p(own[:, 1])
            own[:, 2] = np.log1p(np.bincount(row, np.maximum(-d, 0), len(rows)))
            own[:, 3] = np.log1p(total / kilo)
            for i, least in enumerate(BEYOND):
                hits = np.bincount(row, gain > least, len(rows))
                own[:, 4 + 2 * i] = np.log1p(hits)
                own[:, 5 + 2 * i] = np.log1p(hits / kilo)
    x[:, -1] = 1
    return x


@dataclass
class Toxicity:
    known: Dictionaries
    weights: np.ndarray

    def scores(self, rows: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(described(rows, self.known) @ self.weights, -30, 30)))


def learn(rows: list[tuple[str, int]], counts: dict[int, int]) -> Toxicity | None:
    """A model from labelled texts; counts: all labelled rows of each class."""
    if {y for _, y in rows} != {0, 1}:
        return None
    y = np.array([v for _, v in rows])
    nth = np.zeros(len(y), np.int64)  # of its class: the second of each three only calibrates
    for v in (0, 1):
        nth[y == v] = np.arange((y == v).sum())
    tune = (nth % 3 == 1) if min(np.bincount(y)) >= 6 else np.ones(len(y), bool)
    known = _dictionaries([rows[i] for i in np.flatnonzero(~tune if not tune.all() else tune)])
    x = described([rows[i][0] for i in np.flatnonzero(tune)], known)
    t = y[tune]
    share = np.array([counts[v] / max(1, (t == v).sum()) for v in (0, 1)])
    weight = share[t] / share[t].mean()
    return Toxicity(known, newton(x, t, weight, ridge=0.05))


def _dictionaries(rows: list[tuple[str, int]]) -> Dictionaries:
    """The ordinary dictionary, that of toxic passages that tell alone, and that of those that tell together."""
    of = {v: [folded(t) for t, y in rows if y == v] for v in (0, 1)}
    base = _base(of[0][:: 1 + len(of[0]) // 1500])
    cases = [(0, (TOGETHER[0], ALONE[1])), (1, ALONE), (1, TOGETHER)]
    good = {g: _telling(of, g, cases) for g in GRAMS}
    content = [_content(_typical(of[v], {g: good[g][k] for g in GRAMS})) for k, (v, _) in enumerate(cases)]
    return Dictionaries(*(c + base for c in content))


def trained(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Toxicity | None:
    return learn(*fit_sample(docs, labels, label, PER_CLASS, MAX_BYTES, TOTAL))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            rows = b.column("text").to_pylist()
            s = model.value.scores(rows) if model.value else np.zeros(len(rows))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return texts(docs).withColumn("held_out", fold() == 0).mapInArrow(run, f"doc_id {id_type(docs)}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with all their columns.

    Only texts go to the workers and only scores come back.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels))
    if model.value is None:
        return docs
    return docs.where(by_text(lambda rows: pa.array(model.value.scores(rows), pa.float64()), "double") < threshold)
