"""2. Quality by ordinal cumulative-link regression on graded ratings.

A text is described by hashed byte strings (GRAM bytes, mean over the text) and a few overall
rates; one weight vector is shared by all grades, and ordered thresholds cut its
product into grades: P(grade > k) = sigmoid(w.x - t_k), t_1 < t_2 < ...  Two grades give one threshold.
Selection uses the expected grade and the tail probability P(grade >= keep_from).

Learns from labelled rows outside the held-out fold, at most PER_CLASS of each grade and none above MAX_BYTES
(a bounded sample), weighted to the true shares.  Every document is scored by its whole text.
Empty and null texts are scored as texts without strings.  Without two grades every row gets the only grade (or 0).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import fit_sample, flat, fold, id_type, steps, texts

PER_CLASS, MAX_BYTES = 2_000, 100_000
GRAM, BITS, ROUNDS = 4, 16, 150


def _slots(data: np.ndarray) -> np.ndarray:
    """Slot of the 4-byte string at each place."""
    x = data.astype(np.uint32)
    x = x[:-3] | (x[1:-2] << np.uint32(8)) | (x[2:-1] << np.uint32(16)) | (x[3:] << np.uint32(24))
    return ((x * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


def _rates(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Overall features: shares of kinds of bytes, and the length."""
    size = np.diff(offsets)
    kinds = [(data >= 65) & (data <= 90), (data >= 48) & (data <= 57), data == 10, data >= 128, (data >= 33) & (data <= 47), data == 32]
    total = [np.concatenate(([0], np.cumsum(k))) for k in kinds]
    cols = [(t[offsets[1:]] - t[offsets[:-1]]) / np.maximum(size, 1) for t in total]
    return np.column_stack([*cols, np.log1p(size) / 10])


@dataclass
class Quality:
    grades: list[int]
    weights: np.ndarray
    rates: np.ndarray
    cuts: np.ndarray

    def scores(self, rows: list[str]) -> np.ndarray:
        """w.x of each text."""
        data, offsets = flat(pa.array([t.encode("utf-8", "surrogatepass") for t in rows], pa.large_binary()))
        out = _rates(data, offsets) @ self.rates
        if len(data) >= GRAM:
            total = np.concatenate(([0], np.cumsum(self.weights[_slots(data)], dtype=np.float64)))
            a, b = np.minimum(offsets[:-1], len(total) - 1), np.clip(offsets[1:] - GRAM + 1, 0, len(total) - 1)
            out += np.where(b > a, (total[b] - total[np.minimum(a, b)]) / np.maximum(1, b - a), 0)
        return out

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > each cut)."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.cuts[None, :], -30, 30)))


def learn(rows: list[tuple[str, int]], counts: dict[int, int]) -> Quality:
    grades = sorted({y for _, y in rows}) or [0]
    if len(grades) < 2:
        return Quality(grades, np.zeros(1 << BITS), np.zeros(7), np.zeros(0))
    y = np.array([grades.index(v) for _, v in rows])
    share = np.array([counts[g] / max(1, (y == i).sum()) for i, g in enumerate(grades)])[y]
    share /= share.sum()
    raw = [np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) for t, _ in rows]
    rate = np.concatenate([_rates(d, np.array([0, len(d)])) for d in raw])
    slot, value, ends = [], [], [0]
    for d in raw:
        k, n = np.unique(_slots(d), return_counts=True) if len(d) >= GRAM else (np.zeros(0, np.int64), np.zeros(0))
        slot.append(k)
        value.append(n / max(1, n.sum()))
        ends.append(ends[-1] + len(k))
    slot, value = np.concatenate(slot), np.concatenate(value)
    row = np.repeat(np.arange(len(rows)), np.diff(ends))
    scale = 30.0  # mean rates are small; weights are kept near one
    size = (1 << BITS) + rate.shape[1] + len(grades) - 1
    v = np.zeros(size)  # weights, rates, first cut and logarithms of the steps to the next
    below = (1 << BITS) + rate.shape[1]
    up = np.stack([y > k for k in range(len(grades) - 1)], axis=1)
    v[below] = -np.log((up[:, 0] * share).sum() / max(1e-9, (~up[:, 0] * share).sum()))
    m1, m2 = np.zeros(size), np.zeros(size)
    before = np.inf
    for t in range(1, ROUNDS + 1):
        cuts = v[below] + np.concatenate(([0], np.cumsum(np.exp(v[below + 1 :]))))
        s = np.bincount(row, value * v[slot], len(rows)) * scale + rate @ v[1 << BITS : below]
        p = 1 / (1 + np.exp(-np.clip(s[:, None] - cuts, -30, 30)))
        # grade k has probability p[k-1] - p[k]; gradient of its logarithm through the two sigmoids
        wide = np.concatenate((np.ones((len(y), 1)), p, np.zeros((len(y), 1))), axis=1)
        at = np.arange(len(y))
        prob = np.maximum(wide[at, y] - wide[at, y + 1], 1e-9)
        loss = -(np.log(prob) * share).sum()
        if abs(before - loss) < 1e-7 * max(1e-3, loss):
            break
        before = loss
        slope = wide * (1 - wide)
        hi, lo = slope[at, y] / prob * share, slope[at, y + 1] / prob * share
        g = np.zeros(size)
        d = hi - lo
        g[: 1 << BITS] = np.bincount(slot, value * d[row], 1 << BITS) * scale
        g[1 << BITS : below] = rate.T @ d
        g_cut = np.zeros(len(cuts) + 2)
        np.add.at(g_cut, y, -hi)
        np.add.at(g_cut, y + 1, lo)
        g_cut = g_cut[1:-1]
        g[below] = g_cut.sum()
        for k in range(1, len(cuts)):
            g[below + k] = g_cut[k:].sum() * np.exp(v[below + k])
        g[:below] -= 1e-5 * v[:below]
        m1 += 0.1 * (g - m1)
        m2 += 0.01 * (g * g - m2)
        v += 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    cuts = v[below] + np.concatenate(([0], np.cumsum(np.exp(v[below + 1 :]))))
    return Quality(grades, v[: 1 << BITS] * scale, v[1 << BITS : below], cuts)


def score_quality(docs: DataFrame, labels: DataFrame, keep_from: int = 1, least: float = 0.5) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability, keep of every document."""
    model = docs.sparkSession.sparkContext.broadcast(learn(*fit_sample(docs, labels, "quality", PER_CLASS, MAX_BYTES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in steps(batches):
            tails = m.tails(m.scores(b.column("text").to_pylist()))
            grade = m.grades[0] + tails @ np.diff(m.grades)
            k = next((i for i, g in enumerate(m.grades[1:]) if g >= keep_from), None)
            tail = np.full(b.num_rows, float(m.grades[0] >= keep_from)) if m.grades[0] >= keep_from or k is None else tails[:, k]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(grade, pa.float64()), pa.array(tail, pa.float64()), pa.array(tail >= least)], ["doc_id", "held_out", "expected_grade", "tail_probability", "keep"])

    return texts(docs).withColumn("held_out", fold() == 0).mapInArrow(run, f"doc_id {id_type(docs)}, held_out boolean, expected_grade double, tail_probability double, keep boolean")
