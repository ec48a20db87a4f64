"""Sparse linear models over hashed text: FTRL-proximal logistic and cumulative-link ordinal regression."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions

#: From the texts of a batch to (feature, index of the text), each feature once for a text.
Features = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def distinct_by_text(feature: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each 32-bit feature of a text once."""
    both = np.unique((text.astype(np.uint64) << np.uint64(32)) | feature.astype(np.uint64))
    return (both & np.uint64(0xFFFFFFFF)).astype(np.uint32), (both >> np.uint64(32)).astype(np.int64)


def to_bytes(column: pa.Array) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


#: Bytes of text that a classifier is fitted on at most, besides its bound on rows; a text longer than this is not learned from.
TRAIN_BYTES = 64 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, features: Features, max_rows: int, max_bytes: int = TRAIN_BYTES) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of at most ``max_rows`` rows of ``labels`` (doc_id, label), picked by a hash of the id.

    The ids picked, at most ``max_rows`` of them, are broadcast, and features are made where the texts are. Rows that repeat
    an id count each; of all rows with the ids picked the first ``max_rows`` count, in the order of that hash, the id, the
    label and the text's hash, as far as their texts together have ``max_bytes``.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("label")]
    picked = labels.where("doc_id is not null and label is not null").orderBy(*order).limit(max_rows)
    rows = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.xxhash64("text").alias("mark"))
    order = [*order, F.col("mark")]
    first = rows.select("doc_id", "label", "mark", "size").orderBy(*order).limit(max_rows).collect()  # some 40 bytes a row
    total = np.cumsum([r["size"] for r in first])
    first = first[: int(np.searchsorted(total, max_bytes, side="right"))]
    if not first:
        return [], np.zeros(0, np.int64)
    wanted = docs.sparkSession.createDataFrame([(r["doc_id"], r["label"], r["mark"]) for r in first], "doc_id long, label int, mark long").distinct()
    chosen = rows.join(F.broadcast(wanted), ["doc_id", "label", "mark"]).select("doc_id", "label", "mark", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in portions(batch.column("text")):
                part = batch.slice(begin, end - begin)
                f, i = features(to_bytes(part.column("text")))
                cuts = np.searchsorted(i, np.arange(part.num_rows + 1))
                blobs = [f[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(blobs, pa.binary())], names=["doc_id", "label", "mark", "f"])

    got = chosen.mapInArrow(extract, "doc_id long, label int, mark long, f binary").orderBy(F.xxhash64("doc_id"), "doc_id", "label", "mark").limit(len(first)).collect()
    got.sort(key=lambda r: (r["doc_id"], r["label"], r["mark"]))
    order = np.random.default_rng(7).permutation(len(got))
    return [np.frombuffer(got[i]["f"], np.uint32) for i in order], np.array([got[i]["label"] for i in order], np.int64)


def compact(rows: list[np.ndarray], least: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Features in at least ``least`` rows, sorted, and the rows as positions in that list."""
    if not rows:
        return np.zeros(0, np.uint32), []
    names, counts = np.unique(np.concatenate(rows), return_counts=True)
    names = names[counts >= least]
    out = []
    for r in rows:
        at = np.searchsorted(names, r)
        ok = at < len(names)
        ok[ok] = names[at[ok]] == r[ok]
        out.append(at[ok])
    return names, out


@dataclass(frozen=True)
class SparseWeights:
    """Non-zero weights by feature, and the intercept or thresholds."""

    names: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def dot(self, feature: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n)
        if len(self.names):
            at = np.minimum(np.searchsorted(self.names, feature), len(self.names) - 1)
            hit = self.names[at] == feature
            np.add.at(out, text[hit], self.weights[at[hit]])
        return out

    def keep(self, feature: np.ndarray) -> np.ndarray:
        """Which features have a weight: most have none, and need not be told apart."""
        table = np.zeros(1 << 20, bool)
        table[self.names & np.uint32(0xFFFFF)] = True
        ok = np.flatnonzero(table[feature & np.uint32(0xFFFFF)])
        if len(self.names):
            at = np.minimum(np.searchsorted(self.names, feature[ok]), len(self.names) - 1)
            ok = ok[self.names[at] == feature[ok]]
        return ok


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def ftrl(rows: list[np.ndarray], y: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0, epochs: int = 3, least: int = 3) -> SparseWeights:
    """FTRL-proximal: each coordinate's rate falls with its own gradients; |z| <= l1 keeps its weight at exactly 0."""
    names, rows = compact(rows, least)
    z, n = np.zeros(len(names) + 1), np.zeros(len(names) + 1)  # the last is the intercept, without l1

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    bias = len(names)
    for _ in range(epochs):
        for at, t in zip(rows, y):
            w = weights(at)
            b = -z[bias] / ((beta + np.sqrt(n[bias])) / alpha)
            g = 1 / (1 + np.exp(-min(35.0, max(-35.0, w.sum() + b)))) - t
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
            s = (np.sqrt(n[bias] + g * g) - np.sqrt(n[bias])) / alpha
            z[bias] += g - s * b
            n[bias] += g * g
    w = weights(np.arange(len(names)))
    b = -z[bias] / ((beta + np.sqrt(n[bias])) / alpha)
    on = w != 0
    return SparseWeights(names[on], w[on], np.array([b]))


def ordinal(rows: list[np.ndarray], y: np.ndarray, grades: int, rate: float = 0.3, l2: float = 1e-4, epochs: int = 8, least: int = 3) -> SparseWeights:
    """Cumulative-link (proportional odds) regression by AdaGrad: P(grade > k) = sigmoid(w.x - theta_k), theta ascending.

    One weight vector serves all thresholds; the thresholds are the first one plus positive steps exp(s_k).
    """
    names, rows = compact(rows, least)
    w, gw = np.zeros(len(names)), np.full(len(names), 1e-8)
    k = max(1, grades - 1)
    above = np.array([np.mean(y > j) if len(y) else 0.5 for j in range(k)])
    above = np.clip(above, 0.01, 0.99)
    theta = np.maximum.accumulate(-np.log(above / (1 - above)))
    first, steps = theta[0], np.log(np.maximum(np.diff(theta), 0.1))
    gt = np.full(k, 1e-8)
    for _ in range(epochs):
        for at, grade in zip(rows, y):
            theta = first + np.concatenate([[0.0], np.cumsum(np.exp(steps))])
            cum = sigmoid(w[at].sum() - theta)  # P(grade > j)
            hi, lo = np.concatenate([[1.0], cum])[grade], np.concatenate([cum, [0.0]])[grade]
            p = max(hi - lo, 1e-9)
            slope = cum * (1 - cum)
            dhi = slope[grade - 1] if grade > 0 else 0.0
            dlo = slope[grade] if grade < k else 0.0
            g = -(dhi - dlo) / p  # of the loss by w.x
            gi = g + l2 * w[at]
            gw[at] += gi * gi
            w[at] -= rate * gi / np.sqrt(gw[at])
            dt = np.zeros(k)  # of the loss by theta
            if grade > 0:
                dt[grade - 1] += dhi / p
            if grade < k:
                dt[grade] -= dlo / p
            raw = np.concatenate([[dt.sum()], np.array([dt[j + 1 :].sum() * np.exp(steps[j]) for j in range(k - 1)])])
            gt += raw * raw
            move = rate * raw / np.sqrt(gt)
            first -= move[0]
            steps = np.clip(steps - move[1:], -5, 5)
    theta = first + np.concatenate([[0.0], np.cumsum(np.exp(steps))])
    on = np.abs(w) > 1e-6
    return SparseWeights(names[on], w[on], theta)
