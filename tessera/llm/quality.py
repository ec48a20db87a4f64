"""Quality classifier: ordinal cumulative-link regression over hashed text for graded ratings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import portions
from .linear import SparseWeights, distinct_by_text, labelled_sample, ordinal, sigmoid, to_bytes
from .textgrams import LOWER, SAME, SPACES, mix, window_hashes, word_hashes

TRAIN_ROWS = 5000
#: A document is kept if the probability of a grade of at least KEEP_GRADE is at least KEEP_PROBABILITY.
KEEP_GRADE, KEEP_PROBABILITY = 1, 0.5
_CLASS = np.full(256, 5, np.uint8)  # of bytes: lower, upper, digit, space, punctuation, beyond ASCII
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 0, 1, 2
_CLASS[[0x20, *range(0x09, 0x0E)]] = 3
_CLASS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 4
_MARKS = np.where(_CLASS == 4, SAME, np.uint8(0x20))  # punctuation alone is left


def _level(x: np.ndarray) -> np.ndarray:
    """Buckets of a share: fine near 0, tenths above."""
    return np.where(x < 0.1, np.round(2 * np.log2(np.maximum(x, 2**-9))), np.round(10 * x) + 100).astype(np.int64)


def _portion(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    n = len(texts)
    words, offsets = word_hashes(texts, SPACES, LOWER, None)
    text = np.repeat(np.arange(n), np.diff(offsets))
    marks, mark_offsets = word_hashes([t.translate(_MARKS.tobytes()) for t in texts], SPACES, lane=None)
    mark_text = np.repeat(np.arange(n), np.diff(mark_offsets))
    sizes = np.array([len(t) for t in texts])
    buf = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    shares = [np.add.reduceat((_CLASS[buf] == k).astype(np.int32), begins) / np.maximum(sizes, 1) for k in range(5)]

    def distinct(h: np.ndarray, of: np.ndarray) -> np.ndarray:
        have = np.bincount(of, minlength=n)
        tagged = np.unique((of.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
        return np.bincount((tagged >> np.uint64(40)).astype(np.int64), minlength=n) / np.maximum(have, 1)

    pairs, _, pair_text = window_hashes(words, offsets, 4)
    size_level = np.round(np.log2(np.maximum(np.diff(offsets), 1))).astype(np.int64)
    stats = [*map(_level, shares), _level(np.bincount(mark_text, minlength=n) / np.maximum(np.diff(offsets), 1)), size_level]
    stats += [1000 * size_level + _level(distinct(words, text)), _level(1 - distinct(pairs, pair_text))]
    stats.append(np.round(2 * sizes / np.maximum(np.diff(offsets), 1)).clip(0, 60).astype(np.int64))
    kinds = [mix(words + np.uint64(1)), mix(marks + np.uint64(2))] + [mix(s.astype(np.uint64) + np.uint64((k + 3) << 32)) for k, s in enumerate(stats)]
    feature = np.concatenate(kinds).astype(np.uint32)
    return distinct_by_text(feature, np.concatenate([text, mark_text] + [np.arange(n)] * len(stats)))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, punctuation runs, and bucketed shares: letter classes, marks, repeated words and 4-grams, sizes."""
    if not texts:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return _portion(texts)


def train(docs: DataFrame, ratings: DataFrame, max_rows: int = TRAIN_ROWS) -> SparseWeights:
    """From ``ratings`` (doc_id, label = grade 0, 1, 2, ...; rows without either are skipped), at most ``max_rows``."""
    rows, y = labelled_sample(docs, ratings.where("label >= 0"), features, max_rows)
    return ordinal(rows, y, int(y.max()) + 1 if len(y) else 2)


def grade(docs: DataFrame, model: SparseWeights, keep_grade: int = KEEP_GRADE, keep_probability: float = KEEP_PROBABILITY) -> DataFrame:
    """All columns of ``docs`` (which has ``text``), then ``expected_grade``, ``tail_probability``, ``accepted``.

    ``tail_probability`` is P(grade >= keep_grade). Null and empty texts are graded like any other, from their
    sizes alone; repeated rows are graded each. Columns of ``docs`` with those three names are replaced.
    """
    added = ["expected_grade", "tail_probability", "accepted"]
    docs = docs.drop(*added)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for begin, end in portions(batch.column("text")):
                part = batch.slice(begin, end - begin)
                total = m.dot(*features(to_bytes(part.column("text"))), part.num_rows)
                above = sigmoid(total[:, None] - m.bias[None, :])  # P(grade > k)
                tail = above[:, keep_grade - 1] if 0 < keep_grade <= above.shape[1] else np.full(part.num_rows, float(keep_grade <= 0))
                new = [pa.array(above.sum(axis=1)), pa.array(tail), pa.array(tail >= keep_probability)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *added])

    new = [T.StructField(c, T.BooleanType() if c == "accepted" else T.DoubleType()) for c in added]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *new]))


def ratings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.select("doc_id", F.col("quality").cast("int").alias("label"))


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades by ``labels.quality``, learned from documents whose crc32(doc_id as text) mod 5 is not 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, ratings_of(spark, sf_dir).where(~held_out()))
    return grade(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "expected_grade", "tail_probability", "accepted")
