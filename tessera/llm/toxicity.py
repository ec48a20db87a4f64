"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import portions
from .linear import SparseWeights, distinct_by_text, ftrl, labelled_sample, sigmoid, to_bytes
from .textgrams import LOWER, NON_WORD, mix, stem_hashes

#: At most so many labelled rows are learned from.
TRAIN_ROWS = 5000
#: Words count in full and by their first bytes, so that inflected forms share a feature.
STEMS = (4, 5, 6, 7)
_GRAM = np.uint64(0xA24BAED4963EE407)


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All features, repeated as they occur: words, stems, bigrams and skip-grams over one and two words."""
    h, offsets = stem_hashes(texts, NON_WORD, LOWER, STEMS)
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    kinds, texts_of = [], []
    for k, row in enumerate(h):
        kinds.append(mix(row + np.uint64(k + 1)))
        texts_of.append(text)
    for gap in (1, 2, 3):
        same = text[gap:] == text[:-gap]
        kinds.append(mix(h[0][:-gap][same] * _GRAM + h[0][gap:][same] + np.uint64(16 + gap)))
        texts_of.append(text[gap:][same])
    return np.concatenate(kinds).astype(np.uint32), np.concatenate(texts_of)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return distinct_by_text(*_grams(texts))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> SparseWeights:
    """Weights from ``labels`` (doc_id, label 0/1; rows without either are skipped), at most ``max_rows`` rows of them (and ``TRAIN_BYTES`` of text)."""
    rows, y = labelled_sample(docs, labels, features, max_rows)
    return ftrl(rows, y)


def score(docs: DataFrame, model: SparseWeights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for each row: the probability of label 1 from the whole text, and score >= 0.5.

    Null and empty texts get the score of the intercept alone; repeated rows are scored each; null ids are carried
    on; other columns are ignored. The weights broadcast are the non-zero ones, at most those of the training rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for begin, end in portions(batch.column("text")):
                part = batch.slice(begin, end - begin)
                f, text = _grams(to_bytes(part.column("text")))
                ok = m.keep(f)
                p = sigmoid(m.dot(*distinct_by_text(f[ok], text[ok]), part.num_rows) + m.bias[0])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, score double, predicted int")


def fold(buckets: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % buckets


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").cast("int").alias("label"))
    model = train(docs, labels.where(fold(5) != 0))
    return score(docs, model).select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
