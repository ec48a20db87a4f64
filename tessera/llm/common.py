"""Shared helpers: durable intermediate tables, joins that tolerate hot keys, sizing."""

from __future__ import annotations

import ctypes
import math
import re
import tempfile
import uuid
from collections.abc import Iterator
from typing import TypeVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one block of documents holds on average; a block is what one Python call sees.
BLOCK_BYTES = 2 << 20
#: Least and most bytes of text for a block, and for a bucket of what blocks exchange. The most takes some GB in a worker.
BLOCK_RANGE, BUCKET_RANGE = (BLOCK_BYTES, 64 << 20), (4 << 20, 128 << 20)
#: Bytes of text that a message from a block to a bucket stands for, where the ranges allow it.
MESSAGE_BYTES = 384


#: Rows and bytes of text that a Python worker turns into Python objects at once.
PORTION_ROWS, PORTION_BYTES = 256, 1 << 20
_T = TypeVar("_T")


def portions(texts: pa.Array, most_rows: int = PORTION_ROWS, most_bytes: int = PORTION_BYTES) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of rows with at most ``most_bytes`` of text; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and (size + n > most_bytes or i - begin == most_rows):
            yield begin, i
            begin, size = i, 0
        size += n
    if len(texts):
        yield begin, len(texts)


def tidy(result: _T) -> _T:
    """Hands a Python worker's freed memory back to the system, and ``result`` through: idle workers shall not keep their peaks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
    return result


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a local master gets a temporary one (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join that always shuffles both sides for itself, so that AQE may split a hot key of the left side.

    A side that was just aggregated by ``keys`` is already laid out by them and would be joined in place,
    one task for each key; the extra derived key makes Spark lay out both sides anew.
    """
    tag = F.xxhash64(*[F.col(k) for k in keys])
    joined = left.withColumn("__tag", tag).join(right.withColumn("__tag", tag), [*keys, "__tag"], how)
    return joined.drop("__tag")


def text_stats(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """(rows, bytes of text) of a table."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text_col)).alias("b")).first()
    return int(row["n"] or 0), int(row["b"] or 0)


def grid(size: int) -> tuple[int, int]:
    """(blocks, buckets) for a table of ``size`` bytes of text.

    Every block may send to every bucket, so with parts of constant size messages would grow with the square of the
    table and hold next to nothing. Parts grow with its square root instead, from some 90 GB on.
    """
    block = min(max(math.isqrt(MESSAGE_BYTES // 2 * size), BLOCK_RANGE[0]), BLOCK_RANGE[1])
    bucket = min(max(MESSAGE_BYTES * size // block, BUCKET_RANGE[0]), BUCKET_RANGE[1])
    return max(1, -(-size // block)), max(1, -(-size // bucket))


def in_blocks(docs: DataFrame, id_col: str, text_col: str, n_blocks: int) -> DataFrame:
    """``block, doc_id, text`` with documents dealt to blocks by a hash of id (rows without one: of the text)."""
    doc_id = F.col(id_col).cast("long")
    return docs.select(
        F.pmod(F.xxhash64(F.coalesce(F.xxhash64(doc_id), F.xxhash64(F.col(text_col)))), F.lit(n_blocks)).alias("block"),
        doc_id.alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
    )
