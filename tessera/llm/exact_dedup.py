"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_join, materialize

PREFIX_CHARS = 256


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Column | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, keep_id, group_size, kept, content_sha256`` (binary).

    Rows with equal texts form a group; the row with its largest id stays. Rows are first grouped by byte length, those whose
    length recurs by a hash of their prefix too, and only those that still have company by SHA-256 of the whole text.
    Rows that drop out on the way are alone in their group; their ``content_sha256`` is null unless ``digest`` (a
    column with the SHA-256 of the text) is given. The table is scanned once, or twice without ``digest``, when the
    texts of the survivors are read; what the first scan sees of a row (some 60 bytes) is written to the shared folder.

    Null texts count as empty. Rows that repeat id and text count each in ``group_size``; of these one, the first
    as scanned, stays if that id does. A row without id only stays if no row of its group has one. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = [F.octet_length(text).cast("long").alias("len"), F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("prefix")]
    doc_id = F.col(id_col).cast("long").alias("doc_id")
    if digest is None:
        rows = materialize(docs.select(*key), "texts")
    else:
        rows = materialize(docs.select(doc_id, *key, digest.alias("digest"), F.monotonically_increasing_id().alias("row")), "texts")
    recurs = F.col("n") > 1
    by_length = rows.groupBy("len").agg(F.count(F.lit(1)).alias("n")).where(recurs).select("len")
    stage1 = fresh_join(rows.select("len", "prefix"), by_length, ["len"], "left_semi")
    by_prefix = stage1.groupBy("len", "prefix").agg(F.count(F.lit(1)).alias("n")).where(recurs).select("len", "prefix")
    if digest is None:
        by_prefix = materialize(by_prefix, "prefixes")
        whole = docs.select(doc_id, *key, text.alias("body"))
        survivors = fresh_join(whole, by_prefix, ["len", "prefix"], "left_semi").select("doc_id", "len", F.unhex(F.sha2("body", 256)).alias("digest"))
        rest = fresh_join(whole.drop("body"), by_prefix, ["len", "prefix"], "left_anti").select("doc_id", "len", F.lit(None).cast("binary").alias("digest"))
        rows = materialize(survivors.union(rest).withColumn("row", F.monotonically_increasing_id()), "survivors")
        survivors = rows.where("digest is not null")
    else:
        survivors = fresh_join(rows, by_prefix, ["len", "prefix"], "left_semi")
    first = F.struct(F.col("doc_id").isNotNull(), "doc_id", (-F.col("row")).alias("row"))
    groups = (
        survivors.groupBy("len", "digest")
        .agg(F.max(first).alias("stays"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") > 1)
        .select("len", "digest", "group_size", F.col("stays")["doc_id"].alias("keep_id"), (-F.col("stays")["row"]).alias("keep_row"))
    )
    joined = fresh_join(rows.select("doc_id", "len", "digest", "row"), groups, ["len", "digest"], "left")
    return joined.select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_row") == F.col("row"), F.lit(True)).alias("kept"),
        F.col("digest").alias("content_sha256"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group; the contract wants each text's SHA-256, so the scan itself computes it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    out = exact_dedup(docs, digest=digest)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("content_sha256")).alias("text_sha256"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
