"""From raw documents to packed training sequences, in stages that each work on all that the one before kept.

Every function takes (spark, docs, sf_dir), where docs has the columns of ``documents``; all but the last return those
columns. Rows without id and null texts go through every stage: a null text is graded, compared and packed as an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import quality as quality_model
from tessera.llm.common import materialize
from tessera.llm.decontamination import find_contamination
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.ngram_join import similar_components
from tessera.llm.packing import pack

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier accepts; learned from ``labels`` of these documents."""
    model = quality_model.train(docs.select("doc_id", "text"), quality_model.ratings_of(spark, sf_dir))
    return quality_model.grade(docs.select(*COLUMNS), model).where("accepted").select(*COLUMNS)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays; of rows that repeat both, one."""
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    kept = exact_dedup(docs, digest=digest).where("kept").select(F.col("doc_id").alias("keep"), F.col("content_sha256").alias("of")).distinct()
    rows = docs.select(*COLUMNS, digest.alias("digest"))
    stays = rows.join(kept, rows["doc_id"].eqNullSafe(kept["keep"]) & (rows["digest"] == kept["of"]), "left_semi")
    once = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("doc_id"))
    return stays.withColumn("nth", once).where("nth = 1").select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by links of 5-word shingles with a similarity of 0.8 or more, the one with the least doc_id stays."""
    goes = similar_components(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(goes, "doc_id", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a 10-word window of a benchmark item occurs."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_contamination(docs, benchmark, carry=("lang", "source", "n_chars"))
    return found.where(F.size("spans") == 0).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens, sources in proportion to their tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact_dedup", dedup_exact), ("near_dedup", dedup_near), ("decontamination", decontaminate), ("packing", packing)]

#: The classifier and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
