"""Tokenizing streams: encoding is row-local, so a stream needs neither state nor watermark for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tokenizer import Tokenizer


def encode_stream(stream: DataFrame, tokenizer: Tokenizer, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    return stream.withColumn(out_col, tokenizer.encode(F.col(text_col)))


def token_counts(stream: DataFrame, tokenizer: Tokenizer, time_col: str, window: str = "5 minutes", late: str = "10 minutes", text_col: str = "text") -> DataFrame:
    """Tokens and texts in each event-time window; texts later than ``late`` are left out."""
    counted = stream.withColumn("n_tokens", F.size(tokenizer.encode(F.col(text_col))))
    return counted.withWatermark(time_col, late).groupBy(F.window(time_col, window)).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("texts"))
