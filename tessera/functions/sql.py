"""The tokenizer as SQL functions of text: tok_pieces, tok_encode, tok_tokens, tok_count, tok_decode and the table function tok_explode.

Segmentation is an expression of built-in functions, so ``tok_pieces`` is a SQL function with that expression as its body.
Only merging and decoding run in Python, in Arrow batches. Over large tables ``LATERAL VIEW posexplode(tok_tokens(text))`` of a
subquery is the form to take: Spark turns a lateral ``tok_explode`` into a join on the texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..operators.bpe import encode_joined, encode_pieces
from ..operators.tokenizer import Tokenizer

_PIECE = "ARRAY<STRUCT<piece: STRING, special: INT>>"
#: A string literal, which stays as it is, or an operator in the form of a function.
_OPERATOR = re.compile(r"'(?:[^'\\\\]|\\\\.)*'|(?<![\w`])(and|or|not|[-=<>!+*/%&|^~]+)\(", re.S)


def sql_of(column: Column) -> str:
    """The SQL text of an expression of built-in functions. Operators such as ``=(a, b)`` are put in backquotes, as functions are called."""
    return _OPERATOR.sub(lambda m: f"`{m[1]}`(" if m[1] else m[0], column._jc.node().sql())


def register(spark: SparkSession, tokenizer: Tokenizer, prefix: str = "tok", once: bool = False) -> None:
    """Registers the functions ``<prefix>_pieces`` and so on for this session. A null text or list gives null, and no rows of ``_explode``.

    From an explode Spark infers a filter on the size of its lists and evaluates ``<prefix>_tokens`` for that, too. With ``once``
    it can't, but then ``<prefix>_tokens`` may not stand in the arguments of aggregates and in conditions of joins.
    """
    spark.udf.register(f"{prefix}__merge", encode_pieces(tokenizer._spec))
    spark.udf.register(f"{prefix}_decode", tokenizer.decoder())
    each = encode_joined(tokenizer._spec)
    spark.udf.register(f"{prefix}__each", each)
    spark.udf.register(f"{prefix}__once", each.asNondeterministic() if once else each)
    parts = "(transform(p, x -> x.piece), transform(p, x -> x.special))"
    make = "CREATE OR REPLACE TEMPORARY FUNCTION"
    spark.sql(f"{make} {prefix}_pieces(t STRING) RETURNS {_PIECE} RETURN {sql_of(tokenizer.pieces(F.col('t')))}")
    spark.sql(f"{make} {prefix}_encode(t STRING) RETURNS ARRAY<INT> RETURN {prefix}__merge{parts.replace('(p,', f'({prefix}_pieces(t),')}")
    spark.sql(f"{make} {prefix}_count(t STRING) RETURNS INT RETURN size({prefix}_encode(t))")
    pairs = "ARRAY<STRUCT<piece: STRING, id: INT>>"
    joined = f"array_join(transform({prefix}_pieces(t), x -> coalesce(x.piece, concat(chr(10), x.special))), ' ')"
    own = "transform(split({0}, ' ', -1), p -> if(startswith(p, chr(10)), NULL, p))"
    with_ids = f"flatten(zip_with({own}, {{1}}({{0}}), (p, ids) -> transform(ids, i -> named_struct('piece', p, 'id', i))))"
    spark.sql(f"{make} {prefix}__pairs(ps STRING) RETURNS {pairs} RETURN {with_ids.format('ps', f'{prefix}__once')}")  # cut once, as an argument
    spark.sql(f"{make} {prefix}_tokens(t STRING) RETURNS {pairs} RETURN {prefix}__pairs({joined})")
    rows = f"SELECT x.pos, x.col.piece, x.col.id FROM (SELECT {with_ids.format(joined, f'{prefix}__each')} AS z) d, LATERAL posexplode(d.z) x"
    spark.sql(f"{make} {prefix}_explode(t STRING) RETURNS TABLE(pos INT, piece STRING, id INT) RETURN {rows}")
