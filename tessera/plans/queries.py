"""One query for each operator over the driver's tables, with its SQL where SQL can express it.

Lists of pieces are compared as their number and the SHA-256 of the pieces joined by U+001F.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sql import register
from ..functions.text import SEGMENTS, byte_map, byte_table
from ..operators import metrics
from ..operators import pretokenizers as pre
from ..operators.labels import sft_labels
from ..operators.normalizers import normalize
from ..operators.specials import segments
from ..operators.tokenizer import Tokenizer
from ..sources.spec import TokenizerSpec, load, merges_table, reverse_table, specials_table, vocab_table

Query = Callable[[SparkSession, str], DataFrame]
SEP = "\x1f"
#: Bytes of a table from which, and bytes a core below which, it is dealt out.
SPREAD_FROM, SPREAD_BELOW = 1 << 18, 16 << 20
#: Merges of the small definition whose encoding SQL can restate.
SMALL_MERGES = 60
CHAT = {"<|im_start|>": 60001, "<|im_end|>": 60002, "<|im|>": 60003}
ATTRIBUTES = ["href", "class", "id", "charset", "lang", "style"]
BYTE_LEVEL = {"type": "Sequence", "pretokenizers": [{"type": "ByteLevel", "add_prefix_space": False}]}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def full_spec(path: str | None = None) -> TokenizerSpec:
    """The public byte-level vocabulary with byte-level segmentation (a bare root has no steps)."""
    return replace(load(path or vocabulary_path()), pre_tokenizer=BYTE_LEVEL)


def small_spec(path: str | None = None, merges: int = SMALL_MERGES) -> TokenizerSpec:
    """Its byte symbols and first merges."""
    spec = full_spec(path)
    small = spec.truncated(256 + merges)
    return replace(small, merges=small.merges[:merges], specials={})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one that is small for the cores at hand is dealt out to them, as its file may be a single row group.

    Large tables come in enough scan tasks and aren't shuffled.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if SPREAD_FROM < size < cores * SPREAD_BELOW else df


def _digest(pieces: Column) -> list[Column]:
    return [F.size(pieces).cast("long").alias("n_pieces"), F.sha2(F.array_join(pieces, SEP), 256).alias("digest")]


def _cut(cut: Callable[[Column], Column], spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(cut(F.col("text")), F.array().cast("array<string>")).alias("p")).select("doc_id", *_digest(F.col("p")))


def _map(f: Callable[[Column], Column], spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", f(F.col("text")).alias("t")).select("doc_id", F.char_length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("digest"))


def _norm(node: dict) -> Callable[[Column], Column]:
    return lambda t: normalize(F.array(t), {"type": "Sequence", "normalizers": [node]})[0]


def _pre(*nodes: dict) -> Callable[[Column], Column]:
    return pre.PreTokenizer({"type": "Sequence", "pretokenizers": list(nodes)}).pieces


CUTS: dict[str, Callable[[Column], Column]] = {
    "pretok_bytelevel": lambda t: pre.matches(t, SEGMENTS),
    "pretok_bytelevel_prefix": lambda t: pre.byte_level(t),
    "pretok_whitespace": pre.whitespace,
    "pretok_whitespace_split": pre.whitespace_split,
    "pretok_bert": pre.bert,
    "pretok_digits": pre.digits,
    "pretok_digits_individual": lambda t: pre.digits(t, True),
    "pretok_punct_isolated": pre.punctuation,
    "pretok_punct_removed": lambda t: pre.punctuation(t, "Removed"),
    "pretok_metaspace_always": pre.metaspace,
    "pretok_metaspace_first": lambda t: pre.metaspace(t, scheme="first"),
    "pretok_metaspace_never": lambda t: pre.metaspace(t, scheme="never"),
    "pretok_chardelim": lambda t: pre.compile_item({"type": "CharDelimiterSplit", "delimiter": "e"})[0][1](t),
    "pretok_scripts": pre.unicode_scripts,
    "pretok_strip": lambda t: pre.compile_item({"type": "Strip"})[0][1](t),
    "pretok_replace": lambda t: pre.compile_item({"type": "Replace", "pattern": {"Regex": "[aeiou]+"}, "content": "<$0>"})[0][1](t),
    "split_isolated": lambda t: pre.split(t, "[,.]"),
    "split_removed": lambda t: pre.split(t, "[,.]", "Removed"),
    "split_merged_prev": lambda t: pre.split(t, "[%$,.]", "MergedWithPrevious"),
    "split_merged_next": lambda t: pre.split(t, "[%$,.]", "MergedWithNext"),
    "split_contiguous": lambda t: pre.split(t, "[%$,.]", "Contiguous"),
    "pretok_sequence": _pre({"type": "WhitespaceSplit"}, {"type": "Digits", "individual_digits": True}, {"type": "Punctuation"}),
    "pretok_bytelevel_whole": _pre({"type": "ByteLevel", "use_regex": False}),
    "split_string": _pre({"type": "Split", "pattern": {"String": ". "}, "behavior": "Isolated"}),
    "split_invert": lambda t: pre.split(t, "[a-z]+", "Isolated", True),
}
MAPS: dict[str, Callable[[Column], Column]] = {
    "norm_strip": _norm({"type": "Strip"}),
    "norm_replace": _norm({"type": "Replace", "pattern": {"Regex": "([aeiou])n"}, "content": "$1m"}),
    "norm_nmt": _norm({"type": "Nmt"}),
    "norm_bert_clean": _norm({"type": "BertNormalizer", "lowercase": False, "strip_accents": False}),
    "norm_lower": _norm({"type": "Lowercase"}),
    "norm_nfc": _norm({"type": "NFC"}),
    "norm_nfd": _norm({"type": "NFD"}),
    "norm_nfkc": _norm({"type": "NFKC"}),
    "norm_nfkd": _norm({"type": "NFKD"}),
    "norm_strip_accents": _norm({"type": "StripAccents"}),
    "norm_bert": _norm({"type": "BertNormalizer"}),
    "norm_sequence": _norm(
        {
            "type": "Sequence",
            "normalizers": [{"type": "Lowercase"}, {"type": "StripAccents"}, {"type": "Replace", "pattern": {"String": "."}, "content": "!"}, {"type": "Strip", "right": False}],
        }
    ),
    "byte_map": byte_map,
}


def encode_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = Tokenizer(spark, small_spec())
    return _ids(table(spark, sf_dir, "documents").select("doc_id", tok.encode(F.col("text")).alias("ids")))


def token_count_by_lang(spark: SparkSession, sf_dir: str, spec: TokenizerSpec | None = None) -> DataFrame:
    """Tokens and characters by language."""
    tok = Tokenizer(spark, spec or small_spec())
    docs = table(spark, sf_dir, "documents").select("lang", F.col("text"), tok.encode(F.col("text")).alias("ids"))
    return docs.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("ids")).cast("long").alias("n_tokens"), F.sum(metrics.utf16_length(F.col("text"))).cast("long").alias("n_chars")
    )


def encode_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pieces, each merged once and joined back: ids by how often they occur."""
    tok = Tokenizer(spark, small_spec())
    return tok.encode_long(table(spark, sf_dir, "documents")).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def encode_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = Tokenizer(spark, full_spec())
    ids = table(spark, sf_dir, "documents").select("doc_id", tok.encode(F.col("text")).alias("ids"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.hash("ids").alias("ids_hash"))


def _ids(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), 256).alias("digest"))


def _sql(query: str) -> Query:
    """A query in Spark SQL over ``{docs}`` with the functions of the small definition."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, Tokenizer(spark, small_spec()), "small_tok", once=True)
        return spark.sql(query, docs=table(spark, sf_dir, "documents"))

    return run


SQL_QUERIES = {
    "sql_tok_encode": "SELECT doc_id, CAST(small_tok_count(text) AS BIGINT) AS n_ids, sha2(array_join(transform(small_tok_encode(text), i -> CAST(i AS STRING)), ','), 256) AS digest FROM {docs}",
    "sql_tok_pieces": "SELECT doc_id, CAST(size(p) AS BIGINT) AS n_pieces, sha2(array_join(transform(p, x -> x.piece), '\x1f'), 256) AS digest FROM (SELECT doc_id, small_tok_pieces(text) AS p FROM {docs})",
    "sql_tok_decode": "SELECT doc_id, small_tok_decode(small_tok_encode(text)) AS text FROM {docs}",
    "sql_tok_tokens": "SELECT x.id, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, explode(z) AS x FROM (SELECT doc_id, small_tok_tokens(text) AS z FROM {docs})) GROUP BY x.id",
}


def decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = Tokenizer(spark, full_spec())
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", tok.decode(tok.encode(F.col("text"))).alias("text"))


def decode_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = Tokenizer(spark, small_spec())
    return table(spark, sf_dir, "documents").select("doc_id", tok.decode_native(tok.encode(F.col("text"))).alias("text"))


def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))


def special_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _chat(spark, sf_dir).select("conv_id", "turn", segments(F.col("text"), CHAT).alias("s"))
    shown = F.transform("s", lambda x: F.coalesce(x["special"].cast("string"), x["text"]))
    return parts.select("conv_id", "turn", *_digest(shown))


def encode_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = _chat_tokenizer(spark)
    ids = _chat(spark, sf_dir).select("conv_id", "turn", tok.encode(F.col("text")).alias("ids"))
    return ids.select("conv_id", "turn", F.size("ids").cast("long").alias("n_ids"), (F.element_at("ids", 1) == 60001).alias("begins"), tok.decode(F.col("ids")).alias("text"))


def _chat_tokenizer(spark: SparkSession) -> Tokenizer:
    return Tokenizer(spark, replace(full_spec(), specials={i: c for c, i in CHAT.items()}))


def encode_special_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Special tokens as ordinary text: their characters come back from the ids of the vocabulary alone."""
    tok = _chat_tokenizer(spark)
    return _chat(spark, sf_dir).select("conv_id", "turn", tok.decode(tok.encode(F.col("text"), handle_special=False), include_special=False).alias("text"))


def decode_special_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of special tokens are looked up in the vocabulary, which lacks them."""
    tok = _chat_tokenizer(spark)
    return _chat(spark, sf_dir).select("conv_id", "turn", tok.decode(tok.encode(F.col("text")), include_special=False).alias("text"))


def decode_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each id decoded on its own; the characters that no cut falls into come back."""
    tok = Tokenizer(spark, full_spec())
    parts = table(spark, sf_dir, "documents").select("doc_id", F.array_join(tok.tokens(tok.encode(F.col("text"))), "").alias("t"))
    return parts.select("doc_id", F.sha2(F.regexp_replace("t", r"[^\x00-\x7F]+", ""), 256).alias("digest"))


def chars_per_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = pre.whitespace_split(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n_tokens"), metrics.chars_per_token(F.col("text"), words).alias("ratio"))


def merge_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merges_table(spark, small_spec())


def vocab_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reverse_table(spark, full_spec().truncated(300))


def special_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = replace(small_spec(), specials={i: c for c, i in CHAT.items()})
    return specials_table(spark, spec).select("id", "content", F.hex("utf8").alias("utf8"))


def vocab_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab_table(spark, full_spec().truncated(300))


def chat_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character codes of chat turns as ids; a turn's label part is from 'en' to the first '.', with pads 32."""
    docs = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c)).alias("ids"))
    labels = docs.select("conv_id", "turn", sft_labels(F.col("ids"), [101, 110], 46, 32).alias("l"))
    return labels.select("conv_id", "turn", F.size("l").cast("long").alias("n"), F.sha2(F.array_join(F.transform("l", lambda x: x.cast("string")), ","), 256).alias("digest"))


def single_char_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", F.explode(pre.whitespace_split(F.col("text"))).alias("t"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum((metrics.utf16_length(F.col("t")) == 1).cast("long")).alias("n_single"))


def suffix_ing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", metrics.has_suffix(pre.whitespace_split(F.col("text")), "ing").alias("found"))


def html_attr_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", metrics.known_attributes(F.col("html"), ATTRIBUTES).cast("long").alias("n_known"))


def distinct_piece_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = table(spark, sf_dir, "documents").select(F.explode(pre.matches(F.col("text"), SEGMENTS)).alias("p"))
    by_piece = pieces.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    return by_piece.agg(F.sum("n").cast("long").alias("n_pieces"), F.count(F.lit(1)).alias("n_distinct"))


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {name: partial(_cut, cut) for name, cut in CUTS.items()}
    out |= {name: partial(_map, f) for name, f in MAPS.items()}
    more = [encode_ids, token_count_by_lang, encode_long, encode_full, decode_roundtrip, decode_native, special_split, encode_chat, vocab_truncate]
    more += [chat_labels, single_char_rate, suffix_ing, html_attr_count, distinct_piece_reuse]
    more += [encode_special_off, decode_special_off, decode_tokens, chars_per_token, merge_ranks, vocab_reverse, special_table]
    return out | {name: _sql(q) for name, q in SQL_QUERIES.items()} | {f.__name__: f for f in more}


# SQL for DuckDB, whose regular expressions have no lookahead.

_WS, _NWS = r"[\t-\r\x{85}\p{Z}]", r"[^\t-\r\x{85}\p{Z}]"
_WORD = r"[\p{L}\p{Mn}\p{Nd}\p{Pc}]"
_SCRIPTS = [s for s in pre.SCRIPTS]


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_cut(pieces: str, where: str = "documents") -> str:
    return (
        f"SELECT doc_id, CAST(len(p) AS BIGINT) AS n_pieces, sha256(array_to_string(p, chr(31))) AS digest "
        f"FROM (SELECT doc_id, list_filter({pieces}, lambda x: x <> '') AS p FROM {where})"
    )


def _sql_map(text: str) -> str:
    return f"SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(t) AS digest FROM (SELECT doc_id, {text} AS t FROM documents)"


def _all(pattern: str, text: str = "text") -> str:
    return f"regexp_extract_all({text}, {_lit(pattern)})"


def _gaps(pattern: str) -> str:
    return f"string_split_regex(text, {_lit(pattern)})"


def _tagged(pattern: str) -> str:
    return f"string_split(regexp_replace(text, {_lit(f'({pattern})')}, chr(1) || '\\1' || chr(1), 'g'), chr(1))"


_MARKED = f"regexp_replace(text, '([\\t\\v\\f\\x{{85}}\\p{{Z}}])({_NWS})', chr(1) || '\\1\\2', 'g')"
_SQL_SEGMENTS = (
    r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}\x01]?\p{L}+|\p{N}{1,3}| ?[^\t-\r\x{85}\p{Z}\p{L}\p{N}\x01]+[\r\n]*"
    rf"|{_WS}*[\r\n]+|{_WS}+"
)
_SEGMENTED = _all(_SQL_SEGMENTS, _MARKED)


def _trim(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^{_WS}+', ''), '{_WS}+$', '')"


def _byte_map_sql(text: str) -> str:
    table_ = ", ".join(f"'{b:02X}': {_lit(c)}" for b, c in enumerate(byte_table()))
    return f"array_to_string(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: (MAP {{{table_}}})[h]), '')"


def _words(mark: str) -> str:
    return f"list_transform(list_filter({_gaps(_WS + '+')}, lambda x: x <> ''), lambda x: {mark})"


def _fold_sql(spec: TokenizerSpec) -> str:
    """Distinct pieces to rows of (piece, tok_pos, id): one replacement for each merge, in order."""
    fold = f"regexp_replace({_byte_map_sql('piece')}, '(.)', ' \\1 ', 'g')"
    for _, a, b in spec.merges:
        fold = f"replace({fold}, {_lit(f' {a}  {b} ')}, {_lit(f' {a}{b} ')})"
    vocab = ", ".join(f"({_lit(t)}, {i})" for t, i in spec.vocab.items())
    return f"""
pieces AS (SELECT doc_id, unnest(s) AS piece, unnest(range(1, len(s) + 1)) AS piece_pos FROM (SELECT doc_id, {_SEGMENTED} AS s FROM documents)),
folded AS (SELECT piece, list_filter(string_split({fold}, ' '), lambda x: x <> '') AS toks FROM (SELECT DISTINCT piece FROM pieces)),
toks AS (SELECT piece, unnest(toks) AS token, unnest(range(1, len(toks) + 1)) AS tok_pos FROM folded),
vocab(token, id) AS (VALUES {vocab}),
ids AS (SELECT doc_id, piece_pos, tok_pos, id FROM pieces JOIN toks USING (piece) JOIN vocab USING (token))"""


_SQL_IDS = "SELECT doc_id, count(*) AS n_ids, sha256(string_agg(CAST(id AS VARCHAR), ',' ORDER BY piece_pos, tok_pos)) AS digest FROM ids GROUP BY 1"


def oracle_sql() -> dict[str, str]:
    small = small_spec()
    prefixed = f"list_transform({_SEGMENTED}, lambda x, i: CASE WHEN i > 1 OR NOT starts_with(x, ' ') THEN 'Ġ' ELSE '' END || {_byte_map_sql('x')})"
    chat = "(SELECT conv_id, turn, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' AS text FROM conversations)"
    merged_prev = r"regexp_extract_all(text, '[^%$,.]+[%$,.]|[^%$,.]+|[%$,.]')"
    merged_next = r"regexp_extract_all(regexp_replace(text, '[%$,.]+([%$,.])', '\1', 'g'), '[%$,.]?[^%$,.]+|[%$,.]')"
    bert = _trim(rf"regexp_replace(regexp_replace(text, '[\x01-\x1F\x7F-\x{{9F}}]', ' ', 'g'), '{_WS}+', ' ', 'g')")
    out = {
        "pretok_bytelevel": _sql_cut(_SEGMENTED),
        "pretok_bytelevel_prefix": _sql_cut(prefixed),
        "pretok_whitespace": _sql_cut(_all(rf"{_WORD}+|[^\p{{L}}\p{{Mn}}\p{{Nd}}\p{{Pc}}\t-\r\x{{85}}\p{{Z}}]+")),
        "pretok_whitespace_split": _sql_cut(_gaps(_WS + "+")),
        "pretok_bert": _sql_cut(_all(r"\p{P}|[^\p{P}\t-\r\x{85}\p{Z}]+")),
        "pretok_digits": _sql_cut(_all(r"\p{Nd}+|\P{Nd}+")),
        "pretok_digits_individual": _sql_cut(_all(r"\p{Nd}|\P{Nd}+")),
        "pretok_punct_isolated": _sql_cut(_tagged(rf"{_WORD}+|\p{{P}}")),
        "pretok_punct_removed": _sql_cut(_gaps(rf"{_WORD}+|\p{{P}}")),
        "pretok_metaspace_always": _sql_cut(_words("'▁' || x")),
        "pretok_metaspace_first": _sql_cut(_words("x").replace("lambda x: x)", "lambda x, i: CASE WHEN i = 1 THEN '▁' || x ELSE x END)")),
        "pretok_metaspace_never": _sql_cut(_words("x")),
        "pretok_chardelim": _sql_cut("string_split(text, 'e')"),
        "pretok_scripts": _sql_cut(_all("|".join(f"[{s}]+" for s in _SCRIPTS) + f"|[^{''.join(_SCRIPTS)}]+")),
        "pretok_strip": _sql_cut(f"[{_trim('text')}]"),
        "pretok_replace": _sql_cut(r"[regexp_replace(text, '([aeiou]+)', '<\1>', 'g')]"),
        "split_isolated": _sql_cut(_tagged("[,.]")),
        "split_removed": _sql_cut(_gaps("[,.]")),
        "split_merged_prev": _sql_cut(merged_prev),
        "split_merged_next": _sql_cut(merged_next),
        "split_contiguous": _sql_cut(_tagged("[%$,.]+")),
        "pretok_sequence": _sql_cut(_all(r"\p{Nd}|[\p{L}\p{Mn}\p{Pc}]+|\p{P}|[^\p{Nd}\p{L}\p{Mn}\p{Pc}\p{P}\t-\r\x{85}\p{Z}]+")),
        "pretok_bytelevel_whole": _sql_cut(f"[{_byte_map_sql('text')}]"),
        "split_string": _sql_cut(_tagged(r"\. ")),
        "split_invert": _sql_cut(_gaps("[a-z]+")),
        "norm_strip": _sql_map(_trim("text")),
        "norm_replace": _sql_map(r"regexp_replace(text, '([aeiou])n', '\1m', 'g')"),
        "norm_nmt": _sql_map(_trim(rf"regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]', ' ', 'g'), '{_WS}+', ' ', 'g')")),
        "norm_bert_clean": _sql_map(bert),
        "norm_bert": _sql_map(f"lower(strip_accents({bert}))"),
        "norm_sequence": _sql_map(f"regexp_replace(replace(strip_accents(lower(text)), '.', '!'), '^{_WS}+', '')"),
        "norm_lower": _sql_map("lower(text)"),
        "norm_nfc": _sql_map("nfc_normalize(text)"),
        "norm_strip_accents": _sql_map("strip_accents(text)"),
        "byte_map": _sql_map(_byte_map_sql("text")),
        "encode_ids": f"WITH {_fold_sql(small)} SELECT doc_id, count(*) AS n_ids, sha256(string_agg(CAST(id AS VARCHAR), ',' ORDER BY piece_pos, tok_pos)) AS digest FROM ids GROUP BY 1",
        "token_count_by_lang": f"""WITH {_fold_sql(small)}, n AS (SELECT doc_id, count(*) AS n FROM ids GROUP BY 1)
SELECT lang, count(*) AS n_docs, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_tokens, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents LEFT JOIN n USING (doc_id) GROUP BY 1""",
        "encode_long": f"WITH {_fold_sql(small)} SELECT CAST(id AS INTEGER) AS id, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM ids GROUP BY 1",
        "sql_tok_encode": f"WITH {_fold_sql(small)} {_SQL_IDS}",
        "sql_tok_pieces": _sql_cut(f"list_transform({_SEGMENTED}, lambda x: {_byte_map_sql('x')})"),
        "sql_tok_decode": "SELECT doc_id, text FROM documents",
        "sql_tok_tokens": f"WITH {_fold_sql(small)} SELECT CAST(id AS INTEGER) AS id, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM ids GROUP BY 1",
        "decode_roundtrip": "SELECT doc_id, text FROM documents",
        "decode_tokens": r"SELECT doc_id, sha256(regexp_replace(text, '[^\x00-\x7F]+', '', 'g')) AS digest FROM documents",
        "encode_special_off": f"SELECT conv_id, turn, text FROM {chat}",
        "decode_special_off": "SELECT conv_id, turn, role || chr(10) || text AS text FROM conversations",
        "chars_per_token": f"SELECT doc_id, n AS n_tokens, length(text) / nullif(n, 0) AS ratio FROM (SELECT doc_id, text, len(list_filter({_gaps(_WS + '+')}, lambda x: x <> '')) AS n FROM documents)",
        "merge_ranks": 'SELECT CAST(rank AS INTEGER) AS rank, "left", "right" FROM (VALUES ' + ", ".join(f"({r}, {_lit(a)}, {_lit(b)})" for r, a, b in small.merges) + ') v(rank, "left", "right")',
        "vocab_reverse": "SELECT CAST(id AS INTEGER) AS id, token FROM (VALUES " + ", ".join(f"({_lit(t)}, {i})" for t, i in full_spec().truncated(300).vocab.items()) + ") v(token, id)",
        "special_table": "SELECT CAST(id AS INTEGER) AS id, content, hex(encode(content)) AS utf8 FROM (VALUES " + ", ".join(f"({i}, {_lit(c)})" for c, i in CHAT.items()) + ") v(id, content)",
        "decode_native": "SELECT doc_id, text FROM documents",
        "special_split": f"""SELECT conv_id, turn, CAST(len(p) AS BIGINT) AS n_pieces, sha256(array_to_string(p, chr(31))) AS digest FROM (
SELECT conv_id, turn, list_filter(['60001', substr(text, 13, length(text) - 22), '60002'], lambda x: x <> '') AS p FROM {chat})""",
        "vocab_truncate": "SELECT token, CAST(id AS INTEGER) AS id FROM (VALUES " + ", ".join(f"({_lit(t)}, {i})" for t, i in full_spec().truncated(300).vocab.items()) + ") v(token, id)",
        "chat_labels": r"""WITH c AS (SELECT conv_id, turn, text, regexp_extract_all(text, '(?s).') AS l FROM conversations),
runs AS (SELECT conv_id, turn, len(l) AS n, l, regexp_replace(text, '(?s)^(.)(.*)$', '\1') AS head FROM c),
spans AS (SELECT conv_id, turn, n, l, regexp_replace(regexp_replace(array_to_string(l[2:], ''), '(?s)(en[^.]*(?:\.[. ]*)?)', chr(2) || '\1' || chr(3), 'g'), '^', '') AS t FROM runs),
chars AS (SELECT conv_id, turn, n, l, unnest(regexp_extract_all(t, '(?s).')) AS ch, unnest(range(1, length(t) + 1)) AS p FROM spans WHERE n > 1),
flags AS (SELECT conv_id, turn, n, ch, p, sum(CASE ch WHEN chr(2) THEN 1 WHEN chr(3) THEN -1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY p) AS inside FROM chars),
labels AS (SELECT conv_id, turn, n, string_agg(CASE WHEN inside > 0 THEN CAST(unicode(ch) AS VARCHAR) ELSE '-100' END, ',' ORDER BY p) AS s FROM flags WHERE ch NOT IN (chr(2), chr(3)) GROUP BY 1, 2, 3)
SELECT c.conv_id, c.turn, CAST(len(c.l) AS BIGINT) AS n, sha256(CASE WHEN len(c.l) = 0 THEN '' WHEN s IS NULL THEN '-100' ELSE s || ',-100' END) AS digest
FROM c LEFT JOIN labels USING (conv_id, turn)""",
        "single_char_rate": f"""SELECT lang, count(*) AS n_tokens, CAST(sum(CAST(length(t) = 1 AS BIGINT)) AS BIGINT) AS n_single
FROM (SELECT lang, unnest({_gaps(_WS + '+')}) AS t FROM documents) WHERE t <> '' GROUP BY 1""",
        "suffix_ing": f"SELECT doc_id, len(list_filter({_gaps(_WS + '+')}, lambda x: ends_with(x, 'ing'))) > 0 AS found FROM documents",
        "html_attr_count": f"SELECT page_id, CAST(len(list_filter(regexp_extract_all(html, '([^ =]*)=', 1), lambda x: x IN ({', '.join(map(_lit, ATTRIBUTES))}))) AS BIGINT) AS n_known FROM pages",
        "distinct_piece_reuse": f"SELECT count(*) AS n_pieces, count(DISTINCT p) AS n_distinct FROM (SELECT unnest({_SEGMENTED}) AS p FROM documents)",
    }
    return out
