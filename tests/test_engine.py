"""Table-driven tests of the tokenizer engine; expectations are derived by hand from the documented semantics."""

import json
from dataclasses import replace

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.text import byte_table, token_bytes
from tessera.operators import metrics
from tessera.operators import pretokenizers as pre
from tessera.operators.bpe import merge_symbols
from tessera.operators.labels import mask
from tessera.operators.normalizers import compile_root, lower, normalize
from tessera.operators.specials import segments
from tessera.operators.tokenizer import Tokenizer
from tessera.plans.queries import BYTE_LEVEL, full_spec, small_spec
from tessera.sources.spec import SpecError, TokenizerSpec, merge_pairs, parse, pattern_of

pytestmark = pytest.mark.filterwarnings("ignore")


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


ITEMS = [
    ({"type": "Split", "pattern": {"String": "-"}}, "a--b-", ["a", "-", "-", "b", "-"]),
    ({"type": "Split", "pattern": "-", "behavior": "Removed"}, "a--b-", ["a", "b"]),
    ({"type": "Split", "pattern": "-", "behavior": "merged_with_previous"}, "a--b-", ["a-", "-", "b-"]),
    ({"type": "Split", "pattern": "-", "behavior": "MergedWithNext"}, "a--b-", ["a", "-b", "-"]),
    ({"type": "Split", "pattern": "-", "behavior": "Contiguous"}, "a--b-", ["a", "--", "b", "-"]),
    ({"type": "Split", "pattern": "[ab]", "invert": True}, "axbyy", ["x", "yy"]),
    ({"type": "ByteLevel", "add_prefix_space": True}, "hello world", ["Ġhello", "ĠĠworld"]),
    ({"type": "ByteLevel", "add_prefix_space": False}, "hello😊world", ["hello", "ðŁĺĬ", "world"]),
    ({"type": "ByteLevel", "use_regex": False}, "a b", ["aĠb"]),
    ({"type": "ByteLevel", "add_prefix_space": False}, "a  b\n c12345 it's", ["a", "Ġ", "Ġb", "Ċ", "Ġc", "123", "45", "Ġit", "'s"]),
    ({"type": "Whitespace"}, "a_b, c!! 2", ["a_b", ",", "c", "!!", "2"]),
    ({"type": "WhitespaceSplit"}, " a b\t c ", ["a", "b", "c"]),
    ({"type": "BertPreTokenizer"}, "a,,b c$", ["a", ",", ",", "b", "c$"]),
    ({"type": "Digits"}, "a12b3", ["a", "12", "b", "3"]),
    ({"type": "Digits", "individual_digits": True}, "a12b", ["a", "1", "2", "b"]),
    ({"type": "Punctuation"}, "ab, c$", ["ab", ",", " ", "c", "$"]),
    ({"type": "Punctuation", "behavior": "Removed"}, "ab, c$", [" ", "$"]),
    ({"type": "Metaspace"}, "a  b", ["▁a", "▁b"]),
    ({"type": "Metaspace", "prepend_scheme": "first"}, "a  b", ["▁a", "b"]),
    ({"type": "Metaspace", "prepend_scheme": "never"}, "a  b", ["a", "b"]),
    ({"type": "CharDelimiterSplit", "delimiter": "."}, "a..b.", ["a", "b"]),
    ({"type": "Replace", "pattern": "b", "content": ""}, "b", []),
    ({"type": "Strip"}, "  a ", ["a"]),
    ({"type": "Strip", "lstrip": False}, "  a ", ["  a"]),
    ({"type": "UnicodeScripts"}, "abc 中文かな, привет", ["abc", " ", "中文かな", ", ", "привет"]),
    ({"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "Digits"}]}, "a1 b", ["a", "1", "b"]),
]


@pytest.mark.parametrize(("item", "text", "expected"), ITEMS)
def test_pre_tokenizer(spark, item, text, expected):
    assert one(spark, pre.PreTokenizer({"pretokenizers": [item]}).pieces, text) == expected
    assert one(spark, pre.PreTokenizer({"pretokenizers": [item]}).pieces, "") == []


NORMALIZERS = [
    ({"type": "Lowercase"}, "ÀİΑΣ", "àİας".replace("ς", "σ")),
    ({"type": "NFC"}, "é", "é"),
    ({"type": "NFD"}, "é", "é"),
    ({"type": "NFKC"}, "ﬁ", "fi"),
    ({"type": "NFKD"}, "ﬁé", "fié"),
    ({"type": "Strip", "right": False}, " a ", "a "),
    ({"type": "Replace", "pattern": {"Regex": "(a)b"}, "content": "$1$$"}, "abab", "a$a$"),
    ({"type": "Replace", "pattern": {"String": "."}, "content": "\\"}, "a.b", "a\\b"),
    ({"type": "StripAccents"}, "àé中", "ae中"),
    ({"type": "ByteLevel"}, "é ", "Ã©Ġ"),
    ({"type": "Nmt"}, " a\n\tb\x07c ", "a b c"),
    ({"type": "BertNormalizer"}, "中国人 ÉA\x00", "中 国 人 ea"),
    ({"type": "BertNormalizer", "lowercase": False}, "中国 É", "中 国 É"),
    ({"type": "Sequence", "normalizers": [{"type": "Strip"}, {"type": "Lowercase"}]}, " A ", "a"),
]


@pytest.mark.parametrize(("item", "text", "expected"), NORMALIZERS)
def test_normalizer(spark, item, text, expected):
    assert one(spark, lambda t: normalize(F.array(t), {"normalizers": [item]})[0], text) == expected


def test_bad_definitions():
    for text in ("{}", '{"model": {"vocab": {}, "merges": []}}', '{"model": {"vocab": {"a": 0}}}', '{"model": {"vocab": {"a": 0}, "merges": ["ab"]}}', '{"model": {"vocab": {"a": 0}, "merges": [["a"]]}}'):
        with pytest.raises(SpecError):
            parse(text)
    for item in ({"type": "Precompiled"}, {"type": "Nope"}, {"type": "Replace"}):
        with pytest.raises(SpecError):
            compile_root({"normalizers": [item]})
    for item in ({"type": "Metaspace", "replacement": "xy"}, {"type": "CharDelimiterSplit", "delimiter": "ab"}, {"type": "Split", "pattern": " "}, {"type": "Replace"}, {"type": "Nope"}):
        with pytest.raises(SpecError):
            pre.PreTokenizer({"pretokenizers": [item]})
    with pytest.raises(SpecError):
        compile_root({"type": "Replace", "pattern": "a"})  # a bare root loses its parameters


def test_loading_rules():
    assert merge_pairs(["a b", "ab c"]) == merge_pairs([["a", "b"], ["ab", "c"]]) == [(0, "a", "b"), (1, "ab", "c")]
    assert merge_pairs([["a b", "c"], ["", "b"], ["x", "y"]]) == [(0, "a", "b"), (2, "x", "y")]
    assert pattern_of({"String": "a.b", "Regex": "x"}) == "x" and pattern_of({"other": 1}) is None
    spec = parse(json.dumps({"model": {"vocab": {"a": 0, "b": 1, "c": 1, "d": 2}, "merges": ["a b", "b c", "a b"]}, "added_tokens": [{"id": 9, "content": "<x>"}, None, {"id": 9, "content": "<y>"}, {"id": 8, "content": ""}]}))
    assert spec.ranks == {("a", "b"): 2, ("b", "c"): 1} and spec.specials == {9: "<y>"} and spec.reverse[1] == "c"
    small = spec.truncated(2)
    assert small.vocab == {"a": 0, "b": 1, "c": 1} and len(small.merges) == 2  # c shares a kept id
    shared = TokenizerSpec({"a": 0, "b": 0, "c": 1}, [])
    assert shared.truncated(1).vocab == {"a": 0, "b": 0}
    assert pre.PreTokenizer({"type": "ByteLevel"}).steps == []


def test_byte_table():
    t = byte_table()
    assert len(set(t)) == 256 and t[32] == "Ġ" and sum(t[b] != chr(b) for b in range(256)) == 68
    assert token_bytes("Ġa") == b" a" and token_bytes("a b▁ȁ") == b"a\0b\0"


def test_specials(spark):
    got = one(spark, lambda t: segments(t, {"<a>": 1, "<a>b": 2, "<c>": 3}), "x<a>b<a><c>y<")
    assert [(r["text"], r["special"]) for r in got] == [("x", None), ("<a>b", 2), ("<a>", 1), ("<c>", 3), ("y<", None)]
    assert one(spark, lambda t: segments(t, {}), "") == []


def naive(piece, ranks):
    s = list(piece)
    while len(s) > 1:
        best = min((ranks.get(p, 1 << 40) for p in zip(s, s[1:])))
        if best == 1 << 40:
            break
        out, i = [], 0
        while i < len(s):
            if i + 1 < len(s) and ranks.get((s[i], s[i + 1])) == best:
                out.append(s[i] + s[i + 1])
                i += 2
            else:
                out.append(s[i])
                i += 1
        s = out
    return s


@given(st.text("ab", max_size=14), st.lists(st.tuples(st.text("ab", min_size=1, max_size=3), st.text("ab", min_size=1, max_size=3)), max_size=12))
def test_merging_equals_rescanning(piece, pairs):
    ranks = {p: r for r, p in enumerate(pairs)}
    assert merge_symbols(piece, ranks) == naive(piece, ranks)


TEXTS = ["<|endoftext|>hello  你好<|endoftext|>", "", "  hello  ", " " * 10, "hello world !", "hello\tworld\nline2\r\n", "a" * 10000, "hello😊world", "><", "\x00\x01", "我爱北京天安门，天气很好。"]


def test_encode_decode(spark):
    tok = Tokenizer(spark, full_spec())
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "i int, t string")
    out = df.withColumn("ids", tok.encode(F.col("t"))).withColumn("back", tok.decode(F.col("ids"))).orderBy("i").collect()
    assert [r["back"] for r in out] == [*TEXTS, None]
    assert out[0]["ids"][0] == 50256 and out[1]["ids"] == [] and out[-1]["ids"] is None
    again = df.repartition(3).withColumn("ids", tok.encode(F.col("t"))).orderBy("i").collect()
    assert [r["ids"] for r in again] == [r["ids"] for r in out]
    plain = df.where("i = 0").select(tok.encode(F.col("t"), handle_special=False).alias("ids")).first()["ids"]
    assert 50256 not in plain
    odd = spark.createDataFrame([([50256, 50999, 72],), ([],)], "ids array<int>")
    assert [r[0] for r in odd.select(tok.decode(F.col("ids"))).collect()] == ["<|endoftext|>i", ""]
    assert tok.vocab_size == 50256


@pytest.mark.parametrize("limit", [0, 400])
def test_native_and_arrow_agree(spark, monkeypatch, limit):
    monkeypatch.setattr("tessera.operators.bpe.FOLD_MERGES", limit)
    tok = Tokenizer(spark, small_spec())
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    wide = {r["doc_id"]: r["ids"] for r in df.select("doc_id", tok.encode(F.col("text")).alias("ids")).collect()}
    long: dict = {}
    for r in sorted(tok.encode_long(df).collect(), key=lambda r: (r["doc_id"], r["piece_pos"], r["tok_pos"])):
        long.setdefault(r["doc_id"], []).append(r["id"])
    assert long == {k: v for k, v in wide.items() if v}
    back = df.select("text", tok.decode_native(tok.encode(F.col("text"))).alias("back")).collect()
    assert all(r["text"] == r["back"] for r in back)


def test_vocabulary_misses_are_dropped(spark):
    spec = replace(small_spec(), vocab={"a": 5}, merges=[], pre_tokenizer=BYTE_LEVEL)
    assert one(spark, Tokenizer(spark, spec).encode, "abca") == [5, 5]


def test_labels():
    import numpy as np

    run = lambda ids: mask(np.array(ids), np.array([1, 7]), 2, 0, -100).tolist()
    assert run([1, 7, 5, 2]) == [-100] * 4  # never at the first position
    assert run([9, 1, 7, 5, 2, 0, 2, 3]) == [1, 7, 5, 2, 0, 2, -100, -100]
    assert run([9, 1, 7, 5]) == [1, 7, 5, -100]
    assert run([]) == []


def test_lower_is_one_to_one():
    assert lower("AÉİ") == "aéİ" and len(lower("ẞΣ")) == 2


def test_stream(spark, tmp_path):
    from tessera.streaming.encode import encode_stream

    spark.createDataFrame([("hello world",)], "text string").write.parquet(str(tmp_path / "in"))
    tok = Tokenizer(spark, full_spec())
    stream = encode_stream(spark.readStream.schema("text string").parquet(str(tmp_path / "in")), tok)
    q = stream.writeStream.format("memory").queryName("encoded").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("encoded").first()["ids"] == [31373, 995]


def test_sql_takes_text(spark):
    from tessera.functions.sql import register

    tok = Tokenizer(spark, replace(full_spec(), specials={60001: "<|im_start|>", 60002: "<|im_end|>"}))
    register(spark, tok)
    texts = [*TEXTS, None, "<|im_start|>it's 'quoted' \\ back\n<|im_end|>"]
    spark.createDataFrame(list(enumerate(texts)), "i int, text string").createOrReplaceTempView("x")
    got = spark.sql("select i, tok_pieces(text) p, tok_encode(text) ids, tok_count(text) n, tok_decode(tok_encode(text)) back from x order by i").collect()
    want = spark.table("x").select("i", tok.pieces(F.col("text")).alias("p"), tok.encode(F.col("text")).alias("ids")).orderBy("i").collect()
    assert [(r["p"], r["ids"]) for r in got] == [(r["p"], r["ids"]) for r in want]
    assert [r["back"] for r in got] == texts and [r["n"] for r in got] == [None if t is None else len(r["ids"]) for t, r in zip(texts, want)]
    rows = spark.sql("select x.i, t.* from x, lateral tok_explode(x.text) t order by x.i, t.pos").collect()
    long = spark.sql("select piece, id from tok_explode('hello world !') order by pos").collect()
    assert [tuple(r) for r in long] == [("hello", 31373), ("Ġworld", 995), ("Ġ!", 5145)]
    assert [(r["i"], r["pos"], r["id"]) for r in rows] == [(r["i"], k, x) for r in want for k, x in enumerate(r["ids"] or [])]


def test_sql_tokens_come_in_runs_and_once(spark, monkeypatch):
    import pyarrow as pa

    from tessera.functions.sql import register
    from tessera.operators import bpe

    tok = Tokenizer(spark, replace(full_spec(), specials={60001: "<|im_start|>", 60002: "<|im_end|>"}))
    texts = [*TEXTS, None, "", "<|im_start|>it's\n<|im_end|>", "a" * 5000]
    spark.createDataFrame(list(enumerate(texts)), "i int, text string").createOrReplaceTempView("y")
    for once in (False, True):
        register(spark, tok, "runs", once)
        rows = spark.sql("select runs_tokens(text) z, runs_encode(text) ids, runs_pieces(text) p from y order by i").collect()
        assert [None if r["z"] is None else [x["id"] for x in r["z"]] for r in rows] == [r["ids"] for r in rows]
        for r in rows:
            shown = list(dict.fromkeys((x["piece"] for x in r["z"] or [])))
            assert shown == list(dict.fromkeys(x["piece"] for x in r["p"] or []))
        exploded = spark.sql("select x.id, count(*) n from (select explode(z) x from (select i, runs_tokens(text) z from y)) group by 1")
        assert sum(r["n"] for r in exploded.collect()) == sum(len(r["ids"] or []) for r in rows)
        assert exploded._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == (1 if once else 2)
    assert spark.sql("select sum(size(runs_encode(text))) from y").first()[0] == sum(len(r["ids"] or []) for r in rows)
    monkeypatch.setattr(bpe, "RUN_BYTES", 12)
    runs = list(bpe.encode_joined(tok._spec).func(iter([pa.array(["hello Ġworld", None, "", "\n60001 hello", "hello"])])))
    assert [x for r in runs for x in r.to_pylist()] == [[[31373], [995]], None, [[]], [[60001], [31373]], [[31373]]]
    assert len(runs) == 3


def test_close_releases(spark):
    df = spark.createDataFrame([("hello world",)], "t string")
    with Tokenizer(spark, full_spec()) as tok:
        assert df.select(tok.decode(tok.encode(F.col("t")))).first()[0] == "hello world"
        held = list(tok._shared)
        assert len(held) == 2
    assert tok._shared == []
    with pytest.raises(Exception, match="destroyed"):
        held[0].unpersist()


def test_load_by_a_path_of_spark(spark, tmp_path):
    import shutil

    from tessera.plans.queries import vocabulary_path

    shutil.copy(vocabulary_path(), tmp_path / "t.json")
    tok = Tokenizer.load(spark, f"file://{tmp_path}/t.json", 300)  # open() doesn't take such a path
    assert tok.vocab_size == 300


def test_single_ids(spark):
    tok = Tokenizer(spark, full_spec())
    df = spark.createDataFrame([([31373, 995, 50999],), ([],), (None,), ([50256],)], "ids array<int>")
    assert [r[0] for r in df.select(tok.tokens(F.col("ids"))).collect()] == [["hello", " world", ""], [], None, ["<|endoftext|>"]]
    assert [r[0] for r in df.select(tok.decode(F.col("ids"))).collect()] == ["hello world", "", None, "<|endoftext|>"]


def test_stream_counts_by_window(spark, tmp_path):
    from tessera.streaming.encode import token_counts

    rows = [("2024-01-01 00:01:00", "hello world"), ("2024-01-01 00:04:00", "hello"), ("2024-01-01 00:06:00", None), ("2024-01-01 01:00:00", "hello world")]
    spark.createDataFrame(rows, "at string, text string").select(F.to_timestamp("at").alias("at"), "text").write.parquet(str(tmp_path / "in"))
    tok = Tokenizer(spark, full_spec())
    stream = token_counts(spark.readStream.schema("at timestamp, text string").parquet(str(tmp_path / "in")), tok, "at")
    q = stream.writeStream.format("memory").queryName("counted").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    out = {r["window"]["start"].strftime("%H:%M"): (r["tokens"], r["texts"]) for r in spark.table("counted").collect()}
    assert out["00:00"] == (3, 2) and out["00:05"][1] == 1 and out["01:00"] == (2, 1)


def test_ratio_is_null_without_tokens(spark):
    df = spark.createDataFrame([("ab cd",), ("",), ("  ",), (None,)], "text string")
    out = df.select(metrics.chars_per_token(F.col("text"), pre.whitespace_split(F.col("text"))).alias("r")).collect()
    assert [r["r"] for r in out] == [2.5, None, None, None]
