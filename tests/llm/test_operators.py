"""Edge cases and brute force for each operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, decontamination, exact_dedup, html_extraction, language_id, license_scan, linear, ngram_join, packing, quality, substring_dedup, textgrams, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block long, n long, spans string"


def make(spark, rows):
    """rows: (doc_id, text); the other columns clash with names used inside, or are null."""
    return spark.createDataFrame([(i, t, None, f"s{k % 2}" if k % 3 else None, None, 7, 7, "x") for k, (i, t) in enumerate(rows)], SCHEMA)


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "the", "The"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 4, 5, 12, 13, 30, 80]))) for _ in range(n)]
    rows = list(enumerate(texts))
    for i in range(0, n, 3):  # near copies and shared passages
        w = texts[i].split()
        if len(w) > 20:
            v = list(w)
            v[r.randrange(len(v))] = "changed"
            rows.append((len(rows), " ".join(v)))
            rows.append((len(rows), "\n".join(w[:15] + ["other", "words"])))
    return rows + [(len(rows), texts[6]), (len(rows) + 1, None), (len(rows) + 2, ""), (3, texts[3]), (None, texts[6]), (len(rows) + 3, "word " * 3000)]


ROWS = corpus()


def check(a, b):
    assert sorted(a, key=repr) == sorted(b, key=repr)


def test_exact_dedup(spark):
    df = make(spark, ROWS)
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    groups: dict = {}
    for i, t in ROWS:
        groups.setdefault(t or "", []).append(i)
    expected = [(i, max((x for x in g if x is not None), default=None), len(g)) for t, g in groups.items() for i in g]
    for d in (None, digest):
        out = exact_dedup.exact_dedup(df, digest=d).collect()
        check([(r["doc_id"], r["keep_id"], r["group_size"]) for r in out], expected)
        assert sum(r["kept"] for r in out) == len(groups)  # of rows that repeat id and text, one
        assert all(r["doc_id"] == r["keep_id"] for r in out if r["kept"])
    assert exact_dedup.exact_dedup(make(spark, ROWS[:0])).count() == 0
    alone = exact_dedup.exact_dedup(make(spark, [(None, "x"), (None, "x")])).collect()
    assert [(r["doc_id"], r["keep_id"], r["group_size"]) for r in alone] == [(None, None, 2)] * 2 and sum(r["kept"] for r in alone) == 1


def test_substring_dedup(spark):
    words = {k: (t or "").split() for k, (_, t) in enumerate(ROWS)}
    first: dict = {}
    for k, (i, _) in enumerate(ROWS):
        for s in range(len(words[k]) - 12):
            if i is not None:
                key = tuple(words[k][s : s + 13])
                first[key] = min(first.get(key, i), i)
    expected = []
    for k, (i, _) in enumerate(ROWS):
        gone = set()
        for s in range(len(words[k]) - 12):
            if i is not None and first[tuple(words[k][s : s + 13])] < i:
                gone.update(range(s, s + 13))
        expected.append((i, len(words[k]), len(gone), " ".join(w for p, w in enumerate(words[k]) if p not in gone)))
    for parts in (None, (1, 1), (9, 64)):
        out = substring_dedup.substring_dedup(make(spark, ROWS), parts=parts).collect()
        check([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out], expected)
        assert any(r["n_removed"] for r in out) and all(sum(s["end"] - s["begin"] for s in r["spans"]) == r["n_removed"] for r in out)
    assert substring_dedup.substring_dedup(make(spark, ROWS[:0])).count() == 0


def test_grid_keeps_messages_worth_sending():
    for size in (0, 1, 10**9, 8 * 10**10, 10**12, 10**13):
        blocks, buckets = common.grid(size)
        assert blocks >= 1 and buckets >= 1
        assert size / (blocks * buckets) >= 300 or blocks * buckets == 1
        assert size / blocks <= common.BLOCK_RANGE[1] and size / buckets <= common.BUCKET_RANGE[1]
    blocks, buckets = common.grid(10**14)
    assert 10**14 / (blocks * buckets) >= 80


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_words_that_collide_for_every_base_are_kept_apart(spark):
    """Thue-Morse words agree in any polynomial modulo 2**64."""
    for n in (1024, 2048):
        pair = [thue_morse(n).encode(), thue_morse(n, "b", "a").encode()]
        for lane in (0, 1):
            assert len(set(textgrams.word_hashes(pair, textgrams.SPACES, lane=lane)[0])) == 2
        x, y = (" ".join([p.decode()] + [f"w{i}" for i in range(14)]) for p in pair)
        rows = [(1, x), (2, y), (3, x)]
        out = {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(make(spark, rows)).collect()}
        assert out == {1: 0, 2: 14, 3: 15}  # the second keeps its first word only
        out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_components(make(spark, [(1, x), (2, y)])).collect()}
        assert out == {1: (11, 1), 2: (11, 1)}
        short = [(1, " ".join(x.split()[:5])), (2, " ".join(y.split()[:5])), (3, " ".join(x.split()[:5]))]
        out = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_components(make(spark, short)).collect()}
        assert out == {1: 1, 2: 2, 3: 1}


def test_equal_hashes_of_different_windows_are_told_apart(monkeypatch):
    import pyarrow as pa

    real = textgrams.WordTable.hashes
    monkeypatch.setattr(textgrams.WordTable, "hashes", lambda self, lane: real(self, lane) & np.uint64(1))  # nearly all collide
    texts = [" ".join(random.Random(s).choices("abcdef", k=30)) for s in (1, 2, 1, 3)]
    table = pa.table({"doc_id": pa.array([4, 1, 2, 3]), "text": pa.array(texts)})
    b = substring_dedup._Block(table, 13, 3)
    number = b.words.number
    windows = [tuple(number[f : f + 13]) for f in b.first]
    first: dict = {}
    for i, w in enumerate(windows):
        first.setdefault(w, i)
    assert b.leader.tolist() == [first[w] for w in windows] and sorted(b.entries.tolist()) == sorted(first.values())


def test_word_table_splits_as_bytes_do():
    import pyarrow as pa

    texts = ["", None, "  a b\x0bc\td ", "x" * 1_500_000 + " y", "é à\x1cz   q\xa0r", "w"]
    t = textgrams.WordTable(pa.array(texts))
    words = t.distinct.to_pylist()
    for i, x in enumerate(texts):
        assert [words[k].encode() for k in t.number[t.offsets[i] : t.offsets[i + 1]]] == (x or "").encode().split()
    assert len(textgrams.WordTable(pa.array([None, ""])).hashes(0)) == 0


def shingles(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    best: dict = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            best[find(k)] = min(best.get(find(k), i), i)
    return [(i, len(sets[k]), best.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)]


def test_ngram_join(spark):
    out = ngram_join.similar_components(make(spark, ROWS)).collect()
    check([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out], brute_components(ROWS))
    assert ngram_join.similar_components(make(spark, ROWS[:0])).count() == 0


def test_ngram_join_large_group(spark, monkeypatch):
    """Chunks, hubs and the second look: a family whose members link to some others only, and short texts of shared lines."""
    monkeypatch.setattr(ngram_join, "CHUNK", 8)
    monkeypatch.setattr(ngram_join, "HUBS", 2)
    monkeypatch.setattr(ngram_join, "FREQUENT", 8)
    r = random.Random(5)
    base = [f"b{i}" for i in range(70)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 2, 3])):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    line = "released under the terms of some licence for all"
    for i in range(90, 150):
        rows.append((i, line + "".join(f" y{r.randrange(30)}" for _ in range(r.choice([1, 2, 3])))))
    out = ngram_join.similar_components(make(spark, rows)).collect()
    check([(x["doc_id"], x["n_shingles"], x["component_id"]) for x in out], brute_components(rows))


def test_decontamination(spark):
    docs = make(spark, [*ROWS, (900, "a short ITEM here"), (901, "x " + " ".join(f"q{i}" for i in range(12)) + " y")])
    items = [(1, "Short item"), (2, " ".join(f"q{i}" for i in range(11))), (3, None), (None, "the"), (5, ""), (2, " ".join(f"q{i}" for i in range(11))), (11, "short, item!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 20, 10):
        out = {r["doc_id"]: r for r in decontamination.find_contamination(docs, bench, broadcast_bytes=limit).collect()}
        assert out[900]["items"] == [1, 11] and [(s["begin"], s["end"]) for s in out[900]["spans"]] == [(1, 3)]
        assert out[901]["items"] == [2] and [(s["begin"], s["end"]) for s in out[901]["spans"]] == [(1, 12)]
        assert sum(bool(r["spans"]) for r in out.values()) == 2
    assert decontamination.find_contamination(docs, bench.limit(0)).where("size(items) > 0").count() == 0
    assert decontamination.find_contamination(docs.limit(0), bench).count() == 0


def test_decontamination_by_brute_force(spark):
    """Random items and texts; portions of any size give the same, and each plan holds one of them."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(r.choices(words, k=r.choice([1, 2, 3, 4, 5, 40])))) for i in range(12)]
    docs = [(i, " ".join(r.choices([*words, "W1.", "é"], k=r.randrange(0, 60)))) for i in range(40)]
    normal = lambda t: decontamination.normal_words(t.encode())
    expected = []
    for i, t in docs:
        w, hit, found = normal(t), set(), set()
        for item, x in items:
            b = normal(x)
            k = min(3, len(b))
            grams = {tuple(b[j : j + k]) for j in range(len(b) - k + 1)}
            at = [j for j in range(len(w) - k + 1) if tuple(w[j : j + k]) in grams]
            found |= {item} if at else set()
            hit.update(p for j in at for p in range(j, j + k))
        expected.append((i, len(w), sorted(hit), sorted(found)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 20, 500):
        out = decontamination.find_contamination(make(spark, docs), bench, ngram=3, broadcast_bytes=limit)
        assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        got = [(r["doc_id"], r["n_words"], [p for s in r["spans"] for p in range(s["begin"], s["end"])], r["items"]) for r in out.collect()]
        check(got, expected)


def test_decontamination_index_is_bounded(spark):
    r = random.Random(1)
    items = [(i, " ".join(f"x{r.randrange(10**6)}" for _ in range(2000))) for i in range(60)]
    bench = spark.createDataFrame([*items, (99, " ".join(f"y{i}" for i in range(40_000)))], "item_id long, text string")
    limit = 1 << 20
    sizes = [x.size for x in decontamination._portions(bench, "item_id", "text", 10, limit)]
    assert len(sizes) > 4 and max(sizes) <= 1.1 * limit


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = [*ROWS[:-1], (950, "it's 'll ’quoted’ 日本 <|endoftext|> x\xa0y ½ d'été"), (951, "naïve ÀÉ ×÷ " * 500)]
    rows = [(i, t) for i, t in rows if i is not None and (i, t) != ROWS[3]]
    ids = {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in rows}
    for kw in ({}, {"lane_bytes": 500, "targets": {"s0": 0.7}}):
        out = packing.pack(make(spark, rows), path, **kw).collect()
        by_doc: dict = {}
        by_seq: dict = {}
        for r in out:
            by_doc.setdefault(r["doc_id"], []).append(r)
            by_seq.setdefault(r["sequence_id"], []).append(r)
            assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
        assert set(by_doc) == set(ids)
        for i, parts in by_doc.items():
            at = 0
            for r in sorted(parts, key=lambda r: r["start"]):
                assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids[i])
                at += r["length"]
            assert at == len(ids[i])
        for k, parts in by_seq.items():
            at = 0
            for r in sorted(parts, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at == 2048 or k == max(by_seq)
    assert packing.pack(make(spark, [(1, None)]), path).count() == 1
    assert packing.pack(make(spark, []), path).count() == 0


def served_one_by_one(share, deficit, left, begin, sequence):
    """Tokens of each source in each window of a lane, by the rule of ``allot`` spelled out token by token."""
    deficit, left, windows, position, end = list(deficit), list(left), [], begin, begin + sum(left)
    while position < end:
        room = min(sequence - position % sequence, end - position)
        deficit = [d + s * room for d, s in zip(deficit, share)]
        want = [min(max(int(d // 1), 0), x) for d, x in zip(deficit, left)]
        if sum(want) > room:
            total = sum(want)
            want = [w * room // total for w in want]
        rest = min(room, sum(left)) - sum(want)
        while rest:
            spare = [x - w for x, w in zip(left, want)]
            weight = [max(s, 1e-12) if x > 0 else 0.0 for s, x in zip(share, spare)]
            more = [min(int(rest * w / sum(weight)), x) for w, x in zip(weight, spare)]
            if not any(more):
                by_deficit = sorted((w - d, i) for i, (w, d) in enumerate(zip(want, deficit)))
                for _, i in [x for x in by_deficit if spare[x[1]] > 0][:rest]:
                    more[i] = 1
            want = [w + m for w, m in zip(want, more)]
            rest -= sum(more)
        windows.append(want)
        deficit = [d - w for d, w in zip(deficit, want)]
        left = [x - w for x, w in zip(left, want)]
        position += room
    return windows


def test_packing_keeps_the_mixture(spark):
    """Against a run from lane to lane that carries its deficits in one variable."""
    r = random.Random(9)
    sources = ["a", "b", "c", "d"]
    rows = [(i, "word " * r.randrange(1, 900), r.choices(sources, [8, 4, 2, 1])[0]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    path, lane_bytes = public_tokenizers.path("word_bpe_49k.json"), 400_000
    for targets in (None, {"a": 0.25, "b": 0.25, "c": 0.25, "d": 0.25}):
        out = packing.pack(df, path, targets, lane_bytes=lane_bytes).collect()
        size = sum(len(t) for _, t, _ in rows)
        lanes = {x["doc_id"]: x["block"] for x in packing._laned(df, "doc_id", "text", F.col("source"), -(-size // lane_bytes)).collect()}
        tokens = {x["doc_id"]: x["doc_tokens"] for x in out}
        total = sum(tokens.values())
        own = [sum(tokens[i] for i, _, s in rows if s == k) / total for k in sources]
        share, given, expected, at = [targets[s] for s in sources] if targets else own, [0] * 4, {}, 0
        full = []
        for lane in sorted(set(lanes.values())):
            left = [sum(tokens[i] for i, _, s in rows if s == k and lanes[i] == lane) for k in sources]
            first = [s * at - g for s, g in zip(share, given)]
            rest = list(left)
            for w, window in enumerate(served_one_by_one(share, first, left, at, 2048)):
                for k, n in enumerate(window):
                    expected[at // 2048 + w, sources[k]] = expected.get((at // 2048 + w, sources[k]), 0) + n
                rest = [a - b for a, b in zip(rest, window)]
                if not sum(given) and min(rest) > 0:  # the first lane has nothing to make up for
                    full.append([abs(n - 2048 * s) for n, s in zip(window, share)])
            given = [g + x for g, x in zip(given, left)]
            at += sum(left)
        got: dict = {}
        for x in out:
            got[x["sequence_id"], x["source"]] = got.get((x["sequence_id"], x["source"]), 0) + x["length"]
        assert {k: v for k, v in expected.items() if v} == got
        if targets is None:
            assert len(full) > 10 and np.max(full) <= 2  # proportions hold in every window, not only on average


def test_packing_takes_any_tokenizer_file(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, "Hello World"), (2, "  It's  2024,\tÉtÉ!"), (3, None)]
    tok = Tokenizer.from_file(path)
    out = {r["doc_id"]: r for r in packing.pack(make(spark, rows), path).collect()}
    for i, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        assert out[i]["length"] == len(ids) and out[i]["ids_crc32"] == zlib.crc32(ids.tobytes())


def labelled(spark, n=300):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        bad = r.random() < 0.3
        words = [f"w{r.randrange(200)}" for _ in range(40)] + (["nasty"] if bad else [])
        r.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    labels += [(None, 1), (5, None), (n + 99, 1)]
    return make(spark, rows).select("doc_id", "text"), spark.createDataFrame(labels, "doc_id long, label int"), dict(labels[:n])


def test_toxicity(spark):
    docs, labels, truth = labelled(spark)
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0 or doc_id is null"))
    out = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert np.mean([out[i]["predicted"] == truth[i] for i in truth if i % 2]) > 0.97
    assert len(model.names) < 1000
    odd = toxicity.score(make(spark, [(1, None), (2, ""), (None, "nasty"), (1, None)]), model).collect()
    assert len(odd) == 4 and all(0 <= r["score"] <= 1 for r in odd)
    nothing = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs.limit(0), nothing).count() == 0 and toxicity.score(docs, nothing).count() == 300


def test_quality(spark):
    docs, labels, truth = labelled(spark)
    grades = labels.withColumn("label", F.when(F.col("doc_id") % 5 == 0, F.lit(2)).otherwise(1 - F.col("label")))
    for ratings, good in ((labels.withColumn("label", 1 - F.col("label")), truth), (grades, None)):
        model = quality.train(docs, ratings)
        out = {r["doc_id"]: r for r in quality.grade(docs, model).collect()}
        assert len(out) == 300 and list(np.diff(model.bias) >= 0) == [True] * (len(model.bias) - 1)
        if good:
            assert np.mean([out[i]["accepted"] == (not truth[i]) for i in truth]) > 0.97
    odd = quality.grade(make(spark, [(1, None), (2, ""), (None, "x")]).withColumn("accepted", F.lit("old")), model)
    assert odd.count() == 3 and dict(odd.dtypes)["accepted"] == "boolean"
    assert quality.grade(docs.limit(0), quality.train(docs, labels.limit(0))).count() == 0


def test_ordinal_thresholds_separate_grades():
    r = np.random.default_rng(0)
    y = r.integers(0, 3, 300)
    rows = [np.array([1 if g > 0 else 2, 3 if g > 1 else 4, 5], np.uint32) for g in y]
    model = linear.ordinal(rows, y, 3)
    scores = [model.dot(x, np.zeros(len(x), int), 1)[0] for x in rows]
    assert np.array_equal([(s > model.bias).sum() for s in scores], y)


def test_toxicity_scores_by_brute_force(spark):
    """Every feature of a text spelled out with strings, once each, times its weight."""
    rows = [(1, "Bad words, BAD ones and a naïve naïveté"), (2, ""), (3, "x y " * 30_000), (4, "one")]

    def feature(kind, *words):
        h = [textgrams.word_hashes([w], textgrams.NON_WORD, lane=None)[0][0] for w in words]
        with np.errstate(over="ignore"):
            x = h[0] if len(h) == 1 else h[0] * toxicity._GRAM + h[1]
            return int(textgrams.mix(np.array([x + np.uint64(kind)], np.uint64)).astype(np.uint32)[0])

    def brute(text):
        w, out = decontamination.normal_words(text.encode()), set()
        for i, x in enumerate(w):
            out.add(feature(1, x))
            out.update(feature(2 + k, x[:n]) for k, n in enumerate(toxicity.STEMS))
            out.update(feature(16 + gap, w[i - gap], x) for gap in (1, 2, 3) if i >= gap)
        return out

    expected = {i: brute(t if len(t) < 999 else t[:40]) for i, t in rows}
    f, of = toxicity.features([t.encode() for _, t in rows])
    assert {i: set(f[of == k].tolist()) for k, (i, _) in enumerate(rows)} == expected
    names = np.array(sorted(set().union(*expected.values())), np.uint32)[::2]
    model = linear.SparseWeights(names, np.linspace(-1, 1, len(names)), np.array([0.3]))
    weight = dict(zip(names.tolist(), model.weights))
    for r in toxicity.score(make(spark, rows), model).collect():
        z = 0.3 + sum(weight.get(x, 0.0) for x in expected[r["doc_id"]])
        assert np.isclose(r["score"], 1 / (1 + np.exp(-z))) and r["predicted"] == (z >= 0)


def test_ftrl_against_its_formula():
    """The published update, one coordinate at a time in plain floats."""
    import math

    r = np.random.default_rng(3)
    rows = [np.unique(r.integers(0, 12, 5)).astype(np.uint32) for _ in range(80)]
    y = r.integers(0, 2, 80)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.4, 1.0
    z, n = dict.fromkeys([*range(12), "b"], 0.0), dict.fromkeys([*range(12), "b"], 0.0)

    def w(i):
        lasso = 0.0 if i == "b" else l1
        if abs(z[i]) <= lasso:
            return 0.0
        return -(z[i] - math.copysign(lasso, z[i])) / ((beta + math.sqrt(n[i])) / alpha + (0.0 if i == "b" else l2))

    for _ in range(3):
        for x, t in zip(rows, y):
            coords = [*x.tolist(), "b"]
            now = {i: w(i) for i in coords}
            g = 1 / (1 + math.exp(-sum(now.values()))) - t
            for i in coords:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * now[i]
                n[i] += g * g
    model = linear.ftrl(rows, y, alpha, beta, l1, l2, epochs=3, least=1)
    got = dict(zip(model.names.tolist(), model.weights))
    assert all(np.isclose(got.get(i, 0.0), w(i)) for i in range(12)) and np.isclose(model.bias[0], w("b"))
    assert any(w(i) == 0 for i in range(12)) and len(got) > 3


def test_quality_grades_by_brute_force(spark):
    """Three grades: expected grade and tail probabilities from the model's weights, and the grades come out in order."""
    r = random.Random(6)
    words = ["poor", "fair", "good"]
    rows = [(i, " ".join([words[i % 3]] * 3 + r.choices(["a", "b", "c", "d", "e"], k=30))) for i in range(240)]
    docs, ratings = make(spark, rows), spark.createDataFrame([(i, i % 3) for i, _ in rows], "doc_id long, label int")
    model = quality.train(docs.select("doc_id", "text"), ratings.where("doc_id % 4 <> 0"))
    assert len(model.bias) == 2
    out = {x["doc_id"]: x for x in quality.grade(docs.select("doc_id", "text"), model, keep_grade=2).collect()}
    weight = dict(zip(model.names.tolist(), model.weights))
    for i, t in rows:
        f, _ = quality.features([t.encode()])
        above = [1 / (1 + np.exp(b - sum(weight.get(x, 0.0) for x in f.tolist()))) for b in model.bias]
        assert np.isclose(out[i]["expected_grade"], sum(above)) and np.isclose(out[i]["tail_probability"], above[1])
    held = [(round(out[i]["expected_grade"]), i % 3) for i, _ in rows if i % 4 == 0]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert np.mean([out[i]["accepted"] == (i % 3 == 2) for i, _ in rows if i % 4 == 0]) > 0.95


def test_labelled_sample_is_defined(spark):
    """Repeated ids, bounds on rows and bytes: the same rows whatever the layout, and no more than the bounds."""
    docs = spark.createDataFrame([(i % 20, f"text number {i} " * (1 + i % 5)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, label int")
    pick = lambda d, **kw: [(r.tolist(), int(t)) for r, t in zip(*linear.labelled_sample(d, labels, toxicity.features, 50, **kw))]
    one = pick(docs)
    assert len(one) == 50 and one == pick(docs.repartition(7).orderBy(F.rand(3)))
    assert 0 < len(pick(docs, max_bytes=500)) < 20 and pick(docs, max_bytes=1) == []


def test_language_id(spark):
    r = random.Random(3)
    words = {"en": "the house and water with people think about".split(), "fr": "maison avec les personnes dans eau être pour".split()}
    rows = [(i, " ".join(r.choices(words[lang], k=20)), lang) for i, lang in enumerate(["en", "fr"] * 40)]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "the", None)], "doc_id long, text string, lang string")
    model = language_id.train(docs.where("doc_id % 3 <> 1"), public_tokenizers.path("piece_bpe_32k.model"))
    out = language_id.identify(docs.unionByName(spark.createDataFrame([(902, "12 !!", None), (903, "日本語 " * 50, None)], docs.schema)), model).collect()
    by = {x["doc_id"]: x for x in out}
    assert all(by[i]["lang_pred"] == lang and 0 <= by[i]["score"] <= 1 for i, _, lang in rows)
    assert by[900]["lang_pred"] == by[902]["lang_pred"] == "und" and by[903]["lang_pred"] in ("en", "fr")
    empty = language_id.train(docs.limit(0), public_tokenizers.path("piece_bpe_32k.model"))
    assert {x["lang_pred"] for x in language_id.identify(docs, empty).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    pieces = ["a", "ab", "b", "▁", "▁a"]
    model = language_id.LanguageModel(["x"], pieces, np.array([[0.2], [0.3], [0.1], [0.15], [0.05], [1e-7]]))

    def brute(w):
        if not w:
            return 1.0
        return sum(model.probability[pieces.index(w[:k]), 0] * brute(w[k:]) for k in range(1, len(w) + 1) if w[:k] in pieces)

    for w in ("▁ab", "▁aab", "▁ba", "▁b"):
        assert np.isclose(np.exp(model.log_likelihood([w])[0, 0]), brute(w))


def brute_counts(model, pieces, w):
    """Probability of a word and expected counts of its pieces, from every segmentation on its own."""
    found = []

    def cut(rest, used, p):
        if not rest:
            found.append((p, used))
        for k in range(1, len(rest) + 1):
            x = rest[:k]
            if x in pieces or k == 1:
                row = pieces.index(x) if x in pieces else -1
                cut(rest[k:], [*used, row], p * model.probability[row, 0])

    cut(w, [], 1.0)
    total = sum(p for p, _ in found)
    counts = np.zeros(len(model.probability))
    for p, used in found:
        for row in used:
            counts[row] += p / total
    return total, counts


def test_long_words_and_long_pieces(monkeypatch):
    pieces = ["a", "ab", "b", "▁", "▁a", "abababababababab"[:14]]
    p = np.array([[0.2], [0.3], [0.1], [0.15], [0.05], [0.02], [1e-7]])
    model = language_id.LanguageModel(["x"], pieces, p)
    word = "▁" + "ab" * 29 + "a"  # 60 letters: by dynamic programming with exact fractions
    from fractions import Fraction

    sums = [Fraction(1)]
    for end in range(1, len(word) + 1):
        sums.append(sum((sums[b] * Fraction(float(p[pieces.index(word[b:end]), 0])) for b in range(max(0, end - 14), end) if word[b:end] in pieces), Fraction(0)))
    import math

    exact = math.log(sums[-1].numerator) - math.log(sums[-1].denominator)
    assert abs(model.log_likelihood([word])[0, 0] - exact) < 1e-9
    huge = model.log_likelihood(["▁" + "ab" * 3000, "▁" + "z" * 500, "▁a"])[:, 0]
    assert np.isfinite(huge).all() and np.isclose(huge[1], np.log(0.15) + 500 * np.log(1e-7))
    words, weight = ["▁ab", "▁aabab", "▁zb", "▁abab"], np.array([[1.0], [2.0], [1.0], [3.0]])
    expected = sum(weight[k, 0] * brute_counts(model, pieces, w)[1] for k, w in enumerate(words))
    for limit in (32, 2):  # plain and in logarithms
        monkeypatch.setattr(language_id, "PLAIN_LETTERS", limit)
        assert np.allclose(model.expected(words, weight)[:, 0], expected)
        assert np.allclose(np.exp(model.log_likelihood(words)[:, 0]), [brute_counts(model, pieces, w)[0] for w in words])


def test_language_of_long_texts():
    model = language_id.fit([("en", "the house of the water " * 50), ("de", "das haus und das wasser " * 50)], language_id.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    assert max(map(len, model.pieces)) > 10
    scorer = language_id._Scorer(model)
    langs, scores = scorer.score(["das haus " * 20_000, "the" * 2000, "", "1 2", "das"])
    assert langs[0] == "de" and langs[2] == langs[3] == "und" and langs[4] == "de" and 0 <= min(scores) <= max(scores) <= 1


PAGE = """<html><head><title>T</title><style>x</style></head><body><header>Site name</header><nav><ul><li><a href=/a>Menu</a></ul></nav>
<div id="cookie-banner">We use cookies and a lot of other things on this page.</div><{tag} class="post"><h1>Head &amp; line</h1>
<p>First   paragraph with <b>bold</b> text that is quite long, to be the content of the page.<p>Short.</p><script>var a="</p>";</script>
<form>Search here <input></form><p>Last paragraph, which again is long enough to be content by its ratio&nbsp;alone.</p></{tag}>
<aside>Related things to read</aside><section class="comments"><p>A reader comment of some length, that must not be part of it.</p></section>
<footer>&copy; someone</footer>"""
TEXT = "Head & line First paragraph with bold text that is quite long, to be the content of the page. Short. Last paragraph, which again is long enough to be content by its ratio alone."


@pytest.mark.parametrize("tag", ["article", "main", "div", "section"])
def test_html(tag):
    assert html_extraction.main_text(PAGE.replace("{tag}", tag)) == TEXT


def test_html_odd_pages(spark):
    assert html_extraction.main_text("just words") == "just words"
    assert html_extraction.main_text("") == "" and html_extraction.main_text("<nav>menu</nav>") == ""
    assert html_extraction.main_text("<article><p>" + "x " * 50_000 + "</article>") == ("x " * 50_000).strip()
    df = spark.createDataFrame([(1, "u", None, "t"), (1, "u", None, "t"), (None, None, "<p>a", "t")], "page_id long, url string, html string, text string")
    check([tuple(r) for r in html_extraction.extract_main_text(df).collect()], [(1, "u", ""), (1, "u", ""), (None, None, "a")])


LONG = "A paragraph of the article itself, with a sentence that goes on for quite a while before it ends at last."
#: No names, no semantic tags: what is content shows in the ratios alone.
BARE = (
    "<body><div>" + "".join(f"<span><b>tag number {i}</b></span><br>" for i in range(60)) + "</div>"
    f"<div><h1>Title of the piece</h1><p>{LONG}</p><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div>"
    "<div>" + "".join(f"<i>item {i}</i><br>" for i in range(9)) + "</div></body>"
)


def test_html_ratios_select_the_region(monkeypatch):
    wanted = f"Title of the piece {LONG} {LONG} Short one. {LONG}"
    assert html_extraction.main_text(BARE) == wanted
    monkeypatch.setattr(html_extraction, "smooth", lambda x, sigma: [1.0] * len(x))
    assert html_extraction.main_text(BARE) != wanted


def test_html_cluster_against_numpy():
    r = random.Random(4)
    for n in (1, 2, 5, 60):
        lines = [(0, "x" * r.randrange(1, 200), r.randrange(0, 9), 0) for _ in range(n)]
        x = np.array([len(t) / max(1, k) for _, t, k, _ in lines])
        kernel = np.exp(-((np.arange(n)[:, None] - np.arange(n)[None, :]) / html_extraction.SIGMA) ** 2 / 2)
        kernel[abs(np.arange(n)[:, None] - np.arange(n)[None, :]) > 2 * html_extraction.SIGMA] = 0
        smoothed = kernel @ x / kernel.sum(axis=1)
        assert np.allclose(html_extraction.smooth(x.tolist(), html_extraction.SIGMA), smoothed)
        assert html_extraction.content_cluster(lines) == (smoothed >= smoothed.std() - 1e-12).tolist()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<p class="ad">Advert<p>Second paragraph', "Second paragraph"),
        ('<ul><li class="share">Share<li>After list</ul>', "After list"),
        ('<table><tr><td class="ad">Ad<td>Cell<tr><td>More</table>', "Cell More"),
        ('<dl><dt class="ad">Ad<dd>Kept</dl>', "Kept"),
        ('<section class="related-work"><p>Related work</section><div id="comments-on-method"><p>On method</div>', "Related work On method"),
        ('<p>x</p><div class="cookie-banner-wrapper">We</div><div id="postComments">say</div>', "x"),
        ("<p>a <math><mi>b</mi></math> <b>c</b>d", "a b cd"),
    ],
)
def test_html_blocks_left_open_and_names(page, text):
    assert html_extraction.main_text(page) == text


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x" + "</div>" * 50_000, "<i><p>" + "<b>" * 50_000 + "</i>" * 50_000 + "x", "<div>" * 20_000 + "<li>x" * 20_000])
def test_html_takes_linear_time(page):
    import time

    began = time.perf_counter()
    assert html_extraction.main_text(page).startswith("x")
    assert time.perf_counter() - began < 30


def test_html_accuracy_on_the_tables():
    """All pages of the smallest tables, whose article is marked: its blocks, from a regular expression of their own."""
    import html
    import re

    import pyarrow.parquet as pq

    for page in pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist():
        body = re.sub(r"</?(?:p|h1|br|li|ul|div)\b[^>]*>", "\n", re.search(r"<article>(.*?)</article>", page, re.S)[1])
        lines = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in body.split("\n")]
        assert html_extraction.main_text(page) == " ".join(x for x in lines if x)


def cosine(line, templates):
    idf, unit = license_scan.template_weights(templates)
    words = license_scan.words_of(line)
    unseen = np.log(1 + len(templates)) + 1
    tf = {w: 1 + np.log(words.count(w)) for w in words}
    norm = np.sqrt(sum((f * idf.get(w, unseen)) ** 2 for w, f in tf.items()))
    return max((round(sum(f * idf.get(w, 0) * v.get(w, 0) for w, f in tf.items()) / norm, 9), k) for k, v in unit.items())


def test_license_scan(spark):
    mit, apache = license_scan.TEMPLATES["MIT"], license_scan.TEMPLATES["Apache-2.0"]
    rows = [
        (1, "a/LICENSE", mit),
        (2, "a/b/x.txt", "plain"),
        (3, "a/b/c/LICENSE", "Licensed under Apache License Version 2.0"),
        (4, "a/b/c/d/y.txt", "plain text"),
        (5, "a/b/c/z.txt", "words " * 50 + "\n" + mit),
        (6, "q/r.txt", None),
        (7, None, "plain"),
        (8, "top.txt", "This has a license of some kind but is about other things altogether and more"),
        (None, "a/x", mit),
        (2, "a/b/x.txt", "plain"),
    ]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "id long, path string, text string, score long, dir long")
    out = {r["id"]: r for r in license_scan.license_scan(df).collect()}
    got = {i: (r["license_id"], r["found_in"], r["from_path"]) for i, r in out.items()}
    assert got == {
        1: ("MIT", "license_file", None),
        2: ("MIT", "inherited", "a/LICENSE"),
        3: ("Apache-2.0", "license_file", None),
        4: ("Apache-2.0", "inherited", "a/b/c/LICENSE"),
        5: ("MIT", "header", None),
        6: (None, None, None),
        7: (None, None, None),
        8: (None, None, None),
        None: (None, None, None),
    }
    assert np.isclose(out[3]["score"], cosine(rows[2][2], license_scan.TEMPLATES)[0]) and cosine(apache, license_scan.TEMPLATES) == (1.0, "Apache-2.0")
    assert license_scan.license_scan(df.limit(0)).count() == 0
    assert license_scan.license_scan(df).count() == len(rows)


def test_license_lines_of_every_kind(spark):
    kinds = {
        "All rights reserved.": "proprietary",
        "Copyright (c) 2020 Example Works Incorporated. All rights reserved.": "proprietary",
        "All rights reserved.\nReleased under the MIT License.": "MIT",
        "# SPDX-License-Identifier: MIT": "MIT",
        "// SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0",
        "SPDX-License-Identifier: CC-BY-SA-4.0": "CC-BY-SA-4.0",
        "This project and all of its documentation are licensed under the MIT License, see below": "MIT",
        "Copyright 2020 Example Works": None,  # names an owner, no terms: the folder's licence holds
        "Every right was reserved for the licensed few": None,
        **{text: name for name, text in license_scan.TEMPLATES.items()},
    }
    df = spark.createDataFrame([(i, f"d{i}/x.txt", text) for i, text in enumerate(kinds)], "id long, path string, text string")
    out = {r["id"]: r["license_id"] for r in license_scan.license_scan(df).collect()}
    assert {text: out[i] for i, text in enumerate(kinds)} == kinds


def test_license_headers_and_full_texts(spark):
    texts = license_scan.standard_texts()
    full = {k: v[-1] for k, v in texts.items() if len(v[-1]) > 700 and k != "AGPL-3.0"}
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0"} <= full.keys()
    code = "\n\nint main() {\n" + "  value = compute(value, other);\n" * 200 + "}\n"
    gpl = license_scan.HEADERS["GPL-3.0"][0]
    wrapped = "\n".join(" * " + " ".join(gpl.split()[i : i + 10]) for i in range(0, len(gpl.split()), 10))
    apache = license_scan.HEADERS["Apache-2.0"][1].replace("You may", "\n#\n#   You may").replace("Unless", "\n#\n# Unless")
    rows = [(f"full/{k}/LICENSE", v.replace("Copyright (c)", "Copyright (c) 2020 Example Works"), (k, "license_file")) for k, v in full.items()]
    rows += [(f"full/{k}/deep/x.c", "int x;", (k, "inherited")) for k in full]
    rows += [
        ("h/a.c", "/*\n * Copyright 2020 Example Works\n *\n" + wrapped + "\n */" + code, ("GPL-3.0", "header")),
        ("h/b.c", "// " + gpl.split(" This program is distributed")[0] + code, ("GPL-3.0", "header")),
        ("h/c.py", "#!/usr/bin/python\n# Copyright 2020 Example Works\n#\n# " + apache + code, ("Apache-2.0", "header")),
        ("h/d.py", "# Licensed under the Apache\n# License, Version 2.0." + code, ("Apache-2.0", "header")),
        ("h/e.c", "/*\n" + texts["MIT"][-1] + "*/" + code, ("MIT", "header")),
        ("h/f.txt", "The committee discussed the license for the hall and the copyright of the songs.\n" * 20, (None, None)),
        ("i/a.txt", "a few words of prose that stand in front of it all here\nand more\nAll rights reserved.", ("proprietary", "header")),
        ("h/g.txt", "words " * 300 + "All rights reserved.", ("proprietary", "header")),
    ]
    df = spark.createDataFrame([(i, path, text) for i, (path, text, _) in enumerate(rows)], "id long, path string, text string")
    out = {r["id"]: (r["license_id"], r["found_in"]) for r in license_scan.license_scan(df).collect()}
    assert {p: out[i] for i, (p, _, _) in enumerate(rows)} == {p: x for p, _, x in rows}
    own = spark.createDataFrame([(1, "a", "Do whatever pleases you with it")], "id long, path string, text string")
    assert license_scan.license_scan(own, {"mine": "Do whatever pleases you"}).first()["license_id"] == "mine"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels, truth = labelled(spark)
    secret = " ".join(f"test{i}" for i in range(12))
    extra = [(400, "w1 w2 w3"), (401, "w1 w2 w3"), (402, "begin " + secret), (401, "w1 w2 w3"), (None, "w9 w8 w7"), (403, None)]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + extra
    near = rows[1][1].split()
    rows.append((404, " ".join(near + ["tail"])))
    table = spark.createDataFrame([(i, t, "en", f"s{k % 3}", 1) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    labels.select("doc_id", (1 - F.col("label")).alias("quality"), F.col("label").alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, secret)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == corpus_pipeline.COLUMNS
        kept.write.parquet(f"{tmp_path}/{len(counts)}")
        kept = spark.read.parquet(f"{tmp_path}/{len(counts)}")
        counts.append({(r["doc_id"], r["text"]) for r in kept.collect()})
        assert kept.count() == len(counts[-1]) or len(counts) == 1
    ids = {i for i, _ in counts[-1]}
    assert 400 not in ids and 402 not in ids and 404 not in ids
    good = [i for i in truth if not truth[i]]
    assert np.mean([i in ids for i in good]) > 0.97 and np.mean([i in ids for i in truth if truth[i]]) < 0.05
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == ids


def test_digest_columns(spark):
    out = substring_dedup.substring_dedup(make(spark, [(1, "a b")])).select(F.sha2("kept_text", 256).alias("h")).first()
    assert out["h"] == hashlib.sha256(b"a b").hexdigest()
