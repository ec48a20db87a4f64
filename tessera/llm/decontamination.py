"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against every training window.

The set is a sorted array of window hashes with each window's place in the benchmark's normalised text, so a hit is
verified word by word. A benchmark whose set would exceed the bound for a broadcast is scanned in portions, the spans found so
far being written to the shared folder between them: no plan and no worker ever holds more than one portion.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, portions, tidy
from .textgrams import LOWER, NON_WORD, covered, intervals, window_hashes, word_hashes

NGRAM = 10
#: Bytes of a broadcast index, of which every Python worker holds a copy; a larger benchmark is scanned in several passes.
BROADCAST_BYTES = 64 << 20
_FOLD = bytes(0x20 if NON_WORD[i] else int(LOWER[i]) for i in range(256))


def normal_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and all non-ASCII bytes."""
    return text.translate(_FOLD).split()


@dataclass(frozen=True)
class Index:
    """Windows of some items: by window length, sorted hashes and the place in ``text`` and item of each."""

    text: bytes
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @property
    def size(self) -> int:
        return len(self.text) + sum(x.nbytes for arrays in self.windows.values() for x in arrays)


def index_of(items: list[tuple[int, bytes]], ngram: int) -> Index:
    """Items by window length: those of fewer words than ``ngram`` are one window as a whole."""
    by_size: dict[int, list[tuple[int, bytes]]] = {}
    for item, text in sorted(set(items)):
        words = normal_words(text)
        if words:
            by_size.setdefault(min(ngram, len(words)), []).append((item, b" ".join(words)))
    text, windows = [], {}
    base = 0
    for size, group in sorted(by_size.items()):
        h, offsets = word_hashes([t for _, t in group], NON_WORD, LOWER, None)
        w, first, of = window_hashes(h, offsets, size)
        joined = b" ".join(t for _, t in group)
        ends = np.flatnonzero(np.frombuffer(joined + b" ", np.uint8) == 0x20)
        begins = np.concatenate([[0], ends[:-1] + 1])
        order = np.argsort(w, kind="stable")
        items_of = np.array([i for i, _ in group], np.int64)[of]
        windows[size] = (w[order], (base + begins[first])[order], (base + ends[first + size - 1])[order], items_of[order])
        text.append(joined)
        base += len(joined) + 1
    return Index(b" ".join(text), windows)


def scan(texts: list[bytes], index: Index) -> list[tuple[np.ndarray, set[int], int]]:
    """For each text: which words are hit, the items found, the number of words."""
    h, at = word_hashes(texts, NON_WORD, LOWER, None)
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    for size, (hashes, *_) in index.windows.items():
        w, first, text = window_hashes(h, at, size)
        low = np.searchsorted(hashes, w)
        for k in np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == w):
            high = int(np.searchsorted(hashes, w[k], side="right"))
            found.setdefault(int(text[k]), []).append((int(first[k] - at[text[k]]), size, int(low[k]), high))
    out = []
    for i, t in enumerate(texts):
        n, items = int(at[i + 1] - at[i]), set()
        starts, sizes = [], []
        if i in found:
            words = normal_words(t)
            for s, size, low, high in found[i]:  # hashes only propose
                _, begins, ends, of = index.windows[size]
                own = b" ".join(words[s : s + size])
                if same := [k for k in range(low, high) if index.text[begins[k] : ends[k]] == own]:
                    items.update(of[same].tolist())
                    starts.append(s)
                    sizes.append(size)
        hit = covered(np.array(starts, np.int64), np.array(sizes, np.int64), n) if starts else np.zeros(n, bool)
        out.append((hit, items, n))
    return out


_SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def _portions(benchmark: DataFrame, item_col: str, text_col: str, ngram: int, limit: int) -> Iterator[Index]:
    """Indexes of at most about ``limit`` bytes. A longer item is cut into parts that share all but one word of a window, as it alone may exceed it."""
    portion, size = [], 0
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null")
    for row in items.toLocalIterator():
        words = normal_words(row["t"].encode())
        step = max(1, limit // 48)
        for begin in range(0, max(1, len(words) - ngram + 1), step):
            part = words[begin : begin + step + ngram - 1]
            cost = 32 * len(part) + sum(map(len, part)) + len(part)  # of a window: hash, place, item; of a word: its bytes
            if portion and size + cost > limit:
                yield index_of(portion, ngram)
                portion, size = [], 0
            portion.append((row["i"], b" ".join(part)))
            size += cost
    yield index_of(portion, ngram)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    ngram: int = NGRAM,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id, text``, the ``carry`` columns and ``n_words, spans, items`` for each row.

    ``spans`` are the hit word intervals, ``items`` those whose windows occur.

    Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. A window is ``ngram`` consecutive
    words of an item, or the whole of a shorter item. Null texts have no words. Items without id or text are ignored;
    repeated items count once; repeated documents each get their row; columns not carried are ignored.

    Only an index of the benchmark is broadcast, about ``broadcast_bytes`` of it at a time; every further portion is one
    more pass over what the last one wrote, which adds to the spans found so far.
    """
    spark = docs.sparkSession
    out = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        *carry,
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<begin:int,end:int>>").alias("spans"),
        F.array().cast("array<long>").alias("items"),
    )
    schema = out.schema
    shared = None
    for index in _portions(benchmark, item_col, item_text_col, ngram, broadcast_bytes):
        if shared is not None:
            out = materialize(out, "spans")
            shared.unpersist()
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin, end in portions(batch.column("text")):
                    part = batch.slice(begin, end - begin)
                    texts = [(t or "").encode() for t in part.column("text").to_pylist()]
                    had = zip(part.column("spans").to_pylist(), part.column("items").to_pylist())
                    counts, spans, items = [], [], []
                    for (hit, more, n), (old, of) in zip(scan(texts, shared.value), had):
                        for s in old or []:
                            hit[s["begin"] : s["end"]] = True
                        begins, ends = intervals(hit)
                        counts.append(n)
                        spans.append([{"begin": int(b), "end": int(e)} for b, e in zip(begins, ends)])
                        items.append(sorted(more | set(of or [])))
                    columns = [*part.columns[:-3], pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)
            tidy(None)

        out = out.mapInArrow(run, schema)
    return out


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["begin"]).cast("long"))
    items = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bg AS (
  SELECT DISTINCT item_id, k, array_to_string(ws[i : i + k - 1], ' ') AS g
  FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i
        FROM (SELECT item_id, ws, least(10, len(ws)) AS k FROM b WHERE len(ws) > 0))),
ks AS (SELECT DISTINCT k FROM bg),
dg AS (
  SELECT doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, ks WHERE len(ws) >= k)),
hits AS (SELECT dg.doc_id, dg.i, dg.k, bg.item_id FROM dg JOIN bg USING (k, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""
