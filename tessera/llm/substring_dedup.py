"""Substring dedup: every window of N words is hashed (Rabin-Karp), counted across documents, and repeats are cut.

1. Documents are dealt to blocks of some MB by a hash of their id. A block numbers its words exactly and compares equal
   hashes by these numbers, so that inside a block only equal windows are one. It sends 32 bits of each distinct
   window's hash to the bucket that the other bits pick, and the bucket answers with one bit: seen elsewhere or not.
   A passage held by a third of all documents costs one entry a block, not one a document.
2. Only of windows seen elsewhere the block sends the identity and the smallest doc_id that has them here. The identity
   is 128 bits, two Rabin-Karp hashes over independent hashes of the words; chance mix-ups are out of the question at any
   size (below 1e-12 expected at 100 TB). The bucket answers whether a smaller document elsewhere has the window.
3. The block joins its documents with the answers, merges the repeated windows into maximal intervals and cuts them.

Shuffles carry about four bytes a window, and 17 to 28 more for the repeated ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import grid, in_blocks, text_stats, tidy
from .textgrams import SECOND_BASE, WordTable, covered, window_hashes

WINDOW = 13
_NO_ID = np.iinfo(np.int64).max
_SEEN = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("short", pa.binary())])
_ENTRY = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("first", pa.binary()), ("second", pa.binary()), ("ids", pa.binary()), ("runs", pa.binary()), ("of", pa.binary()), ("n", pa.int32())])
_ANSWER = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("bits", pa.binary())])
_SPAN = pa.struct([("begin", pa.int32()), ("end", pa.int32())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(_SPAN)), ("kept_text", pa.string())])


def _sql(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'int' if f.type == pa.int32() else 'binary'}" for f in schema)


class _Block:
    """The windows of a block's documents, in order of doc_id (those without one last)."""

    def __init__(self, table: pa.Table, window: int, n_buckets: int):
        ids = pc.fill_null(table.column("doc_id"), _NO_ID).to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.words = words = WordTable(table.column("text").take(pa.array(order)).combine_chunks())
        self.hashes, first, text = window_hashes(words.hashes(0)[words.number], words.offsets, window)
        self.first, self.text = first.astype(np.int32), text.astype(np.int32)
        self.window = window
        by_hash = np.argsort(self.hashes, kind="stable").astype(np.int32)
        new = np.ones(len(by_hash), bool)
        new[1:] = self.hashes[by_hash[1:]] != self.hashes[by_hash[:-1]]
        lead = by_hash[new]  # stable: the first of a hash is of the smallest id
        self.leader = np.empty(len(by_hash), np.int32)
        self.leader[by_hash] = lead[np.cumsum(new) - 1] if len(by_hash) else 0
        lead = np.append(lead, self._tell_apart())
        lead = np.sort(lead[self.ids[self.text[lead]] != _NO_ID])
        bucket = self.bucket_of(self.hashes[lead], n_buckets)
        self.entries = lead[np.argsort(bucket, kind="stable")]
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=n_buckets))])

    def _tell_apart(self) -> np.ndarray:
        """Gives windows whose words differ from those of their hash's leader leaders of their own; returns these."""
        number, other = self.words.number, np.flatnonzero(self.leader != np.arange(len(self.leader)))
        bad = np.zeros(len(other), bool)
        for k in range(self.window):
            bad |= number[self.first[other] + k] != number[self.first[self.leader[other]] + k]
        found: dict[bytes, int] = {}
        for i in other[bad].tolist():
            self.leader[i] = found.setdefault(number[self.first[i] : self.first[i] + self.window].tobytes(), i)
        return np.array(sorted(found.values()), np.int32)

    def second(self, at: np.ndarray) -> np.ndarray:
        """The other half of the identity of some windows."""
        of, h = self.words.hashes(1), np.zeros(len(at), np.uint64)
        for k in range(self.window):
            h *= SECOND_BASE
            h += of[self.words.number[self.first[at] + k]]
        return h

    @staticmethod
    def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _send(window: int, n_buckets: int):
    def send(key: tuple, table: pa.Table) -> pa.Table:
        b = _Block(table, window, n_buckets)
        short = b.hashes[b.entries].astype(np.uint32)
        to = np.flatnonzero(np.diff(b.bounds))
        packed = [short[b.bounds[k] : b.bounds[k + 1]].tobytes() for k in to]
        out = pa.Table.from_arrays([pa.array(to, pa.int32()), pa.array([key[0].as_py()] * len(to), pa.int64()), pa.array(packed, pa.binary())], schema=_SEEN)
        del b
        return tidy(out)

    return send


def _blobs(table: pa.Table, column: str, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in table.column(column).to_pylist()]


def _seen(table: pa.Table) -> pa.Table:
    """Which entries have company: a chance agreement of the 32 bits only makes the next round look at a window in vain."""
    parts = _blobs(table, "short", np.uint32)
    h = np.concatenate(parts)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    bits = [np.packbits(x).tobytes() for x in np.split(again, np.cumsum([len(x) for x in parts])[:-1])]
    return tidy(pa.Table.from_arrays([table.column("block"), table.column("bucket"), pa.array(bits, pa.binary())], schema=_ANSWER))


def _flags(b: _Block, answers: pa.Table) -> np.ndarray:
    out = np.zeros(len(b.entries), bool)
    for k, bits in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist()):
        n = b.bounds[k + 1] - b.bounds[k]
        out[b.bounds[k] : b.bounds[k + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
    return out


def _identify(window: int, n_buckets: int):
    def identify(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.name: [] for f in _ENTRY}
        if docs.num_rows and answers.num_rows:
            b = _Block(docs, window, n_buckets)
            again = _flags(b, answers)
            at = b.entries[again]
            second, first, ids = b.second(at), b.hashes[at], b.ids[b.text[at]]
            bounds = np.concatenate([[0], np.cumsum(again)])[b.bounds]
            for k in np.flatnonzero(np.diff(bounds)).tolist():
                part = slice(bounds[k], bounds[k + 1])
                own = ids[part]
                starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                row = (k, key[0].as_py(), first[part].tobytes(), second[part].tobytes(), own[starts].tobytes(), np.diff(np.append(starts, len(own))).astype(np.int32).tobytes())
                row += (np.packbits(again[b.bounds[k] : b.bounds[k + 1]]).tobytes(), int(b.bounds[k + 1] - b.bounds[k]))
                for name, x in zip(out, row):
                    out[name].append(x)
            del b
        return tidy(pa.Table.from_pydict(out, schema=_ENTRY))

    return identify


def _answer(table: pa.Table) -> pa.Table:
    """For each entry of the first round, whether a smaller document elsewhere has the same window."""
    parts = _blobs(table, "first", np.uint64)
    first, second = np.concatenate(parts), np.concatenate(_blobs(table, "second", np.uint64))
    d = np.concatenate([np.repeat(i, r) for i, r in zip(_blobs(table, "ids", np.int64), _blobs(table, "runs", np.int32))])
    order = np.lexsort((second, first))
    f, s = first[order], second[order]
    new = np.flatnonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (s[1:] != s[:-1])]))
    least = np.minimum.reduceat(d[order], new)
    smaller = np.empty(len(d), bool)
    smaller[order] = np.repeat(least, np.diff(np.append(new, len(d)))) < d[order]
    bits = []
    for mine, of, n in zip(np.split(smaller, np.cumsum([len(x) for x in parts])[:-1]), table.column("of").to_pylist(), table.column("n").to_pylist()):
        whole = np.unpackbits(np.frombuffer(of, np.uint8), count=n).astype(bool)
        whole[whole] = mine
        bits.append(np.packbits(whole).tobytes())
    return tidy(pa.Table.from_arrays([table.column("block"), table.column("bucket"), pa.array(bits, pa.binary())], schema=_ANSWER))


def _cut(window: int, n_buckets: int):
    def cut(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.Table.from_pylist([], schema=_RESULT)
        b = _Block(docs, window, n_buckets)
        elsewhere = np.zeros(len(b.hashes), bool)
        elsewhere[b.entries] = _flags(b, answers)
        # of a window, the leader's bit holds for all; within the block, ids above the leader's have a smaller one
        own = b.ids[b.text]
        gone = (elsewhere[b.leader] | (own > own[b.leader])) & (own != _NO_ID)
        at, words = b.words.offsets, b.words
        mask = covered(b.first[gone], window, int(at[-1]))
        kept_before = np.concatenate([[0], np.cumsum(~mask)])
        kept = words.distinct.take(pa.array(words.number[~mask]))
        texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(kept_before[at]), kept), pa.scalar(" ", pa.large_string())).cast(pa.string())
        # maximal runs of removed words, none beyond its document
        inside = np.concatenate([[False], mask, [False]])
        starts_text, n_words = np.zeros(len(mask) + 1, bool), np.diff(at)
        starts_text[at] = True
        begins = np.flatnonzero(mask & (~inside[:-2] | starts_text[:-1]))
        ends = np.flatnonzero(mask & (~inside[2:] | starts_text[1:])) + 1
        text_of = np.searchsorted(at, begins, side="right") - 1
        spans = pa.StructArray.from_arrays([pa.array((x - at[text_of]).astype(np.int32)) for x in (begins, ends)], fields=list(_SPAN))
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(text_of, np.arange(len(n_words) + 1)).astype(np.int32)), spans)
        ids = pa.array(b.ids, mask=b.ids == _NO_ID)
        removed = n_words - np.diff(kept_before[at])
        return tidy(pa.Table.from_arrays([ids, pa.array(n_words), pa.array(removed), spans, texts], schema=_RESULT))

    return cut


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, parts: tuple[int, int] | None = None) -> DataFrame:
    """``doc_id, n_words, n_removed, spans, kept_text`` for each row of ``docs``.

    Words are runs of anything but space and tab to carriage return, unchanged. A word goes if some window of
    ``window`` words covers it whose words also start in a document with a smaller id, judged on the input.
    ``spans`` are the maximal removed intervals in word positions; the kept words are joined by one space.

    Null texts have no words. Rows that repeat an id don't cut each other. Rows without id are never cut and cut
    nothing. Texts of fewer than ``window`` words stay whole. Other columns are ignored. ``parts`` are the numbers of
    blocks and buckets; without, they follow from the bytes of text.
    """
    n_blocks, n_buckets = parts or grid(text_stats(docs, text_col)[1])
    blocks = in_blocks(docs, id_col, text_col, n_blocks)
    seen = blocks.groupBy("block").applyInArrow(_send(window, n_buckets), _sql(_SEEN)).groupBy("bucket").applyInArrow(_seen, _sql(_ANSWER))
    entries = blocks.groupBy("block").cogroup(seen.groupBy("block")).applyInArrow(_identify(window, n_buckets), _sql(_ENTRY))
    answers = entries.groupBy("bucket").applyInArrow(_answer, _sql(_ANSWER))
    result = "doc_id long, n_words long, n_removed long, spans array<struct<begin:int,end:int>>, kept_text string"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_cut(window, n_buckets), result)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS t
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
bad AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) AS m FROM g) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM bad),
p AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (SELECT p.doc_id, string_agg(x, ' ' ORDER BY p.p) AS t, count(*) AS n FROM p ANTI JOIN gone ON p.doc_id = gone.doc_id AND p.p = gone.p GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
