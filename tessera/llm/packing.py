"""Mixture-controlled packing: deficit round-robin over source queues, carried across windows and partitions.

1. Documents are dealt to lanes of some MB by a hash of their id; each lane's texts are tokenized once and the ids
   written, with the tokens that each source has in the lane, to the shared folder.
2. A lane drains its queues completely, so what every source has been given before lane k, and with it every
   source's deficit at the start of lane k, follows from the counts of the lanes before: a prefix sum over a small
   table, no sequential run. The same sum gives the stream position where the lane begins.
3. A round of deficit round-robin is one window: every source is credited its target share of the window and served what
   its deficit allows. What a window lacks (fractions, queues that are dry) the others fill by their shares, and what a
   source was served too little or too much it carries on. Sequences are cuts of the one stream at every multiple of
   their length, so only the last sequence of all is padded.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import grid, materialize, portions, text_stats, tidy

SEQUENCE = 2048
END_ID = 1
#: Blocks of text (see ``common.grid``) to a lane.
LANE_BLOCKS = 2
#: Texts of these characters only are cut into pre-tokens here; lower-casing and classing them is the same everywhere.
_PLAIN = re.compile("[\t-\r -~¡-©«-¬®-±´¶-¸»¿À-ÖØ-öø-į]*")
_SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[[*range(0x61, 0x7B), 0xC3, 0xC4]] = _LETTER  # after lower-casing; C3 and C4 lead all letters beyond ASCII here
_CLASS[0x30:0x3A] = _DIGIT
#: What the tokenizer's pattern splits off after an apostrophe.
_AFTER_APOSTROPHE = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
#: The normalizer and the pre-tokenizer that ``pretokens`` restates.
_NORMALIZER = ["NFC", ("Replace", r"\s+", " "), "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pre-tokens remembered by one Python worker.
CACHE = 300_000


def pretokens(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the pre-tokens of plain lower-case text: runs of letters, single digits, runs of other marks.

    An apostrophe alone takes s, t, re, ve, m, ll or d from the letters behind it.
    """
    kind = _CLASS[buf]
    tail = np.flatnonzero((buf >= 0x80) & (buf < 0xC0))
    kind[tail] = kind[tail - 1]
    before, after = np.concatenate([[_SPACE], kind[:-1]]), np.concatenate([kind[1:], [_SPACE]])
    begin = (kind != _SPACE) & ((kind != before) | (kind == _DIGIT))
    at = np.flatnonzero((buf == 0x27) & (before != _OTHER) & (after == _LETTER))
    if len(at):
        begin = np.append(begin, False)
        padded = np.append(buf, [0, 0, 0]).astype(np.uint8)
        free = np.ones(len(at), bool)
        for x in _AFTER_APOSTROPHE:
            hit = free & np.logical_and.reduce([padded[at + 1 + k] == c for k, c in enumerate(x)])
            free &= ~hit
            begin[at[hit] + 1] = False
            rest = at[hit] + 1 + len(x)
            rest = rest[rest < len(buf)]
            begin[rest[kind[rest] == _LETTER]] = True
        begin = begin[:-1]
    begins = np.flatnonzero(begin)
    stop = np.append(begin | (kind == _SPACE), True)
    stops = np.flatnonzero(stop)
    return begins, stops[np.searchsorted(stops, begins, side="right")]


def cuts_as_here(definition: dict) -> bool:
    """Whether a ``tokenizers`` file normalizes and cuts plain text as ``pretokens`` does, and nothing else changes its ids."""
    normalizer, pre, model = (definition.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    steps = [(n["type"], n["pattern"].get("Regex"), n["content"]) if n.get("type") == "Replace" else n.get("type") for n in normalizer.get("normalizers") or []]
    cuts = pre.get("pretokenizers") or []
    return (
        steps == _NORMALIZER
        and len(cuts) == 2
        and cuts[0] == {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}
        and cuts[1].get("type") == "ByteLevel"
        and not (cuts[1].get("add_prefix_space") or cuts[1].get("use_regex"))
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and not (definition.get("truncation") or definition.get("padding"))
        and all(t["content"].startswith("<|") for t in definition.get("added_tokens") or [])
    )


class WordTokenizer:
    """Encodes whole texts with a ``tokenizers`` file.

    If the file cuts plain Latin text as ``pretokens`` does, pre-tokens are remembered between texts: such a tokenizer
    never joins anything across them, so a text's ids are those of its pre-tokens in a row. Other texts, those with what
    may be a special token, and all texts under other files go to the tokenizer as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            definition = json.load(f)
        self.fast = cuts_as_here(definition)
        ends = [i for w, i in definition["model"]["vocab"].items() if w.endswith("</w>")] if self.fast else []
        self.ends = np.zeros(max(definition["model"]["vocab"].values(), default=0) + 1 if self.fast else 1, bool)
        self.ends[ends] = True
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.sizes, self.starts, self.flat = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.seen = np.zeros(0, np.int32)

    def _forget(self, room: int) -> None:
        """Makes room: pre-tokens met in one portion only since the last time go first, then all."""
        keep = np.flatnonzero(self.seen > 1)
        if len(keep) + room > CACHE * 3 // 4:
            return self._clear()
        names = list(self.number)
        sizes = self.sizes[keep]
        stops = np.cumsum(sizes)
        self.flat = self.flat[np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(self.starts[keep] - (stops - sizes), sizes)]
        self.number, self.sizes, self.starts = {names[i]: k for k, i in enumerate(keep.tolist())}, sizes, (stops - sizes).astype(np.int64)
        self.seen = np.ones(len(keep), np.int32)

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> None:
        sizes, flat = [], []
        for k in range(0, len(pieces), 1000):
            part = pieces[k : k + 1000]
            ids = np.array(self._plain([b" ".join(part).decode()])[0], np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part) and stops[-1] == len(ids):
                sizes.append(np.diff(np.concatenate([[0], stops])))
            else:  # ids without word ends
                each = self._plain([p.decode() for p in part])
                sizes.append(np.array([len(x) for x in each]))
                ids = np.array([i for x in each for i in x], np.uint32)
            flat.append(ids)
        for p in pieces:
            self.number[p] = len(self.number)
        new = np.concatenate(sizes).astype(np.int32)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(new) - new])
        self.sizes, self.flat = np.concatenate([self.sizes, new]), np.concatenate([self.flat, *flat])
        self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int32)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [i for i, t in enumerate(texts) if _PLAIN.fullmatch(t) and "<|" not in t] if self.fast else []
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        odd = sorted(set(range(len(texts))).difference(plain))
        for i, ids in zip(odd, self._plain([texts[i] for i in odd])):
            out[i] = np.array(ids, np.uint32)
        parts = [texts[i].lower().encode() for i in plain]
        buf = np.frombuffer(b" ".join(parts), np.uint8)
        begins, ends = pretokens(buf) if len(buf) else (np.zeros(0, np.int64),) * 2
        if not len(begins):
            return out
        # pre-tokens hold all bytes but white space, so without it they stand one behind the other
        body = buf[_CLASS[buf] != _SPACE]
        stops = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int32)
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(stops), pa.py_buffer(body)]).dictionary_encode()
        _, at, data = coded.dictionary.buffers()
        data, at = data.to_pybytes(), np.frombuffer(at, np.int32).tolist()
        distinct = [data[a:b] for a, b in zip(at, at[1:])]
        new = [p for p in distinct if p not in self.number]
        if len(self.number) + len(new) > CACHE:
            self._forget(len(distinct))
            new = [p for p in distinct if p not in self.number]
        if new:
            self._learn(new)
        table = np.fromiter(map(self.number.__getitem__, distinct), np.int32, len(distinct))
        self.seen[table] += 1
        number = table[coded.indices.to_numpy()]
        n = self.sizes[number]
        stops = np.cumsum(n)
        ids = self.flat[np.arange(int(stops[-1])) + np.repeat(self.starts[number] - (stops - n), n)]
        limits = np.cumsum([len(p) + 1 for p in parts])[:-1]
        cuts = np.concatenate([[0], stops])[np.searchsorted(begins, limits)]
        for i, x in zip(plain, np.split(ids, cuts)):
            out[i] = x
        return out


def tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """``block, doc_id, source, n, ids`` from ``block, doc_id, source, text``; ids are little-endian 32-bit numbers, or 16-bit where all fit."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = WordTokenizer(path)  # for this task only: an idle worker shall not hold it
        for batch in batches:
            for begin, end in portions(batch.column("text"), 1024, 2 << 20):
                part = batch.slice(begin, end - begin)
                rows = [np.append(x, np.uint32(end_id)).astype("<u4") for x in tok.encode([t or "" for t in part.column("text").to_pylist()])]
                narrow = [r.astype("<u2").tobytes() if r.max() < 65536 else r.tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [part.column("block"), part.column("doc_id"), part.column("source"), pa.array([len(r) for r in rows], pa.int64()), pa.array(narrow, pa.binary())],
                    names=["block", "doc_id", "source", "n", "ids"],
                )
        del tok
        tidy(None)

    return docs.select("block", "doc_id", "source", "text").mapInArrow(encode, "block long, doc_id long, source string, n long, ids binary")


_PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("source", pa.string())])


def allot(share: np.ndarray, deficit: np.ndarray, left: np.ndarray, room: int) -> np.ndarray:
    """Tokens of each source in a window with ``room`` left, none beyond what its queue has ``left``.

    ``deficit`` already holds the window's credits. Sources get the whole tokens of their deficits, in proportion if these
    exceed the room. Room that is left goes to queues with tokens by their shares, the last tokens to the largest deficits.
    """
    want = np.minimum(np.maximum(np.floor(deficit), 0), left).astype(np.int64)
    if (total := int(want.sum())) > room:
        want = want * room // total
    rest = min(room, int(left.sum())) - int(want.sum())
    while rest:
        spare = left - want
        weight = np.where(spare > 0, np.maximum(share, 1e-12), 0.0)
        more = np.minimum(np.floor(rest * weight / weight.sum()).astype(np.int64), spare)
        if not more.any():
            order = np.lexsort((np.arange(len(want)), want - deficit))  # the largest deficit first, ties by name
            more[order[spare[order] > 0][:rest]] = 1
        want += more
        rest -= int(more.sum())
    return want


def _round_robin(sequence: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def serve(docs: pa.Table, state: pa.Table) -> pa.Table:
        if docs.num_rows == 0:
            return pa.Table.from_pylist([], schema=_PIECES)
        docs = docs.sort_by([("source", "ascending"), ("doc_id", "ascending"), ("n", "ascending"), ("ids", "ascending")])
        n = docs.column("n").to_numpy()
        names, source = np.unique(np.array(docs.column("source").to_pylist(), object), return_inverse=True)
        st = {r["source"]: r for r in state.to_pylist()}
        share = np.array([st[s]["share"] for s in names], float)
        deficit = np.array([st[s]["deficit"] for s in names], float)
        begin = position = int(state.column("position")[0].as_py())
        left = np.bincount(source, weights=n).astype(np.int64)
        end = begin + int(left.sum())
        turns = []
        while position < end:
            room = min(sequence - position % sequence, end - position)
            deficit += share * room
            turns.append(allot(share, deficit, left, room))
            deficit -= turns[-1]
            left -= turns[-1]
            position += room
        given = np.stack(turns)  # windows x sources
        first = begin // sequence
        # where each source's part of each window lies in the stream
        base = np.maximum((first + np.arange(len(given))) * sequence, begin)[:, None] + np.cumsum(given, axis=1) - given
        bounds = np.searchsorted(source, np.arange(len(names) + 1))
        parts = []
        for k in range(len(names)):
            ends, stops = np.cumsum(n[bounds[k] : bounds[k + 1]]), np.cumsum(given[:, k])
            cuts = np.union1d(ends, stops)
            cuts = cuts[cuts > 0]
            start = np.concatenate([[0], cuts[:-1]])
            doc, window = np.searchsorted(ends, start, side="right"), np.searchsorted(stops, start, side="right")
            of_doc = start - (ends[doc] - n[bounds[k] + doc])
            at = base[window, k] + start - (stops[window] - given[window, k])
            parts.append((bounds[k] + doc, of_doc, cuts - start, at))
        doc, start, length, at = (np.concatenate(x) for x in zip(*parts))
        blobs = docs.column("ids").combine_chunks()
        crc, last, ids = np.zeros(len(doc), np.int64), -1, b""
        for i, (d, a, b) in enumerate(zip(doc.tolist(), start.tolist(), (start + length).tolist())):
            if d != last:
                raw = blobs[d].as_buffer()
                ids = memoryview(np.frombuffer(raw, "<u2" if len(raw) == 2 * n[d] else "<u4").astype("<u4").tobytes())
                last = d
            crc[i] = zlib.crc32(ids[4 * a : 4 * b])
        columns = [docs.column("doc_id").take(pa.array(doc)), start, length, crc, n[doc], at // sequence, at % sequence, docs.column("source").take(pa.array(doc))]
        return tidy(pa.Table.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=_PIECES))

    return serve


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    targets: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    sequence: int = SEQUENCE,
    end_id: int = END_ID,
    lane_bytes: int | None = None,
) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source``.

    A document's ids are those of its whole text, then ``end_id``; every id lies in exactly one piece. Sequences hold
    ``sequence`` tokens and are gapless; only the last may be shorter. ``targets`` are the wanted proportions of
    tokens by source (others share what is left over by their size); without, the corpus' own. Every full window holds
    them to a token or so while all queues of its lane have tokens; a source that runs dry before the others leaves its
    share to them, as every document must be packed, and so each lane's last windows make up for its own mixture.

    A null text is empty (its end id alone), a null source a source of its own, a null id is carried on. Rows that
    repeat an id are packed each. An empty table gives no rows. Other columns are ignored.
    """
    _, size = text_stats(docs, text_col)
    n_lanes = max(1, -(-size // lane_bytes) if lane_bytes else grid(size)[0] // LANE_BLOCKS)
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")
    lanes = _laned(docs, id_col, text_col, source, n_lanes)
    ids = materialize(tokenize(lanes, tokenizer_path, end_id), "tokens")

    counts = materialize(ids.groupBy("block", "source").agg(F.sum("n").alias("tokens")), "lane-counts")
    totals = counts.groupBy("source").agg(F.sum("tokens").alias("total"))
    if targets:
        wanted = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])
        named = F.coalesce(F.try_element_at(wanted, F.col("source")).cast("double"), F.lit(0.0))
        rest = max(0.0, 1.0 - sum(targets.values()))
        other = F.when(F.col("named") == 0, F.col("total")).otherwise(0)
        shares = totals.withColumn("named", named)
        sums = shares.agg(F.sum("named").alias("sn"), F.sum(other).alias("so"))
        weight = F.col("named") + F.when(F.col("so") > 0, F.lit(rest) * other / F.col("so")).otherwise(0.0)
        shares = shares.crossJoin(F.broadcast(sums)).select("source", weight.alias("weight"))  # sums is one row
        norm = shares.agg(F.sum("weight").alias("w"))
    else:
        shares = totals.select("source", F.col("total").cast("double").alias("weight"))
        norm = shares.agg(F.sum("weight").alias("w"))
    shares = shares.crossJoin(F.broadcast(norm)).select("source", (F.col("weight") / F.greatest("w", F.lit(1e-300))).alias("share"))

    # where each lane begins in the stream: one row a lane
    per_lane = counts.groupBy("block").agg(F.sum("tokens").alias("lane_tokens"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = per_lane.withColumn("position", F.coalesce(F.sum("lane_tokens").over(before), F.lit(0)))
    own = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    served = counts.withColumn("given", F.coalesce(F.sum("tokens").over(own), F.lit(0)))
    state = (
        served.join(begins.select("block", "position"), "block")
        .join(shares, "source")
        .select("block", "source", "position", "share", (F.col("share") * F.col("position") - F.col("given")).alias("deficit"))
    )
    return ids.groupBy("block").cogroup(state.groupBy("block")).applyInArrow(
        _round_robin(sequence),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string",
    )


def _laned(docs: DataFrame, id_col: str, text_col: str, source, n_lanes: int) -> DataFrame:
    key = F.xxhash64(F.coalesce(F.xxhash64(F.col(id_col).cast("long")), F.xxhash64(F.col(text_col))))
    return docs.select(
        F.pmod(key, F.lit(n_lanes)).alias("block"),
        F.col(id_col).cast("long").alias("doc_id"),
        source,
        F.col(text_col).cast("string").alias("text"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
