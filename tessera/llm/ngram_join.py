"""Set-similarity join of word shingles: token-combination prefixes, then verification, then components.

1. Census. Documents are dealt to blocks by a hash of their id; each block sends its distinct shingle hashes once, with
   the number of its documents that have them, to hash buckets, which answer with a frequency class (a few bits of
   log2 of the document frequency). All shingles of all documents are so put in one order, rare before frequent.
2. A set of n shingles that links with another shares at least ceil(0.8 n) of its own with it. So one with fewer shingles
   that occur in any other document links with none and leaves here; for the rest, those that occur nowhere else fill
   the first places of the prefix and never need an index entry. Equal sets go on as one representative.
3. Index. Two linked sets share at least k of their first n - ceil(0.8 n) + k shingles. Of a short set (where shared
   lines crowd the prefix) the frequent ones are indexed as combinations of k = 2, and the rare ones singly; of longer
   sets all are, with lengths that fall between indexed both ways. Keys with the same members are merged.
4. Verification. Each set is first compared within the largest of its keys only, in chunks of bounded size, by
   breadth-first search over the links, so that members already connected are not compared again; chunks of one key
   share some hubs, which connects them. Then every key whose members aren't all in one component is looked at again:
   its members outside the largest component are held against all its chunks. So every pair that shares a key is
   either compared or already connected, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_join, grid, in_blocks, materialize, text_stats
from .components import connected_components
from .textgrams import LOWER, SPACES, mix, window_hashes, word_hashes

SHINGLE = 5
#: Linked are sets with 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Sets up to SHORT shingles are indexed by combinations of frequent shingles; up to SHORT * 100 / PERCENT, both ways.
SHORT = 40
#: Frequency class (4 * log2 of the document frequency) from which a shingle is frequent.
FREQUENT = 16
#: Members of a key that are compared at once, and hubs that chunks of a larger key share.
CHUNK, HUBS = 256, 8

_U = np.uint64


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their text, in order of hash and text; a shorter text is one shingle."""
    words, offsets = word_hashes(texts, SPACES, LOWER)
    h, _, text = window_hashes(words, offsets, size)
    counts = np.diff(offsets)
    for k in range(1, size):
        if len(at := np.flatnonzero(counts == k)):
            part = words[(offsets[at][:, None] + np.arange(k)).ravel()]
            more, _, _ = window_hashes(part, np.arange(len(at) + 1) * k, k)
            h, text = np.concatenate([h, more]), np.concatenate([text, at])
    order = np.lexsort((text, h))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], text[new]


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)


def _short(h: np.ndarray) -> np.ndarray:
    """Enough bits to tell the hashes of a bucket apart, nearly; a mix-up only makes a shingle seem more frequent."""
    return h.astype(np.uint32)


def _runs(h: np.ndarray) -> np.ndarray:
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    return np.flatnonzero(new)


_SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
_CLASSES = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("classes", pa.binary())])
_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("tokens", pa.binary()), ("classes", pa.binary())])


def _send(size: int, n_buckets: int):
    def send(key: tuple, table: pa.Table) -> pa.Table:
        h, _ = shingle_sets([(t or "").encode() for t in table.column("text").to_pylist()], size)
        starts = _runs(h)
        counts = np.minimum(np.diff(np.append(starts, len(h))), 255).astype(np.uint8)
        h = h[starts]
        cuts = np.searchsorted(_bucket(h, n_buckets), np.arange(n_buckets + 1))
        out: dict[str, list] = {f.name: [] for f in _SENT}
        for k in range(n_buckets):
            a, b = cuts[k], cuts[k + 1]
            if b > a:
                out["bucket"].append(k)
                out["block"].append(key[0].as_py())
                out["hashes"].append(_short(h[a:b]).tobytes())
                out["counts"].append(counts[a:b].tobytes())
        return pa.Table.from_pydict(out, schema=_SENT)

    return send


def _classify(table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x, np.uint32) for x in table.column("hashes").to_pylist()]
    h = np.concatenate(parts)
    c = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("counts").to_pylist()]).astype(np.int64)
    order = np.argsort(h)
    starts = _runs(h[order])
    total = np.add.reduceat(c[order], starts)
    level = np.minimum(np.floor(4 * np.log2(total)), 255).astype(np.uint8)  # 0: in one document
    each = np.empty(len(h), np.uint8)
    each[order] = np.repeat(level, np.diff(np.append(starts, len(h))))
    out = [x.tobytes() for x in np.split(each, np.cumsum([len(p) for p in parts])[:-1])]
    return pa.Table.from_arrays([table.column("block"), table.column("bucket"), pa.array(out, pa.binary())], schema=_CLASSES)


def least_shared(n: np.ndarray | int, percent: int):
    """Shingles that a set of n must share to link."""
    return -(-percent * n // 100)


def _order(size: int, n_buckets: int, percent: int):
    def order(docs: pa.Table, classes: pa.Table) -> pa.Table:
        ids = docs.column("doc_id")
        n_docs = docs.num_rows
        h, text = shingle_sets([(t or "").encode() for t in docs.column("text").to_pylist()], size)
        starts = _runs(h)
        cuts = np.searchsorted(_bucket(h[starts], n_buckets), np.arange(n_buckets + 1))
        level = np.zeros(len(starts), np.uint8)
        for k, blob in zip(classes.column("bucket").to_pylist(), classes.column("classes").to_pylist()):
            level[cuts[k] : cuts[k + 1]] = np.frombuffer(blob, np.uint8)
        level = np.repeat(level, np.diff(np.append(starts, len(h))))
        n = np.bincount(text, minlength=n_docs)
        s1, s2 = np.zeros(n_docs, np.uint64), np.zeros(n_docs, np.uint64)
        np.add.at(s1, text, mix(h ^ _U(0x1234567)))
        np.add.at(s2, text, mix(h ^ _U(0x89ABCDEF01)))
        shared = np.bincount(text[level > 0], minlength=n_docs)
        able = (n > 0) & (shared >= least_shared(n, percent))
        keep = np.flatnonzero((level > 0) & able[text])
        keep = keep[np.lexsort((level[keep], text[keep]))]  # stable: by text, class, hash
        at = np.searchsorted(text[keep], np.arange(n_docs + 1))
        tokens: list[bytes | None] = []
        levels: list[bytes | None] = []
        for i in range(n_docs):
            part = keep[at[i] : at[i + 1]]
            first = max(0, int(shared[i] - least_shared(n[i], percent)) + 2)
            tokens.append(h[part].tobytes() if able[i] else None)
            levels.append(level[part[:first]].tobytes() if able[i] else None)
        return pa.Table.from_arrays(
            [ids, pa.array(n.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(tokens, pa.binary()), pa.array(levels, pa.binary())], schema=_SETS
        )

    return order


def _keys(tokens: np.ndarray, levels: np.ndarray, n: int, percent: int) -> np.ndarray:
    """Index keys of a set. ``levels`` are those of its prefix for k = 2, one longer than the prefix for k = 1."""
    short, both = SHORT, SHORT * 100 // percent
    prefix = tokens[: len(levels)]
    frequent = levels >= FREQUENT
    if n > both:
        return prefix[:-1] if len(tokens) >= len(prefix) else prefix
    keys = [prefix[~frequent]]
    f = prefix[frequent]
    a, b = np.triu_indices(len(f), 1)
    keys.append(mix(f[a] * _U(3) + mix(f[b])))
    if n > short:
        keys.append(prefix[frequent])
    elif least_shared(n, percent) < 2 and percent <= 50:
        keys.append(prefix[frequent])  # different sets may link by a single shingle
    return np.concatenate(keys)


def _index(percent: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, rank = [], [], []
            for i, n, t, c in zip(*(batch.column(x).to_pylist() for x in ("id", "n", "tokens", "classes"))):
                own = np.unique(_keys(np.frombuffer(t, np.uint64), np.frombuffer(c, np.uint8), n, percent))
                keys.append(own)
                ids.append(np.full(len(own), i, np.int64))
                rank.append(np.full(len(own), (n - len(t) // 8) / n))
            if keys:
                cols = [np.concatenate(keys).view(np.int64), np.concatenate(ids), np.concatenate(rank)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["key", "id", "apart"])

    return index


class _Sets:
    """Sets of one chunk, renumbered, for counting one against all."""

    def __init__(self, blobs: list[bytes], n: list[int], percent: int):
        parts = [np.frombuffer(b, np.uint64) for b in blobs]
        _, number = np.unique(np.concatenate(parts), return_inverse=True)
        self.starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self.number = number
        self.mark = np.zeros(int(number.max()) + 1 if len(number) else 1, np.int64)
        self.n, self.percent = np.array(n, np.int64), percent

    def links(self, i: int, rest: np.ndarray) -> np.ndarray:
        """Which of ``rest`` (positions) link with i."""
        fits = np.minimum(self.n[rest], self.n[i]) * 100 >= self.percent * np.maximum(self.n[rest], self.n[i])
        rest = rest[fits]
        if not len(rest):
            return rest
        own = self.number[self.starts[i] : self.starts[i + 1]]
        self.mark[own] = 1
        if 4 * len(rest) >= len(self.n):
            common = np.add.reduceat(self.mark[self.number], self.starts[:-1])[rest]
        else:
            common = np.array([self.mark[self.number[self.starts[j] : self.starts[j + 1]]].sum() for j in rest])
        self.mark[own] = 0
        return rest[100 * common >= self.percent * (self.n[i] + self.n[rest] - common)]


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _search(percent: int):
    """Links that connect a chunk's members as all their links would."""

    def search(table: pa.Table) -> pa.Table:
        ids = np.array(table.column("id").to_pylist(), np.int64)
        out: dict[str, list] = {"a": [], "b": []}
        if len(ids) > 1:
            sets = _Sets(table.column("tokens").to_pylist(), table.column("n").to_pylist(), percent)
            rest = np.arange(len(ids))[np.argsort(table.column("apart").to_numpy(), kind="stable")]
            while len(rest):
                queue, rest = [int(rest[0])], rest[1:]
                while queue and len(rest):
                    i = queue.pop(0)
                    if len(found := sets.links(i, rest)):
                        out["a"] += [int(ids[i])] * len(found)
                        out["b"] += ids[found].tolist()
                        queue += found.tolist()
                        rest = np.setdiff1d(rest, found, assume_unique=True)
        return pa.Table.from_pydict(out, schema=_LINKS)

    return search


def _confront(percent: int):
    """Links of some members of a key with a chunk of it, one for each component that the member isn't in."""

    def confront(table: pa.Table) -> pa.Table:
        ids, roots, asks = (np.array(table.column(c).to_pylist()) for c in ("id", "root", "asks"))
        out: dict[str, list] = {"a": [], "b": []}
        if asks.any() and not asks.all():
            sets = _Sets(table.column("tokens").to_pylist(), table.column("n").to_pylist(), percent)
            members = np.flatnonzero(~asks)
            for i in np.flatnonzero(asks):
                found = sets.links(int(i), members[roots[members] != roots[i]])
                _, one = np.unique(roots[found], return_index=True)
                out["a"] += [int(ids[i])] * len(one)
                out["b"] += ids[found[one]].tolist()
        return pa.Table.from_pydict(out, schema=_LINKS)

    return confront


def shingle_table(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """``doc_id, n, s1, s2, tokens, classes``: set size, set signature, and for sets that may link their shared shingles in order."""
    _, total = text_stats(docs, text_col)
    n_blocks, n_buckets = grid(total)
    blocks = in_blocks(docs, id_col, text_col, n_blocks)
    sent = blocks.groupBy("block").applyInArrow(_send(size, n_buckets), "bucket int, block long, hashes binary, counts binary")
    classes = sent.groupBy("bucket").applyInArrow(_classify, "block long, bucket int, classes binary")
    schema = "doc_id long, n long, s1 long, s2 long, tokens binary, classes binary"
    return blocks.groupBy("block").cogroup(classes.groupBy("block")).applyInArrow(_order(size, n_buckets, percent), schema)


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id`` for each row of ``docs``.

    Words are lower-cased (A-Z) runs of anything but space and tab to carriage return; a document's set is its
    distinct ``size``-word shingles, or its whole word sequence if that is shorter. Two documents link when
    100 * intersection >= percent * union. ``class_id`` is the least id of the rows with the same set, and
    ``component_id`` the least id that is reachable over links.

    Null and empty texts have no shingles and link with nothing: their ids are their own. Rows that repeat an id count
    as one document if their texts agree; if not, each row has the component of its own text. Rows without
    id take the component of their text (null if only such rows have it). Other columns are ignored.
    """
    sets = materialize(shingle_table(docs, id_col, text_col, size, percent), "shingles")
    same = ["s1", "s2", "n"]
    classes = sets.where("n > 0").groupBy(*same).agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    whole = fresh_join(sets.select("doc_id", *same), classes, same, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id")
    )
    classes = materialize(whole, "classes")

    own = classes.where("doc_id = class_id and n_shingles > 0").select(F.col("doc_id").alias("id")).distinct()
    able = sets.where("tokens is not null").select(F.col("doc_id").alias("id"), "n", "s1", "tokens", "classes")
    reps = materialize(able.join(own, "id", "left_semi").dropDuplicates(["id", "s1"]).drop("s1"), "sets")
    index = reps.mapInArrow(_index(percent), "key long, id long, apart double")
    index = materialize(index, "index")

    by_key = index.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("id")).alias("x1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x2"))
    merged = by_key.where("m > 1").groupBy("m", "x1", "x2").agg(F.min("key").alias("key")).select("key", "m")
    members = materialize(fresh_join(index, merged, ["key"], "inner").select("key", "m", "id", "apart"), "members")
    chunks = F.ceil(F.col("m") / CHUNK)
    chunk = F.pmod(F.xxhash64("id", "key"), chunks)
    # each set first meets the others of its largest key only
    picked = members.groupBy("id").agg(F.max_by(F.struct("key", "m", "apart"), F.struct("m", "key")).alias("at")).select("id", "at.*")
    plain = picked.select("key", chunk.alias("chunk"), "id", "apart")
    large = picked.where(F.col("m") > CHUNK)
    hubs = large.groupBy("key", "m", F.pmod(F.xxhash64("id"), F.lit(HUBS)).alias("salt")).agg(F.min_by("id", F.struct("apart", "id")).alias("id"), F.min("apart").alias("apart"))
    hubs = hubs.select("key", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"), "id", "apart")
    dealt = plain.union(hubs).distinct()
    body = reps.select("id", "n", "tokens")
    links = dealt.join(body, "id").groupBy("key", "chunk").applyInArrow(_search(percent), "a long, b long")
    links = materialize(links, "found")
    roots = materialize(connected_components(links), "roots")

    # then, of each key whose members aren't all connected by now, those outside its largest component meet all of it
    placed = fresh_join(members.withColumnRenamed("id", "node"), roots, ["node"], "left")
    placed = materialize(placed.select("key", "m", F.col("node").alias("id"), F.coalesce("root", "node").alias("root")), "placed")
    sizes = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("key").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count(F.lit(1)).alias("parts"))
    main = main.where("parts > 1").drop("parts")
    open_keys = fresh_join(placed, main, ["key"], "inner")
    part = F.pmod(F.xxhash64("id"), chunks)
    asking = open_keys.where("root != main").select("key", "m", "id", "root", F.lit(True).alias("asks"), part.alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"))
    questions = asking.select("key", "q", "chunk").distinct()
    answering = open_keys.select("key", "id", "root", F.lit(False).alias("asks"), chunk.alias("chunk"))
    answering = fresh_join(answering, questions, ["key", "chunk"], "inner")
    cols = ["key", "chunk", "q", "id", "root", "asks"]
    both = asking.select(*cols).union(answering.select(*cols)).join(body, "id")
    more = both.groupBy("key", "chunk", "q").applyInArrow(_confront(percent), "a long, b long")
    more = materialize(more, "more")
    if more.limit(1).count():
        roots = connected_components(links.union(more))
    out = fresh_join(classes.withColumnRenamed("class_id", "node"), roots, ["node"], "left")
    return out.select("doc_id", "n_shingles", F.col("node").alias("class_id"), F.coalesce("root", "node").alias("component_id"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return similar_components(docs).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + least(5, len(ws)) - 1], ' ') AS t
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) r USING (doc_id)
"""
