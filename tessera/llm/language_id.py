"""Language ID: unigram piece probabilities for each language over a fixed public vocabulary, summed over segmentations.

A word's probability under a language is the sum, over all ways to cut it into pieces of the vocabulary, of the product
of the pieces' probabilities (the forward algorithm); a text's is the product over its words. The probabilities are
fitted by expectation maximisation with the same sums, on a bounded sample of labelled texts of every language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import portions

#: About so many texts of each language are learned from, and at most so many languages are told apart.
TRAIN_TEXTS, MAX_LANGUAGES = 1000, 1000
#: Words of more letters are summed in logarithms, as products of their probabilities may be too small for a float.
PLAIN_LETTERS = 32
#: Words of more letters aren't remembered; words times letters that are summed at once.
REMEMBERED_LETTERS, CELLS = 64, 1 << 16
#: Probability of a letter as a piece of its own, for letters the vocabulary or the language lacks.
FLOOR = 1e-7
UNDETERMINED = "und"
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_CACHE = 300_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters, whole, each after the vocabulary's mark for a word's beginning."""
    return ["▁" + w for w in _WORD.findall(text.lower())]


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model that words as above can hold."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted(p for p in pieces if regex.fullmatch(r"▁?[\p{L}\p{M}]*", p) and p == p.lower())


def _codes(words: list[str], n: int) -> np.ndarray:
    """Character codes, shorter words filled up with one that no piece has."""
    return np.frombuffer("".join(w.ljust(n, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), n).astype(np.uint64) + np.uint64(1)


class Pieces:
    """Piece numbers of all substrings of many words at once, by a hash table."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces), default=1)
        self.keys = np.zeros(1 << _BITS, np.uint64)
        self.ids = np.full(1 << _BITS, -1, np.int32)
        for i, p in enumerate(pieces):
            h = 0
            for c in p:
                h = (h * int(_BASE) + ord(c) + 1) % (1 << 64)
            slot = (h * int(_BASE) % (1 << 64)) >> (64 - _BITS)
            while self.ids[slot] >= 0:
                slot = (slot + 1) & ((1 << _BITS) - 1)
            self.keys[slot], self.ids[slot] = h, i

    def find(self, h: np.ndarray) -> np.ndarray:
        slot = (h * _BASE >> np.uint64(64 - _BITS)).astype(np.int64)
        out = np.where(self.keys[slot] == h, self.ids[slot], -1)
        miss = np.flatnonzero((out < 0) & (self.ids[slot] >= 0))
        while len(miss):
            slot[miss] = (slot[miss] + 1) & ((1 << _BITS) - 1)
            found = self.keys[slot[miss]] == h[miss]
            out[miss[found]] = self.ids[slot[miss[found]]]
            miss = miss[~found & (self.ids[slot[miss]] >= 0)]
        return out

    def edges(self, words: list[str], n: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """For words of up to n letters: (begin, end, piece number or -1 of each word there)."""
        codes = _codes(words, n)
        for end in range(1, n + 1):
            h, power = np.zeros(len(words), np.uint64), 1
            for begin in range(end - 1, max(-1, end - 1 - self.longest), -1):
                h = h + codes[:, begin] * np.uint64(power)
                power = power * int(_BASE) % (1 << 64)
                yield begin, end, self.find(h)


def _groups(words: list[str]) -> Iterator[tuple[list[int], int]]:
    """Places of words that are summed together, and the letters of the longest: short ones by length, long ones with their like."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    group: list[int] = []
    for i in order:
        n, last = len(words[i]), len(words[group[-1]]) if group else 0
        if group and (n * (len(group) + 1) > CELLS or (n != last and n <= PLAIN_LETTERS) or last <= PLAIN_LETTERS < n):
            yield group, last
            group = []
        group.append(i)
    if group:
        yield group, len(words[group[-1]])


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: list[str]
    probability: np.ndarray  # pieces x languages, then a row for any other letter
    _index: Pieces | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_index": None}

    @property
    def index(self) -> Pieces:
        if self._index is None:
            self._index = Pieces(self.pieces)
        return self._index

    def _edges(self, words: list[str], n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(begin, end, words with a piece there, pieces): single letters always are one, the last row's if need be."""
        for begin, end, piece in self.index.edges(words, n):
            at = np.flatnonzero(piece >= 0) if end - begin > 1 else np.arange(len(words))
            if len(at):
                yield begin, end, at, piece[at]

    def _forward(self, words: list[str], n: int, keep: bool = False) -> tuple[np.ndarray, list]:
        """Sums over the segmentations of all beginnings, as logarithms if n is above ``PLAIN_LETTERS``."""
        logs = n > PLAIN_LETTERS
        p = np.log(self.probability) if logs else self.probability
        alpha = np.full((n + 1, len(words), len(self.languages)), -np.inf if logs else 0.0)
        alpha[0] = 0 if logs else 1
        edges = []
        for begin, end, at, piece in self._edges(words, n):
            if logs:
                alpha[end, at] = np.logaddexp(alpha[end, at], alpha[begin, at] + p[piece])
            else:
                alpha[end, at] += alpha[begin, at] * p[piece]
            if keep:
                edges.append((begin, end, at, piece))
        return alpha, edges

    def log_likelihood(self, words: list[str]) -> np.ndarray:
        """Words x languages."""
        out = np.zeros((len(words), len(self.languages)))
        for part, n in _groups(words):
            own = [words[i] for i in part]
            last = self._forward(own, n)[0][[len(w) for w in own], np.arange(len(own))]
            out[part] = last if n > PLAIN_LETTERS else np.log(last)
        return out

    def expected(self, words: list[str], weight: np.ndarray) -> np.ndarray:
        """Expected piece counts of words, each as often as ``weight`` (words x languages) says."""
        counts = np.zeros_like(self.probability)
        for part, n in _groups(words):
            own = [words[i] for i in part]
            logs, lengths, each = n > PLAIN_LETTERS, [len(w) for w in own], np.arange(len(own))
            alpha, edges = self._forward(own, n, keep=True)
            beta = np.full_like(alpha, -np.inf if logs else 0.0)
            beta[lengths, each] = 0 if logs else 1
            total = alpha[lengths, each]
            p = np.log(self.probability) if logs else self.probability
            for begin, end, at, piece in reversed(edges):
                if logs:
                    flow = p[piece] + beta[end, at]
                    beta[begin, at] = np.logaddexp(beta[begin, at], flow)
                    share = np.exp(alpha[begin, at] + flow - total[at])
                else:
                    flow = p[piece] * beta[end, at]
                    beta[begin, at] += flow
                    share = alpha[begin, at] * flow / total[at]
                np.add.at(counts, piece, share * weight[part][at])
        return counts


def fit(texts: list[tuple[str, str]], pieces: list[str], rounds: int = 3, smoothing: float = 0.01) -> LanguageModel:
    """From (language, text): expectation maximisation over word types, all languages in one pass."""
    languages = sorted({lang for lang, _ in texts})
    counts: dict[str, Counter] = {lang: Counter() for lang in languages}
    for lang, text in texts:
        counts[lang].update(words_of(text))
    types = sorted({w for c in counts.values() for w in c})
    weight = np.array([[counts[lang][w] for lang in languages] for w in types], float).reshape(len(types), len(languages))
    p = np.tile(0.1 ** np.array([len(x) / 2 for x in pieces] + [2.0])[:, None], (1, len(languages)))
    model = LanguageModel(languages, pieces, np.maximum(p / p.sum(axis=0), FLOOR))
    for _ in range(rounds):
        c = model.expected(types, weight) + smoothing
        c[-1] += 1
        model.probability = np.maximum(c / c.sum(axis=0), FLOOR)
    return model


def train(docs: DataFrame, vocabulary_path: str, texts_per_language: int = TRAIN_TEXTS) -> LanguageModel:
    """Learns from ``docs`` (doc_id, text, lang): by a hash of id and text about ``texts_per_language`` of each language.

    All word types of these texts count. Rows without text or language are skipped. A language is a category: more than
    ``MAX_LANGUAGES`` of them are an error.
    """
    rows = docs.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return fit([], vocabulary(vocabulary_path))
    limit = F.create_map(*[F.lit(x) for k, v in sorted(sizes.items()) for x in (k, min(1.0, texts_per_language / v))])
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("lang")), F.lit(1 << 20)) / F.lit(1 << 20)
    got = rows.where(draw <= F.element_at(limit, F.col("lang"))).select("lang", "text").collect()
    return fit(sorted((r["lang"], r["text"]) for r in got), vocabulary(vocabulary_path))


class _Scorer:
    def __init__(self, model: LanguageModel):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.languages)))

    def score(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if len(self.index) > _CACHE:
            self.clear()
        split = [words_of(t) for t in texts]
        words = set().union(*split)
        if new := sorted(w for w in words if len(w) <= REMEMBERED_LETTERS and w not in self.index):
            for w in new:
                self.index[w] = len(self.index)
            self.table = np.concatenate([self.table, self.model.log_likelihood(new)])
        long = sorted(w for w in words if len(w) > REMEMBERED_LETTERS)
        table = self.table
        far = {w: len(table) + k for k, w in enumerate(long)}
        if far:
            table = np.concatenate([table, self.model.log_likelihood(long)])
        langs, scores = [], []
        for words in split:
            if not words or not self.model.languages:
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            find = (lambda w: far[w] if w in far else self.index[w]) if far else self.index.__getitem__
            at = np.fromiter(map(find, words), np.int64, len(words))
            x = table[at].sum(axis=0)
            p = np.exp(x - x.max())
            k = int(np.argmax(p))
            langs.append(self.model.languages[k])
            scores.append(float(p[k] / p.sum()))
        return langs, scores


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for each row, from the whole text; the score is the posterior of the language.

    A null text, or one without any letter, is ``und`` with score 0, as is every text if nothing was learned. Ties go to
    the language first in the alphabet. Repeated rows are scored each; null ids are carried on; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            for begin, end in portions(batch.column("text"), 512):
                part = batch.slice(begin, end - begin)
                langs, scores = scorer.score([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = train(docs.where(~held_out), public_tokenizers.path("piece_bpe_32k.model"))
    return identify(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
