"""Loading and checking tokenizer definitions (``tokenizer.json``) on the driver.

Everything here is small and happens once, when a plan is built; what runs on the cluster are Columns and
Arrow functions made from the resulting :class:`TokenizerSpec`.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field, replace
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class SpecError(ValueError):
    """The definition can't be used as it stands."""


def pattern_of(node: Any) -> str | None:
    """A Split or Replace pattern as a regular expression: a string or {Regex} as is, {String} quoted, other objects None."""
    if node is None or isinstance(node, str):
        return node
    if not isinstance(node, dict):
        raise SpecError("pattern must be a string or an object")
    for key in ("Regex", "regex"):
        if isinstance(node.get(key), str):
            return node[key]
    for key in ("String", "string"):
        if isinstance(node.get(key), str):
            return re.sub(r"([\\*+?|{}\[\]()^$.# ])", r"\\\1", node[key])
    return None


def merge_pairs(merges: Any) -> list[tuple[int, str, str]]:
    """(rank, left, right) of both spellings of merges. A rank is the line's index, also where a line is skipped.

    The form is that of the first element. Lines are parted at the first space. Parts that hold spaces themselves are
    cut as when a pair is written as one line: the first two non-empty words count, and fewer mean a skipped line.
    """
    if not isinstance(merges, list):
        raise SpecError("model.merges is missing")
    as_lines = bool(merges) and isinstance(merges[0], str)
    out = []
    for rank, m in enumerate(merges):
        if as_lines:
            if not isinstance(m, str) or " " not in m:
                raise SpecError(f"merge {rank} has no space: {m!r}")
            line = m
        else:
            if not isinstance(m, list) or len(m) != 2 or not all(isinstance(x, str) for x in m):
                raise SpecError(f"merge {rank} must be a pair: {m!r}")
            line = f"{m[0]} {m[1]}"
        parts = [p for p in line.split(" ") if p]
        if len(parts) >= 2:
            out.append((rank, parts[0], parts[1]))
    return out


@dataclass(frozen=True)
class TokenizerSpec:
    vocab: dict[str, int]
    merges: list[tuple[int, str, str]]
    specials: dict[int, str] = field(default_factory=dict)
    normalizer: dict | None = None
    pre_tokenizer: dict | None = None

    @cached_property
    def fingerprint(self) -> str:
        """What tells definitions apart that encode differently: workers keep their memos by it."""
        return hashlib.sha256(repr((sorted(self.vocab.items()), self.merges)).encode()).hexdigest()

    @property
    def vocab_size(self) -> int:
        return len(self.vocab)

    @property
    def ranks(self) -> dict[tuple[str, str], int]:
        """Rank of each pair; of a repeated pair the last line counts."""
        return {(a, b): r for r, a, b in self.merges}

    @property
    def reverse(self) -> dict[int, str]:
        """Token of each id; of a repeated id the last token counts."""
        return {i: t for t, i in self.vocab.items()}

    @property
    def special_ids(self) -> dict[str, int]:
        return {c: i for i, c in self.specials.items() if c}

    def truncated(self, size: int) -> TokenizerSpec:
        """The ``size`` tokens with the least ids (and others that share such an id), and the first ``size`` merge lines."""
        if not 0 < size < len(self.vocab):
            return self
        kept = set(sorted(self.vocab.values())[:size])
        return replace(self, vocab={t: i for t, i in self.vocab.items() if i in kept}, merges=[m for m in self.merges if m[0] < size])

    def is_ordered(self) -> bool:
        """Whether every merge only uses symbols made by earlier ones: then merging by rank can be a fold over the merges."""
        made: dict[str, int] = {}
        last = {(a, b): r for r, a, b in self.merges}
        for r, a, b in self.merges:
            if last[a, b] != r or any(len(x) > 1 and made.get(x, r) >= r for x in (a, b)):
                return False
            made.setdefault(a + b, r)
        return True


def parse(text: str) -> TokenizerSpec:
    root = json.loads(text)
    model = root.get("model") if isinstance(root, dict) else None
    if not isinstance(model, dict):
        raise SpecError("model is missing")
    vocab = model.get("vocab")
    if not vocab:
        raise SpecError("model.vocab is missing or empty")
    merges = merge_pairs(model.get("merges"))
    specials = {}
    for t in root.get("added_tokens") or []:
        if t and t.get("content"):
            specials[int(t["id"])] = t["content"]
    return TokenizerSpec({str(k): int(v) for k, v in vocab.items()}, merges, specials, root.get("normalizer"), root.get("pre_tokenizer"))


def load(path: str, vocab_size: int = 0, spark: SparkSession | None = None) -> TokenizerSpec:
    """From a local path, or with ``spark`` from any path that Spark reads."""
    if spark is not None:
        text = spark.read.text(path, wholetext=True).first()[0]
    else:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    spec = parse(text)
    return spec.truncated(vocab_size) if vocab_size else spec


def vocab_table(spark: SparkSession, spec: TokenizerSpec) -> DataFrame:
    return spark.createDataFrame(list(spec.vocab.items()), "token string, id int")


def merges_table(spark: SparkSession, spec: TokenizerSpec) -> DataFrame:
    return spark.createDataFrame(spec.merges, "rank int, left string, right string")


def specials_table(spark: SparkSession, spec: TokenizerSpec) -> DataFrame:
    return spark.createDataFrame([(i, c, bytearray(c.encode())) for i, c in spec.specials.items()], "id int, content string, utf8 binary")


def reverse_table(spark: SparkSession, spec: TokenizerSpec) -> DataFrame:
    return spark.createDataFrame(list(spec.reverse.items()), "id int, token string")
