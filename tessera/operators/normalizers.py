"""Normalizers: each is a function from an array column of texts to one of the same length.

Those that built-in expressions can state exactly stay native; Unicode normal forms and one-to-one lower-casing run
as Arrow functions over the arrays.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import WS, byte_map, replacement, strip
from ..sources.spec import SpecError, pattern_of

Step = Callable[[Column], Column]


def native(f: Callable[[Column], Column]) -> Step:
    return lambda texts: F.transform(texts, f)


class _Lower(dict):
    """One-to-one lower-casing by code unit: no final sigma, and characters with longer lower-case forms stay."""

    def __missing__(self, code: int) -> int:
        low = chr(code).lower()
        self[code] = ord(low) if len(low) == 1 and code < 0x10000 else code
        return self[code]


_LOWER = _Lower()


def lower(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_LOWER)


def without_accents(text: str) -> str:
    if text.isascii():
        return text
    kept = "".join(c for c in unicodedata.normalize("NFD", text) if ord(c) > 0xFFFF or unicodedata.category(c) != "Mn")
    return unicodedata.normalize("NFC", kept)


def arrow(f: Callable[[str], str]) -> Step:
    def run(texts: pa.Array) -> pa.Array:
        flat = [None if t is None else f(t) for t in texts.flatten().to_pylist()]
        sizes = [None if x is None else len(x) for x in texts.to_pylist()]
        offsets, at = [], 0
        for n in sizes:
            offsets.append(None if n is None else at)
            at += n or 0
        return pa.ListArray.from_arrays(pa.array([*offsets, at], pa.int32()), pa.array(flat, pa.string()))

    return F.arrow_udf(run, "array<string>")


def _form(name: str) -> Step:
    return arrow(lambda t: t if t.isascii() else unicodedata.normalize(name, t))


def _replace(node: dict) -> Step:
    pattern = pattern_of(node.get("pattern"))
    if not pattern:
        raise SpecError("Replace has no pattern")
    content = replacement(node.get("content") or "", pattern)
    return native(lambda t: F.regexp_replace(t, F.lit(pattern), F.lit(content)))


def _nmt(t: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(t, r"[\p{Cc}&&[^\n\r\t]]", " "), rf"[{WS}]+", " "))


def _clean(t: Column) -> Column:
    t = F.regexp_replace(t, r"[\x{0}\x{FFFF}]", "")
    t = F.regexp_replace(t, r"\p{Cc}", " ")
    return strip(F.regexp_replace(t, rf"[{WS}]+", " "))


def _bert(node: dict) -> list[Step]:
    def flag(name: str, default: bool) -> bool:
        return default if node.get(name) is None else bool(node[name])

    low = flag("lowercase", True)
    steps = []
    if flag("clean_text", True):
        steps.append(native(_clean))
    if flag("handle_chinese_chars", True):
        steps.append(native(lambda t: F.regexp_replace(t, "([一-鿿])(?=[一-鿿])", "$1 ")))
    if flag("strip_accents", low):
        steps.append(arrow(without_accents))
    if low:
        steps.append(arrow(lower))
    return steps


def compile_item(node: dict) -> list[Step]:
    kind = (node.get("type") or "").lower()
    if kind == "sequence":
        return [s for x in node.get("normalizers") or [] for s in compile_item(x)]
    if kind == "strip":
        sides = {k: node.get(k) is None or bool(node[k]) for k in ("left", "right")}
        return [native(lambda t: strip(t, **sides))]
    simple: dict[str, Callable[[], list[Step]]] = {
        "lowercase": lambda: [arrow(lower)],
        "nfc": lambda: [_form("NFC")],
        "nfd": lambda: [_form("NFD")],
        "nfkc": lambda: [_form("NFKC")],
        "nfkd": lambda: [_form("NFKD")],
        "replace": lambda: [_replace(node)],
        "stripaccents": lambda: [arrow(without_accents)],
        "bytelevel": lambda: [native(byte_map)],
        "nmt": lambda: [native(_nmt)],
        "bertnormalizer": lambda: _bert(node),
    }
    if kind not in simple:
        raise SpecError(f"normalizer {node.get('type')!r} is not supported")
    return simple[kind]()


def compile_root(root: dict | None) -> list[Step]:
    """Steps of a whole normalizer. A list of normalizers counts whatever the root's type; a root that isn't a
    sequence runs with default parameters only."""
    if not root:
        return []
    if items := root.get("normalizers"):
        return [s for x in items for s in compile_item(x)]
    if (root.get("type") or "Sequence").lower() == "sequence":
        return []
    return compile_item({"type": root["type"]})


def normalize(texts: Column, root: dict | None) -> Column:
    for step in compile_root(root):
        texts = step(texts)
    return texts
