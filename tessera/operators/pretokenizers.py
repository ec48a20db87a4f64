"""Pre-tokenizers: each is a native function from one text to an array of its pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import ASTRAL, DIGIT, PUNCT, SEGMENTS, SPACE_SYMBOL, WORD, WS, byte_map, replacement, strip
from ..sources.spec import SpecError, pattern_of

Cut = Callable[[Column], Column]


def filled(pieces: Column) -> Column:
    return F.filter(pieces, lambda p: p != "")


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def gaps(text: Column, pattern: str) -> Column:
    """What lies between the matches, empty or not: always one more than there are matches."""
    return F.split(text, pattern, -1)


def _pairs(text: Column, pattern: str, join: Callable[[Column, Column], Column], shift: int = 0) -> Column:
    """join(gap, match) by position; with ``shift`` each gap meets the match before it."""
    found = F.concat(F.array(F.lit("")), matches(text, pattern)) if shift else F.concat(matches(text, pattern), F.array(F.lit("")))
    return F.zip_with(gaps(text, pattern), found, join)


def split(text: Column, pattern: str, behavior: str = "Isolated", invert: bool = False) -> Column:
    """Pieces by what happens to the matches: kept apart, removed, joined to a neighbour, or joined to each other.

    ``invert`` gives what lies between the matches, whatever the behaviour. Of adjacent matches that are to merge with
    what follows, only the last is left; one at the end stays alone.
    """
    kind = behavior.lower().replace("_", "").replace("-", "")
    if invert or kind == "removed":
        return filled(gaps(text, pattern))
    if kind == "mergedwithprevious":
        return filled(_pairs(text, pattern, lambda g, m: F.concat(g, m)))
    if kind == "mergedwithnext":
        last = F.concat(F.array_repeat(F.lit(False), F.size(gaps(text, pattern)) - 1), F.array(F.lit(True)))
        pairs = _pairs(text, pattern, lambda g, m: F.struct(m.alias("m"), g.alias("g")), shift=1)
        return filled(F.zip_with(pairs, last, lambda x, end: F.when((x["g"] != "") | end, F.concat(x["m"], x["g"])).otherwise("")))
    if kind == "contiguous":
        pattern = f"(?:{pattern})+"
    return filled(F.flatten(_pairs(text, pattern, lambda g, m: F.array(g, m))))


def byte_level(text: Column, add_prefix_space: bool = True, use_regex: bool = True) -> Column:
    """Segments, byte-mapped. The prefix goes before the first unless it starts with a space, and before all others."""
    if not use_regex:
        return filled(F.array(byte_map(text)))
    parts = matches(text, SEGMENTS)
    if not add_prefix_space:
        return filled(F.transform(parts, byte_map))
    mark = F.lit(SPACE_SYMBOL)
    return F.transform(parts, lambda p, i: F.when((i > 0) | ~p.startswith(" "), F.concat(mark, byte_map(p))).otherwise(byte_map(p)))


def whitespace(text: Column) -> Column:
    return matches(text, rf"{WORD}+|[[^\p{{L}}\p{{Mn}}\p{{Nd}}\p{{Pc}}{WS}]{ASTRAL}]+")


def whitespace_split(text: Column) -> Column:
    return filled(F.split(text, rf"[{WS}]+", -1))


def bert(text: Column) -> Column:
    return matches(text, rf"{PUNCT}|[[^\p{{P}}{WS}]{ASTRAL}]+")


def digits(text: Column, individual: bool = False) -> Column:
    return matches(text, rf"{DIGIT}{'' if individual else '+'}|[[^\p{{Nd}}]{ASTRAL}]+")


def punctuation(text: Column, behavior: str = "Isolated") -> Column:
    """Splits by words and punctuation marks, which both count as matches."""
    return split(text, rf"{WORD}+|{PUNCT}", behavior.lower().replace("_", ""))


def metaspace(text: Column, mark: str = "▁", scheme: str = "always") -> Column:
    words, kind = whitespace_split(text), scheme.lower()
    if kind == "never":
        return words
    if kind == "first":
        return F.transform(words, lambda w, i: F.when(i == 0, F.concat(F.lit(mark), w)).otherwise(w))
    return F.transform(words, lambda w: F.concat(F.lit(mark), w))


#: Code point ranges of each script bucket; everything else is one more bucket.
SCRIPTS = [
    r"A-Za-z\x{C0}-\x{24F}",
    r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{30FF}",
    r"\x{AC00}-\x{D7AF}",
    r"\x{0400}-\x{04FF}",
    r"\x{0600}-\x{06FF}",
    r"\x{0900}-\x{097F}",
]


def unicode_scripts(text: Column) -> Column:
    return matches(text, "|".join(f"[{s}]+" for s in SCRIPTS) + f"|[^{''.join(SCRIPTS)}]+")


def _flag(node: dict, name: str, default: bool = True) -> bool:
    return default if node.get(name) is None else bool(node[name])


def _one_char(node: dict, name: str, default: str | None) -> str:
    value = node.get(name) or default
    if not value or len(value) != 1:
        raise SpecError(f"{node.get('type')} needs a {name} of one character")
    return value


def compile_item(node: dict) -> list[tuple[str, Cut]]:
    kind = (node.get("type") or "").lower()
    if kind == "sequence":
        return [s for x in node.get("pretokenizers") or [] for s in compile_item(x)]
    cut: Cut
    if kind == "split":
        pattern = pattern_of(node.get("pattern"))
        if not pattern or not pattern.strip():
            raise SpecError("Split has no pattern")
        behavior, invert = node.get("behavior") or "Isolated", _flag(node, "invert", False)
        cut = lambda t: split(t, pattern, behavior, invert)
    elif kind == "bytelevel":
        prefix, use = _flag(node, "add_prefix_space"), _flag(node, "use_regex")
        cut = lambda t: byte_level(t, prefix, use)
    elif kind == "digits":
        individual = _flag(node, "individual_digits", False)
        cut = lambda t: digits(t, individual)
    elif kind == "punctuation":
        how = node.get("behavior") or "Isolated"
        cut = lambda t: punctuation(t, how)
    elif kind == "metaspace":
        mark, scheme = _one_char(node, "replacement", "▁"), node.get("prepend_scheme") or "always"
        cut = lambda t: metaspace(t, mark, scheme)
    elif kind == "chardelimitersplit":
        delimiter = rf"\Q{_one_char(node, 'delimiter', None)}\E"
        cut = lambda t: filled(F.split(t, delimiter, -1))
    elif kind == "replace":
        pattern = pattern_of(node.get("pattern"))
        if not pattern:
            raise SpecError("Replace has no pattern")
        content = replacement(node.get("content") or "", pattern)
        cut = lambda t: filled(F.array(F.regexp_replace(t, F.lit(pattern), F.lit(content))))
    elif kind == "strip":
        left, right = _flag(node, "lstrip"), _flag(node, "rstrip")
        cut = lambda t: filled(F.array(strip(t, left, right)))
    else:
        simple: dict[str, Cut] = {"whitespace": whitespace, "whitespacesplit": whitespace_split, "bertpretokenizer": bert, "unicodescripts": unicode_scripts}
        if kind not in simple:
            raise SpecError(f"pre-tokenizer {node.get('type')!r} is not supported")
        cut = simple[kind]
    return [(kind, cut)]


class PreTokenizer:
    """All steps of a definition; only the root's list of pre-tokenizers counts, a bare root has no steps."""

    def __init__(self, root: dict | None):
        self.steps = [s for x in (root or {}).get("pretokenizers") or [] for s in compile_item(x)]
        self.ends_with_byte_level = bool(self.steps) and self.steps[-1][0] == "bytelevel"

    def pieces(self, text: Column) -> Column:
        out = filled(F.array(text))
        for i, (_, cut) in enumerate(self.steps):
            out = F.when(text != "", cut(text)).otherwise(F.array().cast("array<string>")) if i == 0 else F.flatten(F.transform(out, cut))
        return out
