"""Character classes and byte mapping as native Columns.

Classes are spelled out for java.util.regex and follow UTF-16 code units: characters beyond the basic plane are never
letters, digits or word characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bodies of character classes.
WS = r"\t-\r\x{85}\p{Z}"
ASTRAL = r"\x{10000}-\x{10FFFF}"
LETTER = rf"[\p{{L}}&&[^{ASTRAL}]]"
NUMBER = rf"[\p{{N}}&&[^{ASTRAL}]]"
DIGIT = rf"[\p{{Nd}}&&[^{ASTRAL}]]"
PUNCT = rf"[\p{{P}}&&[^{ASTRAL}]]"
WORD = rf"[\p{{L}}\p{{Mn}}\p{{Nd}}\p{{Pc}}&&[^{ASTRAL}]]"

#: Byte-level segmentation: contractions, letters with one mark before them, up to three digits, marks, white space.
SEGMENTS = (
    r"(?i:'s|'t|'re|'ve|'m|'ll|'d)"
    rf"|[^\r\n\p{{L}}\p{{N}}{ASTRAL}]?{LETTER}+"
    rf"|{NUMBER}{{1,3}}"
    rf"| ?[[^{WS}\p{{L}}\p{{N}}]{ASTRAL}]+[\r\n]*"
    rf"|[{WS}]*[\r\n]+"
    rf"|[{WS}]+(?![^{WS}])"
    rf"|[{WS}]+"
)


def byte_table() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, following = {b: chr(b) for b in own}, 0x100
    for b in range(256):
        if b not in table:
            table[b] = chr(following)
            following += 1
    return [table[b] for b in range(256)]


_TABLE = byte_table()
_FROM = "".join(chr(b) for b in range(256) if _TABLE[b] != chr(b))
_TO = "".join(_TABLE[b] for b in range(256) if _TABLE[b] != chr(b))
SPACE_SYMBOL = _TABLE[0x20]


def byte_map(text: Column) -> Column:
    """The UTF-8 bytes of ``text``, one table character each."""
    return F.translate(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), _FROM, _TO)


def token_bytes(token: str) -> bytes:
    """Bytes of a vocabulary token: table characters by the table, others below U+0400 as zero, the rest as nothing."""
    back = {c: b for b, c in enumerate(_TABLE)}
    units = token.encode("utf-16-le", "surrogatepass")
    chars = [chr(int.from_bytes(units[i : i + 2], "little")) for i in range(0, len(units), 2)]
    return bytes(back.get(c, 0) for c in chars if ord(c) < 1024)


def strip(text: Column, left: bool = True, right: bool = True) -> Column:
    if left:
        text = F.regexp_replace(text, rf"^[{WS}]+", "")
    if right:
        text = F.regexp_replace(text, rf"[{WS}]+\z", "")
    return text


def replacement(content: str, pattern: str) -> str:
    """A .NET replacement string for Java: ``$$`` and ``$&`` translated, unknown groups and backslashes literal."""
    import regex

    try:
        groups = regex.compile(pattern).groups
    except regex.error:
        groups = 9
    out, i = "", 0
    while i < len(content):
        rest = content[i:]
        if rest.startswith("$$"):
            out, i = out + r"\$", i + 2
        elif rest.startswith("$&"):
            out, i = out + "$0", i + 2
        elif m := regex.match(r"\$(\d+)|\$\{(\w+)\}", rest):
            ok = int(m[1]) <= groups if m[1] else not m[2].isdigit() or int(m[2]) <= groups
            text = "$" + m[2] if m[2] and m[2].isdigit() else m[0]
            out += text if ok else m[0].replace("$", r"\$")
            i += m.end()
        else:
            out += {"$": r"\$", "\\": r"\\"}.get(content[i], content[i])
            i += 1
    return out
