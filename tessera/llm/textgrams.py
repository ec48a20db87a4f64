"""Rabin-Karp hashing of words and word windows over the bytes of many texts at once.

A word's hash joins two polynomials of its bytes (each mapped through fixed random tables), modulo 2**64 and modulo a
prime, taken from prefix sums; a window's is the polynomial of its mixed word hashes modulo 2**64. All end in a
full-avalanche mix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE, _WINDOW_BASE = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
#: Another base for windows, for hashes that are independent of the first.
SECOND_BASE = U(0xA0761D6478BD642F)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_prime_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
PRIME = (1 << 31) - 1
_PRIME_BASES = (1_103_515_245, 1_664_525_017)
_PRIME_BYTE = np.random.default_rng(20240502).integers(1, PRIME, (2, 256), dtype=np.uint64)
#: Bytes hashed in one go, to stay within the cache.
CHUNK = 1 << 20


def separators(pattern: str) -> np.ndarray:
    """``ascii``: white space 09-0D and 20. ``alnum``: every ASCII byte but letters and digits."""
    table = np.zeros(256, bool)
    if pattern == "ascii":
        table[[0x20, *range(0x09, 0x0E)]] = True
    else:
        table[:128] = True
        table[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
    return table


SPACES, NON_WORD = separators("ascii"), separators("alnum")
SAME, LOWER = np.arange(256, dtype=np.uint8), np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK + 4096, 1 << (n - 1).bit_length())
    if size not in _powers:
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _keep(_powers, size, out)
    return _powers[size]


def _prime_tables(n: int, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the lane's base modulo ``PRIME``, and of its inverse, by doubling."""
    size = max(CHUNK + 4096, 1 << (n - 1).bit_length())
    if (size, lane) not in _prime_powers:
        out = []
        for base in (_PRIME_BASES[lane], pow(_PRIME_BASES[lane], -1, PRIME)):
            p = np.ones(size, np.uint64)
            have = 1
            while have < size:
                more = min(have, size - have)
                p[have : have + more] = p[:more] * U(pow(base, have, PRIME)) % U(PRIME)
                have += more
            out.append(p)
        _keep(_prime_powers, (size, lane), out)
    return _prime_powers[size, lane]


def _keep(tables: dict, key, value: list[np.ndarray]) -> None:
    """One set of tables of each kind stays, and that of the usual size: those for a huge word go with the next."""
    for old in [k for k in tables if k != key and (k if isinstance(k, int) else k[0]) > CHUNK + 4096]:
        del tables[old]
    tables[key] = (value[0], value[1])


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _spans_of(texts: list[bytes], sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts in one buffer, begins and ends of their words in it, and the number of words of each."""
    buf = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    is_sep = sep[buf]
    begins = np.flatnonzero(is_sep[:-1] & ~is_sep[1:]) + 1
    ends = np.flatnonzero(~is_sep[:-1] & is_sep[1:]) + 1
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.concatenate([[1], 1 + np.cumsum(lengths + 1)])
    return buf, begins, ends, np.diff(np.searchsorted(begins, at))


def span_hashes(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray, fold: np.ndarray = SAME, stems: tuple[int, ...] = (), lane: int | None = 0) -> np.ndarray:
    """Hashes of the byte spans of ``buf`` (non-empty, in order), with a row more for the first k bytes for each k of ``stems``.

    With a ``lane`` the hash also holds a polynomial modulo a prime, so that spans which agree modulo 2**64 for any base
    (Thue-Morse words) differ; lanes are independent of each other. None is faster, for features that may be mixed up.
    Portions fit the power tables; only a single span longer than ``CHUNK`` needs larger ones.
    """
    out, at = [], 0
    while at < len(begins):
        base = int(begins[at])
        to = max(at + 1, int(np.searchsorted(ends, base + CHUNK, side="right")))
        b, e, part = begins[at:to] - base, ends[at:to] - base, buf[base : int(ends[to - 1])]
        stops = [e, *(np.minimum(e, b + k) for k in stems)]
        power, inverse = _power_tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[fold][part] * power[: len(part)], out=sums[1:])
        h = [(sums[x] - sums[b]) * inverse[b] for x in stops]
        if lane is not None:
            power, inverse = _prime_tables(len(part) + 1, lane)
            np.cumsum(_PRIME_BYTE[lane][fold][part] * power[: len(part)] % U(PRIME), out=sums[1:])
            for k, x in enumerate(stops):
                h[k] = h[k] * U(2 * lane + 1) ^ mix((sums[x] - sums[b]) % U(PRIME) * inverse[b] % U(PRIME) + U(lane + 1))
        out.append(np.stack([mix(x) for x in h]))
        at = to
    return np.concatenate(out, axis=1) if out else np.zeros((1 + len(stems), 0), np.uint64)


def word_hashes(texts: list[bytes], sep: np.ndarray, fold: np.ndarray = SAME, lane: int | None = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the offsets of each text's words (len(texts) + 1)."""
    h, offsets = stem_hashes(texts, sep, fold, (), lane)
    return h[0], offsets


def stem_hashes(texts: list[bytes], sep: np.ndarray, fold: np.ndarray, stems: tuple[int, ...], lane: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """As word_hashes, with a row more for the words' first k bytes for each k of ``stems``."""
    hashes, counts, chunk, size = [], [], [], 0
    for i, t in enumerate(texts):
        chunk.append(t)
        size += len(t) + 1
        if size >= CHUNK or i == len(texts) - 1:
            buf, begins, ends, c = _spans_of(chunk, sep)
            hashes.append(span_hashes(buf, begins, ends, fold, stems, lane))
            counts.append(c)
            chunk, size = [], 0
    offsets = np.zeros(len(texts) + 1, np.int64)
    if counts:
        np.cumsum(np.concatenate(counts), out=offsets[1:])
    return (np.concatenate(hashes, axis=1) if hashes else np.zeros((1 + len(stems), 0), np.uint64)), offsets


class WordTable:
    """The words of many texts (runs of anything but space and tab to carriage return), numbered exactly.

    ``number`` has each word's place in ``distinct``; ``offsets`` each text's first word.
    """

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        words = lists.flatten()
        real = pc.greater(pc.binary_length(words), 0)
        before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
        bounds = lists.offsets.to_numpy().astype(np.int64)
        self.offsets = before[bounds] - before[bounds[0]]
        coded = words.filter(real).dictionary_encode()
        self.number = coded.indices.to_numpy()
        self.distinct = coded.dictionary

    def hashes(self, lane: int) -> np.ndarray:
        """A hash of each distinct word; those of two lanes are independent."""
        n = len(self.distinct)
        _, stops, data = self.distinct.buffers()
        at = np.frombuffer(stops, np.int64)[self.distinct.offset : self.distinct.offset + n + 1] if n else np.zeros(1, np.int64)
        return span_hashes(np.frombuffer(data, np.uint8) if n else np.zeros(0, np.uint8), at[:-1], at[1:], lane=lane)[0]


def window_hashes(words: np.ndarray, offsets: np.ndarray, size: int, base: np.uint64 = _WINDOW_BASE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words inside one text: (hash, index of the first word, index of the text)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h *= base
        h += words[j : j + n]
    counts = np.diff(offsets)
    text = np.repeat(np.arange(len(counts)), counts)
    ok = np.flatnonzero(text[:n] == text[size - 1 : size - 1 + n])
    return mix(h[ok] + U(size)), ok, text[ok]


def covered(starts: np.ndarray, size: int | np.ndarray, total: int) -> np.ndarray:
    """Which of ``total`` words lie in some window that starts at ``starts``."""
    edge = np.zeros(total + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, starts + size, 1)
    return np.cumsum(edge[:-1]) > 0


def intervals(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true: (begins, ends)."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
