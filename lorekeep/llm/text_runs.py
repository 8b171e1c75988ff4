"""Texts of an Arrow batch as arrays of code points, so that words and windows are found for a whole batch at once.

Memory is about 40 bytes for each character of what is handled at once: ``chunks`` of about a million characters, or one
text if that alone is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

LETTER, NUMBER, SPACE, BLANK = 1, 2, 4, 8
#: Unicode's White_Space property (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CHUNK_CHARS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


@lru_cache(1)
def classes() -> np.ndarray:
    """For each code point the bits LETTER (``\\p{L}``), NUMBER (``\\p{N}``), SPACE (``\\s``) and BLANK."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    bits = np.zeros(0x110000, np.uint8)
    for bit, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            bits[a : b + 1] |= bit
    bits[0xD800:0xE000] = 0
    bits[WHITE_SPACE] |= SPACE
    bits[[0x09, 0x0A, 0x0D, 0x20]] |= BLANK
    return bits


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts with null as "") of stretches of about CHUNK_CHARS characters."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t or "")
        size += len(held[-1])
        if size >= CHUNK_CHARS:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


class Runs:
    """Code points of several texts, one zero after each, and their classes (0 at those zeros)."""

    def __init__(self, texts: list[str]):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        self.text = "\0".join(texts) + "\0"
        self.points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), "<u4")
        self.bits = classes()[self.points]
        self.bits[self.ends] = 0

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal stretches where ``inside`` holds; it must not at the zeros between texts."""
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        return edge[::2], edge[1::2]

    def of(self, positions: np.ndarray) -> np.ndarray:
        """The text that each position lies in."""
        return np.searchsorted(self.ends, positions, "left")

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit polynomial hashes of stretches, equal for equal stretches wherever they stand."""
        mixed = self.points.astype(np.uint64) + np.uint64(1)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        power, inverse = powers(len(mixed) + 1)
        total = np.zeros(len(mixed) + 1, np.uint64)
        np.cumsum(mixed * power[:-1], out=total[1:])
        return (total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hashes' base and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        most = max(n, CHUNK_CHARS + (1 << 17))
        bases = (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        _POWERS[:] = [np.cumprod(np.append(np.uint64(1), np.full(most - 1, b, np.uint64))) for b in bases]
    return _POWERS[0][:n], _POWERS[1][:n]


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Rolling (Karp-Rabin) hashes of every n consecutive word hashes."""
    k = len(words) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    out = words[:k].copy()
    for j in range(1, n):
        out *= _BASE
        out += words[j : j + k]
    return out
