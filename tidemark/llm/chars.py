"""Many texts as one array of lower-cased code points, and n-gram keys over it."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa

@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@cache
def folded() -> np.ndarray:
    """Each code point's symbol: accents are dropped, so that é is e."""
    out = np.full(0x110000, 28, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.isspace() or c == 0:
            out[c] = 0
        elif x.isalpha():
            base = unicodedata.normalize("NFD", x)[0].lower() if c > 127 else x.lower()
            out[c] = ord(base) - 96 if "a" <= base <= "z" else 29 + c % 3
        elif x.isdigit():
            out[c] = 27
    return out


@cache
def symbols() -> np.ndarray:
    """Each code point's symbol, as a code point: letters without accents, other alphabets' letters as they are, 0 for digits, a space, and a dot for marks."""
    kinds = folded()
    out = np.arange(0x110000, dtype=np.uint32)
    out[kinds == 0], out[kinds == 27], out[kinds == 28] = 32, 48, 46
    latin = (kinds > 0) & (kinds < 27)
    out[latin] = 96 + kinds[latin]
    return out


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all lower-cased texts, each ended by a 0, and the place after each text's 0). Null is empty; a 0 in a text counts as a space."""
    joined = "\0".join((x or "").replace("\0", " ").lower() for x in texts.to_pylist()) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.flatnonzero(points == 0) + 1


def spaced(symbols: np.ndarray, ends: np.ndarray, space: int) -> tuple[np.ndarray, np.ndarray]:
    """Joins runs of spaces, also one before a text's end with that. Each text begins after its predecessor's last symbol, which is a space."""
    gap = symbols == space
    last = np.zeros(len(gap), bool)
    last[ends - 1] = True
    keep = last.copy()
    keep[1:] |= ~(gap[1:] & gap[:-1])
    keep[:1] = True
    symbols, last = symbols[keep], last[keep]
    keep = np.ones(len(symbols), bool)
    keep[:-1] = ~((symbols[:-1] == space) & last[1:] & ~last[:-1])
    return symbols[keep], np.flatnonzero(last[keep]) + 1
