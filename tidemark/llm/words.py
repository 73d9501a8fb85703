"""Words and word shingles of many texts at once, as 64-bit hashes in numpy arrays.

A word is a longest run of characters other than space and bytes 9 to 13; A-Z are lower-cased, nothing else is.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm.common import mixed

#: Bits of a shingle's token, so that a document's number within a piece and a token fit one sortable integer.
TOKEN_BITS = 48
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_VALUE = mixed(_LOWER + np.uint64(0x51ED270B))
_PLAIN = np.array([c if c > 127 or chr(c).isalnum() else 32 for c in range(256)], np.uint8)
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, 1 << 20), base, np.uint64)
        x[0] = 1
        have = _powers[base] = np.cumprod(x, dtype=np.uint64)
    return have[:n]


def plain(data: np.ndarray) -> np.ndarray:
    """The bytes with accented Latin-1 capitals lower-cased and ASCII marks as spaces, for comparing words loosely."""
    out = _PLAIN[data]
    if len(data) > 1:
        out[1:] |= ((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)).astype(np.uint8) << 5
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray, single: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word in order: its text's number, first byte and end. single: Han characters and kana, which no spaces part, are words of their own."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    gap, first = _SEPARATOR[data], np.zeros(n + 1, bool)
    first[offsets] = True
    if single:
        lead = np.flatnonzero((data >= 0xE3) & (data <= 0xE9))  # three bytes each, from U+3000 to U+9FFF
        first[lead], first[np.minimum(lead + 3, n)] = True, True
    before = np.empty(n, bool)
    before[0], before[1:] = True, gap[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, gap[1:]
    starts = np.flatnonzero(~gap & (before | first[:-1]))
    ends = np.flatnonzero(~gap & (after | first[1:])) + 1
    return np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word: differences of one running polynomial sum, shifted back to the word's start."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _powers_of(_BASE, len(data)), out=total[1:])
    return mixed((total[ends] - total[starts]) * _powers_of(_INVERSE, len(data))[starts])


def run_hashes(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each place in at."""
    h = np.full(len(at), k, np.uint64)
    for j in range(k):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[at + j]
    return mixed(h)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles as (text's number, token), sorted; a text of fewer words has its whole sequence as one. At most 65,536 texts."""
    doc, starts, ends = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    size = np.bincount(doc, minlength=len(offsets) - 1)
    at = np.flatnonzero(doc[: max(0, len(doc) - k + 1)] == doc[k - 1 :]) if len(doc) >= k else np.zeros(0, np.int64)
    docs, hashes = [doc[at]], [run_hashes(words, at, k)]
    begin = np.cumsum(size) - size
    for n in range(1, k):
        short = np.flatnonzero(size == n)
        docs.append(short)
        hashes.append(run_hashes(words, begin[short], n))
    key = np.concatenate(docs).astype(np.uint64) << np.uint64(TOKEN_BITS) | np.concatenate(hashes) >> np.uint64(64 - TOKEN_BITS)
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return (key >> np.uint64(TOKEN_BITS)).astype(np.int64), key & np.uint64((1 << TOKEN_BITS) - 1)


def set_hashes(doc: np.ndarray, tokens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set size and a 64-bit hash of its set (0 for an empty one)."""
    size = np.bincount(doc, minlength=n)
    out = np.zeros(n, np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        begin = (np.cumsum(size) - size)[full]
        out[full] = mixed(np.add.reduceat(mixed(tokens + np.uint64(0xA0761D6478BD642F)), begin) + size[full].astype(np.uint64))
    return size, out.view(np.int64)
