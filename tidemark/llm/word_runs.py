"""Periodic runs of words by the Gusfield-Stoye linear method for tandem repeats.

Texts are searched in pieces, each text on its own, with numpy arrays that hold the suffix trees of all texts of a piece side by side:

1. Suffixes are sorted by doubling (`Suffixes`). A node of a tree is a range of that order and a depth; the suffix link of the node of ``w[i : i + d]`` is that of
   ``w[i + 1 : i + d]``. The classes of each doubling tell how far the words from two places agree, ahead and behind, in steps of powers of two.
2. A text is cut into Lempel-Ziv blocks. A repeat's first occurrence touches a block's border, so for each border and period the words ahead and behind say whether
   there is one: these squares cover the leftmost ones of all kinds (`leftmost`).
3. From each of them the walk along suffix links marks the nodes of its rotations, until one is marked: the whole vocabulary of primitive squares (`vocabulary`).
4. A marked node's range in the order holds all places of its square; neighbouring places of one period make a run, whose smallest period that is, as its square is
   primitive (`runs_of`).

Texts in which no four words occur twice hold no run of four periods and six words, and skip 2 to 4. All steps are linear but for the logarithm of the longest
repeat. A text is one task's work, and takes some 4 bytes a word for each doubling.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import pieces

#: Border and period pairs, or nodes, that are looked at at once.
QUERIES = 1 << 17


class Suffixes:
    """The suffixes of texts (doc, word: a row for each word, in order), sorted text by text.

    order: places; levels[j]: for each place the class of the 2**j words from it (none crosses its text's end: it is in no class with others); rank: a place's index
    in order.
    """

    def __init__(self, doc: np.ndarray, word: np.ndarray) -> None:
        n = len(doc)
        key = doc.astype(np.int64) << 32 | word
        self.order = np.argsort(key, kind="stable")
        key, slots, classes, width = key[self.order], np.arange(n), np.zeros(n, np.int32), 1
        self.levels, repeated = [], np.zeros(0, np.int64)
        while len(slots):
            head = np.append(True, key[1:] != key[:-1])
            classes = classes.copy()
            classes[self.order[slots]] = slots[head][np.cumsum(head) - 1]
            self.levels.append(classes)
            again = ~head | np.append(~head[1:], False)
            slots = slots[again]
            if width == 4:
                repeated = np.unique(doc[self.order[slots]])
            at = self.order[slots]
            follows = np.where(at + width < n, classes[np.minimum(at + width, n - 1)] + 1, 0)
            key = classes[at].astype(np.int64) << 32 | follows
            by = np.argsort(key, kind="stable")
            self.order[slots], key, width = at[by], key[by], 2 * width
        #: texts in which some four words occur twice
        self.repeated = repeated
        self.rank = np.empty(n, np.int64)
        self.rank[self.order] = np.arange(n)

    def _alike(self, a: np.ndarray, b: np.ndarray, j: int) -> np.ndarray:
        """Whether the 2**j words from places a and b are the same; places may lie outside."""
        n, classes = len(self.order), self.levels[j]
        return (np.minimum(a, b) >= 0) & (np.maximum(a, b) < n) & (classes.take(a, mode="clip") == classes.take(b, mode="clip"))

    def _same(self, a: np.ndarray, b: np.ndarray, sign: int) -> np.ndarray:
        """Up to the last power of two of words that agree, then down again; sign -1 looks back."""
        top, live, back = np.full(len(a), -1), np.arange(len(a)), int(sign < 0)
        for j in range(len(self.levels)):
            live = live[self._alike(a[live] - (back << j), b[live] - (back << j), j)]
            if not len(live):
                break
            top[live] = j
        out = np.where(top >= 0, 1 << np.maximum(top, 0), 0)
        for j in reversed(range(int(top.max(initial=0)))):
            live = np.flatnonzero(top > j)
            move = sign * out[live] - (back << j)
            out[live] += self._alike(a[live] + move, b[live] + move, j).astype(np.int64) << j
        return out

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from places a and b, which differ, are the same."""
        return self._same(a, b, 1)

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before places a and b are the same."""
        return self._same(a, b, -1)

    def halves(self, a: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the 2**j words from places a and b, or those before them, are the same."""
        out = np.zeros(len(a), bool)
        for level in np.unique(j[j < len(self.levels)]).tolist():
            at = np.flatnonzero(j == level)
            x, y = a[at], b[at]
            out[at] = self._alike(x, y, level) | self._alike(x - (1 << level), y - (1 << level), level)
        return out

    def range_of(self, at: np.ndarray, depth: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The node of depth words from each place: its first and last index in order, between begin and end."""
        rank, found = self.rank[at], []
        for low, high in ((begin, rank), (rank, end - 1)):
            near, far, sign = (rank, low, -1) if high is rank else (rank, high, 1)
            good, bad = near.copy(), far + sign  # good is in the node, bad isn't
            while (open_ := np.flatnonzero(np.abs(bad - good) > 1)).size:
                mid = (good[open_] + bad[open_]) // 2
                inside = self.ahead(self.order[mid], at[open_]) >= depth[open_]
                good[open_[inside]], bad[open_[~inside]] = mid[inside], mid[~inside]
            found.append(good)
        return found[0], found[1]


def _sequences(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number from 0) for sizes[row] numbers of each row."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _earlier(order: list[int]) -> tuple[list[int], list[int]]:
    """For each index of an order of places, the nearest places to the left and to the right in it that are smaller; -1 for none."""
    left, right, stack = [-1] * len(order), [-1] * len(order), []
    for i, x in enumerate(order):
        while stack and order[stack[-1]] > x:
            right[stack.pop()] = x
        if stack:
            left[i] = order[stack[-1]]
        stack.append(i)
    return left, right


def blocks(tree: Suffixes, slots: np.ndarray) -> np.ndarray:
    """Begins of the Lempel-Ziv blocks of the texts that have these slots of the order: a block is the longest stretch that begins earlier in its text too, or one
    word."""
    order = tree.order[slots]
    longest = np.zeros(len(tree.order), np.int64)
    for side in map(np.asarray, _earlier(order.tolist())):
        known = side >= 0
        longest[order[known]] = np.maximum(longest[order[known]], tree.ahead(order[known], side[known]))  # none in common with another text
    places = np.sort(order)
    out, free = [], -1
    for at, jump in zip(places.tolist(), longest[places].tolist()):
        if at >= free:
            out.append(at)
            free = at + (jump or 1)
    return np.array(out)


def leftmost(tree: Suffixes, starts: np.ndarray, end: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Rows (start, length, period), distinct: stretches of two periods or more that cover the first occurrence of each kind of square. For each block, its begin, its
    text's end and the longest period to look for."""
    ends = np.append(starts[1:], end[-1:])
    ends = np.minimum(ends, end)
    size = ends - starts
    following = np.where(ends < end, np.append(size[1:], 0), 0)
    rows = [np.zeros((0, 3), np.int64)]
    # periods that reach back from a block's end, then those that reach ahead from its begin into the next block
    for base, sizes, back in ((ends, np.where(ends < end, size, 0), True), (starts, size + following, False)):
        sizes = np.minimum(sizes, most)
        total = np.cumsum(sizes)
        for lo in range(0, int(total[-1]), QUERIES):
            number = np.arange(lo, min(lo + QUERIES, int(total[-1])))
            row = np.searchsorted(total, number, side="right")
            period = number - (total[row] - sizes[row]) + 1
            a = base[row] - period if back else base[row]
            fits = a + period < end[row]
            a, period = a[fits], period[fits]
            # half of a period agrees ahead or behind
            j = np.frexp((period + 1) // 2)[1] - 1
            half = np.flatnonzero(tree.halves(a, a + period, j))
            a, period = a[half], period[half]
            after, before = tree.ahead(a, a + period), tree.behind(a, a + period)
            found = after + before >= period
            rows.append(np.stack([a - before, after + before + period, period], 1)[found])
    return np.unique(np.concatenate(rows), axis=0)


def primitive(tree: Suffixes, found: np.ndarray) -> np.ndarray:
    """Of rows (start, length, period) those whose period is the smallest of their first two periods."""
    rest, keep, factor = found[:, 2].copy(), np.ones(len(found), bool), 2
    while len(open_ := np.flatnonzero(keep & (rest > 1))):
        factor = factor if factor * factor <= rest[open_].max() else -1
        here = open_[rest[open_] % factor == 0] if factor > 0 else open_
        by = np.full(len(here), factor) if factor > 0 else rest[here]
        start, period = found[here, 0], found[here, 2]
        part = period // by
        keep[here] = tree.ahead(start, start + part) < 2 * period - part
        if factor < 0:
            break
        while len(here := here[rest[here] % factor == 0]):
            rest[here] //= factor
        factor += 1
    return found[keep]


def vocabulary(tree: Suffixes, found: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rows (first, last, period), distinct: the nodes of all squares in found and of their rotations, by suffix links. begin, end: the texts' ranges in order."""
    steps = np.minimum(found[:, 2], found[:, 1] - 2 * found[:, 2] + 1)  # after a period's rotations the walk is where it began
    total, nodes = np.cumsum(steps), [np.zeros((0, 3), np.int64)]
    for lo in range(0, int(total[-1]) if len(total) else 0, QUERIES):
        number = np.arange(lo, min(lo + QUERIES, int(total[-1])))
        row = np.searchsorted(total, number, side="right")
        at, period = found[row, 0] + number - (total[row] - steps[row]), found[row, 2]
        first, last = tree.range_of(at, 2 * period, begin[row], end[row])
        nodes.append(np.unique(np.stack([first, last, period], 1), axis=0))
    return np.unique(np.concatenate(nodes), axis=0)


def runs_of(tree: Suffixes, nodes: np.ndarray) -> np.ndarray:
    """Rows (start, length, period): neighbouring places of squares of one period, put together."""
    row, number = _sequences(nodes[:, 1] - nodes[:, 0] + 1)
    at, period = tree.order[nodes[row, 0] + number], nodes[row, 2]
    by = np.lexsort((at, period))
    at, period = at[by], period[by]
    head = np.append(True, (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1))[: len(at)]
    first = np.flatnonzero(head)
    size = np.diff(np.append(first, len(at)))
    return np.stack([at[first], size - 1 + 2 * period[first], period[first]], 1)


def periodic(doc: np.ndarray, word: np.ndarray, n_docs: int, shortest: int = 6, periods: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(text, rows (start, length, period)) by text, start and period: maximal stretches of words of at least shortest words and periods smallest periods. word: numbers
    of words, in order, doc: the number of its text. shortest must be 5 and periods 3 at least."""
    tree = Suffixes(doc, word)
    if not len(tree.repeated):
        return np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    ends = np.cumsum(np.bincount(doc, minlength=n_docs))
    begins = np.append(0, ends[:-1])
    size = (ends - begins)[tree.repeated]
    row, number = _sequences(size)
    starts = blocks(tree, begins[tree.repeated][row] + number)
    text = doc[starts]
    found = primitive(tree, leftmost(tree, starts, ends[text], (ends - begins)[text] // periods))
    text = doc[found[:, 0]]
    runs = runs_of(tree, vocabulary(tree, found, begins[text], ends[text]))
    runs = runs[(runs[:, 1] >= shortest) & (runs[:, 1] >= periods * runs[:, 2])]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    text = doc[runs[:, 0]]
    runs[:, 0] -= begins[text]
    return text, runs


def word_runs(docs: DataFrame, shortest: int = 6, periods: int = 4) -> DataFrame:
    """(doc_id, n_words, runs (start, length, period), collapsed) for each row of docs (doc_id, text).

    Words are longest stretches without space and bytes 9 to 13. runs: maximal stretches of at least shortest words and periods times their smallest period, by start,
    then period. collapsed: the words joined by one space, less those that a run has after its first period. A null or empty text has no words and no runs, and is ''
    when collapsed. Ids may be null or repeat; other columns are left out. No rows give no rows.
    """
    if shortest < 5 or periods < 3:
        raise ValueError("shorter runs need a search of all texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            words = [x.as_buffer().to_pybytes().split() if x.is_valid else [] for x in piece.column("text").cast(pa.binary())]
            number = defaultdict(count().__next__)
            word = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64)
            size = np.array([len(ws) for ws in words])
            text, runs = periodic(np.repeat(np.arange(len(words)), size), word, len(words), shortest, periods)
            cuts = np.searchsorted(text, np.arange(len(words) + 1))
            for i in np.unique(text).tolist():
                change = np.zeros(size[i] + 1, np.int64)
                start, length, period = runs[cuts[i] : cuts[i + 1]].T
                np.add.at(change, start + period, 1)
                np.add.at(change, start + length, -1)
                words[i] = [w for w, gone in zip(words[i], (np.cumsum(change) > 0).tolist()) if not gone]
            collapsed = pa.array([b" ".join(ws) for ws in words], pa.binary()).view(pa.string())
            items = pa.StructArray.from_arrays([pa.array(c) for c in runs.T], names=["start", "length", "period"])
            yield pa.record_batch([piece.column("doc_id"), pa.array(size), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), items), collapsed], names=["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
