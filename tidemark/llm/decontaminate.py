"""Benchmark decontamination: rare word pairs as seeds find passages, Smith-Waterman alignment scores them.

1. The test items' word pairs are looked for in all documents, and each pair's number of documents is counted (one sum per task and pair). A pair is two
   words that stand next to each other or with one word between, in the item and in the document; so it outlives an edit between its words.
2. An alignment with M equal words scores at most 2 M, less 1 for each edit. Of the M - 1 steps from one equal word to the next, c0 have no edit between, c1
   have one, the others two or more; so a score of T needs ``2 c0 + c1 >= T - 2``, and each place of the item begins one step at most. Hence an item's most
   common places can go without loss, as long as twice their number stays below T - 2: SHARE of that goes, and what the rest must have is counted.
3. Where a document has so much of an item within the length that such a passage can have, the item is aligned with the words around: 2 for an equal word, -1
   for another, -1 for a gap. The best local score, over that of the whole item, is the pair's score. Items for which one equal word is enough have words as seeds.

So all pairs of document and item that reach the score are found, wherever their edits are. Words are compared without case (of ASCII and Latin-1 letters)
and ASCII marks; Han characters and kana are words each. Documents are read twice and never shuffled. Test items go to all tasks in blocks of at most BLOCK_BYTES of text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mixed, pieces, raw_bytes
from tidemark.llm.words import plain, word_hashes, word_spans

#: Of the places that can go without loss, the share that does: with more, less is looked up; with less, fewer passages are aligned.
SHARE = 0.5
BLOCK_BYTES = 8 << 20
#: Cells of the rows that are aligned at once, and places of items that are weighed at once, about.
_CELLS, _PLACES = 1 << 18, 1 << 20


def _pairs(words: np.ndarray, at: np.ndarray, item_step: int, step: int) -> np.ndarray:
    """Hashes of the words at these places and so many (item_step) after; step is how far apart they are in a document, 0 for single words."""
    return mixed((words[at] * np.uint64(0xD6E8FEB86659FD93) + words[at + item_step]) * np.uint64(3) + np.uint64(step))


class Seeds:
    """Hashes of test items' word pairs, with the places (item, word) of each and its weight in the count."""

    def __init__(self, texts: list[str | None], ids: list[int], least: float) -> None:
        data, offsets = raw_bytes(pa.array(texts, pa.string()))
        data = plain(data)
        doc, starts, ends = word_spans(data, offsets, single=True)
        words = word_hashes(data, starts, ends)
        size = np.bincount(doc, minlength=len(texts))
        begin = np.cumsum(size) - size
        self.ids, self.items = np.array(ids, np.int64), [words[b : b + n] for b, n in zip(begin, size)]
        self.size = size
        self.score = np.maximum(1, np.ceil(2 * least * size - 1e-9).astype(np.int64))
        single = self.score <= 2
        #: Places of an item that can go; what is left of the count for the others.
        self.spare = np.where(single, 0, np.maximum(0, (self.score - 3) * SHARE / 2)).astype(np.int64)
        self.need = np.where(single, 1, self.score - 2 - 2 * self.spare)
        hashes, place, weight, step = [], [], [], []
        for d, e in ((0, 0), (1, 1), (1, 2), (2, 1), (2, 2)):  # steps in the document and in the item
            at = np.flatnonzero(doc[: max(0, len(doc) - e)] == doc[e:])
            at = at[single[doc[at]] == (d == 0)]
            hashes.append(_pairs(words, at, e, d))
            place.append(at)
            weight.append(np.full(len(at), 2 if d == e == 1 else 1))
            step.append(np.full(len(at), d))
        place = np.concatenate(place)
        self._set(np.concatenate(hashes), doc[place], place - begin[doc[place]], np.concatenate(weight), np.concatenate(step))

    def _set(self, hashes: np.ndarray, item: np.ndarray, place: np.ndarray, weight: np.ndarray, step: np.ndarray) -> None:
        order = np.lexsort((place, item, hashes))
        hashes, self.item, self.place, self.weight, self.step = hashes[order], item[order], place[order], weight[order], step[order]
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
        self.hashes, self.begin = hashes[first], np.append(first, len(hashes))
        self.sorted = np.repeat(np.arange(len(first)), np.diff(self.begin)) * (1 + len(self.items)) + self.item  # pair, then item
        self.steps = sorted(set(step.tolist()))
        self.shift = np.uint64(64 - min(26, max(16, len(self.hashes).bit_length() + 4)))
        self.map = np.zeros(1 << (64 - int(self.shift)), bool)
        self.map[(self.hashes >> self.shift).astype(np.int64)] = True

    def rarest(self, count: np.ndarray) -> Seeds:
        """Without the places of each item that are in the most documents, as many as can go."""
        key, own = np.unique(self.item * (1 + self.size.max(initial=0)) + self.place, return_inverse=True)
        common = np.bincount(own, weights=np.repeat(count, np.diff(self.begin)), minlength=len(key))
        item = key // (1 + self.size.max(initial=0))
        order = np.lexsort((-common, item))
        nth = np.empty(len(key), np.int64)
        nth[order] = np.arange(len(key)) - np.searchsorted(item, item[order])
        keep = (nth >= self.spare[item])[own]
        out = object.__new__(Seeds)
        out.__dict__ |= {k: self.__dict__[k] for k in ("ids", "items", "size", "score", "spare", "need")}
        out._set(np.repeat(self.hashes, np.diff(self.begin))[keep], self.item[keep], self.place[keep], self.weight[keep], self.step[keep])
        return out

    def found(self, doc: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word's place, number of the pair) wherever a pair stands in these texts."""
        places, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d in self.steps:
            at = np.flatnonzero(doc[: max(0, len(doc) - d)] == doc[d:])
            hashes = _pairs(words, at, d, d)
            some = np.flatnonzero(self.map[(hashes >> self.shift).astype(np.int64)])
            number = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
            real = self.hashes[number] == hashes[some]
            places.append(at[some[real]])
            numbers.append(number[real])
        return np.concatenate(places), np.concatenate(numbers)

    def windows(self, doc: np.ndarray, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(text, item, first word, end) of the passages in which an item can reach its score; so many items at a time that their places stay few."""
        place, number = self.found(doc, words)
        parts = max(1, -(-int(np.diff(self.begin)[number].sum()) // _PLACES))
        cuts = np.linspace(0, len(self.items), min(parts, max(1, len(self.items))) + 1).astype(np.int64)
        for low, high in zip(cuts, cuts[1:]):
            yield self._windows(doc, place, number, low, high)

    def _windows(self, doc: np.ndarray, place: np.ndarray, number: np.ndarray, low_item: int, high_item: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        begin = np.searchsorted(self.sorted, number * (1 + len(self.items)) + low_item)
        n = np.searchsorted(self.sorted, number * (1 + len(self.items)) + high_item) - begin
        pick = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        place = np.repeat(place, n)
        item, weight = self.item[pick], self.weight[pick]
        # a passage has at most 2 m words of its item's and as many others as edits, less than 2 m - score of them
        edits = np.maximum(0, 2 * self.size - self.score)
        key = (doc[place] * len(self.items) + item) * (4 * len(doc) + 4 * self.size.max(initial=0) + 4)
        order = np.argsort(key + place, kind="stable")
        place, item, pick, weight, key = place[order], item[order], pick[order], weight[order], key[order]
        at, total = key + place, np.append(0, np.cumsum(weight))
        upto = np.searchsorted(at, at + (self.size + edits)[item], side="right")
        good = total[upto] - total[:-1] >= self.need[item]
        mark = np.zeros(len(at) + 1, np.int64)  # all hits from a good one to the end of its passage
        np.add.at(mark, np.flatnonzero(good), 1)
        np.add.at(mark, upto[good], -1)
        kept = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
        start, item, d = place[kept] - self.place[pick[kept]], item[kept], doc[place[kept]]
        order = np.lexsort((start, item, d))
        start, item, d = start[order], item[order], d[order]
        m = self.size[item]
        part = start // (4 * m)
        new = np.append(True, (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (part[1:] != part[:-1]) | (start[1:] - start[:-1] > m[1:]))[: len(d)]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(new))[: len(first)] - 1
        d, item = d[first], item[first]
        low, high = start[first] - edits[item], start[last] + self.size[item] + edits[item]
        return d, item, np.maximum(low, np.searchsorted(doc, d)), np.minimum(high, np.searchsorted(doc, d, side="right"))


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(best local score over twice the item's words, end of the aligned passage) for each pair, all pairs at once."""
    m, n = max(map(len, items)), max(map(len, passages))
    a = np.zeros((len(items), m), np.uint64)
    b = np.full((len(items), n), 1, np.uint64)
    for i, (x, y) in enumerate(zip(items, passages)):
        a[i, : len(x)], b[i, : len(y)] = x, y
    size = np.array([len(x) for x in items])
    step = np.arange(n + 1)
    h, best, end = np.zeros((len(items), n + 1), np.int32), np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    for j in range(m):
        t = np.zeros_like(h)
        t[:, 1:] = np.maximum(np.maximum(h[:, :-1] + np.where(b == a[:, j : j + 1], 2, -1), h[:, 1:] - 1), 0)
        h = np.maximum.accumulate(t + step, axis=1) - step
        h[size <= j] = 0
        top = h.argmax(1)
        value = h[np.arange(len(h)), top]
        end = np.where(value > best, top, end)
        best = np.maximum(best, value)
    return best / (2.0 * np.maximum(size, 1)), end


def _read(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = raw_bytes(piece.column("text"))
    data = plain(data)
    doc, starts, ends = word_spans(data, offsets, single=True)
    return doc, word_hashes(data, starts, ends)


def gram_documents(docs: DataFrame, seeds: Seeds) -> np.ndarray:
    """The number of documents that have each gram."""
    shared = docs.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        total = np.zeros(len(s.hashes), np.int64)
        for piece in pieces(batches, "text"):
            doc, words = _read(piece)
            place, number = s.found(doc, words)
            np.add.at(total, np.unique(doc[place] * len(total) + number) % max(1, len(total)), 1)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    rows = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(seeds.hashes), np.int64)
    out[rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    return out


def _matches(docs: DataFrame, seeds: Seeds, least: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for piece in pieces(batches, "text"):
            doc, words = _read(piece)
            rows = []
            for d, item, low, high in s.windows(doc, words):
                begin, i = np.searchsorted(doc, d), 0
                by_size = np.argsort(high - low, kind="stable")
                while i < len(by_size):
                    room = np.searchsorted(np.maximum.accumulate((high - low)[by_size[i : i + 256]]) * np.arange(1, 1 + len(by_size[i : i + 256])), _CELLS, side="right")
                    part = by_size[i : i + max(1, int(room))]
                    i += len(part)
                    score, end = align([s.items[item[c]] for c in part], [words[low[c] : high[c]] for c in part])
                    rows += [(int(d[c]), int(item[c]), float(v), int(low[c] + e - begin[c])) for c, v, e in zip(part, score, end) if v >= least]
            best: dict[tuple[int, int], tuple[float, int]] = {}
            for x, y, v, e in rows:
                best[x, y] = max(best.get((x, y), (0.0, 0)), (v, -e))
            if best:
                keys = sorted(best)
                ids = piece.column("doc_id")
                yield pa.record_batch(
                    [pa.array([ids[x].as_py() for x, _ in keys], pa.int64()), pa.array([int(s.ids[y]) for _, y in keys], pa.int64()), pa.array([best[k][0] for k in keys]), pa.array([-best[k][1] for k in keys], pa.int64())],
                    names=["doc_id", "item_id", "score", "end_word"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, score double, end_word long")


def contaminated(docs: DataFrame, items: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, item_id, score, end_word): documents (doc_id, text) that hold a test item (item_id, text), whole, in part or edited, by at least this score.

    end_word is the number of the document's words up to the passage's end. Null and empty texts and items without words match nothing. A document that
    repeats is answered as often; an item that repeats too. With no items or no documents the result is empty. Extra columns are left out.
    """
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    items = items.select(F.col("item_id").cast("long"), "text").where("item_id is not null")
    out = []
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow().sort_by("item_id")
        seeds = Seeds(rows.column("text").to_pylist(), rows.column("item_id").to_pylist(), least)
        out.append(_matches(docs, seeds.rarest(gram_documents(docs, seeds)), least))
    return reduce(DataFrame.unionByName, out)
