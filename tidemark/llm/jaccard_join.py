"""N-gram Jaccard join: sets of word shingles that overlap by a threshold, found with prefix trees.

1. Texts with the same set become one node; a node is known by a 64-bit hash of its set. Tasks also count the tokens (48-bit shingle hashes) in 2**20 cells.
   Tokens of a cell with more than one in HOT_SHARE of all rows count as hot, and their cell's count as their frequency: nobody gathers their nodes.
2. Of each node one text is read again. A linked pair has a common token among the first ``p = n - ceil(t n) + 1`` of both sets, whatever order all sets have. Here
   some turns of tokens, told by their bits, come first: a share of them somewhat larger than that, so only they are dealt to buckets by their high bits, and
   all tokens of the few sets that have fewer than p of the first turns. A bucket finds each token's nodes and sends back, for each node, labels of those
   tokens that another node has too: a label is the hash of the list of a token's nodes, after their number, so tokens of the same nodes are one. A token's
   nodes in one bucket are at most one in HOT_SHARE of all rows.
3. Within the turns rare tokens come first, those that only one node has before all. So a node links with nothing if p of its tokens are its own; else what
   is left of p are its first labels. Nodes of like sizes that have one in common, also by way of others, form a block. A block of more than BLOCK_TOKENS is cut by
   labels: each has the nodes that have it, and they are dealt to so many groups as the block has BLOCK_TOKENS.
4. Texts of nodes that share a block are read once more, and their sets, of about 5 bytes a token, go straight to their groups. In each group the sets, less what no
   other set there has, go into a radix trie, common tokens first, so that near copies share their path. Each set walks the trie, counting its overlap once for a
   shared path, and leaves a subtree when what remains of the set or of the subtree cannot reach the overlap needed, or when all sets below are in its
   component already. Groups that are still above BLOCK_TOKENS (of near copies), and blocks that cutting would copy more often than that, are cut into
   parts, and each pair of parts has a trie.
5. Links join nodes to components.

Chances of error: two sets of one hash, or tokens of one hash in two compared sets, about 2**-64 and 2**-48 for each pair of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import compress, decompress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import HOT_SHARE, checked_broadcast, durable, hot_join, mixed, pieces, raw_bytes, small_enough
from tidemark.llm.components import components
from tidemark.llm.words import TOKEN_BITS, set_hashes, shingle_sets

#: Tokens that a bucket of step 2 gets on average at most, and tokens in one trie of step 4.
BUCKET_TOKENS, BLOCK_TOKENS = 1 << 20, 1 << 17
_KEPT = 40  # bits of a token that are stored; the bucket has the others
_CELL_BITS, _SLICES = 20, 16
#: Turns that a token may have, and what the first ones' share is of the tokens that a node may have alone.
_TURNS, _AHEAD = 256, 1.4
#: Bits of a filter of rows for each row that it lets through, and bits of one at most: 2**27 are 16 MB. Past that more rows come through than are needed.
_FILTER_SHARE, _FILTER_BITS = 16, 27
#: A label: this bit for a token of later turns, then how many nodes have it (so many at most), then bits of a hash.
_LATE, _MANY, _HASH_BITS = 62, (1 << 14) - 1, 48
#: Places of texts in groups that are broadcast at most: some 100 bytes each.
PLACES = 500_000
_SALT = np.uint64(0x8BB84B93962EACC9)
#: Tasks whose counts are added in one group.
FAN_IN = 64


def needed(size: int, percent: int) -> int:
    """Smallest overlap of a set of this size with any set that it links to."""
    return -(-percent * size // 100)


def first_tokens(size: Column | np.ndarray, percent: int) -> Column | np.ndarray:
    """Of how many tokens, the first ones in an order of all tokens, a set has one in common with any set that it links to."""
    least = F.ceil(size * F.lit(percent) / 100) if isinstance(size, Column) else needed(size, percent)
    return size - least + 1


def size_class(size: np.ndarray, percent: int) -> np.ndarray:
    """Classes of sizes that are each a little wider than 100 / percent; so sets that link are in one or in neighbouring ones."""
    return np.floor(np.log(size) / (np.log(100 / percent) + 1e-9)).astype(np.int64)


def links(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64((1 << _CELL_BITS) - 1)).astype(np.int64)


def _turn(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(_CELL_BITS)) & np.uint64(_TURNS - 1)


def first_turns(percent: int) -> int:
    """How many turns are dealt first; all, if the rest isn't worth another reading of texts."""
    turns = int(np.ceil(_AHEAD * _TURNS * (100 - percent) / 100))
    return turns if turns < 0.8 * _TURNS else _TURNS


def _row() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row")


def sets_of(docs: DataFrame, k: int, turns: int = _TURNS) -> DataFrame:
    """(doc_id, row, n, early, node) for each row, row being a hash of id and text, and early how many of the n tokens have the first turns; and for each task
    (slice, cells), its packed counts of tokens by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, names = np.zeros(1 << _CELL_BITS, np.uint32), ["doc_id", "row", "n", "early", "node", "slice", "cells"]
        nothing = lambda m: [pa.nulls(m, t) for t in (*[pa.int64()] * 5, pa.int32(), pa.binary())]
        for piece in pieces(batches, "text"):
            data, offsets = raw_bytes(piece.column("text"))
            doc, tokens = shingle_sets(data, offsets, k)
            np.add.at(cells, _cell(tokens), np.uint32(1))  # of the cells' own type, as numpy is many times slower if it has to convert
            size, node = set_hashes(doc, tokens, piece.num_rows)
            early = np.bincount(doc[_turn(tokens) < turns], minlength=piece.num_rows)
            yield pa.record_batch([piece.column("doc_id"), piece.column("row"), pa.array(size), pa.array(early), pa.array(node), *nothing(piece.num_rows)[5:]], names=names)
        each = [(i, compress(c.tobytes(), 1)) for i, c in enumerate(np.split(cells, _SLICES)) if c.any()]
        if each:
            yield pa.record_batch([*nothing(len(each))[:5], pa.array([i for i, _ in each], pa.int32()), pa.array([c for _, c in each], pa.binary())], names=names)

    rows = docs.select(F.col("doc_id").cast("long"), _row(), "text")
    return rows.mapInArrow(run, "doc_id long, row long, n long, early long, node long, slice int, cells binary")


def hot_cells(sets: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(cells, counts) of more than one in HOT_SHARE rows: fewer than HOT_SHARE times the tokens of a text. The tasks' counts are added FAN_IN at a time, in as many
    rounds as that takes, so that no group holds more of them."""

    def total(cells: Iterator[pa.Scalar], kind: type) -> np.ndarray:
        out = 0
        for x in cells:
            out = out + np.frombuffer(decompress(x.as_buffer()), kind).astype(np.int64)
        return out

    def added(group: pa.Table) -> pa.Table:
        cells = compress(total(iter(group.column("cells")), np.int64).tobytes(), 1)
        return pa.table({"slice": group.column("slice")[:1].cast(pa.int32()), "of": pa.array([group.column("of")[0].as_py() // FAN_IN], pa.int32()), "cells": pa.array([cells], pa.binary())})

    def last(group: pa.Table) -> pa.Table:
        counts = total(iter(group.column("cells")), np.int64)
        at = np.flatnonzero(counts > rows / HOT_SHARE)
        return pa.table({"cell": pa.array(at + group.column("slice")[0].as_py() * len(counts)), "n": pa.array(counts[at])})

    # a task's counts are summed with some others' first
    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column("slice").to_pylist(), batch.column("cells")):
                counts = np.frombuffer(decompress(x.as_buffer()), np.uint32).astype(np.int64)
                sums[i] = sums[i] + counts if i in sums else counts
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([compress(c.tobytes(), 1) for c in sums.values()], pa.binary())], names=["slice", "cells"])

    counts = sets.where("slice is not null").select("slice", "cells").mapInArrow(some, "slice int, cells binary")
    tasks = sets.rdd.getNumPartitions()
    counts = counts.withColumn("of", F.spark_partition_id())
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        counts = counts.groupBy("slice", F.expr(f"of div {FAN_IN}").alias("group")).applyInArrow(added, "slice int, of int, cells binary")
    found = counts.groupBy("slice").applyInArrow(last, "cell long, n long").toArrow()
    order = np.argsort(cell := found.column("cell").to_numpy())
    return cell[order], found.column("n").to_numpy()[order]


def row_filter(rows: DataFrame, count: int) -> np.ndarray:
    """Packed bits, one set for the leading bits of each row (a hash) of rows, of which there are so many. So all of them come through, and few others."""
    bits = min(_FILTER_BITS, max(_CELL_BITS, (_FILTER_SHARE * count).bit_length()))
    places = rows.select(F.shiftrightunsigned("row", 64 - bits).alias("place")).distinct().withColumn("slice", F.shiftright("place", _CELL_BITS).cast("int"))

    def part(group: pa.Table) -> pa.Table:
        found = np.zeros(1 << _CELL_BITS, np.uint8)
        found[group.column("place").to_numpy() & ((1 << _CELL_BITS) - 1)] = 1
        return pa.table({"slice": group.column("slice")[:1].cast(pa.int32()), "bits": pa.array([np.packbits(found).tobytes()], pa.binary())})

    out = np.zeros((1 << bits - _CELL_BITS, (1 << _CELL_BITS) // 8), np.uint8)
    for row in places.groupBy("slice").applyInArrow(part, "slice int, bits binary").collect():
        out[row.slice] = np.frombuffer(row.bits, np.uint8)
    return out.reshape(-1)


def passes(found: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which rows a row_filter lets through."""
    place = row.view(np.uint64) >> np.uint64(65 - (8 * len(found)).bit_length())
    return (found[place >> np.uint64(3)] >> (7 - (place & np.uint64(7))).astype(np.uint8) & 1).astype(bool)


def _dealt(docs: DataFrame, k: int, bits: int, hot: tuple[np.ndarray, np.ndarray], rows: np.ndarray, turns: int, percent: int) -> DataFrame:
    """Rows (bucket, nodes, tokens) with packed arrays, of texts that the filter rows lets through: tokens of the first turns, or all if those are too few; within a
    piece, a set that repeats is sent once. Hot tokens go by their node, in buckets below 0."""
    shared, chosen = (docs.sparkSession.sparkContext.broadcast(x) for x in (hot[0], rows))

    def packed(bucket: np.ndarray, node: np.ndarray, tokens: np.ndarray, width: int) -> pa.RecordBatch:
        order = np.argsort(bucket, kind="stable")
        bucket, node, rows = bucket[order], node[order], tokens[order].view(np.uint8).reshape(-1, 8)[:, :width]
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        ends = np.append(cut[1:], len(bucket))
        return pa.record_batch(
            [pa.array(bucket[cut]), pa.array([node[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()), pa.array([rows[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary())],
            names=["bucket", "nodes", "tokens"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_hot = np.zeros(1 << _CELL_BITS, bool)
        is_hot[shared.value] = True
        batches = (b.filter(pa.array(passes(chosen.value, b.column("row").to_numpy()))) for b in batches)
        for piece in pieces(batches, "text"):
            data, offsets = raw_bytes(piece.column("text"))
            doc, tokens = shingle_sets(data, offsets, k)
            size, node = set_hashes(doc, tokens, piece.num_rows)
            early = _turn(tokens) < turns
            short = np.bincount(doc[early], minlength=piece.num_rows) < first_tokens(size, percent)
            once = np.zeros(piece.num_rows, bool)
            once[np.unique(node, return_index=True)[1]] = True
            sent = once[doc] & (early | short[doc])
            tokens, node = tokens[sent], node[doc[sent]]
            warm = is_hot[_cell(tokens)]
            yield packed((tokens[~warm] >> np.uint64(TOKEN_BITS - bits)).astype(np.int32), node[~warm], tokens[~warm], _KEPT // 8)
            yield packed((-1 - (node[warm] & ((1 << bits) - 1))).astype(np.int32), node[warm], tokens[warm], 8)

    return docs.select(_row(), "text").mapInArrow(run, "bucket int, nodes binary, tokens binary")


def _by_part(part: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """Packed columns of each part; part is sorted."""
    cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    for a, b in zip(cut, np.append(cut[1:], len(part))):
        yield int(part[a]), [c[a:b].tobytes() for c in columns]


def _shared(dealt: DataFrame, bits: int, hot: tuple[np.ndarray, np.ndarray, int]) -> DataFrame:
    """(part, nodes, labels), packed, part being a node's high bits: of each bucket's tokens those that more than one node has, as labels for each of their nodes. A hot
    token's label has its cell's count, and stands for no other token. hot: cells, their counts, and how many turns are first."""
    known = dealt.sparkSession.sparkContext.broadcast(hot)

    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        width = _KEPT // 8 if bucket >= 0 else 8
        node = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in group.column("nodes")])
        low = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, width) for x in group.column("tokens")])
        token = np.zeros((len(low), 8), np.uint8)
        token[:, :width] = low
        token = token.view(np.uint64)[:, 0].astype(np.int64)
        if bucket >= 0:
            token |= (bucket >> (bits - (TOKEN_BITS - _KEPT))) << _KEPT
            order = np.argsort(token)
            token, node = token[order], node[order]
            new = np.append(True, token[1:] != token[:-1])
            more = ~(new & np.append(new[1:], True))  # not alone
            token, node = token[more], node[more]
        order = np.lexsort((node, token))
        token, node = token[order], node[order]
        once = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])) if len(token) else np.zeros(0, bool)
        token, node = token[once], node[once]
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
        own, (cells, counts, turns) = token[first].view(np.uint64), known.value
        if bucket >= 0:
            count = np.diff(np.append(first, len(token)))
            label = np.add.reduceat(mixed(node.view(np.uint64) + _SALT), first) if len(first) else np.zeros(0, np.uint64)
        else:
            count, label = np.maximum(2, counts[np.searchsorted(cells, _cell(own))]), own
        late = (_turn(own) >= np.uint64(turns)).astype(np.uint64) << np.uint64(_LATE)
        label = late | np.minimum(count, _MANY).astype(np.uint64) << np.uint64(_HASH_BITS) | mixed(label + _SALT) >> np.uint64(64 - _HASH_BITS)
        label = np.repeat(label, np.diff(np.append(first, len(token))))
        more = np.repeat(count > 1, np.diff(np.append(first, len(token))))
        node, label = node[more], label[more]
        order = np.argsort(node.view(np.uint64))
        node, label = node[order], label[order]
        out = list(_by_part((node.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64), node, label))
        return pa.table({"part": pa.array([p for p, _ in out], pa.int32()), "nodes": pa.array([x for _, (x, _) in out], pa.binary()), "labels": pa.array([x for _, (_, x) in out], pa.binary())})

    return dealt.groupBy("bucket").applyInArrow(run, "part int, nodes binary, labels binary")


def _first_labels(shared: DataFrame, nodes: DataFrame, bits: int, percent: int) -> DataFrame:
    """(node, label): the distinct labels of a node's first tokens, those that are its own left out; nothing for a node that has so many of its own. nodes: (node, n, early).

    Linked sets' sizes are at most 100 / percent apart, so their size_class() at most one: each label comes with a node's class, and once more with the next one.
    """

    def run(sent: pa.Table, told: pa.Table) -> pa.Table:
        joined = lambda name, kind: np.frombuffer(b"".join(x.as_buffer() for x in sent.column(name)), kind)
        node, label = joined("nodes", np.int64), joined("labels", np.int64)
        order = np.lexsort((label, node))
        node, label = node[order], label[order]
        each, begin, inverse, m = np.unique(node, return_index=True, return_inverse=True, return_counts=True)
        known = told.column("node").to_numpy()
        order = np.argsort(known)
        at = order[np.searchsorted(known[order], each)]
        n, early = told.column("n").to_numpy()[at], told.column("early").to_numpy()[at]
        late = label >> _LATE > 0
        m_late = np.bincount(inverse[late], minlength=len(each))
        m -= m_late
        p = first_tokens(n, percent)
        # all tokens of the first turns, then some of the later ones, if those are fewer than p
        take = np.where(early < p, m, p - (early - m))
        take_late = np.where(early < p, p - early - (n - early - m_late), 0)
        nth = np.arange(len(node)) - begin[inverse]
        taken = np.where(late, nth - m[inverse] < take_late[inverse], nth < take[inverse])
        # tokens of the same label are one, and all taken if the first is
        taken &= np.append(True, (node[1:] != node[:-1]) | (label[1:] != label[:-1]))[: len(node)]
        node, label, sizes = node[taken], label[taken].view(np.uint64), size_class(n, percent)[inverse[taken]]
        label = [mixed(label ^ mixed(sizes.astype(np.uint64) + np.uint64(i) + _SALT)).view(np.int64) for i in (0, 1)]
        return pa.table({"node": np.concatenate([node, node]), "label": np.concatenate(label)})

    part = F.shiftrightunsigned("node", 64 - bits).cast("int").alias("part")
    return shared.groupBy("part").cogroup(nodes.select(part, "node", "n", "early").groupBy("part")).applyInArrow(run, "node long, label long")


class Trie:
    """A radix trie over ordered sets, with what bounds need in each branch."""

    __slots__ = ("edge", "below", "ends", "least", "most", "longest", "same")

    def __init__(self, edge: list) -> None:
        self.edge, self.below, self.ends, self.same = edge, {}, [], None
        self.least, self.most, self.longest = 1 << 62, 0, 0

    def add(self, path: list, node: int, size: int) -> None:
        at, i = self, 0
        while True:
            at.least, at.most, at.longest = min(at.least, size), max(at.most, size), max(at.longest, len(path) - i)
            if i == len(path):
                at.ends.append((node, size))
                return
            child = at.below.get(path[i])
            if child is None:
                child = at.below[path[i]] = Trie(path[i:])
                child.least = child.most = size
                child.ends.append((node, size))
                return
            j, n = 0, min(len(child.edge), len(path) - i)
            while j < n and child.edge[j] == path[i + j]:
                j += 1
            if j < len(child.edge):  # cut the edge in two
                upper = Trie(child.edge[:j])
                upper.least, upper.most = child.least, child.most
                upper.longest = child.longest + len(child.edge) - j
                child.edge = child.edge[j:]
                upper.below[child.edge[0]] = child
                at.below[path[i]] = child = upper
            at, i = child, i + j


def trie_links(probes: list[tuple[int, int, list]], stored: list[tuple[int, int, list]], percent: int) -> list[tuple[int, int]]:
    """Links between (node, size, ordered ranks) of probes and stored ones, as many as join all that any link joins."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    top, found = Trie([]), []
    for node, size, path in sorted(stored, key=lambda s: s[2]):
        top.add(path, node, size)

    def settled(t: Trie) -> int | None:
        """The one component of all sets below, if it's known to be one."""
        if t.same is not None:
            return root(t.same)
        roots = {root(x) for x, _ in t.ends}
        for c in t.below.values():
            if len(roots) > 1 or c.same is None:
                return None
            roots.add(root(c.same))
        if len(roots) == 1:
            t.same = roots.pop()
        return t.same

    for node, size, path in probes:
        mine, last = set(path), path
        low, high = needed(size, percent), 100 * size // percent
        stack = [(top, 0, 0)]
        while stack:
            t, have, used = stack.pop()
            if t.most < low or t.least > high or settled(t) == root(node):
                continue
            here = len(mine.intersection(t.edge)) if t.edge else 0
            have += here
            if t.edge:
                # ranks rise along a path: what of the probe may still come is beyond the edge's last rank
                lo, hi = used, len(last)
                end = t.edge[-1]
                while lo < hi:
                    mid = (lo + hi) // 2
                    lo, hi = (mid + 1, hi) if last[mid] <= end else (lo, mid)
                used = lo
            if have + min(len(last) - used, t.longest) < -(-percent * (size + max(t.least, low)) // (100 + percent)):
                continue
            for other, n in t.ends:
                if other != node and links(have, size, n, percent) and root(other) != root(node):
                    parent[root(other)] = root(node)
                    found.append((node, other))
            stack.extend((c, have, used) for c in t.below.values())
    return found


def _sets(docs: DataFrame, k: int, rows: np.ndarray) -> DataFrame:
    """(row, node, n, tokens, high) of texts that the filter rows lets through: tokens has each token's lower 32 bits, high the upper 16, compressed."""
    chosen = docs.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b.filter(pa.array(passes(chosen.value, b.column("row").to_numpy()))) for b in batches)
        for piece in pieces(batches, "text"):
            doc, tokens = shingle_sets(*raw_bytes(piece.column("text")), k)
            size, node = set_hashes(doc, tokens, piece.num_rows)
            ends = np.append(0, np.cumsum(size))
            high = (tokens >> np.uint64(32)).astype(np.uint16)
            high = [compress(high[a:b].tobytes(), 1) for a, b in zip(ends, ends[1:])]
            low = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(tokens.astype(np.uint32).view(np.int32)))
            yield pa.record_batch([piece.column("row"), pa.array(node), pa.array(size), low, pa.array(high, pa.binary())], names=["row", "node", "n", "tokens", "high"])

    return docs.select(_row(), "text").mapInArrow(run, "row long, node long, n long, tokens array<int>, high binary")


def _tries(members: DataFrame, percent: int) -> DataFrame:
    """members: (block, i, j, part, node, n, tokens, high), dealt and sorted by (block, i, j, node). One trie at a time is in memory."""

    def one(rows: list[pa.RecordBatch], i: int, j: int) -> list[tuple[int, int]]:
        block = pa.Table.from_batches(rows).combine_chunks()
        node, n, part = (block.column(c).to_numpy() for c in ("node", "n", "part"))
        high = np.frombuffer(b"".join(decompress(x) for x in block.column("high").to_pylist()), np.uint16)
        tokens = high.astype(np.int64) << 32 | block.column("tokens").chunk(0).flatten().to_numpy().view(np.uint32)
        of = np.repeat(np.arange(len(n)), n)
        _, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        counts = counts[inverse]
        # what no other set here has is in no overlap; a set with too little else links with nothing here
        also = counts > 1
        may = np.bincount(of[also], minlength=len(n)) * 100 >= n * percent
        also &= may[of]
        tokens, counts, of = tokens[also], counts[also], (np.cumsum(may) - 1)[of[also]]
        node, n, part = node[may], n[may], part[may]
        order = np.lexsort((tokens, -counts))
        new = np.append(True, tokens[order][1:] != tokens[order][:-1])[: len(tokens)]
        rank = np.empty(len(tokens), np.int64)
        rank[order] = np.cumsum(new)
        cuts = np.cumsum(np.bincount(of, minlength=len(n)))[:-1]
        sets = [(x, m, sorted(r.tolist())) for x, m, r in zip(node.tolist(), n.tolist(), np.split(rank, cuts))]
        a, b = [s for s, p in zip(sets, part) if p == i], [s for s, p in zip(sets, part) if p == j]
        return trie_links(b, a, percent)

    def told(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            block, i, j, node = (batch.column(c).to_numpy() for c in ("block", "i", "j", "node"))
            change = (block[1:] != block[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            fresh = np.append(True, change | (node[1:] != node[:-1]))  # a row that repeats is taken once
            cuts, found = [0, *np.flatnonzero(change) + 1, len(node)], []
            for first, end in zip(cuts, cuts[1:]):
                now = block[first], int(i[first]), int(j[first])
                if now != key:
                    found += one(held, *key[1:]) if held else []
                    key, held = now, []
                elif held[-1].column("node")[-1].as_py() == node[first]:
                    fresh[first] = False
                rows = batch.slice(first, end - first).filter(pa.array(fresh[first:end]))
                if rows.num_rows:
                    held.append(rows)
            yield told(found)
        if held:
            yield told(one(held, *key[1:]))

    return members.mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text; other columns are left out).

    component_id is the smallest doc_id that links lead to, the document itself included; links need ``100 * intersection >= percent * union`` of the
    shingle sets. Null and empty texts and texts without words have n_shingles 0 and link with nothing, not with each other either. Equal texts link. A row
    that repeats is answered as often. A null doc_id is never a component_id unless all of its component are null.
    """
    sets, named = _components(docs, percent, k)
    full = hot_join(sets.where("n > 0"), named.select("node", "rows", "best"), "node", "rows")
    full = full.select("doc_id", F.col("n").alias("n_shingles"), F.col("best.doc_id").alias("component_id"))
    return full.unionByName(sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """The rows of docs, all columns, less those whose component has a better one: that of the smallest doc_id, null ids last, then of the smallest hash.

    Rows are told apart by id and text, so ids may be null or repeat; of rows that are equal in both, one stays (any, if other columns differ). Rows without words
    all stay. The texts stay where they are, unless both the rows that go and those that stay are too many to broadcast.
    """
    sets, named = _components(docs, percent, k)
    placed = hot_join(sets.where("n > 0"), named.select("node", "rows", "best"), "node", "rows").select("row", F.col("best.row").alias("best"))
    placed = durable(placed.groupBy("row").agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("many")), "placed")
    key = F.xxhash64(docs["doc_id"].cast("long"), docs["text"])
    gone = placed.where("row <> best").select(F.col("row").alias("_gone"))
    stay = placed.where("row = best").select("row").union(sets.where("n = 0").select("row").distinct()).select(F.col("row").alias("_stay"))
    if not small_enough(gone) and small_enough(stay):
        kept = docs.join(F.broadcast(stay), key == stay["_stay"], "left_semi")
    else:
        gone = checked_broadcast(gone)
        kept = docs.join(gone, key == gone["_gone"], "left_anti")
    many = placed.where("row = best and many > 1").select(F.col("row").alias("_many"))
    if many.isEmpty():
        return kept
    many = checked_broadcast(many)
    once = kept.join(many, key == many["_many"], "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(many, key == many["_many"], "left_anti").unionByName(once)


def _grouped(nodes: DataFrame, edges: DataFrame, block: DataFrame) -> DataFrame:
    """(node, block, grp): the groups in which each node is compared. edges: (node, label) of the labels of which a linked pair has one in common."""
    sized = block.join(nodes.select("node", "n"), "node")
    blocks = sized.groupBy("block").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("groups"))
    blocks = durable(blocks.where("groups > 1"), "large")
    if blocks.isEmpty():
        return block.select("node", "block", F.lit(0).alias("grp"))
    large = sized.join(checked_broadcast(blocks), "block")
    dealt = edges.join(large, "node").select("node", "block", F.pmod(F.xxhash64("label"), F.col("groups")).cast("int").alias("grp")).distinct()
    dealt = durable(dealt, "dealt")
    # a block of P parts that are compared pair by pair copies each set P times; what copies more isn't cut by tokens
    copies = dealt.groupBy("block").count().join(large.groupBy("block").agg(F.count(F.lit(1)).alias("nodes"), F.max("groups").alias("groups")), "block")
    cut = durable(copies.where(F.col("count") * 2 <= F.col("nodes") * F.col("groups")).select("block"), "cut")
    some = dealt.join(checked_broadcast(cut), "block", "left_semi")
    return some.select("node", "block", "grp").unionByName(block.join(checked_broadcast(cut), "block", "left_anti").select("node", "block", F.lit(0).alias("grp")))


def _components(docs: DataFrame, percent: int, k: int) -> tuple[DataFrame, DataFrame]:
    """((doc_id, row, n, node) of each row, (node, rows, best) of each node: the best (doc_id, row) of its component)."""
    turns = first_turns(percent)
    written = durable(sets_of(docs, k, turns), "sets")
    sets = written.where("n is not null").select("doc_id", "row", "n", "node")
    rows = sets.count()
    hot = hot_cells(written, rows)
    # what a text with its group of equal sets needs is worked out for each node; rows of documents meet it last
    best = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    nodes = written.where("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.max("early").alias("early"), F.min(best).alias("best"), F.count(F.lit(1)).alias("rows"))
    nodes = durable(nodes, "nodes")
    sent = F.when(F.col("early") < first_tokens(F.col("n"), percent), F.col("n")).otherwise(F.col("early"))
    count, total = nodes.agg(F.count(F.lit(1)), F.sum(sent)).first()
    bits = max(TOKEN_BITS - _KEPT, min(30, int((total or 0) // BUCKET_TOKENS).bit_length()))
    dealt = _dealt(docs, k, bits, hot, row_filter(nodes.select("best.row"), count), turns, percent)
    first = durable(_first_labels(_shared(dealt, bits, (*hot, turns)), nodes, bits, percent), "first")
    roots = first.groupBy("label").agg(F.min("node").alias("root"), F.count("*").alias("c")).where("c > 1")
    edges = durable(hot_join(first, durable(roots, "roots"), "label", "c").select("node", "label", "root"), "edges")
    block = components(edges.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("root", "block")
    place = durable(_grouped(nodes, edges, durable(block, "blocks")), "groups")
    sized = place.join(nodes.select("node", "n", "best.row"), "node")
    parts = sized.groupBy("block", "grp").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("parts"), F.count(F.lit(1)).alias("nodes")).where("nodes > 1")
    members = sized.join(parts, ["block", "grp"])
    members = members.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    where = F.struct(F.xxhash64("block", "grp").alias("block"), F.least("part", "other").cast("int").alias("i"), F.greatest("part", "other").cast("int").alias("j"), "part")
    places = durable(members.groupBy("row").agg(F.collect_list(where).alias("places")), "places")
    # texts stay where they are until they go to their groups, unless those that do are too many to broadcast their places
    count, total = places.agg(F.count(F.lit(1)), F.sum(F.size("places"))).first()
    texts = _sets(docs, k, row_filter(places.select("row"), count))
    members = texts.join(F.broadcast(places) if (total or 0) <= PLACES else places, "row").withColumn("at", F.explode("places")).select("at.*", "node", "n", "tokens", "high")
    found = durable(_tries(members.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "node"), percent), "links")
    joined = components(found)
    keyed = durable(nodes.select("node", "best", "rows").join(joined, "node", "left").withColumn("key", F.coalesce("root", "node")), "keyed")
    least = keyed.groupBy("key").agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("nodes"))
    named = hot_join(keyed.select("node", "key", "rows"), durable(least, "least"), "key", "nodes")
    return sets, durable(named.select("node", "rows", "best"), "named")
