"""Token ids in patched frame-of-reference files.

A file has, in little-endian order: the magic ``PFOR0001``, five 64-bit numbers (documents, ids, ids in a block, blocks, bytes of blocks); each document's id
(signed 64-bit, with the smallest number for null) and number of ids (32-bit); the byte at which each block starts (32-bit, from the first block); the blocks.
A block is: its minimum (32-bit), its width (8-bit), its number of exceptions (16-bit); the ids less the minimum, their low ``width`` bits, packed from the
lowest bit on; the exceptions' places (16-bit each) and whole differences (32-bit each). The width is that of the 90th percentile of the block's
differences. The last block of a file is filled up with its own minimum.

Documents are dealt by ranges of doc_id, or another column, so that the files in order of (part, number) hold them in its ascending order. A task writes to paths of its own, and only those
that a finished task reports are read, so that a task that runs again does no harm. Nothing but the list of files is ever in one place.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import durable, fresh_path, pieces

BLOCK, PERCENTILE = 128, 90
#: Ids in one file at most, but for its last document's.
FILE_IDS = 1 << 21
_MAGIC, _NULL = b"PFOR0001", -(1 << 63)
#: Blocks that are packed together, so that they stay in the processor's cache.
_AT_ONCE = 2048
#: Chunks of text whose ids a worker remembers, twice, and the length above which it doesn't (some 250 MB at most, whatever the language).
_REMEMBERED, _LONGEST = 500_000, 48
#: Letters, then ASCII marks, a line end and letters, marks; all but the first may be missing. Each is a piece of its own (an apostrophe may not be).
_WITH_MARKS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)?(?:(\n)([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)?)?")


def widths(x: np.ndarray) -> np.ndarray:
    """Bits of each value."""
    return np.where(x > 0, np.frexp(x.astype(np.float64))[1], 0)


def pack(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(start of each block, blocks)."""
    n = -(-len(ids) // BLOCK)
    if n > _AT_ONCE:
        parts = [pack(ids[i : i + _AT_ONCE * BLOCK]) for i in range(0, len(ids), _AT_ONCE * BLOCK)]
        before = np.cumsum([0, *(len(b) for _, b in parts)])
        return np.concatenate([s + np.uint32(k) for (s, _), k in zip(parts, before)]), b"".join(b for _, b in parts)
    if not n:
        return np.zeros(0, np.uint32), b""
    full = np.append(ids, np.full(n * BLOCK - len(ids), ids[(n - 1) * BLOCK :].min(), ids.dtype)).astype(np.uint32).reshape(n, BLOCK)
    least = full.min(1)
    rest = full - least[:, None]
    width = widths(np.partition(rest, BLOCK * PERCENTILE // 100, axis=1)[:, BLOCK * PERCENTILE // 100]).astype(np.int64)
    odd = rest >> width[:, None].astype(np.uint32) > 0
    odd_n = odd.sum(1)
    size = 7 + width * BLOCK // 8 + 6 * odd_n
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)

    def put(at: np.ndarray, rows: np.ndarray) -> None:
        out[at[:, None] + np.arange(rows.shape[1])] = rows

    put(start, least.astype("<u4").view(np.uint8).reshape(n, 4))
    put(start + 4, np.column_stack([width, odd_n & 255, odd_n >> 8]).astype(np.uint8))
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        if w:
            value, words = np.ascontiguousarray(rest[rows].T) & np.uint32((1 << w) - 1), np.zeros((w * BLOCK // 32 + 1, len(rows)), np.uint32)
            for i in range(BLOCK):
                word, bit = divmod(i * w, 32)
                words[word] |= value[i] << np.uint32(bit)
                if bit + w > 32:
                    words[word + 1] |= value[i] >> np.uint32(32 - bit)
            put(start[rows] + 7, np.ascontiguousarray(words[:-1].T).astype("<u4").view(np.uint8))
    block, place = np.nonzero(odd)
    if len(block):
        nth = np.arange(len(block)) - np.repeat(np.cumsum(odd_n) - odd_n, odd_n)
        after = start[block] + 7 + width[block] * BLOCK // 8
        put(after + 2 * nth, place.astype("<u2").view(np.uint8).reshape(-1, 2))
        put(after + 2 * odd_n[block] + 4 * nth, rest[block, place].astype("<u4").view(np.uint8).reshape(-1, 4))
    return start.astype(np.uint32), out.tobytes()


def unpack(starts: np.ndarray, blocks: bytes | np.ndarray, n: int) -> np.ndarray:
    """The first n ids of these blocks."""
    data, start = np.frombuffer(blocks, np.uint8), starts.astype(np.int64)
    out = np.zeros((len(start), BLOCK), np.uint32)
    if not len(start):
        return out.reshape(-1)[:n]
    get = lambda at, k: data[at[:, None] + np.arange(k)]
    least = get(start, 4).copy().view("<u4")[:, 0]
    head = get(start + 4, 3).astype(np.int64)
    width, odd_n = head[:, 0], head[:, 1] | head[:, 2] << 8
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        if w:
            words = get(start[rows] + 7, w * BLOCK // 8).view("<u4").T
            words = np.vstack([words, np.zeros((1, len(rows)), np.uint32)])
            value, mask = np.empty((BLOCK, len(rows)), np.uint32), np.uint32((1 << w) - 1)
            for i in range(BLOCK):
                word, bit = divmod(i * w, 32)
                value[i] = words[word] >> np.uint32(bit)
                if bit + w > 32:
                    value[i] |= words[word + 1] << np.uint32(32 - bit)
            value = (value & mask).T
            out[rows] = value
    block = np.repeat(np.arange(len(start)), odd_n)
    if len(block):
        nth = np.arange(len(block)) - np.repeat(np.cumsum(odd_n) - odd_n, odd_n)
        after = start[block] + 7 + width[block] * BLOCK // 8
        place = get(after + 2 * nth, 2).copy().view("<u2")[:, 0]
        out[block, place] = get(after + 2 * odd_n[block] + 4 * nth, 4).copy().view("<u4")[:, 0]
    return (out + least[:, None]).reshape(-1)[:n]


def to_file(docs: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    starts, blocks = pack(ids)
    head = np.array([len(docs), len(ids), BLOCK, len(starts), len(blocks)], "<u8").tobytes()
    known = np.array([_NULL if d is None else d for d in docs], "<i8").tobytes()
    return b"".join([_MAGIC, head, known, np.array(counts, "<u4").tobytes(), starts.astype("<u4").tobytes(), blocks])


def from_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, their numbers of ids, all ids)."""
    if data[:8] != _MAGIC:
        raise ValueError("not a token file")
    n, ids, _, blocks, size = np.frombuffer(data, "<u8", 5, 8).tolist()
    at = 48
    docs = [None if d == _NULL else d for d in np.frombuffer(data, "<i8", n, at).tolist()]
    counts = np.frombuffer(data, "<u4", n, at := at + 8 * n).astype(np.int64)
    starts = np.frombuffer(data, "<u4", blocks, at := at + 4 * n)
    return docs, counts, unpack(starts, np.frombuffer(data, np.uint8, size, at + 4 * blocks), ids)


class Tokens(dict):
    """Ids of texts by a byte-level tokenizer that splits by its usual rule.

    A text is cut before each single space between other characters, where that rule cuts too; a chunk's ids are remembered, and forgotten when it isn't asked
    for in a while. A chunk of letters, or its part before marks or a line end, is one piece of the rule: the tokenizer's model gets it as it is. Other
    tokenizers, and texts with more white space beside a space or with special tokens, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = t = Tokenizer.from_file(path)
        self.special = [x.content for x in t.get_added_tokens_decoder().values()]
        self.simple = t.normalizer is None and str(t.pre_tokenizer).startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in str(t.pre_tokenizer)
        self.piece, self.older, self.bare = t.model.tokenize, {}, {}
        self.kind = np.uint16 if t.get_vocab_size() <= 1 << 16 else np.uint32  # ids are kept in as few bytes as they need
        self.shown = [""] * 256  # how the byte-level rule writes each byte
        rule = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        for c in map(chr, [*range(0x800), *range(0x800, 0xD800, 0x40), *range(0xE000, 0x110000, 0x400)]):
            for b, x in zip(c.encode(), rule.pre_tokenize_str(c)[0][0]):
                self.shown[b] = x
        self.space, self.code = self.shown[32], "H" if self.kind is np.uint16 else "I"

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def letters(self, text: str, before: str = "") -> bytes:
        shown = text if text.isascii() else text.encode().decode("latin-1").translate(self.shown)
        return array(self.code, [t.id for t in self.piece(before + shown)]).tobytes()

    def part(self, text: str) -> bytes:
        """The ids of letters, or of marks, without a space before."""
        found = self.bare.get(text)
        if found is None:
            if len(self.bare) >= _REMEMBERED // 8:
                self.bare.clear()
            found = self.letters(text) if text.isalpha() else self.whole(text)
            if len(text) <= _LONGEST:
                self.bare[text] = found
        return found

    def __missing__(self, chunk: str) -> bytes:
        """The ids of a space and the chunk, for a chunk that neither is empty nor has white space at an end nor a special token in it."""
        found = self.older.get(chunk)
        if found is None:
            if chunk.isascii() and chunk.isalpha():
                found = array(self.code, [t.id for t in self.piece(self.space + chunk)]).tobytes()
            elif chunk.isalpha():
                found = self.letters(chunk, self.space)
            elif not chunk or chunk[0].isspace() or chunk[-1].isspace() or any(s in chunk for s in self.special):
                raise KeyError(chunk)
            elif (m := _WITH_MARKS.fullmatch(chunk)) and m[1].isalpha() and m[1] != chunk and (m[4] or "a").isalpha():
                word, marks, line, after, last = m.groups()
                found = self[word] + (self.part(marks) if marks else b"") + (self.part(line) + self.part(after) if line else b"") + (self.part(last) if last else b"")
            else:
                found = self.whole(" " + chunk)
        if len(chunk) <= _LONGEST:
            if len(self) >= _REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[chunk] = found
        return found

    def head(self, first: str) -> bytes:
        """The ids of a text's first chunk, which has no space before it."""
        if first.isalpha():
            return self.part(first)
        if (m := _WITH_MARKS.fullmatch(first)) and not m[3] and m[1].isalpha():
            return self.part(m[1]) + self.part(m[2])
        return self.whole(first)

    def encode(self, text: str) -> np.ndarray:
        first, *rest = text.split(" ")
        if self.simple and first and rest and not first[-1].isspace() and not any(s in first for s in self.special):
            try:
                ids = b"".join(map(self.__getitem__, rest))
            except KeyError:
                ids = None
            if ids is not None:
                return np.frombuffer(self.head(first) + ids, self.kind)
        return np.frombuffer(self.whole(text), self.kind)


@cache
def tokens_of(path: str) -> Tokens:
    """One for each worker process, so that what a task remembers serves the next one."""
    return Tokens(path)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, encoder: Callable[[str], Tokens] = tokens_of, order: str = "doc_id", file_ids: int = FILE_IDS) -> DataFrame:
    """Writes each document's ids and end_id to files in folder, in ascending order of a column; (part, number, path, documents, ids) for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = encoder(tokenizer), TaskContext.get().partitionId()
        filesystem, base = _filesystem(folder)
        filesystem.create_dir(base, recursive=True)
        known, parts, counts, number = [], [], [], 0

        def flush() -> pa.RecordBatch:
            name = f"part-{part:06d}-{number:06d}-{uuid.uuid4().hex}.pfor"
            ids = np.concatenate(parts)
            with filesystem.open_output_stream(posixpath.join(base, name)) as out:
                out.write(to_file(known, counts, ids))
            return pa.record_batch([pa.array([part]), pa.array([number]), pa.array([f"{folder}/{name}"]), pa.array([len(known)]), pa.array([len(ids)])], names=["part", "number", "path", "documents", "ids"])

        held = 0
        for piece in pieces(batches, "text"):
            for doc, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                ids = np.append(tokens.encode(text or ""), tokens.kind(end_id))
                known.append(doc)
                parts.append(ids)
                counts.append(len(ids))
                held += len(ids)
                if held >= file_ids:
                    yield flush()
                    known, parts, counts, number, held = [], [], [], number + 1, 0
        if known:
            yield flush()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = F.col("doc_id").cast("long") if order == "doc_id" else F.col(order)
    keyed = docs.select(F.col("doc_id").cast("long"), "text", by.alias("by"))
    ranged = keyed.repartitionByRange(n, "by").sortWithinPartitions("by", "doc_id", "text").select("doc_id", "text")
    return durable(ranged.mapInArrow(run, "part long, number long, path string, documents long, ids long"), "files")


def read_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in files, which write_tokens() lists. start counts the ids of all documents before it."""
    before = F.sum("ids").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("ids")
    parts = files.groupBy("part").agg(F.sum("ids").alias("of_part"))
    earlier = F.sum("of_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("of_part")
    starts = files.withColumn("before", before).join(F.broadcast(parts.select("part", earlier.alias("earlier"))), "part")
    starts = durable(starts.select("path", (F.col("before") + F.col("earlier")).alias("start")), "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                filesystem, name = _filesystem(path)
                with filesystem.open_input_stream(name) as file:
                    docs, counts, ids = from_file(file.read())
                ids = ids.astype("<u4")
                ends = np.cumsum(counts)
                crc = [crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), counts.tolist())]
                yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(ends - counts + start), pa.array(counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, starts.count())
    return starts.repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None, order: str = "doc_id") -> DataFrame:
    """read_tokens(write_tokens()) over (doc_id, text), in folder or a fresh one in the shared folder.

    Documents go in ascending order of the column that order names. A null text is empty: its only id is end_id. Documents of equal order are ordered by doc_id
    and text, nulls come first. No documents make no files and no rows. Extra columns are left out.
    """
    return read_tokens(write_tokens(docs, tokenizer, folder or fresh_path(docs.sparkSession, "tokens"), end_id, order=order))
