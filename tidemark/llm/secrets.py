"""Scanning for secrets by regular expressions behind a trigram index.

1. `build_index`: each segment (neighbouring texts, some CHUNK bytes) gets posting lists: for each three bytes that follow each other in its texts, A-Z
   lower-cased, which texts have them. They are a table, sorted by trigram, that is written once and asked by any rules.
2. `query_of` derives from a rule's parsed pattern which trigrams a match must have, as and/or of trigrams: letters and small sets that follow each other are
   strung together, branches are alternatives, what may be absent or has many forms cuts the string. A pattern of which nothing is left has no query.
3. `candidates`: only the posting lists of the queries' trigrams are read; they meet by segment and are intersected and united.
4. `scan`: texts that are candidates are searched by their rules, and all texts by the rules without a query. A text is known by a 64-bit hash of it: equal texts
   are candidates for the same rules, and texts of one hash are searched once too often, never too seldom.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as kinds  # the parsed form of patterns
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checked_broadcast, durable, pieces, raw_bytes

#: Bytes of text of a segment, about, and rows of one at most; bytes of a text whose trigrams are sorted at a time.
SEGMENT_BYTES, SEGMENT_ROWS, STRETCH = 1 << 20, 1 << 14, 1 << 20
#: Strings that a part of a pattern may stand for before it is cut.
FORMS = 64
#: In place of a trigram: the row of a segment that has its texts' hashes.
DIRECTORY = -1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

Query = tuple | int | None


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, and the least length of one of its groups. Matches are leftmost ones that don't overlap; those that are too short are dropped.
    Patterns are read as ASCII: only A-Z have another case, and there are no other digits or spaces."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    flags: int = 0

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, self.flags | re.ASCII)


def _trigrams(strings: set[str]) -> Query:
    """Of any of these strings, all trigrams; None if one has none."""
    ways = []
    for s in strings:
        b = _FOLD[np.frombuffer(s.encode(), np.uint8)].tolist()
        grams = tuple(sorted({b[i] << 16 | b[i + 1] << 8 | b[i + 2] for i in range(len(b) - 2)}))
        if not grams:
            return None
        ways.append(grams[0] if len(grams) == 1 else ("and", *grams))
    ways = sorted(set(ways), key=str)
    return ways[0] if len(ways) == 1 else ("or", *ways)


def _both(a: Query, b: Query) -> Query:
    return b if a is None else a if b is None else ("and", a, b)


def _letters(items: list) -> set[str] | None:
    """The characters of a set, lower-cased where that is ASCII; None if there are many."""
    out: set[str] = set()
    for kind, value in items:
        if kind is kinds.LITERAL:
            out.add(chr(value))
        elif kind is kinds.RANGE and value[1] - value[0] < FORMS:
            out |= set(map(chr, range(value[0], value[1] + 1)))
        else:
            return None
    folded = {c.lower() if c < "\x80" else c for c in out}
    return folded if len(folded) <= 8 else None


def _read(parts, exact: set[str]) -> tuple[set[str] | None, Query]:
    """(the strings that parts may stand for after those of exact, or None where they were cut; the query of what was cut off)."""
    query = None

    def cut() -> None:
        nonlocal exact, query
        query, exact = _both(query, _trigrams(exact)), {""}

    whole = True
    for kind, value in parts:
        forms: set[str] | None = None
        inner: Query = None
        if kind is kinds.LITERAL:
            forms = {chr(value).lower() if value < 128 else chr(value)}
        elif kind is kinds.IN:
            forms = _letters(value)
        elif kind is kinds.SUBPATTERN:
            forms, inner = _read(value[3], {""})
        elif kind is kinds.BRANCH:
            found = [_read(b, {""}) for b in value[1]]
            if all(f is not None and q is None for f, q in found):
                forms = set().union(*(f for f, _ in found))
            else:
                ways = [_both(q, _trigrams(f) if f else None) for f, q in found]
                inner = None if None in ways else ("or", *ways)
        elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT):
            low, high, body = value
            one, q = _read(body, {""})
            if low:
                inner = q
            if one is not None and q is None and high == 1:
                forms = one | {""} if not low else one
            elif one is not None and q is None and low and low == high and len(one) ** low <= FORMS:
                forms = {""}
                for _ in range(low):
                    forms = {a + b for a in forms for b in one}
            elif low and one is not None and q is None:
                inner = _trigrams(one)
        elif kind is kinds.AT:
            continue
        if forms is not None and len(exact) * len(forms) > FORMS:
            cut()
            whole = False
        if forms is not None and len(forms) <= FORMS and inner is None:
            exact = {a + b for a in exact for b in forms}
            continue
        if forms is not None:
            inner = _both(inner, _trigrams(forms))
        cut()
        whole, query = False, _both(query, inner)
    if whole:
        return exact, None
    return None, _both(query, _trigrams(exact))


def query_of(rule: Rule) -> Query:
    """What a text must have to match: a trigram as a number, ("and", ...), ("or", ...), or None if nothing can be told."""
    exact, query = _read(parser.parse(rule.pattern, rule.flags | re.ASCII), {""})
    return query if exact is None else _trigrams(exact)


def trigrams_of(query: Query) -> set[int]:
    return set() if query is None else {query} if isinstance(query, int) else set().union(*map(trigrams_of, query[1:]))


def _distinct(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The texts' trigrams, sorted, as ``trigram << 24 | text's number``, each once a text."""
    found = []
    for lo in range(0, max(0, len(data) - 2), STRETCH):
        part = _FOLD[data[lo : lo + STRETCH + 2]].astype(np.int64)
        at = np.arange(lo, lo + len(part) - 2)
        doc = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 2 < offsets[doc + 1]
        key = (part[:-2] << 16 | part[1:-1] << 8 | part[2:]) << 24 | doc
        found.append(np.unique(key[inside]))
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0] if found else np.zeros(0, np.int64)


def _packed(texts: np.ndarray, n: int) -> bytes:
    """Numbers of texts below n: two bytes each, or a bit for each text if that is shorter."""
    if 2 * len(texts) < (n + 7) // 8:
        return b"\0" + texts.astype(np.uint16).tobytes()
    bits = np.zeros(n, bool)
    bits[texts] = True
    return b"\1" + np.packbits(bits).tobytes()


def _unpacked(posting: bytes, n: int) -> np.ndarray:
    if posting[0]:
        return np.unpackbits(np.frombuffer(posting, np.uint8, offset=1), count=n).astype(bool)
    bits = np.zeros(n, bool)
    bits[np.frombuffer(posting[1:], np.uint16)] = True
    return bits


def build_index(docs: DataFrame) -> DataFrame:
    """(segment, trigram, texts, posting), written: the trigrams of all texts of docs (text), and for each segment a row DIRECTORY with its texts' hashes. Null texts
    have none. A repeated text is in as many posting lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for large in pieces(batches, "text", SEGMENT_BYTES):
            for piece in (large.slice(i, SEGMENT_ROWS) for i in range(0, large.num_rows, SEGMENT_ROWS)):
                key = _distinct(*raw_bytes(piece.column("text")))
                gram, text, n = key >> 24, key & ((1 << 24) - 1), piece.num_rows
                cut = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(key) else np.zeros(0, np.int64)
                lists = [_packed(text[a:b], n) for a, b in zip(cut, np.append(cut[1:], len(text)))]
                hashes = np.asarray(piece.column("hash")).astype(np.int64).tobytes()
                grams = pa.array(np.append(gram[cut], DIRECTORY).astype(np.int32))
                segment = pa.array([uuid.uuid4().hex] * len(grams))
                yield pa.record_batch([segment, grams, pa.array(np.full(len(grams), n, np.int32)), pa.array([*lists, hashes], pa.binary())], names=["segment", "trigram", "texts", "posting"])

    rows = docs.select("text", F.xxhash64("text").alias("hash")).where("text is not null")
    rows = rows.mapInArrow(run, "segment string, trigram int, texts int, posting binary")
    return durable(rows.sortWithinPartitions("trigram", "segment"), "trigrams", "zstd")


def _evaluated(query: Query, lists: dict[int, np.ndarray], n: int) -> np.ndarray:
    if isinstance(query, int):
        return lists.get(query, np.zeros(n, bool))
    each = [_evaluated(q, lists, n) for q in query[1:]]
    return np.logical_and.reduce(each) if query[0] == "and" else np.logical_or.reduce(each)


def candidates(index: DataFrame, queries: list[Query]) -> DataFrame:
    """(hash, rules): texts that may match, and as bits the numbers of the queries that they fulfil. A segment's lists of these queries' trigrams meet in one row."""
    grams = sorted(set().union(*map(trigrams_of, queries)))
    wanted = index.where(F.col("trigram").isin(DIRECTORY, *grams))
    segments = wanted.groupBy("segment").agg(F.max("texts").alias("n"), F.collect_list("trigram").alias("trigrams"), F.collect_list("posting").alias("postings"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, grams, postings in zip(batch.column("n").to_pylist(), batch.column("trigrams").to_pylist(), batch.column("postings").to_pylist()):
                lists = dict(zip(grams, postings))
                hashes = np.frombuffer(lists.pop(DIRECTORY), np.int64)
                lists = {g: _unpacked(p, n) for g, p in lists.items()}
                bits = np.zeros(n, np.int64)
                for i, query in enumerate(queries):
                    if query is not None:
                        bits |= _evaluated(query, lists, n).astype(np.int64) << i
                some = np.flatnonzero(bits)
                yield pa.record_batch([pa.array(hashes[some]), pa.array(bits[some])], names=["hash", "rules"])

    found = segments.select("n", "trigrams", "postings").mapInArrow(run, "hash long, rules long")
    return found.groupBy("hash").agg(F.bit_or("rules").alias("rules"))


def scan(docs: DataFrame, rules: list[Rule], index: DataFrame | None = None) -> DataFrame:
    """(doc_id, spans (kind, start, end)) for each row of docs (doc_id, text): the matches of all rules (63 at most), by start, then in the rules' order. Places are
    code points, end is exclusive. index: build_index() of these or more texts, else it is built. A null or empty text has no spans. Ids may be null or repeat, equal
    rows have equal spans, other columns are left out. No rows give no rows.

    Candidates are sent to the texts if they are few, else texts and candidates meet by hash.
    """
    queries = [query_of(r) for r in rules]
    always = sum(1 << i for i, q in enumerate(queries) if q is None)
    asked = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    if any(q is not None for q in queries):
        found = candidates(build_index(docs) if index is None else index, queries)
        asked = asked.join(checked_broadcast(durable(found, "candidates")), "hash", "left")
    else:
        asked = asked.withColumn("rules", F.lit(0).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [r.compiled() for r in rules]
        for batch in pieces(batches, "text"):
            kind, start, end, ends = [], [], [], [0]
            for text, bits in zip(batch.column("text").to_pylist(), batch.column("rules").fill_null(0).to_pylist()):
                spans = []
                for i, rule in enumerate(rules):
                    if text and (bits | always) >> i & 1:
                        spans += [(m.start(), i, m.end()) for m in compiled[i].finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
                for a, i, b in sorted(spans):
                    kind.append(rules[i].kind)
                    start.append(a)
                    end.append(b)
                ends.append(len(kind))
            items = pa.StructArray.from_arrays([pa.array(kind, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["kind", "start", "end"])
            yield pa.record_batch([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)], names=["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return asked.select("doc_id", "text", "rules").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind: string, start: long, end: long>>")


#: The base kinds, then published forms of keys. hex has no trigram that a match must have.
BASE = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
]
MORE = [
    Rule("private_key", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("url_password", r"[a-z][a-z0-9+.-]{1,30}://[^\s/:@]{1,100}:[^\s/:@]{1,100}@"),
]
