"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Reading cuts archives into splits. A task looks for the magic in its split and parses what follows as a record head; each that parses is a candidate whose
head says where its successor begins. Payloads may hold the magic too, even whole records; so only what is reachable from a file's first byte counts. Within
a split, a task follows the chain by itself and says where each candidate leaves the split; between splits, pointer jumping doubles the distance each round:
the candidates that are reached, and where 1, 2, 4, ... hops lead to. Last, each split is walked from the place where the chain enters it, and only the payloads of
records that are reached are read and hashed: what a payload holds, however often it claims to begin a record, costs no more than its heads.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from hashlib import sha1

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable, fresh_path, small_enough

#: Payload bytes from which equal payloads are stored once; bytes of an archive after which a new one is begun; bytes of a split.
REVISIT_BYTES, FILE_BYTES, SPLIT_BYTES = 1000, 64 << 20, 16 << 20
#: Repeated digests that are sent to all tasks at most (some 100 bytes each), and shares that a digest's pages are dealt to beyond that.
BROADCAST_DIGESTS, SALTS = 400_000, 16
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
#: Bytes that are read on from a split's end, or from what is read of a longer head, each time twice as many.
_READ_BYTES = 1 << 16


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, digest, refers_to): of equal payloads of at least so many bytes, all but those of the largest page_id refer to it.

    A null html is empty. Rows that repeat the largest page_id are all responses. Only digests are shuffled, with a sum per task first; the pages themselves
    are not, unless there are too many repeated digests to broadcast: then by digest and a salt.
    """
    text = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long"), "url", text.alias("html"), F.sha1(F.encode(text, "UTF-8")).alias("digest"))
    large = F.octet_length("html") >= least
    groups = pages.where(large).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1").select("digest", "keep")
    groups = durable(groups, "repeats")
    if small_enough(groups, BROADCAST_DIGESTS):
        joined = pages.join(F.broadcast(groups), "digest", "left")
    else:
        salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = pages.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left")
    refers = F.when(large & F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep"))
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record. The block is an HTTP response; a revisit has its head only, whose Content-Length is the payload's."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if refers_to is not None else b"response"), b"WARC-Record-ID: <urn:page:%s>" % str("" if page_id is None else page_id).encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url).encode("utf-8", "surrogatepass"))
    head += [b"WARC-Date: " + date.encode(), b"WARC-Payload-Digest: sha1:" + digest.encode()]
    if refers_to is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:%d>" % refers_to]
    head += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes with_revisits() rows to archives in folder; (path, bytes, records) for each. A task that runs again writes to new paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _filesystem(folder)
        filesystem.create_dir(base, recursive=True)
        out, done = None, []
        for batch in batches:
            for page_id, url, html, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc", 0, 0
                    out = filesystem.open_output_stream(posixpath.join(base, name))
                data = record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers, date)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((f"{folder}/{name}", size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, n))
        yield pa.record_batch([pa.array([d[i] for d in done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "bytes", "records"])

    return durable(pages.mapInArrow(run, "path string, bytes long, records long"), "archives")


#: What a candidate's head says, and where its block is.
_FIELDS = (("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("declared", pa.string()), ("body", pa.int64()), ("length", pa.int64()))
_TOLD = "path string, at long, page_id long, record_type string, refers_to long, url string"


def parse(head: bytes) -> dict[bytes, bytes] | None:
    """Fields of a record's head by lower-case name, without the first line; None if it isn't one."""
    lines = head.split(b"\r\n")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name or b" " in name:
            return None
        fields[name.strip().lower()] = value.strip()
    return fields if fields.get(b"content-length", b"").isdigit() and b"warc-type" in fields else None


def _number(x: bytes) -> int | None:
    digits = re.fullmatch(rb"<urn:page:(-?\d+)>", x)
    return int(digits[1]) if digits else None


def candidates(files: DataFrame) -> DataFrame:
    """A row for all that parses as a record at the magic: (path, bytes, split, at, next, leaves, fields). leaves is the first place outside the split that its chain
    comes to, null if the chain breaks off."""
    splits = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(bytes - 1) div {SPLIT_BYTES}"))).alias("split"))
    n = max(1, splits.count())

    def scan(file, size: int, start: int, end: int) -> list[tuple]:
        file.seek(start)
        data, step = file.read(min(size, end + _READ_BYTES) - start), _READ_BYTES
        rows = []
        # what the chain comes to has a blank line before it; so heads don't overlap and all of them are parsed in one pass
        for at in [m.start() for m in _MAGIC.finditer(data) if m.start() < 4 or data[m.start() - 4 : m.start()] == b"\r\n\r\n"]:
            if at >= end - start:
                break
            stop = data.find(b"\r\n\r\n", at + 8)
            while stop < 0 and start + len(data) < size:
                seen = max(at + 8, len(data) - 3)
                file.seek(start + len(data))
                more = file.read(min(step, size - start - len(data)))
                if not more:
                    break
                data, step = data + more, 2 * step
                stop = data.find(b"\r\n\r\n", seen)
            if stop < 0:
                break
            fields = parse(data[at:stop])
            if fields is None:
                continue
            body, length = stop + 4, int(fields[b"content-length"])
            after = start + body + length + 4
            if after > size:
                continue
            if body + length + 4 <= len(data):
                tail = data[body + length : body + length + 4]
            else:
                file.seek(after - 4)
                tail = file.read(4)
            if tail != b"\r\n\r\n":
                continue
            url, text = fields.get(b"warc-target-uri"), lambda name: fields.get(name, b"").decode("utf-8", "replace")
            told = (_number(fields.get(b"warc-record-id", b"")), text(b"warc-type"), _number(fields.get(b"warc-refers-to", b"")), url and url.decode("utf-8", "replace"), text(b"warc-payload-digest"), start + body, length)
            rows.append((start + at, after, told))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, split in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "split"))):
                filesystem, name = _filesystem(path)
                start, end = split * SPLIT_BYTES, min(size, (split + 1) * SPLIT_BYTES)
                with filesystem.open_input_file(name) as file:
                    rows = scan(file, size, start, end)
                leaves: dict[int, int | None] = {}
                for at, after, _ in reversed(rows):
                    leaves[at] = after if after >= end else leaves.get(after)
                k = len(rows)
                columns = [pa.array([path] * k, pa.string()), pa.array([size] * k, pa.int64()), pa.array([split] * k, pa.int64()), *(pa.array(x, pa.int64()) for x in ([r[0] for r in rows], [r[1] for r in rows], [leaves[r[0]] for r in rows]))]
                columns += [pa.array([r[2][i] for r in rows], kind) for i, (_, kind) in enumerate(_FIELDS)]
                yield pa.record_batch(columns, names=["path", "bytes", "split", "at", "next", "leaves", *(f for f, _ in _FIELDS)])

    schema = "path string, bytes long, split long, at long, next long, leaves long, page_id long, record_type string, refers_to long, url string, declared string, body long, length long"
    return splits.repartition(n, "path", "split").mapInArrow(run, schema)


def entered(found: DataFrame) -> DataFrame:
    """(path, at) of the candidates at which the chain from each file's start enters a split, by pointer jumping."""
    jump = durable(found.select("path", "at", F.col("leaves").alias("to")), "jumps")
    reached = found.where("at = 0").select("path", "at")
    while True:
        more = reached.join(jump, ["path", "at"]).select("path", F.col("to").alias("at")).where("at is not null").join(jump.select("path", "at"), ["path", "at"], "left_semi")
        grown = durable(reached.union(more).distinct(), "reached")
        if grown.count() == reached.count():
            return grown
        reached = grown
        onward = jump.select("path", F.col("at").alias("to"), F.col("to").alias("further"))
        jump = durable(jump.join(onward, ["path", "to"], "left").select("path", "at", F.col("further").alias("to")), "jumps")


def with_payloads(records: DataFrame) -> DataFrame:
    """records (path, at, page_id, record_type, refers_to, url, declared, body, length) with payload_bytes and payload_digest: of the block after its HTTP head, or as
    a revisit's head says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, file = None, None
        for batch in batches:
            told = []
            for path, kind, declared, body, length in zip(*(batch.column(c).to_pylist() for c in ("path", "record_type", "declared", "body", "length"))):
                if path != opened:
                    if file is not None:
                        file.close()
                    filesystem, name = _filesystem(path)
                    opened, file = path, filesystem.open_input_file(name)
                file.seek(body)
                block = file.read(length)
                if kind == "revisit":  # its block has only the head of what it refers to
                    said = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", block)
                    told.append((int(said[1]) if said else 0, declared.removeprefix("sha1:")))
                else:
                    payload = memoryview(block)[block.find(b"\r\n\r\n") + 4 :] if b"\r\n\r\n" in block else block
                    told.append((len(payload), sha1(payload).hexdigest()))
            kept = [batch.column(c) for c in ("path", "at", "page_id", "record_type", "refers_to", "url")]
            yield pa.record_batch([*kept, pa.array([n for n, _ in told], pa.int64()), pa.array([d for _, d in told], pa.string())], schema=pa.schema([*(batch.schema.field(c) for c in ("path", "at", "page_id", "record_type", "refers_to", "url")), pa.field("payload_bytes", pa.int64()), pa.field("payload_digest", pa.string())]))
        if file is not None:
            file.close()

    return records.mapInArrow(run, f"{_TOLD}, payload_bytes long, payload_digest string")


def read_archives(files: DataFrame) -> DataFrame:
    """(path, at, page_id, record_type, refers_to, url, payload_bytes, payload_digest) of each record of files (path, bytes); of a revisit, as its head says.

    An archive that is cut off, or broken at some place, gives the records before that place. Empty archives give none.
    """
    found = durable(candidates(files.where("bytes > 0")), "candidates")
    marked = found.join(entered(found).withColumn("entry", F.lit(True)), ["path", "at"], "left")
    names = ["path", "at", *(f for f, _ in _FIELDS)]

    def walk(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        at, after = group.column("at").to_numpy(), group.column("next").to_numpy()
        row = {a: i for i, a in enumerate(at.tolist())}
        kept = []
        for i in np.flatnonzero(group.column("entry").fill_null(False).to_numpy(zero_copy_only=False)).tolist():
            while i is not None:
                kept.append(i)
                i = row.get(int(after[i]))
        return group.select(names).take(pa.array(sorted(set(kept)), pa.int64()))

    reached = marked.select("split", "next", "entry", *names).groupBy("path", "split").applyInArrow(walk, f"{_TOLD}, declared string, body long, length long")
    return with_payloads(reached)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """read_archives() of what write_archives() makes of pages (page_id, url, html) in folder or a fresh one in the shared folder.

    Null html is an empty payload, a null page_id or url is left out of the head and comes back null, repeated rows are records each, and urls and texts may be
    of any length. Extra columns are left out. No pages make no archives and no rows. Fails if an archive gives another number of records than were written.
    """
    files = write_archives(with_revisits(pages), folder or fresh_path(pages.sparkSession, "warc"))
    found = durable(read_archives(files), "records")
    read = found.groupBy("path").agg(F.count(F.lit(1)).alias("read"))
    lost = files.join(read, "path", "left").where(F.coalesce("read", F.lit(0)) != F.col("records")).select("path", "records", "read").limit(5).collect()
    if lost:
        raise ValueError(f"archives with other records than were written: {lost}")
    return found
