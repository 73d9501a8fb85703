"""AVI files of motion JPEG: byte payloads in, frames, histograms and timed clips out.

A payload is stored losslessly: each byte is one quantised DCT coefficient of amplitude class 8, whose eight bits are the byte; 192 bytes are one minimum
coded unit of three 8x8 blocks, a restart interval of its own. The reader takes any AVI with baseline JPEG frames: it follows the RIFF lists to the index
(or walks ``movi`` where there is none), and entropy-decodes all restart intervals of all frames of a batch in step with one another.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable, pieces, raw_bytes

UNIT, FRAME_UNITS, FPS, BINS = 192, 64, 25, 32
#: Bytes that are stored or decoded in step.
AT_ONCE = 1 << 20
#: Frames before a frame whose differences set its threshold, standard deviations above their mean, and the least difference of a cut.
SPAN, SPREAD, LEAST = 12, 3.0, 0.08

#: The zigzag order of JPEG.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@cache
def _frame_head(units: int) -> bytes:
    one_code = bytes([1, *[0] * 15, 8])
    return b"".join([
        b"\xff\xd8", _segment(0xDB, b"\0" + b"\1" * 64), _segment(0xC0, struct.pack(">BHHB", 8, 8, 8 * units, 3) + b"".join(bytes([c, 0x11, 0]) for c in (1, 2, 3))),
        _segment(0xC4, b"\x00" + one_code), _segment(0xC4, b"\x10" + one_code), _segment(0xDD, b"\0\1"), _segment(0xDA, b"\3\1\0\2\0\3\0\0\x3f\0"),
    ])


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def to_avi(frames: list[bytes], width: int, height: int, fps: int = FPS) -> bytes:
    index, movi, at = [], [b"movi"], 4
    for f in frames:
        chunk = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(chunk)
        at += len(chunk)
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def store(data: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """An AVI for each of the payloads that data joins; sizes are multiples of UNIT."""
    units = data.reshape(-1, UNIT)
    bits = np.zeros((units.size, 9), np.uint8)
    bits[:, 1:] = np.unpackbits(units.reshape(-1)).reshape(-1, 8)
    coded = np.packbits(bits.reshape(len(units), -1), axis=1)
    n = sizes // UNIT
    within = np.arange(len(units)) - np.repeat(np.cumsum(n) - n, n)
    rows = np.column_stack([coded, np.full(len(units), 0xFF, np.uint8), (0xD0 + within % FRAME_UNITS % 8).astype(np.uint8)])
    stuffed = np.zeros(rows.shape, bool)
    stuffed[:, : coded.shape[1]] = coded == 0xFF
    length = rows.shape[1] + stuffed.sum(1)
    flat, more = rows.reshape(-1), stuffed.reshape(-1)
    place = np.arange(len(flat)) + np.cumsum(more) - more
    out = np.zeros(len(flat) + int(more.sum()), np.uint8)
    out[place] = flat
    out, ends = out.tobytes(), np.cumsum(length)
    media, first = [], 0
    for k in n.tolist():
        frames = []
        for u in range(first, first + k, FRAME_UNITS):
            m = min(FRAME_UNITS, first + k - u)
            frames.append(_frame_head(m) + out[int(ends[u - 1]) if u else 0 : int(ends[u + m - 1]) - 2] + b"\xff\xd9")
        media.append(to_avi(frames, 8 * min(FRAME_UNITS, k), 8))
        first += k
    return media


def frames_of(avi: bytes) -> tuple[float, list[tuple[int, int]]]:
    """(frames a second, place and size of each video chunk). Without a usable index, the chunks of ``movi`` in order. Not an AVI: no frames."""
    if len(avi) < 12 or avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        return 0.0, []
    rate, movi, index = float(FPS), None, b""
    todo = [(12, len(avi))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, size = avi[at : at + 4], struct.unpack_from("<I", avi, at + 4)[0]
            body, stop = at + 8, min(end, at + 8 + size)
            if name == b"LIST" and avi[body : body + 4] == b"movi":
                movi = (body, stop)
            elif name == b"LIST":
                todo.append((body + 4, stop))
            elif name == b"idx1":
                index = avi[body:stop]
            elif name == b"strh" and avi[body : body + 4] == b"vids" and stop - body >= 28:
                scale, per = struct.unpack_from("<II", avi, body + 20)
                rate = per / scale if scale and per else rate
            at = body + size + (size & 1)
    found: list[tuple[int, int]] = []
    if movi and index:
        for k in range(0, len(index) - 15, 16):
            name, _, at, size = struct.unpack_from("<4sIII", index, k)
            for base in (movi[0], 0):  # offsets count from ``movi`` or from the file's start
                if name[2:] in (b"dc", b"db") and avi[base + at : base + at + 4] == name:
                    found.append((base + at + 8, size))
                    break
    if movi and not found:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            name, size = avi[at : at + 4], struct.unpack_from("<I", avi, at + 4)[0]
            if name[2:] in (b"dc", b"db"):
                found.append((at + 8, min(size, movi[1] - at - 8)))
            at += 8 + size + (size & 1)
    return rate, found


class Head:
    """What a baseline JPEG's header says: size, blocks of a unit as (component, DC table, AC table), quantisers, restart interval, first byte of data."""

    def __init__(self, jpeg: bytes) -> None:
        at, self.interval, quantisers, codes, parts = 2, 0, {}, {}, {}
        while True:
            if jpeg[at] != 0xFF:
                raise ValueError("not a JPEG marker")
            marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
            body = jpeg[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                k = 0
                while k < len(body):
                    wide = body[k] >> 4
                    quantisers[body[k] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.int32)
                    k += 65 + 64 * bool(wide)
            elif marker == 0xC4:
                k = 0
                while k < len(body):
                    n = sum(body[k + 1 : k + 17])
                    codes[body[k]] = body[k + 1 : k + 17 + n]
                    k += 17 + n
            elif marker == 0xC0:
                _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                parts = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
            elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise ValueError("only baseline JPEG is read")
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                order = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
                break
        self.data = at
        self.blocks = tuple((i, t >> 4, 0x10 | t & 15) for i, (c, t) in enumerate(order) for _ in range(parts[c][0] * parts[c][1] if len(order) > 1 else 1))
        self.quantiser = np.stack([quantisers[parts[c][2]] for c, _ in order])
        most_h, most_v = (max(parts[c][i] for c, _ in order) if len(order) > 1 else 1 for i in (0, 1))
        self.units = -(-self.width // (8 * most_h)) * -(-self.height // (8 * most_v))
        self.codes = tuple(sorted((k, bytes(v)) for k, v in codes.items()))


@cache
def _lookup(codes: tuple[tuple[int, bytes], ...]) -> tuple[dict[int, int], np.ndarray]:
    """For each table, the symbol and the length (times 256) of the code that 16 bits begin with; 0 for none."""
    out = np.zeros((len(codes), 1 << 16), np.int32)
    for row, (_, table) in zip(out, codes):
        code, k = 0, 16
        for length in range(1, 17):
            for _ in range(table[length - 1]):
                row[code << (16 - length) : (code + 1) << (16 - length)] = table[k] | length << 8
                code, k = code + 1, k + 1
            code <<= 1
    return {name: i for i, (name, _) in enumerate(codes)}, out


def coefficients(jpegs: list[bytes], heads: list[Head]) -> list[np.ndarray]:
    """Quantised coefficients (blocks x 64, zigzag order) of frames whose heads have the same tables and blocks; damaged data end in zeros."""
    head = heads[0]
    where, table = _lookup(head.codes)
    raw = np.frombuffer(b"".join(j[h.data :] + b"\xff\xd9" for j, h in zip(jpegs, heads)), np.uint8)
    frame_end = np.cumsum([len(j) - h.data + 2 for j, h in zip(jpegs, heads)])
    mark = np.flatnonzero(raw[:-1] == 0xFF)
    follow = raw[mark + 1]
    restart = mark[(follow >= 0xD0) & (follow <= 0xD7)]
    keep = np.ones(len(raw), bool)
    keep[mark[follow == 0] + 1] = False
    place = np.cumsum(keep) - keep  # of each byte among those kept
    data = np.append(raw[keep], np.zeros(8, np.uint8)).astype(np.int32)
    start = np.sort(np.concatenate([np.append(0, frame_end[:-1]), restart + 2]))
    frame = np.searchsorted(frame_end, start, side="right")
    nth = np.arange(len(start)) - np.searchsorted(frame, np.arange(len(jpegs)))[frame]
    units = np.array([h.units for h in heads])[frame]
    each = np.array([h.interval or h.units for h in heads])[frame]
    todo = np.clip(units - nth * each, 0, each) * len(head.blocks)
    base = np.cumsum(todo) - todo
    out = np.zeros(int(todo.sum()) * 64, np.int16)
    kind = np.array([c for c, _, _ in head.blocks])
    tables = np.array([[where.get(d, 0), where.get(a, 0)] for _, d, a in head.blocks], np.int32)
    bit = place[np.minimum(start, len(place) - 1)].astype(np.int64) * 8
    last = np.int64(len(data) - 4) * 8
    block, k, alive = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), np.flatnonzero(todo > 0)
    before = np.zeros((len(start), kind.max() + 1), np.int32)
    flat = table.reshape(-1)

    def peek(at: np.ndarray) -> np.ndarray:
        p = at >> 3
        return ((data[p] << 16 | data[p + 1] << 8 | data[p + 2]) >> (8 - (at & 7)) & 0xFFFF).astype(np.int64)

    bit, block, k = bit[alive], block[alive], k[alive]
    while len(alive):
        b = block % len(head.blocks)
        code = flat[tables[b, (k > 0).astype(np.int64)] * (1 << 16) + peek(bit)]
        symbol, length = code & 255, code >> 8
        run, size = np.where(k > 0, symbol >> 4, 0), symbol & 15
        bit = bit + length
        value = (peek(np.minimum(bit, last)) >> (16 - size)).astype(np.int32)
        value = np.where((size > 0) & (value < (1 << size >> 1)), value - (1 << size) + 1, np.where(size > 0, value, 0))
        bit = bit + size
        at = k + run
        first = k == 0
        if first.any():
            rows = np.flatnonzero(first)
            before[alive[rows], kind[b[rows]]] += value[rows]
            value[rows] = before[alive[rows], kind[b[rows]]]
        put = np.flatnonzero(((size > 0) | first) & (at < 64))
        out[(base[alive[put]] + block[put]) * 64 + at[put]] = value[put]
        k = np.where((symbol == 0) & ~first, 64, at + 1)
        done = k > 63
        k, block = np.where(done, 0, k), block + done
        live = (block < todo[alive]) & (length > 0) & (bit < last)
        if not live.all():
            alive, bit, block, k = alive[live], bit[live], block[live], k[live]
    ends = np.cumsum([h.units * len(head.blocks) for h in heads])
    total = np.bincount(frame, weights=todo, minlength=len(heads)).astype(np.int64)
    if (total == np.diff(np.append(0, ends))).all():
        return np.split(out.reshape(-1, 64), ends[:-1])
    parts = np.split(out.reshape(-1, 64), np.cumsum(total)[:-1])
    return [np.concatenate([p, np.zeros((h.units * len(head.blocks) - len(p), 64), np.int16)]) for p, h in zip(parts, heads)]


@cache
def _inverse() -> np.ndarray:
    """The inverse DCT as a 64 x 64 matrix of whole numbers, times 2**16: sums are exact, so equal blocks give equal samples in any batch."""
    i = np.arange(8)
    basis = np.cos((2 * i[:, None] + 1) * i[None] * np.pi / 16) * np.where(i == 0, np.sqrt(1 / 8), 0.5)
    full = np.einsum("xu,yv->uvxy", basis, basis).reshape(64, 64)
    return np.round(full[ZIGZAG] * 65536)


def samples(blocks: np.ndarray, quantiser: np.ndarray) -> np.ndarray:
    """8-bit samples (blocks x 64, row by row) of coefficient blocks."""
    return np.clip(np.floor((blocks.astype(np.float64) * quantiser) @ _inverse() / 65536 + 128.5), 0, 255).astype(np.uint8)


def decode(jpegs: list[bytes]) -> list[tuple[Head, np.ndarray] | None]:
    """(head, coefficients) of each frame, None for one that isn't baseline JPEG. Frames of the same tables are decoded together."""
    out: list = [None] * len(jpegs)
    alike: dict[tuple, list[tuple[int, Head]]] = {}
    for i, j in enumerate(jpegs):
        try:
            h = Head(j)
        except (ValueError, IndexError, KeyError, struct.error):
            continue
        alike.setdefault((h.codes, h.blocks), []).append((i, h))
    for group in alike.values():
        for (i, h), c in zip(group, coefficients([jpegs[i] for i, _ in group], [h for _, h in group])):
            out[i] = (h, c)
    return out


def histograms(frames: list[tuple[Head, np.ndarray] | None]) -> np.ndarray:
    """Shares of the first component's samples in BINS classes, by frame; zeros for a frame that can't be read."""
    out = np.zeros((len(frames), BINS))
    good = [i for i, f in enumerate(frames) if f is not None and f[0].units]
    if good:
        luma = [f[1][np.array([c == 0 for c, _, _ in f[0].blocks] * f[0].units)] for f in (frames[i] for i in good)]
        quantiser = np.concatenate([np.broadcast_to(frames[i][0].quantiser[0], (len(x), 64)) for i, x in zip(good, luma)])
        which = np.repeat(good, [len(x) for x in luma])
        values = samples(np.concatenate(luma), quantiser) // (256 // BINS)
        out = np.bincount((which[:, None] * BINS + values).reshape(-1), minlength=out.size).reshape(out.shape).astype(float)
        out /= np.maximum(out.sum(1, keepdims=True), 1)
    return out


def cuts(shares: np.ndarray) -> list[int]:
    """First frames of shots: where the difference to the frame before is above the mean of the SPAN differences before it by SPREAD deviations, and LEAST."""
    found, change = [0] if len(shares) else [], np.abs(np.diff(shares, axis=0)).sum(1) / 2
    since = 0
    for t, d in enumerate(change):
        known = change[max(since, t - SPAN) : t]
        if d > max(LEAST, known.mean() + SPREAD * known.std() if len(known) else 0.5):
            found.append(t + 1)
            since = t + 1
    return found


def payloads(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, each filled up with spaces to a positive multiple of UNIT; sizes before; sizes after)."""
    data, offsets = raw_bytes(texts)
    size = np.diff(offsets)
    full = np.maximum(1, -(-size // UNIT)) * UNIT
    out = np.full(int(full.sum()), 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.cumsum(full) - full - offsets[:-1], size)] = data
    return out, size, full


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) for each row of docs (doc_id, text): the text as an AVI. A null text is empty. Extra columns are left out.

    stored() writes them to the shared folder; what reads them gets what was stored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", AT_ONCE):
            data, size, full = payloads(piece.column("text"))
            yield pa.record_batch([piece.column("doc_id"), pa.array(size), pa.array(store(data, full), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def stored(media: DataFrame) -> DataFrame:
    """media as it comes back from the shared folder, where it lies compressed: the coded bits shift by one each byte, which hides repeats from faster codecs."""
    return durable(media, "media", compression="zstd")


def _watched(piece: pa.RecordBatch) -> Iterator[tuple[int, bytes, float, list, np.ndarray]]:
    """(row, media, frames a second, decoded frames, histogram shares) of each row."""
    media = [x or b"" for x in piece.column("media").to_pylist()]
    found = [frames_of(m) for m in media]
    frames = decode([m[a : a + n] for m, (_, at) in zip(media, found) for a, n in at])
    shares, first = histograms(frames), 0
    for i, (m, (rate, at)) in enumerate(zip(media, found)):
        yield i, m, rate, frames[first : first + len(at)], shares[first : first + len(at)]
        first += len(at)


def clips(media: DataFrame) -> DataFrame:
    """(doc_id, clip, first_frame, frames, start_s, end_s) for each shot of each row of media (doc_id, media).

    Null, empty and foreign media give no rows; a frame that can't be read has an empty histogram. Repeated rows give repeated clips.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "media", AT_ONCE):
            ids, rows = piece.column("doc_id").to_pylist(), []
            for i, _, rate, frames, shares in _watched(piece):
                first = cuts(shares)
                rows += [(ids[i], k, a, b - a, a / rate, b / rate) for k, (a, b) in enumerate(zip(first, [*first[1:], len(frames)]))]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.record_batch([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=["doc_id", "clip", "first_frame", "frames", "start_s", "end_s"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, clip long, first_frame long, frames long, start_s double, end_s double")


def payload_of(frames: list[tuple[Head, np.ndarray] | None]) -> bytes:
    """The bytes that store() put into these frames."""
    if not frames or any(f is None for f in frames):
        return b""
    c = np.concatenate([f[1] for f in frames]).reshape(-1)
    return np.where(c > 0, c, c + 255).astype(np.uint8).tobytes()


def digests(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, clips) read from the media of store_texts().

    feature tells the frames, the shots and their first frames, and a checksum of the histograms in thousandths; clips has the times of all shots. Null media
    have an empty payload, no frames and no clips. Equal media give equal values; repeated rows are answered as often.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "media", AT_ONCE):
            rows = []
            for _, m, rate, frames, shares in _watched(piece):
                p, first = payload_of(frames), cuts(shares)
                told = f"mjpeg;fps={rate:g};frames={len(frames)};shots={len(first)};at={'.'.join(map(str, first))};histogram={crc32(np.round(shares * 1000).astype('<u2').tobytes()):08x}"
                shots = [{"first_frame": a, "frames": b - a, "start_s": a / rate, "end_s": b / rate} for a, b in zip(first, [*first[1:], len(frames)])]
                rows.append((len(p), sha256(p).hexdigest(), crc32(p[-16:]), len(m), sha256(m).hexdigest(), told, shots))
            shot = pa.struct([("first_frame", pa.int64()), ("frames", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64())])
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(shot))
            yield pa.record_batch(
                [piece.column("doc_id"), piece.column("n_bytes"), *(pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds))],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"],
            )

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema += ", clips array<struct<first_frame: long, frames: long, start_s: double, end_s: double>>"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
