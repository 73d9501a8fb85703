"""Window and series plots as gray images, and a plain patch encoder: the Python boundary, in Arrow batches."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame

from tidemark.operators.tokens import keep_heap, nested

#: Figures, and the capitals of the plots' names, of 3 x 5 dots, row by row.
_FIGURES = {
    "0": "111101101101111", "1": "010110010010111", "2": "111001111100111", "3": "111001011001111", "4": "101101111001001", "5": "111100111001111",
    "6": "111100111101111", "7": "111001010010010", "8": "111101111101111", "9": "111101111001111", "-": "000000111000000", ".": "000000000000010", "e": "000111101110011", "+": "000010111010000",
    "A": "010101111101101", "E": "111100111100111", "I": "111010010010111", "L": "100100100100111", "M": "101111111101101", "R": "110101110101101", "S": "011100010001110",
    "T": "111010010010010", "U": "101101101101111", "V": "101101101101010", " ": "000000000000000",
}


#: Width of the line and side of the points' squares in pixels: 1 and 0.1 points of a plot of 100 dots an inch.
LINE, MARK = 100 / 72, 10 / 72
#: Windows that are drawn together: one, so that what is made of their edges stays in a core's cache.
DRAWN = 1


def _outlines(values: np.ndarray, height: int, width: int, low: float | None, high: float | None, line: float, mark: float) -> np.ndarray:
    """Edges (n, x, y of both ends) of the line's segments, as rectangles, and of the points' squares, all of one turn; y grows downwards."""
    values = np.asarray(values, float)
    known = np.isfinite(values)
    if not known.any():
        return np.zeros((0, 2, 2))
    low, high = values[known].min() if low is None else low, values[known].max() if high is None else high
    x = np.linspace(0, width, len(values))[known] if len(values) > 1 else np.array([width / 2])
    y = (1 - (values[known] - low) / (high - low)) * height if high > low else np.full(len(x), height / 2)
    at = np.stack([x, np.clip(y, -1e6, 1e6)], 1)
    along = np.diff(at, axis=0)
    aside = np.stack([-along[:, 1], along[:, 0]], 1) * (line / 2 / np.hypot(*along.T))[:, None]
    shapes = [np.stack([at[:-1] + aside, at[1:] + aside, at[1:] - aside, at[:-1] - aside], 1)] if line > 0 else []
    if mark > 0:
        shapes.append(at[:, None] + np.array([[-1, 1], [1, 1], [1, -1], [-1, -1]]) * (mark / 2))
    return np.concatenate([np.stack([s, np.roll(s, -1, 1)], 2).reshape(-1, 2, 2) for s in shapes]) if shapes else np.zeros((0, 2, 2))


def _split(of: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each whole number from low to high (not included) of each item: the item and the number."""
    size = np.maximum(high - low, 0)
    item = np.repeat(of, size)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)


def rasters(windows: list[np.ndarray], height: int = 224, width: int = 224, low: float | None = 0.0, high: float | None = 1.0, line: float = LINE, mark: float = MARK) -> np.ndarray:
    """Black lines on white from the left edge to the right with a square at each point: gray values 0 to 1 by image, row and column.

    A pixel's ink is the exact area of it that each segment and square covers, added up, 1 at most. Missing points are left out, so that the line goes on from the point
    before to the one behind. What is beyond low or high is beyond the image; low or high None: the least or greatest value. A lone point is its square, equal
    values are a line in the middle.

    Every edge is cut at the borders of rows and columns. A piece covers what is right of it in its row, so the sum of the pieces along a row, with their signs, is the
    area covered.
    """
    edges = [_outlines(w, height, width, low, high, line, mark) for w in windows]
    image = np.repeat(np.arange(len(windows)), [len(e) for e in edges])
    edges = np.concatenate(edges) if edges else np.zeros((0, 2, 2))
    across = edges[:, 0, 1] != edges[:, 1, 1]  # level ones cover nothing of a row
    image, edges = image[across], edges[across]
    pad = int(np.ceil(max(line, mark))) + 1
    edges[:, :, 0] += pad
    wide = width + 2 * pad + 1
    # what goes up counts against what goes down
    sign = np.where(edges[:, 1, 1] >= edges[:, 0, 1], 1.0, -1.0)
    up = sign < 0
    edges[up] = edges[up][:, ::-1]
    (x0, y0), (x1, y1) = edges[:, 0].T, edges[:, 1].T
    slope = (x1 - x0) / (y1 - y0)
    edge, row = _split(np.arange(len(edges)), np.clip(np.floor(y0), 0, height).astype(np.int64), np.clip(np.ceil(y1), 0, height).astype(np.int64))
    from_y, slope, from_x = y0[edge], slope[edge], x0[edge]
    top, bottom = np.maximum(from_y, row), np.minimum(y1[edge], row + 1)
    a, b = (np.clip(from_x + (t - from_y) * slope, 0, wide - 1.001) for t in (top, bottom))
    deep, left, right = (bottom - top) * sign[edge], np.minimum(a, b), np.maximum(a, b)
    # cells go column by column, as an edge's pieces mostly lie one below the other
    start, first = np.floor(left), (image * (wide * height))[edge] + row
    many = right > start + 1  # most pieces are in one column
    one = ~many
    column, part = start[one], deep[one]
    place = first[one] + column.astype(np.int64) * height
    inner = part * ((left[one] + right[one]) / 2 - column)
    if many.any():
        left, right, deep, first, start = left[many], right[many], deep[many], first[many], start[many]
        piece, column = _split(np.arange(len(left)), start.astype(np.int64), np.ceil(right).astype(np.int64))
        begin, end, span = np.maximum(left[piece], column), np.minimum(right[piece], column + 1), (right - left)[piece]
        more = deep[piece] * ((end - begin) / span)
        place, part = np.concatenate([place, first[piece] + column * height]), np.concatenate([part, more])
        inner = np.concatenate([inner, more * ((begin + end) / 2 - column)])
    cells = len(windows) * height * wide
    ink = np.bincount(place, part - inner, cells) + np.bincount(place + height, inner, cells + height)[:cells]
    ink = np.abs(np.cumsum(ink.reshape(len(windows), wide, height), axis=1)[:, pad : pad + width])
    return np.ascontiguousarray((1 - np.minimum(ink, 1)).astype(np.float32).swapaxes(1, 2))


def raster(values: np.ndarray, height: int = 224, width: int = 224, low: float | None = 0.0, high: float | None = 1.0) -> np.ndarray:
    """One image of rasters."""
    return rasters([values], height, width, low, high)[0]


def ticks(low: float, high: float, most: int) -> np.ndarray:
    """At most so many round numbers from low to high: steps of 1, 2 or 5 times a power of ten."""
    if not high > low:
        return np.array([low])
    rough = (high - low) / max(1, most - 1)
    power = 10.0 ** np.floor(np.log10(rough))
    step = next(power * k for k in (1, 2, 5, 10) if power * k >= rough * (1 - 1e-9))
    return np.arange(np.ceil(low / step - 1e-9), np.floor(high / step + 1e-9) + 1) * step + 0.0


def label(text: str, size: int = 2) -> np.ndarray:
    """Figures as ink (1) on paper (0)."""
    dots = [np.array(list(_FIGURES.get(c, "0" * 15)), np.uint8).reshape(5, 3) for c in text]
    return np.kron(np.hstack([np.pad(d, ((0, 0), (0, 1))) for d in dots]), np.ones((size, size), np.uint8)).astype(np.float32)


def _clear_corner(area: np.ndarray, ink: np.ndarray, gap: int = 6) -> tuple[int, int]:
    """Row and column for ink in the corner of the area where it hides least; the upper right one of equal ones."""
    (height, width), (h, w) = area.shape, ink.shape
    places = [(r, c) for r in (gap, height - h - gap) for c in (width - w - gap, gap)]
    return min(places, key=lambda at: round(float((1 - area[at[0] : at[0] + h, at[1] : at[1] + w]).sum()), 3))


def plot(index: np.ndarray, values: np.ndarray, height: int = 342, width: int = 1200, names: tuple[str, str, str] = ("TIME SERIES", "TIME", "VALUE")) -> np.ndarray:
    """A series against its index, with axes: numbered ticks at round places and unnumbered ones between them, so that indices can be read off.

    names: the line's, over the plot and in the legend, which goes where it hides least of the line; and those of both axes.
    """
    known, (left, below, above) = np.isfinite(values), (90, 44, 20)
    index, values = np.asarray(index, float)[known], np.asarray(values, float)[known]
    wide, tall, canvas = width - left, height - below - above, np.ones((height, width), np.float32)
    out = canvas[above:]  # rows count from the top of the plot's area
    out[:tall, left], out[tall - 1, left:] = 0, 0

    def put(ink: np.ndarray, row: int, col: int, on: np.ndarray = out) -> None:
        row, col = max(0, min(row, on.shape[0] - ink.shape[0])), max(0, min(col, on.shape[1] - ink.shape[1]))
        on[row : row + ink.shape[0], col : col + ink.shape[1]] = np.minimum(on[row : row + ink.shape[0], col : col + ink.shape[1]], 1 - ink)

    title, across_name, up_name = (label(x) for x in names)
    put(title, 4, left + (wide - title.shape[1]) // 2, canvas)
    put(across_name, tall + 28, left + (wide - across_name.shape[1]) // 2)
    put(np.rot90(up_name), (tall - up_name.shape[1]) // 2, 2)
    if not len(index):
        return canvas
    x_low, x_high, y_low, y_high = index.min(), index.max(), values.min(), values.max()
    across = lambda i: (np.asarray(i) - x_low) / ((x_high - x_low) or 1) * (wide - 1)
    down = lambda v: (1 - (np.asarray(v) - y_low) / ((y_high - y_low) or 1)) * (tall - 8) + 3
    x, y = across(index), down(values)
    edges = np.interp(np.arange(wide + 1) - 0.5, x, y)
    top, bottom = np.minimum(edges[:-1], edges[1:]), np.maximum(edges[:-1], edges[1:])
    column = np.clip(np.round(x).astype(int), 0, wide - 1)
    np.minimum.at(top, column, y)
    np.maximum.at(bottom, column, y)
    rows = np.arange(tall)[:, None]
    line = np.clip(np.maximum(top - rows, rows - bottom), 0, 1)
    out[:tall, left:] = np.minimum(out[:tall, left:], line)

    legend = np.pad(np.hstack([np.zeros((10, 26), np.float32), title]), 5)
    legend[9:11, 5:25] = 1
    legend[[0, -1]], legend[:, [0, -1]] = 1, 1
    area = out[: tall - 1, left + 1 :]
    row, col = _clear_corner(area, legend)
    area[row : row + legend.shape[0], col : col + legend.shape[1]] = 1 - legend

    major = ticks(x_low, x_high, 11)
    for i in major:
        at = left + int(round(float(across(i))))
        out[tall - 1 : tall + 6, at] = 0
        ink = label(f"{i:.0f}")
        put(ink, tall + 9, at - ink.shape[1] // 2)
    for i in (major[1:] + major[:-1]) / 2:
        out[tall - 1 : tall + 4, left + int(round(float(across(i))))] = 0
    for v in ticks(y_low, y_high, 5):
        at = int(round(float(down(v))))
        out[at, left - 6 : left] = 0
        ink = label(f"{v:.5g}")
        put(ink, at - 5, left - 9 - ink.shape[1])
    return canvas


def png(gray: np.ndarray) -> bytes:
    """An 8-bit gray PNG."""
    rows = np.round(np.clip(gray, 0, 1) * 255).astype(np.uint8)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    data = b"".join(b"\0" + r.tobytes() for r in rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", rows.shape[1], rows.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


class Encoder(Protocol):
    """Tokens (n x patches x dimensions), row by row of the grid, of n gray images (n x height x width, 0 to 1)."""

    def __call__(self, images: np.ndarray) -> np.ndarray: ...


class PatchEncoder:
    """Each square patch flattened and projected by fixed orthogonal directions. It stands in for a pretrained model, which users plug in."""

    def __init__(self, patch: int = 16, dims: int = 16, seed: int = 3) -> None:
        self.patch = patch
        self.directions = np.linalg.qr(np.random.default_rng(seed).normal(size=(patch * patch, dims)))[0]

    def __call__(self, images: np.ndarray) -> np.ndarray:
        p, (n, height, width) = self.patch, images.shape
        grid = images.reshape(n, height // p, p, width // p, p).swapaxes(2, 3).reshape(n, -1, p * p)
        return (1 - grid) @ self.directions + 1e-6


def images(windows: DataFrame, side: int = 224, low: float | None = 0.0, high: float | None = 1.0) -> DataFrame:
    """(series_id, window_id, image): 8-bit gray values, row by row. low or high None: each window's own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_heap()
        for b in batches:
            for at in range(0, len(b), DRAWN):
                part = b.iloc[at : at + DRAWN]
                drawn = np.round(rasters(part.points.tolist(), side, side, low, high) * 255).astype(np.uint8)
                yield part[["series_id", "window_id"]].assign(image=[x.tobytes() for x in drawn])

    return windows.mapInPandas(run, "series_id string, window_id long, image binary")


@lru_cache(maxsize=1)
def _made(maker: bytes) -> Encoder:
    """The encoder of a worker process, which lives on from task to task."""
    return cloudpickle.loads(maker)()


def _tokens(maker: bytes, images: np.ndarray) -> tuple[list[np.ndarray | None], list[str | None]]:
    """Each image's tokens, or None and the error. If the encoder fails on all together, they are encoded one by one."""
    try:
        toks = np.asarray(_made(maker)(images), float)
        if toks.ndim == 3 and len(toks) == len(images):
            return list(toks), [None] * len(toks)
        raise ValueError(f"tokens of shape {toks.shape} for {len(images)} images")
    except Exception as e:
        if len(images) == 1:
            return [None], [f"{type(e).__name__}: {e}"[:500]]
        each = [_tokens(maker, images[i : i + 1]) for i in range(len(images))]
        return [t[0] for t, _ in each], [e[0] for _, e in each]


def encoded(imaged: DataFrame, encoder: Callable[[], Encoder], side: int = 224, most: int = 16, profile: ResourceProfile | None = None) -> DataFrame:
    """(series_id, window_id, toks, error): a window's tokens, or what the encoder failed with, which doesn't end the job.

    encoder makes an Encoder, once in each worker process, which gets at most so many images at a time; their tokens leave the worker before the next ones are made.
    profile: what a task needs, such as a device.
    """
    maker = cloudpickle.dumps(encoder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_heap()
        for b in batches:
            for at in range(0, b.num_rows, most):
                part = b.slice(at, most)
                gray = np.stack([np.frombuffer(x.as_buffer(), np.uint8).reshape(side, side) for x in part.column("image")])
                toks, errors = _tokens(maker, gray.astype(np.float32) / 255)
                lists = nested([np.zeros((0, 0)) if t is None else t for t in toks])
                lists = pa.ListArray.from_arrays(lists.offsets, lists.values, mask=pa.array([t is None for t in toks]))
                yield pa.record_batch([part.column("series_id"), part.column("window_id"), lists, pa.array(errors, pa.string())], names=["series_id", "window_id", "toks", "error"])

    kept = imaged.select("series_id", "window_id", "image")
    return kept.mapInArrow(run, "series_id string, window_id long, toks array<array<double>>, error string", profile=profile)
