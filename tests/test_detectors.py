"""The detectors' queries over the whole table of events, against plain loops; and resampling in blocks."""

import os

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidemark.functions.scalar import z_value
from tidemark.operators import render, tokens

DATA = "/root/testdata/sf0.01"


def of_squares(maps, side, kernel):
    """The mean of each kernel x kernel square of tokens (windows x patches x dimensions), and each square's patches."""
    wide = side - kernel + 1
    squares = [[(r + i) * side + c + j for i in range(kernel) for j in range(kernel)] for r in range(wide) for c in range(wide)]
    return np.stack([maps[:, s].mean(1) for s in squares], 1), squares


def away(toks):
    """For each window and token, half of 1 less the best cosine to the lower medians over all windows."""
    middle = np.sort(toks, axis=0)[(len(toks) - 1) // 2]
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    return np.array([[min(0.5 * (1 - float(t @ m)) for m in unit(middle)) for t in unit(w)] for w in toks])


def resampled(vector, covered, n):
    x = [i * (len(vector) - 1) / (covered - 1) for i in range(covered)]
    out = np.interp(x, range(len(vector)), vector).tolist()
    slope = out[-1] - out[-2]
    return np.array(out + [out[covered - 1] + slope * (j + 1) for j in range(n - covered)])


def column_scores(score_maps, side, size):
    """Columns' means of the highest quarter, of maps stretched by half-pixel centres."""
    out = []
    at = [max(0.0, (d + 0.5) * side / size - 0.5) for d in range(size)]
    for m in score_maps:
        grid = m.reshape(side, side)
        rows = np.array([np.interp(at, range(side), grid[:, c]) for c in range(side)]).T
        full = np.array([np.interp(at, range(side), row) for row in rows])
        out.append(np.sort(full, axis=0)[-(size // 4) :].mean(0))
    return out


def by_force(values, size=240, step=60, side=224, patch=16, alpha=0.01):
    """(first, last) index and mean score of the intervals of one series."""
    n, grid = len(values), side // patch
    flat = values - np.polyval(np.polyfit(np.arange(n), values, 1), np.arange(n))
    flat = (flat - flat.min()) / (flat.max() - flat.min())
    drawn = [np.round(render.raster(flat[b : b + size], side, side) * 255) / 255 for b in range(0, n - size + 1, step)]
    toks = np.stack([render.PatchEncoder(patch)(x[None].astype(np.float32))[0] for x in drawn])
    single, total = away(toks), 0
    for kernel in (3, 2):
        means, squares = of_squares(toks, grid, kernel)
        far = away(means)
        mean = np.zeros_like(single)
        for p in range(grid * grid):
            held = [k for k, s in enumerate(squares) if p + 1 in s]
            mean[:, p] = [len(held) / sum(1 / d[held]) if held and d[held].all() else (0.0 if held else np.nan) for d in far]
        total = total + mean
    maps = (total + single) / 3
    maps[~np.isfinite(maps)] = 0
    laid, times = np.zeros((len(maps) - 1) * 56 + side), np.zeros((len(maps) - 1) * 56 + side)
    for w, columns in enumerate(column_scores(maps, grid, side)):
        laid[w * 56 : w * 56 + side] += columns
        times[w * 56 : w * 56 + side] += 1
    covered = (n - size) // step * step + size
    score = resampled(laid / np.maximum(times, 1), covered, n)
    smooth = pd.Series(score).ewm(span=max(1, n // 100)).mean().to_numpy() if n // 100 > 1 else score
    over = smooth > smooth.mean() + z_value(alpha) * smooth.std()
    runs, begin = [], None
    for i, on in enumerate([*over, False]):
        if on and begin is None:
            begin = i
        elif not on and begin is not None:
            runs.append((begin, i - 1, score[begin:i].mean()))
            begin = None
    return runs


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_detectors_over_events(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_type", "ts", "value", "event_id").toPandas().sort_values(["ts", "event_id"])
    want = {}
    for name, g in events.groupby("event_type"):
        ts = g.ts.tolist()
        want |= {(name, ts[s], ts[e]): severity for s, e, severity in by_force(g.value.to_numpy(float))}
    told = lambda q: {(r.series_id, pd.Timestamp(r.start), pd.Timestamp(r.end)): r.severity for r in entry.queries()[q](spark, DATA).toPandas().itertuples()}
    found = told("screen_detect")
    assert want and found.keys() == want.keys()
    assert all(found[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())
    assert told("two_stage_detect") == {k: 1.0 for k in want}


@pytest.mark.parametrize("cells", [3, 10, 1 << 16])
def test_resampling_in_blocks(spark, monkeypatch, cells):
    monkeypatch.setattr(tokens, "CELLS", cells)
    random, rows, lengths, want = np.random.default_rng(cells), [], [], {}
    for name, size, window, n in (("a", 50, 24, 91), ("b", 50, 24, 24), ("c", 7, 24, 200), ("d", 400, 24, 30), ("e", 2, 24, 40), ("f", 1, 24, 40), ("g", 9, 24, 20), ("h", 31, 24, 25)):
        vector = random.normal(size=size)
        rows += [(name, k, float(v)) for k, v in enumerate(vector)]
        lengths.append((name, n))
        if n >= window:
            covered = (n - window) // 12 * 12 + window
            want |= {(name, i): v for i, v in enumerate(resampled(vector, covered, n))}
    vector = spark.createDataFrame(rows, "series_id string, k long, score double")
    got = tokens.aligned(vector, spark.createDataFrame(lengths, "series_id string, n long"), 24, 12).collect()
    assert len(got) == len(want) and all(r.score == pytest.approx(want[r.series_id, r.idx], abs=1e-9) for r in got)
