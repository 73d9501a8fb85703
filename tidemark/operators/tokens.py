"""Patch tokens on a square grid: pooling, memory, dissimilarity, maps.

Tokens come one to a row (series_id, window_id, token_idx, tok) or one window to a row (series_id, window_id, toks), tokens in order. What is a matrix product for each
window (pooling, cosines to the memory) is one, in Arrow batches; a series' memory is sent once to each stretch of its windows, not to each token or window.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import doubles
from tidemark.operators.scan import as_bits, as_doubles, order_statistics
from tidemark.sources.storage import durable

KEYS = ["series_id", "window_id"]
#: Windows of a series that meet its memory in one key.
STRETCH = 1024
#: Windows of a series that tell, about, where its medians are; how many standard deviations of a sample's rank these may lie off; dimensions whose values one group
#: holds, and windows that are counted together.
SAMPLE, SPREAD, PART, COUNTED = 4096, 6.0, 64, 128
#: Windows of a series up to which a group's share of them is gathered; beyond, medians are found by selection.
GATHERED = 1 << 21
#: Cells of a stitched vector that one group resamples.
CELLS = 1 << 16


@cache
def keep_heap() -> None:
    """Lets a worker process keep some 64 MB of freed memory for the next arrays, where the C library can do that: to get it anew costs as much as what is done in it."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt:
        mallopt(-3, 1 << 25)  # arrays below this come from the heap,
        mallopt(-1, 1 << 26)  # whose end is given back from this on


def make_masks(spark: SparkSession, side: int, kernel: int, stride: int = 1, scale: str = "mid") -> DataFrame:
    """(scale, mask_idx, patch_idx): the patches under each place of a kernel x kernel square."""
    wide = (side - kernel) // stride + 1
    top = F.expr(f"(mask_idx div {wide}) * {stride}")
    left = (F.col("mask_idx") % wide) * stride
    cells = spark.range(wide * wide).withColumnRenamed("id", "mask_idx").withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(kernel * kernel - 1))))
    patch = (top + F.expr(f"cell div {kernel}")) * side + left + F.col("cell") % kernel
    return cells.select(F.lit(scale).alias("scale"), "mask_idx", patch.cast("long").alias("patch_idx"))


def mask_matrix(side: int, kernel: int, stride: int = 1) -> np.ndarray:
    """make_masks() as masks x patches, 1 where a mask has the patch."""
    wide, out = (side - kernel) // stride + 1, np.zeros((((side - kernel) // stride + 1) ** 2, side, side))
    for i in range(wide):
        for j in range(wide):
            out[i * wide + j, i * stride : i * stride + kernel, j * stride : j * stride + kernel] = 1
    return out.reshape(wide * wide, side * side)


def packed(tokens: DataFrame) -> DataFrame:
    """(series_id, window_id, toks) of single tokens; a window has as many as the grid has places."""
    rows = tokens.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("token_idx", doubles(F.col("tok")).alias("tok")))).alias("t"))
    return rows.select(*KEYS, F.col("t.tok").alias("toks"))


def unpacked(windows: DataFrame) -> DataFrame:
    rows = windows.select(*KEYS, F.posexplode("toks").alias("token_idx", "tok"))
    return rows.select(*KEYS, F.col("token_idx").cast("long").alias("token_idx"), "tok")


def _matrix(cell: pa.Scalar) -> np.ndarray:
    """An array of equally long arrays of numbers as a matrix."""
    rows = cell.values
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(rows), -1)


def nested(rows: list[np.ndarray]) -> pa.Array:
    flat = pa.ListArray.from_arrays(np.cumsum([0, *(r.shape[1] for r in rows for _ in range(len(r)))]).astype(np.int32), pa.array(np.concatenate([r.reshape(-1) for r in rows]) if rows else np.zeros(0)))
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)]).astype(np.int32), flat)


def pooled(windows: DataFrame, masks: np.ndarray) -> DataFrame:
    """windows with a token for each mask: the mean of its patches. One matrix product a window."""
    mean = masks / masks.sum(1, keepdims=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("series_id"), b.column("window_id"), nested([mean @ _matrix(x) for x in b.column("toks")])], names=[*KEYS, "toks"])

    return windows.select(*KEYS, "toks").mapInArrow(run, "series_id string, window_id long, toks array<array<double>>")


def memory(windows: DataFrame) -> DataFrame:
    """(series_id, token_idx, mem): the lower median over all windows, dimension by dimension, by selection."""
    each = unpacked(windows).select("series_id", "token_idx", F.posexplode("tok").alias("dim", "x"))
    middle = order_statistics(each, ["series_id", "token_idx", "dim"], "x", {"mem": F.expr("(n - 1) div 2")})
    return middle.groupBy("series_id", "token_idx").agg(F.sort_array(F.collect_list(F.struct("dim", "mem")))["mem"].alias("mem"))


def _pools(masks: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {name: m / m.sum(1, keepdims=True) for name, m in masks.items()}


def _flat(toks: list[np.ndarray], pools: dict[str, np.ndarray]) -> np.ndarray:
    """The bits, in order, of windows' pooled tokens, scale by scale, and single ones: a row for each value's place, a column for each window."""
    toks = np.stack(toks)
    return as_bits(np.concatenate([(m @ toks).reshape(len(toks), -1) for m in pools.values()] + [toks.reshape(len(toks), -1)], axis=1).T.copy())


def _series_runs(b: pa.RecordBatch, most: int) -> Iterator[tuple[str, int, int]]:
    """Stretches of a batch's rows of one series, at most so many."""
    ids, at = b.column("series_id").to_pylist(), 0
    while at < len(ids):
        end = at + 1
        while end < min(len(ids), at + most) and ids[end] == ids[at]:
            end += 1
        yield ids[at], at, end
        at = end


def _cells(rows: pa.ChunkedArray) -> list[np.ndarray]:
    return [x.values.to_numpy() for chunk in rows.chunks for x in chunk]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)]).astype(np.int32), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))


#: Below and above all bits of values, in order.
NONE, ALL = np.iinfo(np.int64).min, np.iinfo(np.int64).max
BOUNDS = "series_id string, part int, n long, dims int, low array<long>, high array<long>"


def _sampled_bounds(windows: DataFrame, masks: dict[str, np.ndarray]) -> DataFrame:
    """BOUNDS of each part of a series' values: between which bits its medians lie, as some SAMPLE windows have it. Where these are all windows, low = high are the medians."""
    pools, part, spread = _pools(masks), PART, SPREAD
    counts = windows.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    some = windows.join(counts, "series_id").where(F.pmod(F.xxhash64("window_id"), "n") < SAMPLE).select("series_id", "n", "toks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_heap()
        for b in batches:
            for s, at, end in _series_runs(b, COUNTED):
                toks = [_matrix(x) for x in b.column("toks").slice(at, end - at)]
                flat = _flat(toks, pools)
                cells = [flat[i : i + part].reshape(-1) for i in range(0, len(flat), part)]
                k, same = len(cells), lambda x, kind: pa.array([x] * len(cells), kind)  # noqa: B023
                yield pa.record_batch([same(s, pa.string()), pa.array(range(k), pa.int32()), same(b.column("n")[at].as_py(), pa.int64()), same(toks[0].shape[1], pa.int32()), same(end - at, pa.int32()), _lists(cells)], names=["series_id", "part", "n", "dims", "k", "bits"])

    def bound(rows: pa.Table) -> pa.Table:
        x = np.concatenate([c.reshape(-1, k) for k, c in zip(rows["k"].to_pylist(), _cells(rows["bits"]))], axis=1)
        x.sort(axis=1)
        n, k = rows["n"][0].as_py(), x.shape[1]
        middle, off = (n - 1) // 2 * k / n, spread * k**0.5 / 2
        first, last = ((n - 1) // 2,) * 2 if k == n else (int(np.floor(middle - off)), int(np.ceil(middle + off)))
        low = x[:, first] if first >= 0 else np.full(len(x), NONE)
        high = x[:, last] if last < k else np.full(len(x), ALL)
        high = high if k == n else np.maximum(high, low + 1)  # what a sample tells is still to be counted
        return pa.table([rows["series_id"][:1], rows["part"][:1], rows["n"][:1], rows["dims"][:1], _lists([low]), _lists([high])], names=["series_id", "part", "n", "dims", "low", "high"])

    dealt = some.mapInArrow(cut, "series_id string, part int, n long, dims int, k int, bits array<long>")
    return dealt.groupBy("series_id", "part").applyInArrow(bound, BOUNDS)


def _closer(windows: DataFrame, bounds: DataFrame, masks: dict[str, np.ndarray]) -> DataFrame:
    """BOUNDS after all windows of the series in bounds were counted: values below low, at low, at high, and those between, which go on. low = high, the median, where it
    was within; else bounds on the side where it is."""
    pools, part = _pools(masks), PART
    told = bounds.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("part", "low", "high"))).alias("b"))
    told = told.select("series_id", F.array(F.flatten("b.low"), F.flatten("b.high")).alias("held"))

    def count(s: str, toks: list[np.ndarray], held: np.ndarray) -> pa.RecordBatch:
        x, (low, high) = _flat(toks, pools), held[:, :, None]
        inside = (x > low) & (x < high)
        told = np.stack([(x < low).sum(1), (x == low).sum(1), inside.sum(1), ((x == high) & (high > low)).sum(1)])
        at = range(0, len(x), part)
        between = np.split(x[inside], np.cumsum(told[2])[part - 1 : -1 : part]) if len(at) > 1 else [x[inside]]
        return pa.record_batch([pa.array([s] * len(at), pa.string()), pa.array(range(len(at)), pa.int32()), _lists([told[:, i : i + part].reshape(-1) for i in at]), _lists(between)], names=["series_id", "part", "told", "bits"])

    def pick(key: tuple, counted: pa.Table, rows: pa.Table) -> pa.Table:
        told = np.stack([c.reshape(4, -1) for c in _cells(counted["told"])])
        ends = np.cumsum(told[:, 2], axis=1)
        bits, (low, high) = _cells(counted["bits"]), (_cells(rows[c])[0].copy() for c in ("low", "high"))
        below, at_low, between, at_high = told.sum(0)
        rank = (rows["n"][0].as_py() - 1) // 2 - below
        for i in np.flatnonzero(low < high):
            r = rank[i]
            if r < 0:
                low[i], high[i] = NONE, low[i]
            elif r < at_low[i]:
                high[i] = low[i]
            elif r < at_low[i] + between[i]:
                x = np.concatenate([b[e[i] - t[2, i] : e[i]] for b, e, t in zip(bits, ends, told)])
                low[i] = high[i] = np.partition(x, r - at_low[i])[r - at_low[i]]
            elif r < at_low[i] + between[i] + at_high[i]:
                low[i] = high[i]
            else:
                low[i], high[i] = high[i], ALL
        return pa.table([rows["series_id"], rows["part"], rows["n"], rows["dims"], _lists([low]), _lists([high])], names=["series_id", "part", "n", "dims", "low", "high"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_heap()
        series, held = None, None
        for b in batches:
            windows, bounds = b.column("toks"), b.column("held")
            for s, at, end in _series_runs(b, b.num_rows):
                if s != series:
                    series, held = s, None
                fresh = []
                for i in range(at, end):
                    if bounds[i].is_valid:
                        held = np.stack([x.values.to_numpy() for x in bounds[i]])
                    else:
                        fresh.append(_matrix(windows[i]))
                    if fresh and (len(fresh) == COUNTED or i == end - 1):
                        yield count(s, fresh, held)
                        fresh = []

    met = _dealt(windows.join(told.select("series_id"), "series_id", "left_semi"), told)
    counted = met.mapInArrow(each, "series_id string, part int, told array<long>, bits array<long>")
    return counted.groupBy("series_id", "part").cogroup(bounds.groupBy("series_id", "part")).applyInArrow(pick, BOUNDS)


def _of_tokens(name: str, mem: DataFrame) -> DataFrame:
    """(series_id, name, mems): memory() with a row for each series."""
    return mem.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("token_idx", "mem")))["mem"].alias("mems")).select("series_id", F.lit(name).alias("name"), "mems")


def memories(windows: DataFrame, masks: dict[str, np.ndarray]) -> DataFrame:
    """(series_id, name, mems): memory() of the pooled tokens by each of masks, and of single ones, by the name patch, an array of tokens each.

    A sample of a series' windows tells where the medians lie, give or take SPREAD deviations. Then all windows are counted, where they are, against these bounds, and
    only values within are gathered, some 9 % of 2**12 sampled ones' share. A median that lies elsewhere is sought there in another round, so the result is exact.
    """
    if (windows.groupBy("series_id").count().agg(F.max("count")).first()[0] or 0) > GATHERED:
        kinds = [_of_tokens(name, memory(pooled(windows, m))) for name, m in masks.items()] + [_of_tokens("patch", memory(windows))]
        return durable(reduce(DataFrame.unionByName, kinds), "memories")
    bounds = durable(_sampled_bounds(windows, masks), "bounds")
    open_series = lambda b: b.join(b.where("low <> high").select("series_id").distinct(), "series_id", "left_semi")
    done, left = bounds, open_series(bounds)
    while not left.isEmpty():
        closer = durable(_closer(windows, left, masks), "bounds")
        done = done.join(left.select("series_id").distinct(), "series_id", "left_anti").unionByName(closer)
        left = open_series(closer)
    flat = done.groupBy("series_id").agg(F.max("dims").alias("dims"), F.sort_array(F.collect_list(F.struct("part", "low"))).alias("b")).select("series_id", "dims", F.flatten("b.low").alias("bits"))
    sizes = [(name, len(m)) for name, m in masks.items()]

    def shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, names, out = [], [], []
            for s, dims, bits in zip(b.column("series_id").to_pylist(), b.column("dims").to_pylist(), b.column("bits")):
                mem, at = as_doubles(bits.values.to_numpy()).reshape(-1, dims), 0
                for name, size in [*sizes, ("patch", None)]:
                    end = len(mem) if size is None else at + size
                    ids.append(s)
                    names.append(name)
                    out.append(mem[at:end])
                    at = end
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(names, pa.string()), nested(out)], names=["series_id", "name", "mems"])

    return durable(flat.mapInArrow(shaped, "series_id string, name string, mems array<array<double>>"), "memories")


def _dealt(windows: DataFrame, held: DataFrame) -> DataFrame:
    """windows, and a copy of held's rows of their series ahead of each stretch of them, as one sorted run of rows: no series is one task."""
    stretch = F.expr(f"window_id div {STRETCH}")
    last = windows.groupBy("series_id").agg(F.max(stretch).alias("last"))
    copies = held.join(last, "series_id").withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))).drop("last").withColumn("window_id", F.lit(-1).cast("long"))
    rows = windows.select("series_id", stretch.alias("stretch"), "window_id", "toks").unionByName(copies, allowMissingColumns=True)
    return rows.repartition("series_id", "stretch").sortWithinPartitions("series_id", "stretch", "window_id")


def with_memory(windows: DataFrame, memories: DataFrame | dict[str, DataFrame], run: Callable[[np.ndarray, dict[str, np.ndarray]], np.ndarray]) -> DataFrame:
    """(series_id, window_id, out): run(tokens of a window, its series' memory by name) for each window, an array of doubles. memories: what
    memories() gives, or memory() by name.

    One series' memory is held at a time, which comes ahead of each stretch of its windows.
    """
    if isinstance(memories, dict):
        memories = reduce(DataFrame.unionByName, (_of_tokens(name, mem) for name, mem in memories.items()))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_heap()
        series, held = None, {}
        for b in batches:
            ids, numbers, out = [], [], []
            for s, w, name, toks, mems in zip(b.column("series_id").to_pylist(), b.column("window_id").to_pylist(), b.column("name").to_pylist(), b.column("toks"), b.column("mems")):
                if s != series:
                    series, held = s, {}
                if name is not None:
                    held[name] = _matrix(mems)
                else:
                    ids.append(s)
                    numbers.append(w)
                    out.append(run(_matrix(toks), held))
            ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(numbers, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(out) if out else np.zeros(0)))], names=[*KEYS, "out"])

    return _dealt(windows, memories).mapInArrow(each, "series_id string, window_id long, out array<double>")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def distances(toks: np.ndarray, mem: np.ndarray, row_side: int | None = None) -> np.ndarray:
    """Half of 1 less the best cosine of each token to the memory; row_side: to memory in the same row of the grid only."""
    cosine = _unit(toks) @ _unit(mem).T
    if row_side:
        cosine = np.where(np.arange(len(toks))[:, None] // row_side == np.arange(len(mem)) // row_side, cosine, -np.inf)
    return 0.5 * (1 - cosine.max(1))


def dissimilarity(windows: DataFrame, mem: DataFrame, row_side: int | None = None) -> DataFrame:
    """(series_id, window_id, token_idx, score): distances() to the series' memory."""
    found = with_memory(windows, {"mem": mem}, lambda toks, held: distances(toks, held["mem"], row_side))
    return found.select(*KEYS, F.posexplode("out").alias("token_idx", "score")).withColumn("token_idx", F.col("token_idx").cast("long"))


def harmonic(scores: DataFrame, masks: DataFrame, side: int, shift: int = 1) -> DataFrame:
    """(series_id, window_id, patch, score): the harmonic mean of the masks that hold patch + shift; 0 if one of them is 0, null if there is none.

    shift 1 is what the published scores come from; 0 is the plain reading.
    """
    grid = scores.select(*KEYS).distinct().withColumn("patch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(side * side - 1).cast("long"))))
    held = scores.join(F.broadcast(masks.select(F.col("mask_idx").alias("token_idx"), (F.col("patch_idx") - shift).alias("patch"))), "token_idx")
    mean = F.when(F.min("score") == 0, 0.0).otherwise(F.count("score") / F.sum(F.when(F.col("score") != 0, 1 / F.col("score"))))
    return grid.join(held.groupBy(*KEYS, "patch").agg(mean.alias("score")), [*KEYS, "patch"], "left")


def harmonic_map(scores: np.ndarray, masks: np.ndarray, shift: int = 1) -> np.ndarray:
    """harmonic() of one window; NaN where no mask holds the patch."""
    zero, held = scores == 0, masks[:, shift:]
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = held.sum(0) / (np.where(zero, 0.0, 1 / scores) @ held)
    mean = np.where(zero.astype(float) @ held > 0, 0.0, mean)  # no mask: 0 / 0
    return np.concatenate([mean, np.full(shift, np.nan)])


def fused(large: DataFrame, mid: DataFrame, patch: DataFrame) -> DataFrame:
    """(series_id, window_id, patch, score): the mean of three maps; 0 where one is missing or not finite."""
    total = None
    for name, m in (("l", large), ("m", mid), ("p", patch)):
        m = m.select(*KEYS, "patch", F.col("score").alias(name))
        total = m if total is None else total.join(m, [*KEYS, "patch"])
    mean = (F.col("l") + F.col("m") + F.col("p")) / 3
    return total.select(*KEYS, "patch", F.when(mean.isNull() | F.isnan(mean) | (F.abs(mean) == float("inf")), 0.0).otherwise(mean).alias("score"))


@cache
def bilinear(side: int, size: int) -> np.ndarray:
    """Weights (size x side) that stretch a row of side cells to size, by half-pixel centres."""
    out = np.zeros((size, side))
    for d in range(size):
        x = max(0.0, (d + 0.5) * side / size - 0.5)
        low = min(int(x), side - 1)
        out[d, low] += 1 - (x - low)
        out[d, min(low + 1, side - 1)] += x - low
    return out


def upsampled(maps: DataFrame, side: int, size: int) -> DataFrame:
    """(series_id, window_id, r, c, score): both directions stretched by bilinear() weights; a cell's four taps are joined by place."""
    taps = [(d, i, float(w)) for d, row in enumerate(bilinear(side, size)) for i, w in enumerate(row) if w]
    taps = maps.sparkSession.createDataFrame(taps, "at long, of long, w double")
    placed = maps.withColumn("of_r", F.expr(f"patch div {side}")).withColumn("of_c", F.col("patch") % side)
    rows = placed.join(F.broadcast(taps.toDF("r", "of_r", "wr")), "of_r").groupBy(*KEYS, "r", "of_c").agg(F.sum(F.col("score") * F.col("wr")).alias("score"))
    return rows.join(F.broadcast(taps.toDF("c", "of_c", "wc")), "of_c").groupBy(*KEYS, "r", "c").agg(F.sum(F.col("score") * F.col("wc")).alias("score"))


def column_top(maps: DataFrame, side: int, share: float = 0.25) -> DataFrame:
    """(series_id, window_id, c, score): the mean of each column's highest share of cells, one at least."""
    k = max(1, -int(-side * share // 1))
    rank = F.row_number().over(Window.partitionBy(*KEYS, "c").orderBy(F.desc("score"), "r"))
    return maps.withColumn("_rank", rank).where(F.col("_rank") <= k).groupBy(*KEYS, "c").agg(F.avg("score").alias("score"))


def column_scores(toks: np.ndarray, held: dict[str, np.ndarray], masks: dict[str, np.ndarray], side: int, size: int, share: float = 0.25, shift: int = 1) -> np.ndarray:
    """One window's column scores: what pooled(), dissimilarity(), harmonic(), fused(), upsampled() and column_top() give, without a row for each cell.

    masks has the scales to use besides single patches; held the memory of each scale, that of patches by the name patch.
    """
    maps = [distances(toks, held["patch"])]
    for name, m in masks.items():
        maps.append(harmonic_map(distances(m @ toks / m.sum(1, keepdims=True), held[name]), m, shift))
    mean = np.mean(maps, axis=0)
    stretch = bilinear(side, size)
    full = stretch @ np.where(np.isfinite(mean), mean, 0.0).reshape(side, side) @ stretch.T
    k = max(1, -int(-size * share // 1))
    return np.partition(full, size - k, axis=0)[-k:].mean(0)


def stitched(columns: DataFrame, width: int, ratio: float) -> DataFrame:
    """(series_id, k, score, covered): windows laid over each other every width / ratio cells, averaged; 0 in gaps."""
    step = int(width / ratio)
    laid = columns.groupBy("series_id", (F.col("window_id") * step + F.col("c")).alias("k")).agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("covered"))
    spans = columns.groupBy("series_id").agg((F.max("window_id") * step + width - 1).alias("last"))
    places = spans.select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("k"))
    return places.join(laid, ["series_id", "k"], "left").select("series_id", "k", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("covered", F.lit(0)).alias("covered"))


def _resampled(cells: np.ndarray, first: int, wide: int, block: int, size: int, covered: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the points that lie between a block's `wide` cells; the last block's carry on to n. cells: those from `first` on, of `size` in all."""
    rate, last = (size - 1) / max(covered - 1, 1), block == max(size - 2, 0) // wide
    begin = 0 if not block else int(block * wide / rate) - 2
    end = covered if last else int((block + 1) * wide / rate) + 2
    idx = np.arange(max(0, min(begin, covered - 2)), min(end, covered))
    x = idx * (size - 1) / max(covered - 1, 1)
    low = np.clip(np.floor(x).astype(np.int64), 0, max(size - 2, 0))
    mine = low // wide == block
    if last:
        mine |= idx >= covered - 2
    x, low, idx, mine = x[mine], low[mine], idx[mine], low[mine] // wide == block
    left = cells[low - first]
    value = left + (x - low) * (cells[np.minimum(low + 1, size - 1) - first] - left)
    if not last:
        return idx, value
    slope = value[-1] - value[-2] if len(value) > 1 else 0.0
    tail = np.arange(covered, n)
    return np.concatenate([idx[mine], tail]), np.concatenate([value[mine], value[-1] + slope * (tail - covered + 1)])


def aligned(vector: DataFrame, lengths: DataFrame, window: int, step: int) -> DataFrame:
    """(series_id, idx, score): the stitched vector resampled to the points that windows cover, then carried on along its last slope, or cut, to n points.

    vector: (series_id, k, score) for each k from 0; lengths: (series_id, n). A series' cells are dealt in blocks of CELLS with those beside them, so the vector is
    shuffled once and no task has a whole series. Series that no window covers have no rows.
    """
    wide = CELLS
    size = vector.groupBy("series_id").agg((F.max("k") + 1).alias("len")).join(lengths, "series_id")
    size = size.withColumn("covered", F.when(F.col("n") >= window, F.expr(f"(n - {window}) div {step}") * step + window).otherwise(0)).where("covered > 0")
    size = size.withColumn("beside", F.ceil((F.col("len") - 1) / F.greatest(F.col("covered") - 1, F.lit(1))) + 1)  # the last but one point may lie so many cells before the last
    blocks = F.sequence(F.expr(f"greatest(k - 1, 0) div {wide}"), F.expr(f"least(k + beside, greatest(len - 2, 0)) div {wide}"))
    dealt = vector.select("series_id", "k", "score").join(size, "series_id").select("series_id", "k", "score", "len", "n", "covered", blocks.alias("blocks"))
    dealt = dealt.withColumn("block", F.explode("blocks")).drop("blocks")

    def run(rows: pa.Table) -> pa.Table:
        k = rows["k"].to_numpy()
        order = np.argsort(k)
        given = (rows[c][0].as_py() for c in ("block", "len", "covered", "n"))
        idx, value = _resampled(rows["score"].to_numpy()[order], int(k[order[0]]), wide, *given)
        return pa.table([pa.array([rows["series_id"][0].as_py()] * len(idx), pa.string()), pa.array(idx, pa.int64()), pa.array(value)], names=["series_id", "idx", "score"])

    return dealt.groupBy("series_id", "block").applyInArrow(run, "series_id string, idx long, score double")
