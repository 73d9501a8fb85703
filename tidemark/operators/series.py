"""Series as rows (series_id, ts, value): index, detrending, scaling, smoothing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import finite
from tidemark.operators import scan
from tidemark.operators.scan import blocked, running

#: Points of the windows that one group cuts: few, so that the groups, which are drawn and encoded where they are cut, even out over the tasks.
CUT = 1 << 14
#: Neighbouring windows of a series that are ranked together for a sample.
SAMPLED = 1 << 16


def by_series():
    return Window.partitionBy("series_id")


def require(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing")
    return df


def with_index(df: DataFrame, *ties: str) -> DataFrame:
    """Adds idx, the place from 0 by ts (ties by the named columns, else by value), and n, the series' length. NaN and infinite values become null."""
    require(df, "series_id", "ts", "value")
    kept = blocked(df.withColumn("value", finite(F.col("value").cast("double"))), "ts")
    out = running(kept, ["ts", *(ties or ("value",))], {"idx": F.lit(1).cast("long")}, {"n": "idx"})
    return out.withColumn("idx", F.col("idx") - 1)


def detrended(df: DataFrame, value: str = "value", out: str = "residual") -> DataFrame:
    """Subtracts each series' least-squares line over idx."""
    x, y = F.col("idx").cast("double"), F.col(value)
    slope, base = F.regr_slope(y, x).over(by_series()), F.regr_intercept(y, x).over(by_series())
    return df.withColumn(out, y - (F.coalesce(slope, F.lit(0.0)) * x + F.coalesce(base, F.avg(y).over(by_series()))))


def min_max(df: DataFrame, value: str = "residual", out: str = "value_norm", eps: float = 0.0) -> DataFrame:
    """Scales each series to 0..1; a constant one to 0."""
    low, high = F.min(value).over(by_series()), F.max(value).over(by_series())
    return df.withColumn(out, F.when(high - low > eps, (F.col(value) - low) / (high - low)).otherwise(0.0))


def smoothed(df: DataFrame, value: str = "score", out: str = "smooth") -> DataFrame:
    """Bias-corrected exponential mean of span max(1, n div 100), as two running sums, whose weights are at most e**200."""
    span = F.greatest(F.lit(1), F.expr("n div 100")).cast("double")
    keep = 1 - 2 / (span + 1)
    weight = F.pow(F.when(span > 1, keep).otherwise(1.0), -F.col("idx").cast("double"))
    sums = {"_sum": F.col(value) * weight, "_weight": F.when(F.col(value).isNotNull(), weight)}
    rows = running(df.withColumn("_block", F.expr(f"idx div {scan.BLOCK}")), ["idx"], sums)
    mean = F.when(F.col("_weight") > 0, F.col("_sum") / F.col("_weight"))
    return rows.withColumn(out, F.when(span > 1, mean).otherwise(F.col(value))).drop("_sum", "_weight")


def window_span(size: int, ratio: float) -> int:
    step = int(size / ratio)
    if step < 1:
        raise ValueError("the ratio is above the window's size")
    return step


def window_count(n: Column, size: int, step: int) -> Column:
    return F.when(n >= size, F.floor((n - size) / step) + 1).otherwise(0).cast("long")


def _in_windows(df: DataFrame, size: int, step: int) -> DataFrame:
    """Adds _low and _high, the first and last window that a point is in; points in none go."""
    low = F.greatest(F.lit(0), F.ceil((F.col("idx") - size + 1) / step)).cast("long")
    high = F.least(F.floor(F.col("idx") / step), window_count(F.col("n"), size, step) - 1).cast("long")
    return df.withColumn("_low", low).withColumn("_high", high).where("_low <= _high")


def with_windows(df: DataFrame, size: int, step: int) -> DataFrame:
    """A row for each window of `size` points that a point is in: window_id and pos are added. Windows that would end after the series aren't made."""
    inside = _in_windows(df, size, step)
    inside = inside.withColumn("window_id", F.explode(F.sequence("_low", "_high"))).drop("_low", "_high")
    return inside.withColumn("pos", F.col("idx") - F.col("window_id") * step)


def window_rows(df: DataFrame, size: int, step: int, value: str = "value_norm") -> DataFrame:
    """(series_id, window_id, points): the windows of with_windows(), one to a row, values in order of idx.

    A stretch of neighbouring windows, CUT points of them, is cut in one task from the points that they share. So a point is shuffled once, and those at the end of a
    stretch, fewer than `size`, twice. Missing indices are left out, null values stay.
    """
    many = max(1, CUT // size)
    rows = _in_windows(df, size, step).select("series_id", "idx", "n", F.col(value).cast("double").alias("v"), F.explode(F.sequence(F.expr(f"_low div {many}"), F.expr(f"_high div {many}"))).alias("stretch"))

    def cut(points: pa.Table) -> pa.Table:
        idx, n, first = points["idx"].to_numpy(), points["n"][0].as_py(), points["stretch"][0].as_py() * many
        order = np.argsort(idx, kind="stable")
        windows = np.arange(first, min(first + many, (n - size) // step + 1))
        begin, end = np.searchsorted(idx, windows * step, sorter=order), np.searchsorted(idx, windows * step + size, sorter=order)
        windows, begin, end = (x[end > begin] for x in (windows, begin, end))
        ends = np.cumsum(end - begin)
        taken = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - (end - begin)), end - begin)
        values = points["v"].combine_chunks().take(pa.array(order[taken]))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)
        return pa.table([pa.array([points["series_id"][0].as_py()] * len(windows), pa.string()), pa.array(windows, pa.int64()), lists], names=["series_id", "window_id", "points"])

    # tasks by their number, as by their bytes few would be left, and what comes of a window takes much longer than to read it
    rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "series_id", "stretch")
    return rows.groupBy("series_id", "stretch").applyInArrow(cut, "series_id string, window_id long, points array<double>")


def threshold_panes(df: DataFrame) -> DataFrame:
    """Adds low and high, the first and last of a point's large windows: n div 3 points every n div 10, the last ones cut short. A series has some 20 such pairs, its panes."""
    size, step = F.greatest(F.lit(1), F.expr("n div 3")), F.greatest(F.lit(1), F.expr("n div 10"))
    low = F.greatest(F.lit(0), F.ceil((F.col("idx") - size + 1) / step)).cast("long")
    return df.withColumn("low", low).withColumn("high", F.floor(F.col("idx") / step).cast("long"))


def with_threshold_windows(df: DataFrame) -> DataFrame:
    """A row for each of a point's large windows."""
    return threshold_panes(df).withColumn("window_id", F.explode(F.sequence("low", "high"))).drop("low", "high")


def sampled_windows(windows: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """At most `size` windows of each series, chosen by a multiplicative hash of window_id that any engine can compute: the smallest of each SAMPLED neighbouring windows
    first, then of what they leave, so that no task ranks all windows of a series."""
    draw = (F.col("window_id") * 7919 + seed * 104729 + 12345) % 1000003
    rows = windows.select("series_id", "window_id").distinct().withColumn("_part", F.expr(f"window_id div {SAMPLED}"))
    for part in (["_part"], []):
        rank = F.row_number().over(Window.partitionBy("series_id", *part).orderBy(draw, "window_id"))
        rows = rows.withColumn("_rank", rank).where(F.col("_rank") <= size).drop("_rank")
    return rows.drop("_part")
