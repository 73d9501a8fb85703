"""From scores (series_id, idx, ts, n, score) to intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import z_value
from tidemark.operators import scan
from tidemark.operators.scan import blocked, percentiles, running
from tidemark.operators.series import by_series, smoothed, threshold_panes, with_threshold_windows
from tidemark.sources.storage import durable

#: Neighbouring points that meet the intervals over them in one key.
TIME_BLOCK = 256


def _limits(df: DataFrame, keys: list[str], method: str) -> DataFrame:
    """(keys, centre, spread) of smooth."""
    if method == "mean":
        return df.groupBy(*keys).agg(F.avg("smooth").alias("centre"), F.stddev_pop("smooth").alias("spread"))
    if method != "median":
        raise ValueError(f"unknown method {method}")
    middle = durable(percentiles(df, keys, "smooth", 0.5, "centre"), "medians")
    away = df.join(middle, keys).withColumn("_away", F.abs(F.col("smooth") - F.col("centre")))
    return middle.join(percentiles(away, keys, "_away", 0.5, "spread"), keys)


def _smooth(scores: DataFrame, smoothing: bool, method: str) -> DataFrame:
    """Adds smooth; for medians, which are found in several passes, as a written table."""
    rows = smoothed(scores) if smoothing else scores.withColumn("smooth", F.col("score"))
    return durable(rows, "smooth") if method == "median" else rows


def _pane_limits(panes: DataFrame, alpha: float) -> DataFrame:
    """(series_id, low, high, limit): the least threshold of the large windows that a pane's points are in. A window's mean and spread come from those of its panes."""
    part = panes.groupBy("series_id", "low", "high").agg(F.count("smooth").alias("m"), F.avg("smooth").alias("mean"), F.var_pop("smooth").alias("var"))
    window, m = Window.partitionBy("series_id", "window_id"), F.col("m")
    each = part.withColumn("window_id", F.explode(F.sequence("low", "high"))).withColumn("centre", F.sum(m * F.col("mean")).over(window) / F.nullif(F.sum(m).over(window), F.lit(0)))
    spread = F.sqrt(F.sum(m * (F.col("var") + F.pow(F.col("mean") - F.col("centre"), 2))).over(window) / F.sum(m).over(window))
    return each.withColumn("limit", F.col("centre") + z_value(alpha) * spread).groupBy("series_id", "low", "high").agg(F.min("limit").alias("limit"))


def judged(scores: DataFrame, alpha: float, method: str = "mean", smoothing: bool = True, sliding: bool = False) -> DataFrame:
    """Adds smooth and threshold to each row of scores: what is compared and what it has to exceed. sliding: the least threshold of the large windows that a point is in.

    A null score has a null smooth unless earlier ones are carried on; a series without scores has a null threshold, which nothing exceeds.
    """
    rows, limit = _smooth(scores, smoothing, method), F.col("centre") + z_value(alpha) * F.col("spread")
    if not sliding:
        return rows.join(_limits(rows, ["series_id"], method).select("series_id", limit.alias("threshold")), "series_id", "left")
    panes = threshold_panes(rows)  # points stay one row each
    if method == "mean":
        limits = _pane_limits(panes, alpha)
    else:
        each = _limits(with_threshold_windows(rows), ["series_id", "window_id"], method).select("series_id", "window_id", limit.alias("limit"))
        windows = panes.select("series_id", "low", "high").distinct().withColumn("window_id", F.explode(F.sequence("low", "high")))
        limits = windows.join(each, ["series_id", "window_id"]).groupBy("series_id", "low", "high").agg(F.min("limit").alias("limit"))
    return panes.join(limits, ["series_id", "low", "high"], "left").drop("low", "high").withColumnRenamed("limit", "threshold")


def flagged(scores: DataFrame, alpha: float, method: str = "mean", smoothing: bool = True, sliding: bool = False) -> DataFrame:
    """Rows of scores that are above their threshold, strictly; sliding: above that of any of their large windows."""
    return judged(scores, alpha, method, smoothing, sliding).where("smooth > threshold")


def _runs(rows: DataFrame, keys: list[str], sums: list[str] | None = None) -> DataFrame:
    """(keys, s, e, first time, last time and sums of these columns with their counts) of runs of consecutive idx: first within blocks of indices; then those that
    touch a block's border, at most two a block, are put together."""
    block = f"idx div {scan.BLOCK}"
    run = F.col("idx") - F.row_number().over(Window.partitionBy(*keys, "_block").orderBy("idx"))
    told = [F.min("idx").alias("s"), F.max("idx").alias("e")]
    if sums:
        told += [F.min_by("ts", "idx").alias("start"), F.max_by("ts", "idx").alias("end")] + [x for c in sums for x in (F.sum(c).alias(c), F.count(c).alias(f"n_{c}"))]
    parts = rows.withColumn("_block", F.expr(block)).withColumn("_run", run).groupBy(*keys, "_block", "_run").agg(*told).drop("_block", "_run")
    border = F.expr(f"s % {scan.BLOCK} = 0 or (e + 1) % {scan.BLOCK} = 0")
    order = Window.partitionBy(*keys).orderBy("s")
    fresh = F.when(F.lag("e").over(order) + 1 == F.col("s"), 0).otherwise(1)
    group = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    again = [F.min("s").alias("s"), F.max("e").alias("e")]
    if sums:
        again += [F.min_by("start", "s").alias("start"), F.max_by("end", "s").alias("end")] + [F.sum(x).alias(x) for c in sums for x in (c, f"n_{c}")]
    joined = parts.where(border).withColumn("_new", fresh).withColumn("_group", group).groupBy(*keys, "_group").agg(*again).drop("_group")
    return parts.where(~border).unionByName(joined)


def islands(rows: DataFrame) -> DataFrame:
    """(series_id, s, e): runs of consecutive idx among the rows."""
    return _runs(rows, ["series_id"])


def padded(intervals: DataFrame, lengths: DataFrame, by: int) -> DataFrame:
    """Intervals wider by so many points at both ends, within the series. lengths: (series_id, n)."""
    joined = intervals.join(lengths, "series_id")
    return joined.select("series_id", F.greatest(F.col("s") - by, F.lit(0)).alias("s"), F.least(F.col("e") + by, F.col("n") - 1).alias("e"))


def merged(intervals: DataFrame, gap: Column | int = 1, start: str = "s", end: str = "e", severity: str | None = None) -> DataFrame:
    """Joins intervals that overlap or lie within gap; severity: its plain mean. By a running maximum of ends."""
    order = by_series().orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.lit(gap) if isinstance(gap, int) else gap
    fresh = F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0)
    groups = intervals.withColumn("_new", fresh).withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    means = [F.avg(severity).alias(severity)] if severity else []
    return groups.groupBy("series_id", "_group").agg(F.min(start).alias(start), F.max(end).alias(end), *means).drop("_group")


def with_times(intervals: DataFrame, scores: DataFrame, severity: bool = True) -> DataFrame:
    """(series_id, start, end, severity) of index intervals: the times at both ends and the mean raw score between them.

    Points meet intervals by series and block of TIME_BLOCK indices, so that a long series is many tasks' work; without scores, severity is 1.
    """
    block = lambda c: F.expr(f"{c} div {TIME_BLOCK}")
    asked = intervals.select("series_id", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e")).where("s <= e")
    asked = asked.withColumn("_block", F.explode(F.sequence(block("s"), block("e"))))
    points = scores.select("series_id", "idx", "ts", *(["score"] if severity else [])).withColumn("_block", block("idx"))
    inside = points.join(asked, ["series_id", "_block"]).where("idx >= s and idx <= e")
    mean = F.avg("score") if severity else F.lit(1.0)
    return inside.groupBy("series_id", "s", "e").agg(F.min_by("ts", "idx").alias("start"), F.max_by("ts", "idx").alias("end"), mean.alias("severity"))


def _by_island(rows: DataFrame, *keys: str) -> DataFrame:
    keys = keys or ("series_id",)
    severity = F.when(F.col("n_score") > 0, F.col("score") / F.col("n_score"))
    return _runs(rows, list(keys), ["score"]).select(*keys, "start", "end", severity.alias("severity"))


def detect_each(scores: DataFrame, alphas: tuple[float, ...], method: str = "mean", smoothing: bool = True) -> DataFrame:
    """(alpha, series_id, start, end, severity): detect for several alphas, with scores smoothed and summed up once.

    A point is repeated only for the alphas whose threshold it is above.
    """
    rows = _smooth(scores, smoothing, method)
    levels = F.array(*(F.struct(F.lit(float(a)).alias("alpha"), F.lit(z_value(a)).alias("z")) for a in alphas))
    over = F.filter(levels, lambda v: F.col("smooth") > F.col("centre") + v["z"] * F.col("spread"))
    found = rows.join(_limits(rows, ["series_id"], method), "series_id").withColumn("_over", F.explode(over["alpha"])).withColumnRenamed("_over", "alpha")
    return _by_island(found, "alpha", "series_id")


def detect(scores: DataFrame, alpha: float = 0.01, method: str = "mean", smoothing: bool = True, sliding: bool = False, padding: int = 0) -> DataFrame:
    """(series_id, start, end, severity). Without padding, an interval's points are already in its island: no join is needed."""
    rows = flagged(scores, alpha, method, smoothing, sliding)
    if not padding:
        return _by_island(rows)
    lengths = scores.select("series_id", "n").distinct()
    return with_times(merged(padded(islands(rows), lengths, padding)), scores).drop("s", "e")


def above_percentile(scores: DataFrame, percent: float = 99.0, threshold: float | None = None) -> DataFrame:
    """Islands of scores above a threshold, or above each series' interpolated percentile."""
    if threshold is not None:
        return _by_island(scores.where(F.col("score") > threshold))
    limits = percentiles(scores, ["series_id"], "score", percent / 100, "threshold")
    return _by_island(scores.join(limits, "series_id").where("score > threshold"))


def clamped(pairs: DataFrame, lengths: DataFrame, swap: bool = True) -> DataFrame:
    """Index pairs (series_id, s, e) within the series; a reversed one is turned round if swap."""
    joined = pairs.join(lengths, "series_id")
    s, e = (F.greatest(F.lit(0), F.least(F.col(c).cast("long"), F.col("n") - 1)) for c in ("s", "e"))
    joined = joined.withColumn("_s", s).withColumn("_e", e)
    low, high = (F.least("_s", "_e"), F.greatest("_s", "_e")) if swap else (F.col("_s"), F.col("_e"))
    return joined.withColumn("s", low).withColumn("e", high).drop("_s", "_e", "n")


def indices_of(intervals: DataFrame, indexed: DataFrame) -> DataFrame:
    """(series_id, iv, s, e) of time intervals (series_id, iv, start, end): the first idx at or after start, the last at or before end, within the series.

    One running count of points in order of time answers all of a series' intervals: a start counts the points before it, an end those up to it.
    """
    mark = lambda df, at, kind, iv: df.select("series_id", F.col(at).alias("at"), F.lit(kind).alias("kind"), iv.alias("iv"))
    nothing = F.lit(None).cast(intervals.schema["iv"].dataType)
    rows = mark(intervals, "start", 0, F.col("iv")).unionByName(mark(indexed, "ts", 1, nothing)).unionByName(mark(intervals, "end", 2, F.col("iv")))
    before = running(blocked(durable(rows, "marks"), "at"), ["at", "kind"], {"before": F.when(F.col("kind") == 1, 1).otherwise(0)}).where("kind <> 1")
    found = before.groupBy("series_id", "iv").agg(F.min(F.when(F.expr("kind = 0 and at is not null"), F.col("before"))).alias("s"), F.max(F.when(F.expr("kind = 2 and at is not null"), F.col("before") - 1)).alias("e"))
    top = F.col("n") - 1
    first, last = F.coalesce("s", "n"), F.coalesce("e", F.lit(-1))
    found = found.join(indexed.select("series_id", "n").distinct(), "series_id")
    return found.select("series_id", "iv", F.greatest(F.lit(0), F.least(first, top)).alias("s"), F.greatest(F.lit(0), F.least(last, top)).alias("e"))
