"""Running sums over series of any length, and exact order statistics of groups of any size.

A running sum is a scan in two levels: a long series is cut into blocks, each block's sums are put together over the blocks before it, and one pass within each block
adds its rows. So no task holds or sorts a whole series. Order statistics are found by selection: counts of values by their leading bits leave one bin for each rank,
and the values in it are counted by the bits that follow, until one value is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.storage import durable

#: Points of a series that one task may sort, and quantiles at which a longer one may be cut: a block has so many points, or a series' quantile.
BLOCK, QUANTILES = 1 << 20, 256
#: Rows that are broadcast (a series and some bounds, or a group and some numbers each).
BROADCAST_ROWS = 1 << 15
#: Leading bits that one round of a selection tells apart.
BITS = 16


def _broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _largest(df: DataFrame, keys: list[str]) -> int:
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def blocked(df: DataFrame, at: str, by: str = "series_id") -> DataFrame:
    """Adds _block, if there are series of more than BLOCK rows: how many of the quantiles of `at` that cut a series into blocks of about that size are below it.

    Rows with the same `at` are in one block, null ones in the first; shorter series are one block. One pass counts rows; if there are long series, one sketches quantiles.
    """
    if _largest(df, [by]) <= BLOCK:
        return df
    points = F.array(*(F.lit(q / QUANTILES) for q in range(1, QUANTILES)))
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(at, points, F.lit(20 * QUANTILES)).alias("_q")).where(F.col("_n") > BLOCK)
    every = F.greatest(F.lit(1), F.ceil(F.lit(float(QUANTILES)) * BLOCK / F.col("_n"))).cast("int")
    sizes = durable(sizes.select(by, F.filter("_q", lambda _, i: (i + 1) % every == 0).alias("_bounds")), "bounds")
    number = F.size(F.filter("_bounds", lambda b: b < F.col(at)))
    return df.join(_broadcast(sizes), by, "left").withColumn("_block", F.when(F.col("_bounds").isNull(), 0).otherwise(F.greatest(number, F.lit(0)))).drop("_bounds")


def running(df: DataFrame, order: list[str | Column], sums: dict[str, Column], totals: dict[str, str] | None = None, by: str = "series_id") -> DataFrame:
    """Adds the running sums, this row included, by order; _block, which rises with it, goes. Null counts as nothing. totals: a name for a sum over the whole series.
    Without _block, each series is one block."""
    named, whole = df.withColumns({f"_x_{k}": F.coalesce(c, F.lit(0)) for k, c in sums.items()}), Window.partitionBy(by)
    if "_block" not in df.columns:
        upto = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = named.withColumns({k: F.sum(f"_x_{k}").over(upto) for k in sums} | {name: F.sum(f"_x_{k}").over(whole) for name, k in (totals or {}).items()})
        return out.drop(*(f"_x_{k}" for k in sums))
    each = named.groupBy(by, "_block").agg(*(F.sum(f"_x_{k}").alias(f"_x_{k}") for k in sums))  # a row for each block
    before = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = each.select(by, "_block", *(F.coalesce(F.sum(f"_x_{k}").over(before), F.lit(0)).alias(f"_a_{k}") for k in sums), *(F.sum(f"_x_{k}").over(whole).alias(name) for name, k in (totals or {}).items()))
    if not totals:  # most series have one block, and nothing before it
        ahead = ahead.where("_block > 0")
    upto = Window.partitionBy(by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = named.withColumns({f"_r_{k}": F.sum(f"_x_{k}").over(upto) for k in sums}).join(ahead, [by, "_block"], "inner" if totals else "left")
    return rows.select(*(c for c in df.columns if c != "_block"), *((F.col(f"_r_{k}") + F.coalesce(f"_a_{k}", F.lit(0))).alias(k) for k in sums), *(totals or {}))


def _ordered(x: np.ndarray) -> np.ndarray:
    """The bits of doubles as whole numbers of the doubles' order, and back; NaN is above all."""
    return x ^ (x >> 63 & 0x7FFFFFFFFFFFFFFF)


def as_bits(x: np.ndarray) -> np.ndarray:
    return _ordered(x.view(np.int64))


def as_doubles(x: np.ndarray) -> np.ndarray:
    return _ordered(x).view(np.float64)


def _as_bits(values: DataFrame, keys: list[str], x: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([*b.columns[:-1], pa.array(_ordered(b.column(len(keys)).to_numpy(zero_copy_only=False).view(np.int64)))], names=[*keys, "bits"])

    kinds = ", ".join(f"`{k}` {values.schema[k].dataType.simpleString()}" for k in keys)
    return values.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("x")).mapInArrow(run, f"{kinds}, bits long")


def order_statistics(values: DataFrame, keys: list[str], x: str, ranks: dict[str, Column]) -> DataFrame:
    """(keys, n, a column for each of ranks): in each group, how many values x there are (null ones aren't) and those at the given places, from 0 in ascending order.

    ranks: expressions of n, the places; those below 0 or from n on are null. Groups without values have no row, nor have null keys. Each round counts values by BITS
    more bits within the bins that hold a rank, in tasks first; a group's bins are at most 2**BITS rows. Only values of these bins go on, equal ones as one row. When
    no bin has more than 2**BITS values, they are put in order.
    """
    rows, shift, wanted, done = _as_bits(values, keys, x).withColumn("m", F.lit(1).cast("long")), 64, None, None
    upto = lambda by, of: F.sum("m").over(Window.partitionBy(*keys, by).orderBy(of).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within, left = F.expr("rank >= upto - m and rank < upto"), (F.col("rank") - F.col("upto") + F.col("m")).alias("rank")
    while True:
        shift -= BITS
        bins = rows.groupBy(*keys, F.shiftright("bits", shift).alias("bin")).agg(F.sum("m").alias("m"), F.min("bits").alias("low"), F.max("bits").alias("high"))
        bins = bins.withColumn("parent", F.shiftright("bin", BITS) if wanted else F.lit(0)).withColumn("upto", upto("parent", "bin"))
        if wanted:
            hit = bins.join(wanted.select(*keys, "n", "name", "rank", F.col("bin").alias("parent")), [*keys, "parent"])
        else:
            places = F.array(*(F.struct(F.lit(k).alias("name"), c.cast("long").alias("rank")) for k, c in ranks.items()))
            hit = bins.withColumn("n", F.sum("m").over(Window.partitionBy(*keys))).withColumn("p", F.explode(places)).select(*bins.columns, "n", "p.name", "p.rank")
        hit = durable(hit.where(within).select(*keys, "n", "name", left, "bin", "m", "low", "high"), "ranks")
        told = hit.where("low = high").select(*keys, "n", "name", F.col("low").alias("bits"))
        done = done.unionByName(told) if done else told
        wanted = hit.where("low < high")
        most = wanted.agg(F.max("m")).first()[0]
        if most is None:
            break
        rows = rows.withColumn("bin", F.shiftright("bits", shift)).join(_broadcast(wanted.select(*keys, "bin").distinct()), [*keys, "bin"], "left_semi")
        rows = rows.groupBy(*keys, "bin", "bits").agg(F.sum("m").alias("m"))
        if most <= 1 << BITS:
            last = rows.withColumn("upto", upto("bin", "bits")).join(wanted.drop("m"), [*keys, "bin"]).where(within)
            done = done.unionByName(last.select(*keys, "n", "name", "bits"))
            break
        rows = durable(rows.drop("bin"), "values")
    found = _as_doubles(done, keys)
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("name") == k, F.col("x"))).alias(k) for k in ranks))


def _as_doubles(rows: DataFrame, keys: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _ordered(np.asarray(b.column("bits"))).view(np.float64)
            yield pa.record_batch([*(b.column(c) for c in (*keys, "n", "name")), pa.array(x)], names=[*keys, "n", "name", "x"])

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(run, f"{kinds}, n long, name string, x double")


def percentiles(values: DataFrame, keys: list[str], x: str, share: float, out: str) -> DataFrame:
    """(keys, out): the value at a share of the way from the smallest to the largest, between neighbours in proportion; null values and keys have none.

    Groups of at most BLOCK values are counted in tasks' memory; if one is larger, all go by selection.
    """
    values = values.where(F.col(x).isNotNull())
    if _largest(values, keys) <= BLOCK:
        return values.groupBy(*keys).agg(F.percentile(x, F.lit(float(share))).alias(out))
    at = F.lit(float(share)) * (F.col("n") - 1)
    found = order_statistics(values, keys, x, {"_low": F.floor(at), "_high": F.ceil(at)})
    part = at - F.floor(at)
    return found.select(*keys, F.when(part == 0, F.col("_low")).otherwise(F.col("_low") * (1 - part) + F.col("_high") * part).alias(out))
