"""Interval metrics, result rows and summaries."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import safe_ratio
from tidemark.operators.scan import blocked, running
from tidemark.sources.storage import durable


def _number(c: str, kind: str) -> Column:
    """A time, of this type, as a number: seconds, or what it is."""
    if kind == "timestamp_ntz":  # whatever the session's zone
        day = F.unix_date(F.col(c).cast("date")).cast("double")
        return day * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.extract(F.lit("SECOND"), c).cast("double")
    return (F.unix_date(c) if kind == "date" else F.col(c)).cast("double")


def _level() -> Column:
    """The least whole number of which the power of 2 is no less than the interval's length."""
    return F.ceil(F.log2(F.greatest(F.col("_e") - F.col("_s"), F.lit(1.0)))).cast("int")


def _levelled(df: DataFrame, other: DataFrame, side: str) -> DataFrame:
    """A row for each block of 2**level that an interval touches, at its own level and at those above it that the other side has in this series: at most two blocks
    each, as an interval is no longer than its level. Series that the other side lacks are left out."""
    theirs = other.groupBy("series_id").agg(F.collect_set("_own").alias("_levels"))
    levels = F.array_union(F.array("_own"), F.filter("_levels", lambda x: x > F.col("_own")))
    rows = df.join(theirs, "series_id").withColumn("_level", F.explode(levels))
    block = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
    rows = rows.withColumn("_block", F.explode(F.sequence(block("_s"), block("_e"))))
    return rows.select("series_id", *(F.col(c).alias(f"{side}{c}") for c in ("start", "end", "_own", "_s")), "_level", "_block")


def overlap_pairs(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(series_id, start, end, truth_start, truth_end) of closed intervals of one series that touch.

    Intervals meet in blocks of time whose length is that of the longer one's level, so a long series isn't one key, and a long interval isn't many rows. An
    interval whose end is before its start is compared with all of its series. Both sides are written first, as they are read several times.
    """
    kind = dict(found.dtypes)["start"]
    found, truth = (durable(df.select("series_id", "start", "end"), name) for df, name in ((found, "found"), (truth, "truth")))
    ordered = F.col("start") <= F.col("end")
    f, t = (df.where(ordered).withColumns({"_s": _number("start", kind), "_e": _number("end", kind)}).withColumn("_own", _level()) for df in (found, truth))
    f, t = _levelled(f, t, "f"), _levelled(t, f, "t")
    both = (F.col("fstart") <= F.col("tend")) & (F.col("tstart") <= F.col("fend"))
    # each pair once: at the level of the longer one, in the block in which the later begins
    once = (F.col("_level") == F.greatest("f_own", "t_own")) & (F.col("_block") == F.floor(F.greatest("f_s", "t_s") / F.pow(F.lit(2.0), F.col("_level"))))
    names = ("series_id", "fstart", "fend", "tstart", "tend")
    pairs = f.join(t, ["series_id", "_level", "_block"]).where(both & once).select(*names)
    turned = [df.where(~ordered) for df in (found, truth)]
    for a, b, odd in ((turned[0], truth, turned[0]), (found.where(ordered), turned[1], turned[1])):
        if odd.isEmpty():  # as nearly always; else the other side would be shuffled for nothing
            continue
        a, b = a.select("series_id", F.col("start").alias("fstart"), F.col("end").alias("fend")), b.select("series_id", F.col("start").alias("tstart"), F.col("end").alias("tend"))
        pairs = pairs.unionByName(a.join(b, "series_id").where(both).select(*names))
    return pairs.toDF("series_id", "start", "end", "truth_start", "truth_end")


def overlap_counts(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(side, series_id, start, end, copies, overlaps): how many of the other side's intervals each touches; side is f or t.

    What touches has begun by an interval's end and not ended before its start: one running count of begins and ends in order of time answers all of a series'
    intervals, and each input is read once. Begins go before ends of the same time. Ends before starts are turned round for this.
    """
    low, high = F.least("start", "end"), F.greatest("start", "end")
    rows = None
    for side, df in (("f", found), ("t", truth)):
        marks = F.array(F.struct(low.alias("at"), F.lit(0).alias("kind")), F.struct(high.alias("at"), F.lit(1).alias("kind")))
        own = df.select(F.lit(side).alias("side"), "series_id", "start", "end", F.explode(marks).alias("m")).select("side", "series_id", "start", "end", "m.at", "m.kind")
        rows = own if rows is None else rows.unionByName(own)
    of = lambda side, kind: F.when((F.col("side") == side) & (F.col("kind") == kind), 1).otherwise(0)
    rows = running(blocked(durable(rows, "marks"), "at"), ["at", "kind"], {f"_{s}{k}": of(s, k) for s in "ft" for k in (0, 1)})
    other = F.when(F.col("side") == "f", F.when(F.col("kind") == 0, -F.col("_t1")).otherwise(F.col("_t0"))).otherwise(F.when(F.col("kind") == 0, -F.col("_f1")).otherwise(F.col("_f0")))
    counted = rows.withColumn("other", other).groupBy("side", "series_id", "start", "end")
    copies = F.sum(F.when(F.col("kind") == 0, 1).otherwise(0))
    return counted.agg(copies.alias("copies"), (F.max(F.when(F.col("kind") == 1, F.col("other"))) + F.max(F.when(F.col("kind") == 0, F.col("other")))).alias("overlaps"))


def _of_side(a: DataFrame, b: DataFrame, touching: bool) -> DataFrame:
    a = durable(a, "intervals")  # it is counted and then joined with its counts
    counts = overlap_counts(a, b).where("side = 'f'").where("overlaps > 0" if touching else "overlaps = 0").select("series_id", "start", "end")
    return a.join(counts, ["series_id", "start", "end"], "left_semi").select(a.columns)


def unmatched(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that overlap nothing in b: false positives, or misses with the sides turned."""
    return _of_side(a, b, False)


def matched(a: DataFrame, b: DataFrame) -> DataFrame:
    return _of_side(a, b, True)


def rates(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to counts tp, fp, fn; 0 for an empty denominator."""
    out = counts.withColumn("precision", safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", safe_ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", safe_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def interval_rates(found: DataFrame, truth: DataFrame, roster: DataFrame) -> DataFrame:
    """(series_id, tp, fp, fn, precision, recall, f1) for each series of the roster. tp counts overlapping pairs."""
    total = lambda side, value: F.sum(F.when(F.col("side") == side, value).otherwise(0))
    alone = F.when(F.col("overlaps") == 0, F.col("copies")).otherwise(0)
    sums = overlap_counts(found, truth).groupBy("series_id").agg(total("f", F.col("copies") * F.col("overlaps")).alias("tp"), total("f", alone).alias("fp"), total("t", alone).alias("fn"))
    return rates(roster.select("series_id").distinct().join(sums, "series_id", "left").na.fill(0, ["tp", "fp", "fn"]))


def with_status(detected: DataFrame, roster: DataFrame) -> DataFrame:
    """Series (series_id, n_detected) get status success if the roster lists them, else no_gt; n_ground_truth is null then."""
    return detected.join(roster, "series_id", "left").withColumn("status", F.when(F.col("n_ground_truth").isNotNull(), "success").otherwise("no_gt"))


def results_union(frames: list[DataFrame], model: str | None = None, alpha: float | None = None) -> DataFrame:
    """All result rows of success; columns that a frame lacks are null, a missing status counts as success, missing model and alpha get the given ones."""

    def filled(df: DataFrame) -> DataFrame:
        for name, default in (("status", "success"), ("model", model), ("alpha", alpha)):
            if name not in df.columns:
                df = df.withColumn(name, F.lit(default))
        return df.where(F.col("status") == "success")

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(filled, frames))


def best_f1_summary(results: DataFrame) -> DataFrame:
    """Mean, sample deviation and number of each signal's best F1 over alphas, by dataset and model."""
    best = results.groupBy("dataset", "model", "signal").agg(F.max("f1").alias("f1max"))
    out = best.groupBy("dataset", "model").agg(F.round(F.avg("f1max"), 4).alias("Avg_F1max"), F.round(F.stddev_samp("f1max"), 4).alias("Std_F1max"), F.count(F.lit(1)).alias("N_Signals"))
    return out.select(F.col("dataset").alias("Dataset"), F.col("model").alias("Model"), "Avg_F1max", "Std_F1max", "N_Signals").orderBy("Dataset", "Model")


def filename_fields(stems: DataFrame, models: tuple[str, ...] = ("screening", "two_stage"), default_model: str = "screening") -> DataFrame:
    """Adds dataset, model and alpha, from stems ``results_<dataset>[_<model>]_alpha_<alpha>``."""
    parts = F.split("stem", "_")
    at = F.array_position(parts, "alpha").cast("int")
    middle = F.array_join(F.slice(parts, 2, at - 2), "_")
    known = rf"^(?:(.*)_)?({'|'.join(map(re.escape, models))})$"
    model = F.regexp_extract(middle, known, 2)
    dataset = F.when(model != "", F.regexp_extract(middle, known, 1)).otherwise(middle)
    return stems.where(at > 2).select("stem", dataset.alias("dataset"), F.when(model != "", model).otherwise(default_model).alias("model"), F.element_at(parts, at + 1).try_cast("double").alias("alpha"))
