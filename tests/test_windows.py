"""Windows cut from shared points, thresholds from panes, samples in parts, and encoders that get batches."""

import os
import resource

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalar import z_value
from tidemark.operators import detect, render, series, tokens


def indexed(spark, lengths, seed=4):
    random = np.random.default_rng(seed)
    rows = [(name, i, n, None if random.random() < 0.05 else float(x)) for name, n in lengths.items() for i, x in enumerate(random.normal(size=n).cumsum())]
    return spark.createDataFrame(rows, "series_id string, idx long, n long, value double")


@pytest.mark.parametrize("size, step, cut", [(24, 6, 1 << 18), (24, 6, 50), (10, 3, 10), (5, 8, 20), (7, 7, 1), (300, 75, 600)])
def test_windows_in_rows_are_windows_of_points(spark, monkeypatch, size, step, cut):
    monkeypatch.setattr(series, "CUT", cut)
    rows = indexed(spark, {"a": 211, "b": 24, "c": 7, "d": 1})
    points = {(r.series_id, r.idx): r.value for r in rows.collect()}
    want = {}
    for name, n in (("a", 211), ("b", 24), ("c", 7), ("d", 1)):
        for w, begin in enumerate(range(0, n - size + 1, step)):
            want[name, w] = [points[name, i] for i in range(begin, begin + size)]
    got = series.window_rows(rows, size, step, "value").collect()
    assert len(got) == len(want) and {(r.series_id, r.window_id): list(r.points) for r in got} == want


def test_windows_of_no_rows_and_of_missing_indices(spark):
    rows = indexed(spark, {"a": 40})
    assert series.window_rows(rows.where("idx < 0"), 8, 4, "value").count() == 0
    got = {r.window_id: len(r.points) for r in series.window_rows(rows.where("idx % 2 = 0 and idx >= 16"), 8, 4, "value").collect()}
    assert got == {w: sum(i % 2 == 0 and i >= 16 for i in range(w * 4, w * 4 + 8)) for w in range(3, 9)}


def test_a_point_is_shuffled_once(spark):
    rows = spark.range(200_000).select(F.lit("s").alias("series_id"), F.col("id").alias("idx"), F.lit(200_000).cast("long").alias("n"), F.rand(1).alias("value_norm"))
    got = series.window_rows(rows, 240, 60)
    cuts = 200_000 // (series.CUT // 240 * 60) + 1
    dealt = series._in_windows(rows, 240, 60).selectExpr(f"explode(sequence(_low div {series.CUT // 240}, _high div {series.CUT // 240}))").count()
    assert got.count() == (200_000 - 240) // 60 + 1 and dealt <= 200_000 + cuts * 240


@pytest.mark.parametrize("alpha", [0.3, 0.05])
def test_sliding_thresholds_from_panes(spark, alpha):
    rows = indexed(spark, {"a": 233, "b": 31, "c": 9, "d": 2, "e": 1}).withColumn("ts", F.col("idx")).withColumnRenamed("value", "score")
    got = {(r.series_id, r.idx) for r in detect.flagged(rows, alpha, smoothing=False, sliding=True).collect()}
    table, want = rows.toPandas(), set()
    for name, g in table.groupby("series_id"):
        x, n = g.sort_values("idx").score.to_numpy(), len(g)
        size, step = max(1, n // 3), max(1, n // 10)
        for begin in range(0, n, step):
            part = x[begin : begin + size]
            if np.isfinite(part).any():
                limit = np.nanmean(part) + z_value(alpha) * np.nanstd(part)
                want |= {(name, begin + i) for i, v in enumerate(part) if v > limit + 1e-12}
    assert want and {k for k in got} == want


def test_samples_in_parts_are_the_smallest_of_all(spark, monkeypatch):
    rows = spark.range(500).selectExpr("if(id % 3 = 0, 'a', 'b') as series_id", "id as window_id")
    rows = rows.unionByName(rows.where("window_id < 40"))
    pick = lambda: {(r.series_id, r.window_id) for r in series.sampled_windows(rows, 7, 3).collect()}
    monkeypatch.setattr(series, "SAMPLED", 1 << 16)
    whole = pick()
    monkeypatch.setattr(series, "SAMPLED", 11)
    draw = lambda w: ((w * 7919 + 3 * 104729 + 12345) % 1000003, w)
    want = {(s, w) for s in "ab" for w in sorted((w for w in range(500) if (w % 3 == 0) == (s == "a")), key=draw)[:7]}
    assert pick() == whole == want


class Wide(render.PatchEncoder):
    """768 dimensions; its tokens' first numbers are the process, how many encoders it has made, and the images of the call."""

    made = 0

    def __init__(self):
        super().__init__(16, 256)
        Wide.made += 1

    def __call__(self, images):
        if (images[:, 0, 0] == 0).any():
            raise ValueError("black corner")
        out = np.tile(super().__call__(images), (1, 1, 3))
        out[:, 0, :3] = os.getpid(), Wide.made, len(images)
        return out


def pictures(spark, n, side, spoiled=()):
    white, black = bytes([255]) * (side * side), bytes([0]) * (side * side)
    shade = F.lit(white) if not spoiled else F.when(F.col("id").isin(list(spoiled)), F.lit(black)).otherwise(F.lit(white))
    return spark.range(0, n, 1, 2).select(F.lit("s").alias("series_id"), F.col("id").alias("window_id"), shade.alias("image"))


def test_encoder_is_made_once_a_worker_and_gets_few_images(spark):
    toks = F.col("toks")
    got = render.encoded(pictures(spark, 60, 32), Wide, 32, most=8).select("window_id", toks[0][0].alias("pid"), toks[0][1].alias("made"), toks[0][2].alias("k"), F.size(toks).alias("n"), F.size(toks[3]).alias("dims"), "error").collect()
    assert len(got) == 60 and {(r.n, r.dims, r.error) for r in got} == {(4, 768, None)} and max(r.k for r in got) == 8
    assert {r.made for r in got} == {1.0}


def test_one_bad_image_fails_alone(spark):
    got = {r.window_id: r for r in render.encoded(pictures(spark, 20, 32, (3, 17)), Wide, 32, most=8).collect()}
    assert {w for w, r in got.items() if r.error} == {3, 17} and got[3].error == "ValueError: black corner" and got[3].toks is None and len(got[4].toks) == 4
    assert {r.error for r in render.encoded(pictures(spark, 3, 32), _unmade, 32).collect()} == {"OSError: no weights"}
    assert render.encoded(pictures(spark, 20, 32).where("window_id < 0"), Wide, 32).count() == 0


def _unmade():
    raise OSError("no weights")


class Peak(Wide):
    def __call__(self, images):
        out = np.full((len(images), 196, 768), 0.5)
        out[:, 0, 0] = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
        return out


def test_memory_of_tokens_of_768_dimensions(spark):
    """1,200 windows of 224 x 224 pixels have 1.4 GB of tokens; a worker holds those of a few windows."""
    peak = render.encoded(pictures(spark, 1200, 224), Peak, most=8).agg(F.max(F.col("toks")[0][0]), F.count("toks")).first()
    assert peak[1] == 1200 and peak[0] < 900, peak


@pytest.mark.parametrize("method, sliding", [("mean", False), ("median", False), ("mean", True), ("median", True)])
def test_thresholds_of_each_point(spark, method, sliding):
    rows = indexed(spark, {"a": 133, "b": 31, "c": 2, "d": 1}).withColumn("ts", F.col("idx")).withColumnRenamed("value", "score")
    nothing = spark.createDataFrame([("e", 0, 1, None, 0)], "series_id string, idx long, n long, score double, ts long")
    got = {(r.series_id, r.idx): r for r in detect.judged(rows.unionByName(nothing), 0.1, method, smoothing=False, sliding=sliding).collect()}
    assert len(got) == 168 and got["e", 0].threshold is None
    for name, g in rows.toPandas().groupby("series_id"):
        x, n = g.sort_values("idx").score.to_numpy(), len(g)
        size, step = (max(1, n // 3), max(1, n // 10)) if sliding else (n, n)
        want = np.full(n, np.inf)
        for begin in range(0, n, step):
            part = x[begin : begin + size]
            part = part[np.isfinite(part)]
            if len(part):
                middle = part.mean() if method == "mean" else np.median(part)
                spread = part.std() if method == "mean" else np.median(np.abs(part - middle))
                want[begin : begin + size] = np.minimum(want[begin : begin + size], middle + z_value(0.1) * spread)
        for i in range(n):
            limit = got[name, i].threshold
            assert (limit is None) if np.isinf(want[i]) else limit == pytest.approx(want[i])


@pytest.mark.parametrize("sample, spread, part", [(1000, 6.0, 64), (8, 6.0, 7), (20, 1.0, 5), (12, 0.0, 64)])
def test_memories_are_the_medians_of_all_windows(spark, monkeypatch, sample, spread, part):
    """Of windows that are all sampled, of some, and where bounds miss; with many equal values, both zeros, far values, and a series of one window."""
    for name, value in (("SAMPLE", sample), ("SPREAD", spread), ("PART", part), ("COUNTED", 9), ("STRETCH", 16)):
        monkeypatch.setattr(tokens, name, value)
    random, side, dims = np.random.default_rng(sample), 3, 2
    toks = {s: random.normal(size=(n, side * side, dims)) for s, n in (("a", 90), ("b", 61), ("c", 1), ("d", 40))}
    toks["a"][random.random(toks["a"].shape) < 0.6] = 1e-6
    toks["b"] = np.round(toks["b"])
    toks["d"][:3, 0], toks["d"][3:6, 1] = 1e9, -1e9
    rows = [(s, w, x.tolist()) for s, ws in toks.items() for w, x in enumerate(ws)]
    windows = spark.createDataFrame(rows, "series_id string, window_id long, toks array<array<double>>").repartition(3)
    masks = {"of2": tokens.mask_matrix(side, 2)}
    got = {(r.series_id, r.name): np.array(r.mems) for r in tokens.memories(windows, masks).collect()}
    assert got.keys() == {(s, name) for s in toks for name in ("of2", "patch")}
    for s, ws in toks.items():
        for name, each in (("patch", ws), ("of2", np.stack([masks["of2"] / 4 @ x for x in ws]))):
            np.testing.assert_allclose(got[s, name], np.sort(each, axis=0)[(len(ws) - 1) // 2], rtol=1e-12, atol=0 if name == "patch" else 1e-12)


def test_few_points_are_many_tasks_windows(spark, monkeypatch):
    """What a task draws and encodes isn't told by the bytes of its points."""
    monkeypatch.setattr(series, "CUT", 40)
    rows = spark.range(2000).selectExpr("'s' as series_id", "id as idx", "2000L as n", "cast(id as double) as value_norm")
    windows = series.window_rows(rows, 10, 5).select(F.spark_partition_id().alias("task"), "window_id").collect()
    assert sorted(r.window_id for r in windows) == list(range(399))
    assert len({r.task for r in windows}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
