"""Small vectors with answers worked out by hand, and properties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import z_value
from tidemark.operators import detect, evaluate, render, series, tokens


def of(spark, values, name="s"):
    return spark.createDataFrame([(name, float(i), v) for i, v in enumerate(values)], "series_id string, ts double, value double")


def scores(spark, values):
    return series.with_index(of(spark, values)).selectExpr("*", "value as score")


def test_detrend_and_scale(spark):
    got = series.min_max(series.detrended(series.with_index(of(spark, [0.0, 1.0, 2.0, 9.0])))).orderBy("idx").toPandas()
    assert np.allclose(got.value_norm, [0.857143, 0.428571, 0, 1], atol=1e-6)
    assert series.min_max(of(spark, [3.0, 3.0]), "value").toPandas().value_norm.tolist() == [0, 0]


def test_smoothing_is_the_bias_corrected_mean(spark):
    x = np.random.default_rng(0).normal(size=700)
    got = series.smoothed(scores(spark, x.tolist())).orderBy("idx").toPandas()
    assert np.allclose(got.smooth, pd.Series(x).ewm(span=7).mean())


@pytest.mark.parametrize(("n", "size", "step"), [(23, 24, 6), (24, 24, 6), (50, 7, 3), (20, 4, 9)])
def test_windows(spark, n, size, step):
    got = series.with_windows(series.with_index(of(spark, [0.0] * n)), size, step).select("window_id", "idx").collect()
    want = {(k, i) for k, a in enumerate(range(0, n - size + 1, step)) for i in range(a, a + size)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_window_step_must_be_positive():
    with pytest.raises(ValueError):
        series.window_span(4, 8)


def test_threshold(spark):
    assert z_value(0.01) == pytest.approx(2.3263478740408408)
    for method in ("mean", "median"):
        got = detect.detect(scores(spark, [1.0, 1.0, 1.0, 1.0, 10.0, 1.0, 1.0, 1.0]), 0.1, method).collect()
        assert [(r.start, r.end, r.severity) for r in got] == [(4, 4, 10)]
    assert detect.detect(scores(spark, [2.0] * 9), 0.1).count() == 0
    with pytest.raises(ValueError):
        detect.detect(scores(spark, [1.0, 2.0]), 0.1, "mode")


def test_nan_is_never_flagged_and_the_last_run_is_closed(spark):
    got = detect.above_percentile(scores(spark, [1.0, float("nan"), 5.0, 6.0]), threshold=2.0).collect()
    assert [(r.start, r.end) for r in got] == [(2, 3)]


def test_padding_and_merging(spark):
    runs = spark.createDataFrame([("s", 2, 3), ("s", 6, 7), ("s", 15, 15)], "series_id string, s long, e long")
    wide = detect.padded(runs, spark.createDataFrame([("s", 20)], "series_id string, n long"), 1)
    assert sorted((r.s, r.e) for r in detect.merged(wide).collect()) == [(1, 8), (14, 16)]
    rows = [(1, 5, 0.1), (2, 3, 0.2), (4, 9, 0.3), (10, 12, 0.4), (14, 20, 0.5), (15, 16, 0.9), (30, 31, 1.0)]
    rows = spark.createDataFrame([("s", *r) for r in rows], "series_id string, s long, e long, w double")
    got = sorted((r.s, r.e, round(r.w, 6)) for r in detect.merged(rows, severity="w").collect())
    assert got == [(1, 12, 0.25), (14, 20, 0.7), (30, 31, 1.0)]


def test_indices(spark):
    ts = spark.createDataFrame([("s", t, 0.0) for t in (10, 20, 20, 30)], "series_id string, ts long, value double")
    asked = spark.createDataFrame([("s", 1, 20, 20), ("s", 2, 5, 9), ("s", 3, 31, 40)], "series_id string, iv long, start long, end long")
    got = sorted((r.iv, r.s, r.e) for r in detect.indices_of(asked, series.with_index(ts)).collect())
    assert got == [(1, 1, 2), (2, 0, 0), (3, 3, 3)]
    pair = spark.createDataFrame([("s", 5, -1)], "series_id string, s long, e long")
    n = spark.createDataFrame([("s", 3)], "series_id string, n long")
    assert [tuple(r) for r in detect.clamped(pair, n).select("s", "e").collect()] == [(0, 2)]
    assert [tuple(r) for r in detect.clamped(pair, n, swap=False).select("s", "e").collect()] == [(2, 0)]


def test_rates(spark):
    iv = lambda rows: spark.createDataFrame([("s", *r) for r in rows], "series_id string, start long, end long")
    roster = spark.createDataFrame([("s",)], "series_id string")
    got = evaluate.interval_rates(iv([(15, 35), (70, 80)]), iv([(10, 20), (30, 40), (50, 60)]), roster).first()
    assert (got.tp, got.fp, got.fn) == (2, 1, 1) and got.f1 == pytest.approx(2 / 3)
    assert evaluate.overlap_pairs(iv([(1, 5)]), iv([(5, 9)])).count() == 1
    assert evaluate.interval_rates(iv([(1, 2)]), iv([]), roster).first().f1 == 0


def test_masks_and_harmonic(spark):
    masks = tokens.make_masks(spark, 3, 2)
    got = masks.groupBy("mask_idx").agg({"patch_idx": "collect_set"}).orderBy("mask_idx").collect()
    assert [sorted(r[1]) for r in got] == [[0, 1, 3, 4], [1, 2, 4, 5], [3, 4, 6, 7], [4, 5, 7, 8]]
    rows = spark.createDataFrame([("s", 0, i, v) for i, v in enumerate([0.1, 0.2, 0.3, 0.4])], "series_id string, window_id long, token_idx long, score double")
    want = [0.1, 0.133333, 0.2, 0.15, 0.192, 0.266667, 0.3, 0.342857, 0.4]
    for shift, expect in ((0, want), (1, [*want[1:], None])):
        got = [r.score for r in tokens.harmonic(rows, masks, 3, shift).orderBy("patch").collect()]
        assert all((a is None and b is None) or a == pytest.approx(b, abs=1e-5) for a, b in zip(got, expect))


def test_alignment(spark):
    v = spark.createDataFrame([("s", k, float(x)) for k, x in enumerate([0, 2, 4, 10])], "series_id string, k long, score double")
    n = spark.createDataFrame([("s", 9)], "series_id string, n long")
    got = [r.score for r in tokens.aligned(v, n, 7, 7).orderBy("idx").collect()]
    assert np.allclose(got, [0, 1, 2, 3, 4, 7, 10, 13, 16])


def test_memory_takes_the_lower_median(spark):
    rows = spark.createDataFrame([("s", i, 0, [v, -v]) for i, v in enumerate([4.0, 1.0, 3.0, 2.0])], "series_id string, window_id long, token_idx long, tok array<double>")
    assert tokens.memory(tokens.packed(rows)).first().mem == [2.0, -3.0]
    wide = np.random.default_rng(3).normal(size=(9, 150))  # more dimensions than one row carries
    rows = spark.createDataFrame([("s", i, 0, v.tolist()) for i, v in enumerate(wide)], rows.schema)
    assert np.array_equal(tokens.memory(tokens.packed(rows)).first().mem, np.sort(wide, axis=0)[4])


def test_raster_and_png():
    image = render.raster(np.linspace(0, 1, 50), 32, 32)
    assert image.shape == (32, 32) and image[31, 0] < 0.2 and image[0, 31] < 0.2 and image[0, 0] == 1
    assert render.raster(np.array([5.0, 7.0]), 8, 8, None, None)[0, 7] < 0.2
    assert render.png(image).startswith(b"\x89PNG") and render.PatchEncoder(16, 8)(np.stack([image] * 3)).shape == (3, 4, 8)
    assert (render.raster([float("nan")]) == 1).all()


def inked(values, height, width, low, high, line, mark, k=192):
    """A plot's gray values by k x k samples of each pixel: how many segments and squares each is in."""
    v = np.asarray(values, float)
    ok = np.isfinite(v)
    low, high = v[ok].min() if low is None else low, v[ok].max() if high is None else high
    x = np.array([i * width / (len(v) - 1) if len(v) > 1 else width / 2 for i in range(len(v))])[ok]
    y = (1 - (v[ok] - low) / (high - low)) * height if high > low else np.full(len(x), height / 2)
    px, py = np.meshgrid((np.arange(width * k) + 0.5) / k, (np.arange(height * k) + 0.5) / k)
    n = np.zeros_like(px)
    for i in range(len(x) - 1):
        dx, dy = x[i + 1] - x[i], y[i + 1] - y[i]
        along, aside = ((px - x[i]) * dx + (py - y[i]) * dy) / np.hypot(dx, dy) ** 2, ((px - x[i]) * dy - (py - y[i]) * dx) / np.hypot(dx, dy)
        n += (along >= 0) & (along <= 1) & (np.abs(aside) <= line / 2)
    for a, b in zip(x, y):
        n += (np.abs(px - a) <= mark / 2) & (np.abs(py - b) <= mark / 2)
    return 1 - np.minimum(1, n.reshape(height, k, width, k).mean((1, 3)))


def test_ink_is_the_area_that_is_covered():
    random = np.random.default_rng(3)
    for values, height, width, low, high, line, mark in (
        (random.random(12), 12, 9, 0.0, 1.0, render.LINE, render.MARK),
        (random.random(30), 8, 12, 0.0, 1.0, 1.0, 0.0),  # more points than columns
        (random.random(4), 8, 8, 0.0, 1.0, 0.5, 2.3),  # thick squares
        (random.normal(size=20) * 2, 8, 9, 0.0, 1.0, 2.0, 0.5),  # much is beyond the image
        (random.normal(size=9), 9, 13, None, None, 1.4, 0.0),
        ([0.5, np.nan, 0.2, np.nan], 8, 8, 0.0, 1.0, 1.4, 0.3),
        ([3.0, 3.0, 3.0], 8, 8, None, None, 1.4, 0.0),
        ([0.4], 7, 7, 0.0, 1.0, 1.0, 3.0),
    ):
        got = render.rasters([values, [np.nan], values], height, width, low, high, line, mark)
        assert np.abs(got[0] - inked(values, height, width, low, high, line, mark)).max() < 1 / 255
        assert (got[1] == 1).all() and np.array_equal(got[0], got[2])
    assert (render.rasters([[1e300, -1e300, 0.5]], 8, 8, 0.0, 1.0) >= 0).all() and render.rasters([], 8, 8).shape == (0, 8, 8)


def test_files(spark, tmp_path):
    from tidemark.sources import files

    (tmp_path / "a-1.csv").write_text("timestamp,value\n2,5\n1,4\n")
    got = files.read_series(spark, str(tmp_path)).collect()
    assert sorted((r.series_id, r.ts, r.value) for r in got) == [("a-1", 1, 4), ("a-1", 2, 5)]
    (tmp_path / "truth.txt").write_text('signal,events\nx,"[[1, 2], [3, 4]]"\ny,"[]"\nbad line\n')
    truth, roster = files.read_truth(spark, str(tmp_path / "truth.txt"))
    assert truth.count() == 2 and sorted((r.series_id, r.n_ground_truth) for r in roster.collect()) == [("x", 2), ("y", 0)]
    (tmp_path / "index.txt").write_text("A,\"('s1', 's2')\"\nB,\"('s3',)\"\n")
    assert files.read_dataset_index(spark, str(tmp_path / "index.txt"), ["A"]).count() == 2


def test_indices_of_null_bounds_and_ties(spark):
    ts = spark.createDataFrame([("s", t, 0.0) for t in (10, 20, 20, 30)] + [("t", 5, 0.0)], "series_id string, ts long, value double")
    asked = [("s", 1, None, None), ("s", 2, 20, 20), ("s", 3, 20, 20), ("t", 1, 0, 9), ("none", 1, 0, 9)]
    asked = spark.createDataFrame(asked, "series_id string, iv long, start long, end long")
    got = sorted(tuple(r) for r in detect.indices_of(asked, series.with_index(ts)).collect())
    assert got == [("s", 1, 3, 0), ("s", 2, 1, 2), ("s", 3, 1, 2), ("t", 1, 0, 0)]


def test_times_of_intervals_over_several_blocks(spark):
    x = np.random.default_rng(1).normal(size=900)
    pairs = [(0, 899), (255, 256), (256, 256), (100, 700), (5, 4)]
    got = detect.with_times(spark.createDataFrame([("s", *p) for p in pairs], "series_id string, s long, e long"), scores(spark, x.tolist())).collect()
    assert {(r.s, r.e): (r.start, r.end, round(r.severity, 9)) for r in got} == {(a, b): (a, b, round(x[a : b + 1].mean(), 9)) for a, b in pairs if a <= b}


def test_alphas_together_and_apart(spark):
    rows = scores(spark, np.random.default_rng(2).normal(size=400).tolist())
    alphas = (0.1, 0.01, 0.001)
    got = {tuple(r) for r in detect.detect_each(rows, alphas, "median").select("alpha", "start", "end").collect()}
    assert got == {(a, r.start, r.end) for a in alphas for r in detect.detect(rows, a, "median").collect()}


def test_command_line_steps(spark, tmp_path):
    from tidemark import __main__ as cli

    (tmp_path / "truth.json").write_text("[[10, 20], [30, 40], [50, 60]]")
    (tmp_path / "found.csv").write_text("start,end,severity\n15,35,1\n70,80,1\n")
    got = cli.evaluated(spark, str(tmp_path / "truth.json"), str(tmp_path / "found.csv")).first()
    assert got.asDict() == pytest.approx({"precision": 2 / 3, "recall": 2 / 3, "F1": 2 / 3})
    head = "dataset,signal,model,alpha,status,precision,recall,f1,n_detected,n_ground_truth\n"
    (tmp_path / "results_D_two_stage_alpha_0.1.csv").write_text(head + "d,a,two_stage,0.1,success,1,1,0.5,1,1\nd,b,two_stage,0.1,no_gt,,,,1,\n")
    (tmp_path / "results_D_two_stage_alpha_0.01.csv").write_text(head + "d,a,two_stage,0.01,success,1,1,1.0,1,1\nd,c,two_stage,0.01,success,1,1,0.5,1,1\n")
    got = cli.aggregate(spark, str(tmp_path / "results_*_alpha_*.csv"), str(tmp_path / "summary")).collect()
    assert [tuple(r) for r in got] == [("D", "two_stage", 0.75, 0.3536, 2)]


def test_experiment(spark, tmp_path):
    from tidemark import __main__ as cli

    x = np.sin(np.arange(600) / 9)
    x[300:320] += 6
    (tmp_path / "series").mkdir()
    for name in ("a", "b"):
        (tmp_path / "series" / f"{name}.csv").write_text("timestamp,value\n" + "".join(f"{i},{v}\n" for i, v in enumerate(x)))
    (tmp_path / "truth.csv").write_text('signal,events\na,"[[300, 320]]"\n')
    got = cli.experiment(spark, str(tmp_path / "series"), str(tmp_path / "truth.csv"), "D", str(tmp_path / "out"), two_stage=True).collect()
    assert len(got) == 6
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted({(r.signal, r.status) for r in rows}) == [("a", "success"), ("b", "no_gt")] and len(rows) == 12


def test_plots_can_be_read():
    assert render.ticks(0, 1000, 11).tolist() == list(range(0, 1001, 100)) and render.ticks(3, 3, 5).tolist() == [3]
    x = np.arange(3000)
    drawn = render.plot(x, np.where(x == 1500, 9.0, 0.0))
    left = 90
    assert drawn.shape == (342, 1200) and drawn[24:290, left + 554].min() == 0 and drawn[30:250, 300:600].min() == 1  # one spike in the middle
    assert (drawn[304:324] < 0.5).sum() > 200  # figures under the axis
    name = render.label("TIME SERIES") == 1
    for ink in (name, render.label("TIME") == 1, np.rot90(render.label("VALUE")) == 1):
        views = np.lib.stride_tricks.sliding_window_view(drawn < 0.5, ink.shape)
        assert (views == ink).all((2, 3)).any()
    # the legend is in a corner that the line leaves free, and hides nothing
    for values, corner in ((np.zeros(3000), (slice(20, 60), slice(1050, 1200))), (x, (slice(20, 60), slice(91, 260))), (-x, (slice(20, 60), slice(1050, 1200)))):
        drawn = render.plot(x, values.astype(float))
        framed = np.lib.stride_tricks.sliding_window_view(drawn[corner] < 0.5, name.shape)
        assert (framed == name).all((2, 3)).any()
    assert render.plot(x[:0], x[:0].astype(float)).shape == (342, 1200)
    assert render.label("10").sum() == (15 - 2 + 4 - 8 + 0) * 4 or render.label("10").max() == 1


def test_one_window_in_numpy_is_the_frames_together(spark):
    random = np.random.default_rng(11)
    side, size, share = 4, 8, 0.25
    toks = random.normal(size=(6, side * side, 5))
    rows = spark.createDataFrame([("s", w, i, toks[w, i].tolist()) for w in range(6) for i in range(side * side)], "series_id string, window_id long, token_idx long, tok array<double>")
    windows, masks = tokens.packed(rows), {"large": tokens.mask_matrix(side, 3), "mid": tokens.mask_matrix(side, 2)}
    maps, memories = [], {"patch": tokens.memory(windows)}
    for name, k in (("large", 3), ("mid", 2)):
        own = tokens.pooled(windows, masks[name])
        memories[name] = tokens.memory(own)
        maps.append(tokens.harmonic(tokens.dissimilarity(own, memories[name]), tokens.make_masks(spark, side, k), side))
    plain = tokens.dissimilarity(windows, memories["patch"]).withColumnRenamed("token_idx", "patch")
    want = tokens.column_top(tokens.upsampled(tokens.fused(*maps, plain), side, size), size, share).collect()
    found = tokens.with_memory(windows, memories, lambda t, held: tokens.column_scores(t, held, masks, side, size, share)).collect()
    got = {(r.window_id, c): v for r in found for c, v in enumerate(r.out)}
    assert len(got) == len(want) == 48 and all(got[r.window_id, r.c] == pytest.approx(r.score) for r in want)
    for k in (2, 3):
        listed = tokens.make_masks(spark, side, k).collect()
        assert {(r.mask_idx, r.patch_idx) for r in listed} == set(zip(*np.nonzero(tokens.mask_matrix(side, k))))


def test_windows_meet_their_memory_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(tokens, "STRETCH", 3)
    rows = spark.createDataFrame([(s, w, [[float(w), 1.0]]) for s in "ab" for w in range(10)], "series_id string, window_id long, toks array<array<double>>")
    mem = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 0, [0.0, 1.0])], "series_id string, token_idx long, mem array<double>")
    got = {(r.series_id, r.window_id): r.out for r in tokens.with_memory(rows, {"m": mem}, lambda t, held: (t @ held["m"].T)[:, 0]).collect()}
    assert got == {(s, w): [float(w) if s == "a" else 1.0] for s in "ab" for w in range(10)}


def test_overlaps_against_force(spark):
    random = np.random.default_rng(12)

    def some(n):
        start = random.integers(0, 3000, n)
        return [(f"s{i % 3}", int(a), int(a + length)) for i, (a, length) in enumerate(zip(start, np.where(random.random(n) < 0.05, 2000, random.integers(0, 30, n))))]

    a, b = some(300), some(250)
    a += a[:5]
    schema = "series_id string, start long, end long"
    found, truth = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    pairs = [(x, y) for x in a for y in b if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2]]
    assert sorted(tuple(r) for r in evaluate.overlap_pairs(found, truth).collect()) == sorted((*x, *y[1:]) for x, y in pairs)
    hit, seen = {x for x, _ in pairs}, {y for _, y in pairs}
    assert sorted(tuple(r) for r in evaluate.unmatched(found, truth).collect()) == sorted(x for x in a if x not in hit)
    assert sorted(tuple(r) for r in evaluate.matched(truth, found).collect()) == sorted(y for y in b if y in seen)
    got = {r.series_id: (r.tp, r.fp, r.fn) for r in evaluate.interval_rates(found, truth, spark.createDataFrame([("s0",), ("s1",), ("s2",), ("none",)], "series_id string")).collect()}
    assert got == {s: (sum(x[0] == s for x, _ in pairs), sum(x[0] == s and x not in hit for x in a), sum(y[0] == s and y not in seen for y in b)) for s in ("s0", "s1", "s2", "none")}
    odd = spark.createDataFrame([("s0", 9, 4)], schema)  # an end before its start
    assert evaluate.overlap_pairs(odd, spark.createDataFrame([("s0", 1, 20), ("s0", 4, 5)], schema)).count() == 1


class Fussy(render.PatchEncoder):
    """Fails on windows that go down at their end."""

    def __call__(self, images):
        if (images[:, : images.shape[1] // 2, -1].min(1) > 0.5).any():
            raise RuntimeError("no such picture")
        return super().__call__(images)


def test_detectors_options_and_failures(spark):
    from tidemark.plans.detector import ScreeningDetector, sweep

    x = np.sin(np.arange(300) / 9) + np.where(np.arange(300) > 285, 4, 0)
    rows = [("up", float(i), float(v)) for i, v in enumerate(x)] + [("down", float(i), float(-v)) for i, v in enumerate(x)] + [("none", float(i), None) for i in range(80)]
    df = spark.createDataFrame(rows, "series_id string, ts double, value double")
    small = dict(window_size=60, side=64)
    scores = ScreeningDetector(**small, encoder=Fussy).scores(df).cache()
    errors = {r.series_id: r.error for r in scores.select("series_id", "error").distinct().collect()}
    assert errors["down"] == "RuntimeError: no such picture" and errors["none"] == "no readable value"
    roster = spark.createDataFrame([("up", 1), ("down", 1)], "series_id string, n_ground_truth long")
    truth = spark.createDataFrame([("up", 286.0, 299.0)], "series_id string, start double, end double")
    got = sweep(scores, truth, roster, "D", (0.1,)).collect()
    assert {(r.signal, r.status) for r in got if r.signal != "up"} == {("down", "failed"), ("none", "failed")} and all(r.f1 is None for r in got if r.status == "failed")
    for options in ({"standardize": False}, {"kernels": ()}, {"kernels": (2,), "index_shift": 0}):
        one = ScreeningDetector(**small, **options).scores(df.where("series_id = 'up'")).collect()
        assert len(one) == 300 and max(r.score for r in one) > 0 and all(r.error is None for r in one)


def test_requests_and_sinks(spark, tmp_path):
    import base64
    import json

    from tidemark.operators import verify
    from tidemark.sources import files

    def send(body):
        part = json.loads(body)["messages"][0]["content"]
        assert part[0]["text"] == "what?" and base64.b64decode(part[1]["image_url"]["url"].removeprefix("data:image/png;base64,")).startswith(b"\x89PNG")
        return "answer"

    assert verify.ChatVerifier(send, "some-model")("what?", render.png(np.ones((4, 4)))) == "answer"
    windows = spark.createDataFrame([("a/b", 0, [0.0, 1.0]), ("a/b", 1, [1.0, 0.0])], "series_id string, window_id long, points array<double>")
    imaged = render.images(windows, 32)
    first, again = (files.write_images(imaged, str(tmp_path / "png"), 32).collect() for _ in range(2))
    assert all(r.written for r in first) and not any(r.written for r in again) and len(list((tmp_path / "png" / "a%2Fb").iterdir())) == 2
    files.write_windows(windows, str(tmp_path / "windows"))
    assert spark.read.parquet(str(tmp_path / "windows")).count() == 2


def test_a_long_series_is_asked_about_by_few_points(spark):
    from tidemark.operators import verify

    x = np.random.default_rng(5).normal(size=9000)
    seen = []
    rows = series.with_index(of(spark, x.tolist()))
    raw = verify.answers(verify.prompts(spark.createDataFrame([("s", 3, 9)], "series_id string, s long, e long")), rows, verify.KeepAll())
    got = verify.answered(raw).collect()
    assert [(r.s, r.e) for r in got] == [(3, 9)] and not seen


def test_overlap_pairs_of_odd_rows_and_series_with_other_levels(spark):
    """Null keys and ends, rows that repeat, ends before starts on both sides, series of one side; an interval has rows at its own series' levels only."""
    found = [("a", 0, 0), ("a", 3, 70), ("a", 3, 70), ("b", 5, 5), ("c", 1, 2), (None, 1, 9), ("a", None, 9), ("a", 9, None), ("b", 9, 4), ("d", 0, 1000)]
    truth = [("a", 0, 4), ("a", 60, 61), ("a", 71, 90), ("b", 1, 2000), ("b", 1, 2000), ("b", 8, 3), ("d", 500, 499), (None, 1, 9), ("e", 1, 1), ("a", None, None)]
    f, t = (spark.createDataFrame(x, "series_id string, start long, end long") for x in (found, truth))
    touch = lambda x, y: x[0] is not None and x[0] == y[0] and None not in (*x, *y) and x[1] <= y[2] and y[1] <= x[2]
    assert sorted(tuple(r) for r in evaluate.overlap_pairs(f, t).collect()) == sorted((*x, *y[1:]) for x in found for y in truth if touch(x, y))
    assert evaluate.overlap_pairs(f.limit(0), t).count() == evaluate.overlap_pairs(f, t.limit(0)).count() == 0
    x, y = (df.where("start <= end").withColumns({"_s": F.col("start").cast("double"), "_e": F.col("end").cast("double")}).withColumn("_own", evaluate._level()) for df in (f, t))
    levels = {(r.series_id, r.fstart, r._level) for r in evaluate._levelled(x, y, "f").collect()}
    assert levels == {("a", 0, 0), ("a", 0, 2), ("a", 0, 5), ("a", 3, 7), ("b", 5, 0), ("b", 5, 11)}


def test_overlap_pairs_finds_each_side_once(spark):
    rows = spark.range(40).select((F.col("id") % 3).cast("string").alias("series_id"), F.col("id").alias("start"), (F.col("id") + 2).alias("end"))
    last = rows.withColumn("n", F.row_number().over(Window.partitionBy("series_id").orderBy("start"))).where("n > 2").drop("n")
    assert "Window" not in evaluate.overlap_pairs(last, last)._jdf.queryExecution().toString()


def test_unmatched_rows_are_found_once_and_odd_ones_stay_as_they_were(spark):
    """Rows that repeat stay with all columns; null keys and ends match nothing and are in neither; what finds the rows isn't in the result's plan."""
    found = [("a", 0, 0, 1.0), ("a", 3, 70, 2.0), ("a", 3, 70, 2.0), ("a", 3, 70, None), ("c", 1, 2, 3.0), (None, 1, 9, 4.0), ("a", None, 9, 5.0), ("a", 9, None, 6.0)]
    f = spark.createDataFrame(found, "series_id string, start long, end long, severity double")
    f = f.withColumn("n", F.row_number().over(Window.partitionBy("series_id").orderBy("start"))).where("n > 0").drop("n")
    t = spark.createDataFrame([("a", 4, 5), ("a", 4, 5), ("b", 1, 2), (None, 1, 9)], "series_id string, start long, end long")
    for made, want in ((evaluate.matched, found[1:4]), (evaluate.unmatched, [found[0], found[4]])):
        out = made(f, t)
        assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
        assert out.columns == f.columns and "Window [row_number" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert evaluate.unmatched(f.limit(0), t).count() == evaluate.matched(f, t.limit(0)).count() == 0
