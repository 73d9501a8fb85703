"""Scans in blocks and selection by rounds against plain windows and numpy; files that are read by their own header."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import detect, evaluate, scan, series
from tidemark.sources import files


def points(n=700, seed=2):
    """Two long series with equal times and null values, and a short one."""
    random = np.random.default_rng(seed)
    rows = [(s, None if s == "b" and i % 97 == 0 else float(random.integers(0, n // 3)), None if i % 41 == 0 else float(random.normal()), i) for s, m in (("a", n), ("b", n // 2), ("c", 3)) for i in range(m)]
    return [rows[i] for i in random.permutation(len(rows))]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(points(), "series_id string, ts double, value double, event_id long").repartition(5)


def told(df):
    return sorted(map(str, df.collect()))


def test_series_in_blocks_are_what_whole_ones_are(frame, monkeypatch):
    def all_of(df):
        indexed = series.with_index(df, "event_id")
        scored = indexed.withColumn("score", F.col("value"))
        smooth = series.smoothed(scored).withColumn("smooth", F.round("smooth", 9))
        found = detect.detect(scored.where("ts is not null"), 0.3, smoothing=False)
        marks = scored.where("event_id % 11 = 0 and ts is not null").select("series_id", F.col("event_id").alias("iv"), (F.col("ts") - 3.5).alias("start"), (F.col("ts") + 2).alias("end"))
        times = marks.select("series_id", "start", "end")
        sums = evaluate.overlap_counts(found.select("series_id", "start", "end"), times)
        return [told(x) for x in (indexed, smooth, detect.islands(scored.where("score > 0")), found.withColumn("severity", F.round("severity", 9)), detect.indices_of(marks, indexed), sums)]

    whole = all_of(frame)
    for block in (20, 1):
        monkeypatch.setattr(scan, "BLOCK", block)
        assert "_block" in scan.blocked(frame, "ts").columns
        assert all_of(frame) == whole
    assert series.with_index(frame.limit(0)).count() == 0


def test_a_long_series_is_many_tasks_rows(frame, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", 50)
    sizes = [r["count"] for r in scan.blocked(frame, "ts").groupBy("series_id", "_block").count().collect()]
    assert max(sizes) <= 150 and len(sizes) > 14


def by_numpy(rows, ranks):
    out = {}
    for key in {k for k, x in rows if x is not None}:
        x = np.sort(np.array([x for k, x in rows if k == key and x is not None]))
        out[key] = (len(x), *(float(x[r(len(x))]) if 0 <= r(len(x)) < len(x) else None for r in ranks))
    return out


def test_order_statistics(spark, monkeypatch):
    random = np.random.default_rng(4)
    rows = [("same", 2.5)] * 400 + [("two", 1.0), ("two", 1.0 + 2**-52)] * 50 + [("one", -7.0), ("null", None), ("odd", -0.0), ("odd", 0.0), ("odd", float("inf")), ("odd", float("-inf")), ("odd", 5e-324)]
    rows += [("many", float(x)) for x in random.normal(size=3000)] + [("close", 1 + float(x) * 1e-13) for x in random.random(500)] + [("many", None)] * 9
    df = spark.createDataFrame(rows, "k string, x double").repartition(3)
    ranks = {"low": F.expr("(n - 1) div 2"), "top": F.expr("n - 1"), "none": F.col("n")}
    want = by_numpy(rows, [lambda n: (n - 1) // 2, lambda n: n - 1, lambda n: n])
    for bits in (16, 4):
        monkeypatch.setattr(scan, "BITS", bits)  # with 4, all rounds are needed
        assert {r.k: (r.n, r.low, r.top, r.none) for r in scan.order_statistics(df, ["k"], "x", ranks).collect()} == want
    assert scan.order_statistics(df.limit(0), ["k"], "x", ranks).count() == 0


def test_percentiles_by_selection(spark, monkeypatch):
    rows = [(f"s{i % 3}", float((i * 7919) % 1009) / 7) for i in range(2000)] + [("s9", 4.0), ("s8", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    want = {k: np.percentile([x for s, x in rows if s == k], 99) for k in ("s0", "s1", "s2", "s9")}
    for block in (scan.BLOCK, 10):
        monkeypatch.setattr(scan, "BLOCK", block)
        got = {r.k: r.p for r in scan.percentiles(df, ["k"], "x", 0.99, "p").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_one_series_of_ten_million_points(spark):
    """No group's state grows: the first round leaves a bin of some hundred thousand values."""
    n = 10_000_000
    df = spark.range(n).select(F.lit("s").alias("k"), (F.pmod(F.col("id") * 1_000_003, F.lit(n)) / 7.0).alias("x"))
    (r,) = scan.order_statistics(df, ["k"], "x", {"low": F.expr("(n - 1) div 2")}).collect()
    assert (r.n, r.low) == (n, (n - 1) // 2 / 7.0)


def test_result_files_by_their_own_header(spark, tmp_path):
    (tmp_path / "results_A_alpha_0.1.csv").write_text("signal,status,f1,precision\ns1,success,0.75,0.5\ns2,failed,,\n\ns3,success,high,1\n")
    (tmp_path / "results_B_two_stage_alpha_0.01.csv").write_text('f1,model,alpha,signal\n0.5,own,0.2,"s,4"\n1,2,3\n')
    (tmp_path / "results_C_alpha_0.1.csv").write_text("a,b\n1,2\n")
    rows = files.read_result_files(spark, f"{tmp_path}/results_*.csv")
    got = sorted((r.dataset, r.signal, r.model, r.alpha, r.status, r.f1, r.precision) for r in rows.collect())
    assert got == [("A", "s1", "screening", 0.1, "success", 0.75, 0.5), ("A", "s2", "screening", 0.1, "failed", None, None), ("A", "s3", "screening", 0.1, "success", None, 1.0), ("B", "s,4", "own", 0.2, "success", 0.5, None)]
    errors = sorted((r.file, r.line) for r in files.result_file_errors(spark, f"{tmp_path}/results_*.csv").collect())
    assert errors == [("results_A_alpha_0.1.csv", 5), ("results_B_two_stage_alpha_0.01.csv", 3), ("results_C_alpha_0.1.csv", 1)]


def test_truth_lines_that_cannot_be_read_are_told(spark, tmp_path):
    (tmp_path / "truth.csv").write_text('signal,events\ns1,"[[1, 2], [3, 4]]"\ns2,"[[oops"\n,"[[1, 2]]"\ns3,"[]"\n')
    assert sorted(r.text for r in files.truth_errors(spark, f"{tmp_path}/truth.csv").collect()) == [',"[[1, 2]]"', 's2,"[[oops"']
