"""Queries of the time-series operators, and the same in SQL for comparison. Doubles are rounded to 6 places on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import dot, l2_normalised, z_value
from tidemark.operators import detect, evaluate, render, series, tokens, verify
from tidemark.plans.detector import ScreeningDetector, TwoStageDetector
from tidemark.sources.storage import durable

SIDE, STEP_RATIO = 4, 2.0


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark: SparkSession, d: str, by: str = "event_type") -> DataFrame:
    return _read(spark, d, "events").select(F.col(by).cast("string").alias("series_id"), "ts", "value", "event_id")


def _indexed(spark: SparkSession, d: str, by: str = "event_type") -> DataFrame:
    return series.with_index(_events(spark, d, by), "event_id")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return _indexed(spark, d).withColumn("score", F.col("value"))


def r6(*names: str) -> list:
    return [F.round(F.col(n), 6).alias(n) for n in names]


def scan_signals(s, d):
    return _events(s, d).drop("event_id")


def index_series(s, d):
    return _indexed(s, d).select("series_id", "event_id", "idx", "n")


def detrend_minmax(s, d):
    return series.min_max(series.detrended(_indexed(s, d))).select("series_id", "idx", F.round("value_norm", 5).alias("value_norm"))


def window_assign(s, d):
    return series.with_windows(_indexed(s, d), 240, series.window_span(240, 4)).select("series_id", "window_id", "pos", "idx")


def window_counts(s, d):
    return _indexed(s, d, "user_id").select("series_id", "n").distinct().withColumn("windows", series.window_count(F.col("n"), 24, series.window_span(24, 4)))


def threshold_windows(s, d):
    return series.with_threshold_windows(_indexed(s, d, "user_id")).groupBy("series_id", "window_id").agg(F.count(F.lit(1)).alias("points"))


def window_sample(s, d):
    return series.sampled_windows(series.with_windows(_indexed(s, d), 240, 60), 5)


def ewma_scores(s, d):
    return series.smoothed(_scores(s, d)).select("series_id", "idx", *r6("smooth"))


def _told(df: DataFrame) -> DataFrame:
    return df.select("series_id", "start", "end", *r6("severity"))


def detect_global_mean(s, d):
    return _told(detect.detect(_scores(s, d), 0.01))


def detect_global_median(s, d):
    return _told(detect.detect(_scores(s, d), 0.01, "median"))


def detect_alpha_sweep(s, d):
    return detect.detect_each(_scores(s, d), (0.1, 0.01, 0.001)).select("alpha", "series_id", "start", "end", *r6("severity"))


def detect_sliding(s, d):
    return _told(detect.detect(_scores(s, d), 0.01, sliding=True))


def global_thresholds(s, d):
    return detect.judged(_scores(s, d), 0.01).select("series_id", "idx", *r6("smooth"), *r6("threshold"), (F.col("smooth") > F.col("threshold")).alias("above"))


def sliding_thresholds(s, d):
    return detect.judged(_scores(s, d), 0.01, sliding=True).select("series_id", "idx", *r6("smooth"), *r6("threshold"), (F.col("smooth") > F.col("threshold")).alias("above"))


def detect_padded_merge(s, d):
    return _told(detect.detect(_scores(s, d), 0.01, padding=3))


def percentile_intervals(s, d):
    return _told(detect.above_percentile(_scores(s, d), 99.0))


def merge_intervals(s, d):
    orders = _read(s, d, "orders").select(F.col("o_custkey").cast("string").alias("series_id"), F.col("o_orderkey").alias("s"), (F.col("o_orderkey") + F.col("o_orderkey") % 977).alias("e"), F.col("o_totalprice").alias("severity"))
    return detect.merged(orders, severity="severity").select("series_id", "s", "e", F.round("severity", 4).alias("severity"))


def _pairs(s, d):
    rows = _indexed(s, d, "user_id")
    return rows.select("series_id", (F.col("idx") + 15).alias("s"), (F.col("idx") * 2 - 10).alias("e")).distinct()


def intervals_from_indices(s, d):
    indexed = _indexed(s, d, "user_id").withColumn("score", F.col("value"))
    pairs = detect.clamped(_pairs(s, d), indexed.select("series_id", "n").distinct())
    return detect.with_times(pairs.distinct(), indexed).select("series_id", "s", "e", "start", "end", *r6("severity"))


def ts_to_index(s, d):
    indexed = _indexed(s, d, "user_id")
    asked = indexed.select("series_id", F.col("event_id").alias("iv"), (F.col("ts") - F.expr("INTERVAL 3 HOURS")).alias("start"), (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("end"))
    return detect.indices_of(asked, indexed)


def _found(s, d, alpha=0.1):
    return detect.detect(_indexed(s, d, "user_id").withColumn("score", F.col("value")), alpha).select("series_id", "start", "end")


def _truth(s, d):
    rows = series.with_index(_read(s, d, "events").select(F.col("user_id").cast("string").alias("series_id"), "ts", "value", "event_id", "event_type"), "event_id").where("event_type = 'error'")
    return detect._by_island(rows.withColumn("score", F.col("value"))).select("series_id", "start", "end")


def overlap_pairs(s, d):
    return evaluate.overlap_pairs(_found(s, d), _truth(s, d))


def false_positives(s, d):
    return evaluate.unmatched(_found(s, d), _truth(s, d))


def false_negatives(s, d):
    return evaluate.unmatched(_truth(s, d), _found(s, d))


def matched_truths(s, d):
    return evaluate.matched(_truth(s, d), _found(s, d))


def interval_prf(s, d):
    out = evaluate.interval_rates(_found(s, d), _truth(s, d), _events(s, d, "user_id"))
    return out.select("series_id", "tp", "fp", "fn", *r6("precision", "recall", "f1"))


def gt_lookup_status(s, d):
    roster = _truth(s, d).where("start < end").groupBy("series_id").agg(F.count(F.lit(1)).alias("n_ground_truth"))
    counted = _found(s, d).groupBy("series_id").agg(F.count(F.lit(1)).alias("n_detected"))
    return evaluate.with_status(counted, roster).na.fill(0, ["n_ground_truth"])


def _results(s, d):
    """Rates for two alphas: series are scored, and truths found, once."""
    truth = durable(_truth(s, d), "truth")
    each = durable(detect.detect_each(_indexed(s, d, "user_id").withColumn("score", F.col("value")), (0.1, 0.01)).select("alpha", "series_id", "start", "end"), "found")
    roster = durable(_events(s, d, "user_id").select("series_id").distinct(), "roster")
    out = None
    for alpha in (0.1, 0.01):
        rated = evaluate.interval_rates(each.where(F.col("alpha") == alpha), truth, roster)
        rows = rated.select((F.col("series_id") % 7).cast("long").cast("string").alias("dataset"), F.lit("screening").alias("model"), F.col("series_id").alias("signal"), F.lit(alpha).alias("alpha"), "f1")
        out = rows if out is None else out.unionByName(rows)
    return durable(out, "results")


def f1max_summary(s, d):
    return evaluate.best_f1_summary(_results(s, d))


def results_union(s, d):
    rated = _results(s, d)
    first = rated.withColumn("status", F.when(F.col("f1") == 0, "failed").otherwise("success"))
    out = evaluate.results_union([first, rated.drop("model", "alpha")], "screening", 0.5)
    return out.select("dataset", "model", "signal", "alpha", "status", *r6("f1"))


def model_fanout(s, d):
    """Rates of two models' rows of one alpha in one table: what screening found, and what a second look that knows the truth would leave of it."""
    found, truth = durable(_found(s, d), "found"), durable(_truth(s, d), "truth")
    roster, out = _events(s, d, "user_id"), None
    for model, rows in (("screening", found), ("two_stage", evaluate.matched(found, truth))):
        rated = evaluate.interval_rates(rows, truth, roster).select(F.lit(model).alias("model"), "series_id", "tp", "fp", "fn", *r6("precision", "recall", "f1"))
        out = rated if out is None else out.unionByName(rated)
    return out


#: A name of a result file for each event, some of other files or without a number.
STEM = """CASE WHEN event_id % 11 = 0 THEN concat('summary_', event_type) ELSE concat('results_', event_type, '_', user_id % 7, CASE event_id % 3 WHEN 0 THEN '_two' WHEN 1 THEN '_screening' ELSE '' END,
  '_alpha_', CASE event_id % 5 WHEN 0 THEN '0.1' WHEN 1 THEN '0.01' WHEN 2 THEN 'x' ELSE '0.001' END) END"""


def filename_fields(s, d):
    return evaluate.filename_fields(_read(s, d, "events").selectExpr(f"{STEM} AS stem").distinct(), ("screening", "two"))


def make_masks(s, d):
    """What lies under each mask of two scales: how many of a series' tokens, and the mean of their first numbers."""
    masks = tokens.make_masks(s, SIDE, 3, 1, "large").unionByName(tokens.make_masks(s, SIDE, 2, 1, "mid"))
    toks = _tokens(s, d).select("series_id", F.col("token_idx").alias("patch_idx"), F.element_at("tok", 1).cast("double").alias("x"))
    under = toks.join(F.broadcast(masks), "patch_idx").groupBy("series_id", "scale", "mask_idx")
    return under.agg(F.count(F.lit(1)).alias("tokens"), (F.round(F.avg("x"), 6) + 0.0).alias("x"))


def _tokens(s, d):
    """A label's vectors are a series, each 16 of them a window's tokens; the last window's missing ones are the series' first again."""
    order = Window.partitionBy("label").orderBy("vec_id")
    rows = _read(s, d, "embeddings").select(F.col("label").cast("string").alias("series_id"), (F.row_number().over(order) - 1).cast("long").alias("i"), F.count(F.lit(1)).over(Window.partitionBy("label")).alias("n"), F.col("embedding").alias("tok"))
    full = F.expr(f"((n + {SIDE * SIDE - 1}) div {SIDE * SIDE}) * {SIDE * SIDE}")
    place = F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE)), lambda k: F.col("i") + k * F.col("n")), lambda p: p < full))
    rows = rows.select("series_id", place.alias("p"), "tok")
    return rows.select("series_id", F.expr(f"p div {SIDE * SIDE}").alias("window_id"), (F.col("p") % (SIDE * SIDE)).alias("token_idx"), "tok")


def _windows(s, d):
    return tokens.packed(_tokens(s, d))


def token_l2(s, d):
    norm = l2_normalised(F.col("tok"))
    return _tokens(s, d).select(*tokens.KEYS, "token_idx", F.round(norm[0], 6).alias("first"), F.round(F.aggregate(norm, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def token_cosine(s, d):
    t = _tokens(s, d).select(*tokens.KEYS, "token_idx", l2_normalised(F.col("tok")).alias("a"))
    u = t.select(*tokens.KEYS, F.col("token_idx").alias("other"), F.col("a").alias("b"))
    return t.join(u, tokens.KEYS).where("token_idx < other").select(*tokens.KEYS, "token_idx", "other", F.round(1 - dot(F.col("a"), F.col("b")), 6).alias("distance"))


def token_pool(s, d):
    rows = tokens.unpacked(tokens.pooled(_windows(s, d), tokens.mask_matrix(SIDE, 2)))
    return rows.select(*tokens.KEYS, "token_idx", F.posexplode("tok").alias("dim", "x")).select(*tokens.KEYS, "token_idx", F.col("dim").cast("long").alias("dim"), (F.round("x", 6) + 0.0).alias("x"))


def memory_median(s, d):
    rows = tokens.memory(_windows(s, d)).select("series_id", "token_idx", F.posexplode("mem").alias("dim", "x"))
    return rows.select("series_id", "token_idx", F.col("dim").cast("long").alias("dim"), *r6("x"))


def dissim_universal(s, d):
    w = durable(_windows(s, d), "windows")
    return tokens.dissimilarity(w, tokens.memory(w)).select(*tokens.KEYS, "token_idx", *r6("score"))


def dissim_rowwise(s, d):
    w = durable(_windows(s, d), "windows")
    return tokens.dissimilarity(w, tokens.memory(w), SIDE).select(*tokens.KEYS, "token_idx", *r6("score"))


def _map(s, windows, kernel):
    own = durable(tokens.pooled(windows, tokens.mask_matrix(SIDE, kernel)), "pooled")
    return tokens.harmonic(durable(tokens.dissimilarity(own, tokens.memory(own)), "distances"), tokens.make_masks(s, SIDE, kernel), SIDE)


def harmonic_map(s, d):
    return _map(s, _windows(s, d), 2).select(*tokens.KEYS, "patch", *r6("score"))


def _fused(s, d):
    w = durable(_windows(s, d), "windows")
    plain = tokens.dissimilarity(w, tokens.memory(w)).withColumnRenamed("token_idx", "patch")
    return tokens.fused(_map(s, w, 3), _map(s, w, 2), plain)


def fused_map(s, d):
    return _fused(s, d).select(*tokens.KEYS, "patch", *r6("score"))


def _columns(s, d):
    cells = _fused(s, d).withColumn("r", F.expr(f"patch div {SIDE}")).withColumn("c", F.col("patch") % SIDE)
    return tokens.column_top(cells, SIDE, 0.5)


def column_topk(s, d):
    return _columns(s, d).select(*tokens.KEYS, "c", *r6("score"))


def stitch_scores(s, d):
    columns = durable(_columns(s, d), "columns")
    return tokens.stitched(columns, SIDE, STEP_RATIO).select("series_id", "k", *r6("score"), "covered")


def align_scores(s, d):
    columns = durable(_columns(s, d), "columns")
    lengths = columns.groupBy("series_id").agg((24 + F.max("window_id") * 12 + 7).alias("n"))
    vector = durable(tokens.stitched(columns, SIDE, STEP_RATIO), "stitched")  # its length is found first
    return tokens.aligned(vector, lengths, 24, 12).select("series_id", "idx", F.round("score", 5).alias("score"))


def upsample_map(s, d):
    return tokens.upsampled(_fused(s, d), SIDE, 8).select(*tokens.KEYS, "r", "c", *r6("score"))


def _asked(s, d):
    """(scores, index pairs of what screening proposes, answers): an answer takes its series' proposals from the prompt, and is spoiled by the series' number."""
    scored = durable(_indexed(s, d, "user_id").withColumn("score", F.col("value")), "scored")
    pairs = durable(detect.islands(detect.flagged(scored, 0.1)), "pairs")
    listed, kind = F.substring_index("prompt", "PROPOSALS ", -1), F.col("series_id").cast("long") % 7
    turned = F.to_json(F.transform(F.from_json(listed, "array<array<long>>"), lambda p: F.reverse(p)))
    told = lambda head, pairs, tail: F.concat(F.lit(head + '{"interval_index": '), pairs, F.lit(tail))
    raw = (
        F.when(kind == 0, told("", listed, "}")).when(kind == 1, told("Sure:\n```json\n", listed, ', "confidence": [2]}\n```')).when(kind == 2, "I see nothing").when(kind == 3, '{"confidence": [1]}')
        .when(kind == 4, '{"interval_index": []}').when(kind == 5, told("", turned, "}")).otherwise('{"interval_index": null}')
    )
    return scored, pairs, verify.prompts(pairs).select("series_id", raw.alias("raw"))


def vlm_parse(s, d):
    return verify.answered(_asked(s, d)[2]).select("series_id", F.col("pos").cast("long").alias("pos"), "s", "e", "confidence")


def vlm_fallback(s, d):
    scored, pairs, raw = _asked(s, d)
    return _told(verify.verified(raw, detect.with_times(pairs, scored), scored))


DETECTOR = ScreeningDetector(window_size=240, alpha=0.01)


def _images(s, d):
    prepared = series.min_max(series.detrended(_indexed(s, d)))
    return render.images(series.window_rows(prepared, 240, 60))


def raster_windows(s, d):
    """Checksums of the windows' plots."""
    return _images(s, d).select("series_id", "window_id", F.crc32("image").alias("crc32"), F.length("image").cast("long").alias("bytes"))


def encode_windows(s, d):
    """Each window's tokens: how many, their dimensions, and the sum of all values."""
    toks = F.col("toks")
    return render.encoded(_images(s, d), render.PatchEncoder).select("series_id", "window_id", F.size(toks).alias("tokens"), F.size(toks[0]).alias("dims"), F.round(F.aggregate(F.flatten(toks), F.lit(0.0), lambda a, x: a + x), 4).alias("total"), "error")


def screen_detect(s, d):
    return DETECTOR.detect(_events(s, d))


def two_stage_detect(s, d):
    return TwoStageDetector(DETECTOR).detect(_events(s, d))


# ---- the same in SQL ----


def _idx(by: str = "event_type") -> str:
    return f"(SELECT CAST({by} AS VARCHAR) AS series_id, ts, value, event_id, event_type, row_number() OVER (PARTITION BY {by} ORDER BY ts, event_id) - 1 AS idx, count(*) OVER (PARTITION BY {by}) AS n FROM events)"


def _smooth(by: str = "event_type") -> str:
    q = "(1 - 2 / (greatest(1, n // 100) + 1e0))"
    run = "(PARTITION BY series_id ORDER BY idx ROWS UNBOUNDED PRECEDING)"
    return f"(SELECT *, value AS score, CASE WHEN n // 100 > 1 THEN sum(value * pow({q}, -idx)) OVER {run} / sum(pow({q}, -idx)) OVER {run} ELSE value END AS smooth FROM {_idx(by)})"


def _islands(flagged: str, extra: str = "", key: str = "series_id") -> str:
    return f"SELECT {extra}series_id, min(ts) AS start, max(ts) AS \"end\", round(avg(score), 6) AS severity FROM (SELECT *, idx - row_number() OVER (PARTITION BY {key} ORDER BY idx) AS run FROM ({flagged})) GROUP BY {extra}series_id, run"


def _flag_mean(alpha: float, by: str = "event_type", extra: str = "") -> str:
    return f"SELECT {extra}* FROM (SELECT *, avg(smooth) OVER (PARTITION BY series_id) + {z_value(alpha)!r} * stddev_pop(smooth) OVER (PARTITION BY series_id) AS threshold FROM {_smooth(by)}) WHERE smooth > threshold"


_FLAG_MEDIAN = f"""SELECT r.* FROM {_smooth()} r JOIN (SELECT series_id, any_value(middle) + {z_value(0.01)!r} * median(abs(smooth - middle)) AS threshold FROM
  (SELECT *, median(smooth) OVER (PARTITION BY series_id) AS middle FROM {_smooth()}) GROUP BY series_id) t ON r.series_id = t.series_id WHERE r.smooth > t.threshold"""
_LARGE = """(SELECT *, unnest(generate_series(greatest(0, CAST(ceil((idx - greatest(1, n // 3) + 1) / CAST(greatest(1, n // 10) AS DOUBLE)) AS BIGINT)), idx // greatest(1, n // 10))) AS window_id FROM {rows})"""
_FLAG_SLIDING = f"""SELECT DISTINCT r.series_id, r.idx, r.ts, r.score FROM {_LARGE.format(rows=_smooth())} r JOIN (SELECT series_id, window_id, avg(smooth) + {z_value(0.01)!r} * stddev_pop(smooth) AS threshold
  FROM {_LARGE.format(rows=_smooth())} GROUP BY series_id, window_id) t ON r.series_id = t.series_id AND r.window_id = t.window_id WHERE r.smooth > t.threshold"""
_POINT = 'r.series_id, r.idx, round(r.smooth, 6) AS smooth, round(t.threshold, 6) AS threshold, r.smooth > t.threshold AS above'
_GLOBAL_LIMITS = f"(SELECT series_id, avg(smooth) + {z_value(0.01)!r} * stddev_pop(smooth) AS threshold FROM {_smooth()} GROUP BY series_id)"
_SLIDING_LIMITS = f"""(SELECT series_id, idx, min(threshold) AS threshold FROM {_LARGE.format(rows=_smooth())} JOIN (SELECT series_id, window_id, avg(smooth) + {z_value(0.01)!r} * stddev_pop(smooth) AS threshold
  FROM {_LARGE.format(rows=_smooth())} GROUP BY series_id, window_id) USING (series_id, window_id) GROUP BY series_id, idx)"""
_FOUND = f"(SELECT series_id, start, \"end\" FROM ({_islands(_flag_mean(0.1, 'user_id'))}))"
_ERRORS = f"SELECT *, value AS score FROM {_idx('user_id')} WHERE event_type = 'error'"
_TRUTH = f"(SELECT series_id, start, \"end\" FROM ({_islands(_ERRORS)}))"
_TOUCH = 'a.series_id = b.series_id AND a.start <= b."end" AND b.start <= a."end"'


def _rates(found: str) -> str:
    return f"""SELECT series_id, tp, fp, fn, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END AS r FROM (
    SELECT s.series_id, (SELECT count(*) FROM {found} a JOIN {_TRUTH} b ON {_TOUCH} WHERE a.series_id = s.series_id) AS tp,
      (SELECT count(*) FROM {found} a WHERE a.series_id = s.series_id AND NOT EXISTS (SELECT 1 FROM {_TRUTH} b WHERE {_TOUCH})) AS fp,
      (SELECT count(*) FROM {_TRUTH} a WHERE a.series_id = s.series_id AND NOT EXISTS (SELECT 1 FROM {found} b WHERE {_TOUCH})) AS fn
    FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS series_id FROM events) s))"""


def _found_at(alpha: float) -> str:
    return f"(SELECT series_id, start, \"end\" FROM ({_islands(_flag_mean(alpha, 'user_id'))}))"


_RESULTS = " UNION ALL ".join(f"SELECT CAST(CAST(series_id AS BIGINT) % 7 AS VARCHAR) AS dataset, 'screening' AS model, series_id AS signal, CAST({a} AS DOUBLE) AS alpha, f1 FROM ({_rates(_found_at(a))})" for a in (0.1, 0.01))

_CELLS = SIDE * SIDE
_TOK = f"""(SELECT s, p // {_CELLS} AS w, p % {_CELLS} AS t, v FROM (SELECT a.s, a.p, b.v FROM (SELECT s, unnest(generate_series(0, {_CELLS} * ((n + {_CELLS - 1}) // {_CELLS}) - 1)) AS p, n FROM
  (SELECT CAST(label AS VARCHAR) AS s, count(*) AS n FROM embeddings GROUP BY label)) a JOIN (SELECT CAST(label AS VARCHAR) AS s, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) b
  ON a.s = b.s AND a.p % a.n = b.i))"""


def _flat(rows: str) -> str:
    return f"(SELECT s, w, t, unnest(generate_series(0, 63)) AS dim, unnest(v) AS x FROM {rows})"


def _masks(side: int, kernel: int) -> str:
    wide = side - kernel + 1
    return f"(SELECT m, (m // {wide} + c // {kernel}) * {side} + m % {wide} + c % {kernel} AS p FROM (SELECT unnest(generate_series(0, {wide * wide - 1})) AS m), (SELECT unnest(generate_series(0, {kernel * kernel - 1})) AS c))"


def _pooled(kernel: int) -> str:
    return f"(SELECT s, w, m AS t, list(x ORDER BY dim) AS v FROM (SELECT s, w, m, dim, avg(x) AS x FROM {_flat(_TOK)} JOIN {_masks(SIDE, kernel)} ON t = p GROUP BY s, w, m, dim) GROUP BY s, w, m)"


def _memory(rows: str) -> str:
    return f"(SELECT s, t, list(x ORDER BY dim) AS v FROM (SELECT s, t, dim, quantile_disc(x, 0.5) AS x FROM {_flat(rows)} GROUP BY s, t, dim) GROUP BY s, t)"


def _dissim(rows: str, row: bool = False) -> str:
    on = f" AND a.t // {SIDE} = b.t // {SIDE}" if row else ""
    return f"(SELECT a.s, a.w, a.t, 0.5 * min(1 - list_cosine_similarity(a.v, b.v)) AS score FROM {rows} a JOIN {_memory(rows)} b ON a.s = b.s{on} GROUP BY a.s, a.w, a.t)"


def _harmonic(kernel: int) -> str:
    return f"""(SELECT g.s, g.w, g.patch, CASE WHEN min(s.score) = 0 THEN 0 ELSE count(s.score) / sum(1 / s.score) END AS score
  FROM (SELECT DISTINCT s, w, unnest(generate_series(0, {SIDE * SIDE - 1})) AS patch FROM {_TOK}) g LEFT JOIN {_masks(SIDE, kernel)} m ON m.p = g.patch + 1
  LEFT JOIN {_dissim(_pooled(kernel))} s ON s.s = g.s AND s.w = g.w AND s.t = m.m GROUP BY g.s, g.w, g.patch)"""


_FUSED = f"(SELECT p.s, p.w, p.t AS patch, coalesce((l.score + m.score + p.score) / 3, 0) AS score FROM {_dissim(_TOK)} p JOIN {_harmonic(3)} l ON l.s = p.s AND l.w = p.w AND l.patch = p.t JOIN {_harmonic(2)} m ON m.s = p.s AND m.w = p.w AND m.patch = p.t)"
_COLUMNS = f"(SELECT s, w, patch % {SIDE} AS c, avg(score) AS score FROM (SELECT *, row_number() OVER (PARTITION BY s, w, patch % {SIDE} ORDER BY score DESC, patch) AS rk FROM {_FUSED}) WHERE rk <= 2 GROUP BY s, w, patch % {SIDE})"
_STITCHED = f"(SELECT s, w * 2 + c AS k, avg(score) AS score, count(*) AS covered FROM {_COLUMNS} GROUP BY s, w * 2 + c)"
#: Each of 8 places along a side, the two of 4 cells it lies between, and how far it is from the first.
_TAPS = f"(SELECT d, CAST(floor(x) AS BIGINT) AS lo, least(CAST(floor(x) AS BIGINT) + 1, {SIDE - 1}) AS hi, x - floor(x) AS f FROM (SELECT d, greatest(0, (d + 0.5) * {SIDE} / 8.0 - 0.5) AS x FROM (SELECT unnest(generate_series(0, 7)) AS d)))"
_NAMES = "s AS series_id, w AS window_id"
_PAIRS = f"""(SELECT *, CAST(series_id AS BIGINT) % 7 AS kind, row_number() OVER (PARTITION BY series_id ORDER BY s, e) - 1 AS pos FROM (SELECT series_id, min(idx) AS s, max(idx) AS e, min(ts) AS start, max(ts) AS "end", avg(score) AS severity FROM
  (SELECT *, idx - row_number() OVER (PARTITION BY series_id ORDER BY idx) AS run FROM ({_flag_mean(0.1, 'user_id')})) GROUP BY series_id, run))"""
_SURE = "CASE WHEN kind = 1 AND pos = 0 THEN 2e0 ELSE 1e0 END"

SQL: dict[str, str] = {
    "scan_signals": "SELECT event_type AS series_id, ts, value FROM events",
    "index_series": f"SELECT series_id, event_id, idx, n FROM {_idx()}",
    "detrend_minmax": f"""SELECT series_id, idx, round((res - min(res) OVER w) / (max(res) OVER w - min(res) OVER w), 5) AS value_norm FROM (SELECT series_id, idx, value -
  (regr_slope(value, CAST(idx AS DOUBLE)) OVER w * idx + regr_intercept(value, CAST(idx AS DOUBLE)) OVER w) AS res FROM {_idx()} WINDOW w AS (PARTITION BY series_id)) WINDOW w AS (PARTITION BY series_id)""",
    "window_assign": f"""SELECT i.series_id, w.window_id, i.idx - w.window_id * 60 AS pos, i.idx FROM {_idx()} i JOIN (SELECT DISTINCT series_id, n, unnest(generate_series(0, (n - 240) // 60)) AS window_id FROM {_idx()} WHERE n >= 240) w
  ON i.series_id = w.series_id AND i.idx >= w.window_id * 60 AND i.idx < w.window_id * 60 + 240""",
    "window_counts": f"SELECT DISTINCT series_id, n, CASE WHEN n >= 24 THEN (n - 24) // 6 + 1 ELSE 0 END AS windows FROM {_idx('user_id')}",
    "threshold_windows": f"""SELECT i.series_id, w.window_id, count(*) AS points FROM {_idx('user_id')} i JOIN (SELECT DISTINCT series_id, n, unnest(generate_series(0, (n - 1) // greatest(1, n // 10))) AS window_id FROM {_idx('user_id')}) w
  ON i.series_id = w.series_id AND i.idx >= w.window_id * greatest(1, i.n // 10) AND i.idx < w.window_id * greatest(1, i.n // 10) + greatest(1, i.n // 3) GROUP BY i.series_id, w.window_id""",
    "window_sample": f"""SELECT series_id, window_id FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY (window_id * 7919 + 12345) % 1000003, window_id) AS rk FROM
  (SELECT DISTINCT series_id, unnest(generate_series(0, (n - 240) // 60)) AS window_id FROM {_idx()} WHERE n >= 240)) WHERE rk <= 5""",
    "ewma_scores": f"SELECT series_id, idx, round(smooth, 6) AS smooth FROM {_smooth()}",
    "detect_global_mean": _islands(_flag_mean(0.01)),
    "detect_global_median": _islands(_FLAG_MEDIAN),
    "detect_alpha_sweep": " UNION ALL ".join(f"SELECT CAST({a} AS DOUBLE) AS alpha, * FROM ({_islands(_flag_mean(a))})" for a in (0.1, 0.01, 0.001)),
    "detect_sliding": _islands(_FLAG_SLIDING),
    "global_thresholds": f"SELECT {_POINT} FROM {_smooth()} r JOIN {_GLOBAL_LIMITS} t USING (series_id)",
    "sliding_thresholds": f"SELECT {_POINT} FROM {_smooth()} r JOIN {_SLIDING_LIMITS} t ON r.series_id = t.series_id AND r.idx = t.idx",
    "detect_padded_merge": f"""WITH runs AS (SELECT series_id, min(idx) AS s, max(idx) AS e, any_value(n) AS n FROM (SELECT *, idx - row_number() OVER (PARTITION BY series_id ORDER BY idx) AS run FROM ({_flag_mean(0.01)})) GROUP BY series_id, run),
  wide AS (SELECT series_id, greatest(s - 3, 0) AS s, least(e + 3, n - 1) AS e FROM runs),
  grouped AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM
    (SELECT *, max(e) OVER (PARTITION BY series_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM wide)),
  joined AS (SELECT series_id, min(s) AS s, max(e) AS e FROM grouped GROUP BY series_id, g)
  SELECT j.series_id, min(i.ts) AS start, max(i.ts) AS "end", round(avg(i.value), 6) AS severity FROM joined j JOIN {_idx()} i ON i.series_id = j.series_id AND i.idx BETWEEN j.s AND j.e GROUP BY j.series_id, j.s, j.e""",
    "percentile_intervals": _islands(f"SELECT i.*, value AS score FROM {_idx()} i JOIN (SELECT event_type, quantile_cont(value, 0.99) AS q FROM events GROUP BY event_type) q ON i.series_id = q.event_type WHERE i.value > q.q"),
    "merge_intervals": """WITH iv AS (SELECT CAST(o_custkey AS VARCHAR) AS series_id, o_orderkey AS s, o_orderkey + o_orderkey % 977 AS e, o_totalprice AS severity FROM orders),
  grouped AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM
    (SELECT *, max(e) OVER (PARTITION BY series_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM iv))
  SELECT series_id, min(s) AS s, max(e) AS e, round(avg(severity), 4) AS severity FROM grouped GROUP BY series_id, g""",
    "intervals_from_indices": f"""WITH p AS (SELECT DISTINCT series_id, n, idx + 15 AS a, idx * 2 - 10 AS b FROM {_idx('user_id')}),
  c AS (SELECT series_id, greatest(0, least(a, n - 1)) AS a, greatest(0, least(b, n - 1)) AS b FROM p), d AS (SELECT DISTINCT series_id, least(a, b) AS s, greatest(a, b) AS e FROM c)
  SELECT d.series_id, d.s, d.e, min(i.ts) AS start, max(i.ts) AS "end", round(avg(i.value), 6) AS severity FROM d JOIN {_idx('user_id')} i ON i.series_id = d.series_id AND i.idx BETWEEN d.s AND d.e GROUP BY d.series_id, d.s, d.e""",
    "ts_to_index": f"""SELECT q.series_id, q.iv, greatest(0, least(coalesce(min(i.idx) FILTER (i.ts >= q.start), max(i.n)), max(i.n) - 1)) AS s, greatest(0, least(coalesce(max(i.idx) FILTER (i.ts <= q."end"), -1), max(i.n) - 1)) AS e
  FROM (SELECT series_id, event_id AS iv, ts - INTERVAL 3 HOUR AS start, ts + INTERVAL 2 DAY AS "end" FROM {_idx('user_id')}) q JOIN {_idx('user_id')} i ON i.series_id = q.series_id GROUP BY q.series_id, q.iv""",
    "overlap_pairs": f'SELECT a.series_id, a.start, a."end", b.start AS truth_start, b."end" AS truth_end FROM {_FOUND} a JOIN {_TRUTH} b ON {_TOUCH}',
    "false_positives": f"SELECT a.* FROM {_FOUND} a WHERE NOT EXISTS (SELECT 1 FROM {_TRUTH} b WHERE {_TOUCH})",
    "false_negatives": f"SELECT a.* FROM {_TRUTH} a WHERE NOT EXISTS (SELECT 1 FROM {_FOUND} b WHERE {_TOUCH})",
    "matched_truths": f"SELECT a.* FROM {_TRUTH} a WHERE EXISTS (SELECT 1 FROM {_FOUND} b WHERE {_TOUCH})",
    "interval_prf": f"SELECT series_id, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM ({_rates(_FOUND)})",
    "gt_lookup_status": f"""SELECT f.series_id, f.n_detected, coalesce(t.n_ground_truth, 0) AS n_ground_truth, CASE WHEN t.n_ground_truth IS NULL THEN 'no_gt' ELSE 'success' END AS status FROM (SELECT series_id, count(*) AS n_detected FROM {_FOUND} GROUP BY series_id) f
  LEFT JOIN (SELECT series_id, count(*) AS n_ground_truth FROM {_TRUTH} WHERE start < "end" GROUP BY series_id) t ON f.series_id = t.series_id""",
    "f1max_summary": f"""SELECT dataset AS "Dataset", model AS "Model", round(avg(m), 4) AS "Avg_F1max", round(stddev_samp(m), 4) AS "Std_F1max", count(*) AS "N_Signals" FROM
  (SELECT dataset, model, signal, max(f1) AS m FROM ({_RESULTS}) GROUP BY dataset, model, signal) GROUP BY dataset, model""",
    "results_union": f"""SELECT dataset, model, signal, alpha, 'success' AS status, round(f1, 6) AS f1 FROM ({_RESULTS}) WHERE f1 <> 0
  UNION ALL SELECT dataset, 'screening', signal, CAST(0.5 AS DOUBLE), 'success', round(f1, 6) FROM ({_RESULTS})""",
    "model_fanout": " UNION ALL ".join(f"SELECT '{m}' AS model, series_id, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM ({_rates(r)})" for m, r in (("screening", _FOUND), ("two_stage", f"(SELECT a.* FROM {_FOUND} a WHERE EXISTS (SELECT 1 FROM {_TRUTH} b WHERE {_TOUCH}))"))),
    "filename_fields": f"""SELECT stem, array_to_string(p[2:CASE WHEN named THEN k - 2 ELSE k - 1 END], '_') AS dataset, CASE WHEN named THEN p[k - 1] ELSE 'screening' END AS model, TRY_CAST(p[k + 1] AS DOUBLE) AS alpha FROM
  (SELECT *, p[k - 1] IN ('screening', 'two') AS named FROM (SELECT *, list_position(p, 'alpha') AS k FROM (SELECT stem, string_split(stem, '_') AS p FROM (SELECT DISTINCT {STEM} AS stem FROM events)))) WHERE k > 2""",
    "make_masks": " UNION ALL ".join(f"SELECT s AS series_id, '{scale}' AS scale, m AS mask_idx, count(*) AS tokens, round(avg(v[1]), 6) + 0.0 AS x FROM {_TOK} JOIN {_masks(SIDE, k)} ON t = p GROUP BY s, m" for scale, k in (("large", 3), ("mid", 2))),
    "token_l2": f"SELECT {_NAMES}, t AS token_idx, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first, round(list_sum(v) / sqrt(list_inner_product(v, v)), 6) AS total FROM {_TOK}",
    "token_cosine": f"SELECT a.s AS series_id, a.w AS window_id, a.t AS token_idx, b.t AS other, round(1 - list_cosine_similarity(a.v, b.v), 6) AS distance FROM {_TOK} a JOIN {_TOK} b ON a.s = b.s AND a.w = b.w AND a.t < b.t",
    "token_pool": f"SELECT {_NAMES}, t AS token_idx, dim, round(x, 6) + 0.0 AS x FROM {_flat(_pooled(2))}",
    "memory_median": f"SELECT s AS series_id, t AS token_idx, dim, round(x, 6) AS x FROM (SELECT s, t, unnest(generate_series(0, 63)) AS dim, unnest(v) AS x FROM {_memory(_TOK)})",
    "dissim_universal": f"SELECT {_NAMES}, t AS token_idx, round(score, 6) AS score FROM {_dissim(_TOK)}",
    "dissim_rowwise": f"SELECT {_NAMES}, t AS token_idx, round(score, 6) AS score FROM {_dissim(_TOK, True)}",
    "harmonic_map": f"SELECT {_NAMES}, patch, round(score, 6) AS score FROM {_harmonic(2)}",
    "fused_map": f"SELECT {_NAMES}, patch, round(score, 6) AS score FROM {_FUSED}",
    "column_topk": f"SELECT {_NAMES}, c, round(score, 6) AS score FROM {_COLUMNS}",
    "stitch_scores": f"SELECT s AS series_id, k, round(score, 6) AS score, covered FROM {_STITCHED}",
    "upsample_map": f"""WITH m AS (SELECT s, w, patch // {SIDE} AS i, patch % {SIDE} AS j, score FROM {_FUSED}), t AS (SELECT * FROM {_TAPS})
  SELECT a.s AS series_id, a.w AS window_id, r.d AS r, c.d AS c, round((1 - r.f) * ((1 - c.f) * a.score + c.f * b.score) + r.f * ((1 - c.f) * e.score + c.f * g.score), 6) AS score FROM t r, t c
    JOIN m a ON a.i = r.lo AND a.j = c.lo JOIN m b ON b.s = a.s AND b.w = a.w AND b.i = r.lo AND b.j = c.hi JOIN m e ON e.s = a.s AND e.w = a.w AND e.i = r.hi AND e.j = c.lo JOIN m g ON g.s = a.s AND g.w = a.w AND g.i = r.hi AND g.j = c.hi""",
    "align_scores": f"""WITH v AS (SELECT s, k, score FROM {_STITCHED}), n AS (SELECT s, 24 + max(w) * 12 AS covered, (max(w) * 2 + 4) AS len FROM {_TOK} GROUP BY s),
  x AS (SELECT s, i, covered, i * (len - 1e0) / (covered - 1) AS x, least(CAST(floor(i * (len - 1e0) / (covered - 1)) AS BIGINT), len - 2) AS low FROM (SELECT *, unnest(generate_series(0, covered - 1)) AS i FROM n)),
  y AS (SELECT x.s, x.i AS idx, covered, a.score + (x.x - x.low) * (b.score - a.score) AS score FROM x JOIN v a ON a.s = x.s AND a.k = x.low JOIN v b ON b.s = x.s AND b.k = x.low + 1),
  z AS (SELECT s, any_value(covered) AS covered, max(score) FILTER (idx = covered - 1) AS last, max(score) FILTER (idx = covered - 2) AS before FROM y GROUP BY s)
  SELECT s AS series_id, idx, round(score, 5) AS score FROM y UNION ALL SELECT s, covered - 1 + j, round(last + (last - before) * j, 5) FROM z, (SELECT unnest(generate_series(1, 7)) AS j)""",
    "vlm_parse": f"SELECT series_id, pos, CASE WHEN kind = 5 THEN e ELSE s END AS s, CASE WHEN kind = 5 THEN s ELSE e END AS e, {_SURE} AS confidence FROM {_PAIRS} WHERE kind IN (0, 1, 5)",
    "vlm_fallback": f"""SELECT series_id, CASE WHEN kind = 5 THEN "end" ELSE start END AS start, CASE WHEN kind = 5 THEN start ELSE "end" END AS "end", CASE WHEN kind IN (0, 1, 5) THEN {_SURE} ELSE round(severity, 6) END AS severity FROM {_PAIRS} WHERE kind <> 4""",
}

NAMES = [
    *SQL, "raster_windows", "encode_windows", "screen_detect", "two_stage_detect",
]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: globals()[name] for name in NAMES}
