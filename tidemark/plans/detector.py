"""Detectors from series to intervals, and a sweep over alphas."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import detect, evaluate, render, series, tokens, verify
from tidemark.sources.storage import durable


@dataclass(frozen=True)
class ScreeningDetector:
    """Window plots, patch tokens, dissimilarity to the series' own median memory, stitched scores, thresholds."""

    window_size: int = 224
    window_ratio: float = 4.0
    side: int = 224
    patch: int = 16
    column_share: float = 0.25
    alpha: float = 0.01
    index_shift: int = 1
    #: Makes the encoder, in each worker; profile tells what its tasks need.
    encoder: Callable[[], render.Encoder] = render.PatchEncoder
    profile: ResourceProfile | None = None
    #: False: raw values, each window's plot between its own extremes.
    standardize: bool = True
    #: Squares of patches whose mean tokens are compared too, besides single patches; none for these only.
    kernels: tuple[int, ...] = (3, 2)

    def scores(self, df: DataFrame) -> DataFrame:
        """(series_id, idx, ts, n, value, score, error); zeros for a series shorter than a window, and for one that can't be read or encoded, whose error is told."""
        step = series.window_span(self.window_size, self.window_ratio)
        grid = self.side // self.patch
        indexed = series.with_index(df)
        prepared = series.min_max(series.detrended(indexed)) if self.standardize else indexed.withColumn("value_norm", F.col("value"))
        windows = series.window_rows(prepared, self.window_size, step)
        drawn = render.images(windows, self.side, *((0.0, 1.0) if self.standardize else (None, None)))
        # the memories and what is compared with them read the tokens: they are drawn and encoded once
        encoded = durable(render.encoded(drawn, self.encoder, self.side, profile=self.profile), "tokens")
        failed = encoded.where("error is not null").groupBy("series_id").agg(F.min("error").alias("error"))
        toks, masks = encoded.where("error is null"), {f"of{k}": tokens.mask_matrix(grid, k) for k in self.kernels}
        memories = tokens.memories(toks, masks)
        size, share, shift = self.side, self.column_share, self.index_shift
        found = tokens.with_memory(toks, memories, lambda t, held: tokens.column_scores(t, held, masks, grid, size, share, shift))
        columns = found.select("series_id", "window_id", F.posexplode("out").alias("c", "score"))
        lengths = indexed.select("series_id", "n").distinct()
        stitched = durable(tokens.stitched(columns, self.side, self.window_ratio), "stitched")
        vector = tokens.aligned(stitched, lengths, self.window_size, step)
        unread = indexed.groupBy("series_id").agg(F.count(F.when(F.col("ts").isNotNull() & F.col("value").isNotNull(), 1)).alias("k")).where("k = 0")
        failed = unread.select("series_id", F.lit("no readable value").alias("error")).unionByName(failed.join(unread, "series_id", "left_anti"))
        joined = indexed.join(vector, ["series_id", "idx"], "left").join(failed, "series_id", "left")
        score = F.when(F.col("error").isNull(), F.coalesce("score", F.lit(0.0))).otherwise(0.0)
        return durable(joined.select("series_id", "idx", "ts", "n", "value", score.alias("score"), "error"), "scores")

    def intervals(self, scores: DataFrame) -> DataFrame:
        return detect.detect(scores, self.alpha)

    def detect(self, df: DataFrame) -> DataFrame:
        return self.intervals(self.scores(df))


@dataclass(frozen=True)
class TwoStageDetector:
    screening: ScreeningDetector = field(default_factory=ScreeningDetector)
    verifier: verify.Verifier = field(default_factory=verify.KeepAll)
    #: Where answers are kept, and how many requests, attempts and seconds there are; models that cost money want a log.
    asking: verify.Asking = field(default_factory=verify.Asking)

    def refine(self, scores: DataFrame, proposals: DataFrame) -> DataFrame:
        """Asks the verifier about each series that has proposals."""
        numbered = proposals.withColumn("iv", F.xxhash64("start", "end"))
        pairs = detect.indices_of(numbered, scores)
        raw = verify.answers(verify.prompts(pairs), scores, self.verifier, asking=self.asking)
        return verify.verified(raw, proposals, scores)

    def detect(self, df: DataFrame, alpha: float | None = None) -> DataFrame:
        screening = self.screening if alpha is None else replace(self.screening, alpha=alpha)
        scores = screening.scores(df)
        return self.refine(scores, durable(screening.intervals(scores), "proposals"))


def sweep(scores: DataFrame, truth: DataFrame, roster: DataFrame, dataset: str, alphas: tuple[float, ...] = (0.1, 0.01, 0.001), two_stage: TwoStageDetector | None = None) -> DataFrame:
    """Result rows of one set of scores for each alpha: rates for series of the roster, no_gt for others; with two_stage, also rows of what its verifier leaves.

    A series that couldn't be read or encoded has rows of status failed, with the error.
    """
    signals = durable(scores.groupBy("series_id").agg(F.max("error").alias("error")), "signals")

    def rows(found: DataFrame, model: str, alpha: float) -> DataFrame:
        counted = signals.join(found.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_detected")), "series_id", "left").na.fill(0, ["n_detected"])
        status = evaluate.with_status(counted, roster).withColumn("status", F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("status")))
        rated = evaluate.interval_rates(found.join(roster.select("series_id"), "series_id", "left_semi"), truth, roster)
        named = F.lit(dataset).alias("dataset"), F.col("series_id").alias("signal"), F.lit(model).alias("model"), F.lit(alpha).alias("alpha")
        joined = status.join(rated, "series_id", "left")
        rated = [F.when(F.col("status") == "success", F.col(c)).alias(c) for c in ("precision", "recall", "f1")]
        return joined.select(*named, "status", *rated, "n_detected", "n_ground_truth", "error")

    out, each = [], durable(detect.detect_each(scores, alphas), "found")
    for alpha in alphas:
        found = each.where(F.col("alpha") == alpha).drop("alpha")
        out.append(rows(found, "screening", alpha))
        if two_stage:
            out.append(rows(durable(two_stage.refine(scores, found), "verified"), "two_stage", alpha))
    return reduce(DataFrame.unionByName, out)
