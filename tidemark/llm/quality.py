"""Quality by naive Bayes support vectors.

Features are hashed character 1- to 4-grams that a text has at all (digits are alike, letters lower-cased, spaces joined), and 1- to 4-grams of whether a
word repeats the word before it. Over all labelled training rows,
documents with each feature are counted per class; the log-ratio of their shares scales the feature. A linear model on these is fitted to the squared hinge
loss by dual coordinate descent, on a sample of at most SAMPLE_ROWS labelled rows, and drawn towards its mean weight as in naive Bayes. A logistic curve on
rows that neither step saw makes probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import calibrate
from tidemark.llm.chars import code_points, folded, spaced
from tidemark.llm.common import mixed, pieces, raw_bytes
from tidemark.llm.words import word_hashes, word_spans

BUCKETS = 1 << 17
ORDERS = (1, 2, 3, 4)
#: Labelled rows that the hinge loss, and the logistic curve, are fitted on at most: those with the smallest hashes of doc_id.
SAMPLE_ROWS, CURVE_ROWS = 4_000, 10_000


def indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text's number, bucket), sorted."""
    points, ends = code_points(texts)
    kinds = folded()[points]
    symbols = np.where(kinds == 0, 32, np.where(kinds == 27, 48, points)).astype(np.uint64)
    symbols, ends = spaced(symbols, ends, 32)
    size = np.diff(np.append(0, ends))
    doc = np.repeat(np.arange(len(ends)), size)
    keys, key = [], np.zeros(len(symbols), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        key = mixed(key[: len(symbols) - n + 1] + symbols[n - 1 :] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) if len(symbols) >= n else key[:0]
        if n in ORDERS:
            inside = doc[: len(key)] == doc[n - 1 :]
            if n == 1:
                inside = inside & (symbols != 32)
            keys.append(doc[: len(key)][inside] << 17 | (key[inside] >> np.uint64(47)).astype(np.int64))
    word_doc, starts, stops = word_spans(*(raw := raw_bytes(texts)))
    words = word_hashes(raw[0], starts, stops)
    same = (words[1:] == words[:-1]).astype(np.int64)
    run = np.zeros(len(same), np.int64)
    for n in range(1, max(ORDERS) + 1):
        run = run[: max(0, len(same) - n + 1)] << 1 | same[n - 1 :]
        inside = word_doc[: len(run)] == word_doc[n:]
        keys.append(word_doc[: len(run)][inside] << 17 | (mixed((run[inside] << 8 | n).astype(np.uint64)) >> np.uint64(47)).astype(np.int64))
    found = np.concatenate(keys)
    found.sort()
    found = found[np.append(True, found[1:] != found[:-1])] if len(found) else found
    return found >> 17, found & (BUCKETS - 1)


def class_counts(labelled: DataFrame) -> DataFrame:
    """(bucket, n1, n0): documents of each class that have a feature; bucket -1 has all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS + 1), np.int64)
        for piece in pieces(batches, "text"):
            doc, bucket = indicators(piece.column("text"))
            label = piece.column("label").to_numpy()
            for c in (0, 1):
                sums[c, 1:] += np.bincount(bucket[label[doc] == c], minlength=BUCKETS)
                sums[c, 0] += (label == c).sum()
        at = np.flatnonzero(sums.any(0))
        yield pa.record_batch([pa.array(at - 1), pa.array(sums[1, at]), pa.array(sums[0, at])], names=["bucket", "n1", "n0"])

    return labelled.select("text", F.col("label").cast("int")).mapInArrow(run, "bucket long, n1 long, n0 long").groupBy("bucket").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def log_ratios(counts: DataFrame, smoothing: float = 1.0) -> np.ndarray:
    rows = counts.toArrow()
    at, n = rows.column("bucket").to_numpy(), np.stack([rows.column(c).to_numpy().astype(float) for c in ("n1", "n0")])
    all_docs = n[:, at == -1].sum(1)
    ratio = np.zeros(BUCKETS)
    some = at >= 0
    share = (n[:, some] + smoothing) / (all_docs[:, None] + 2 * smoothing)
    ratio[at[some]] = np.log(share[0] / share[1])
    return ratio


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = 1.0, rounds: int = 20, seed: int = 7) -> tuple[np.ndarray, float]:
    """(weights, bias) of the squared hinge loss: each step solves one row's dual variable exactly. Classes weigh alike."""
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    values = [ratio[r] / (np.linalg.norm(ratio[r]) or 1.0) for r in rows]
    weight = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum())) * cost
    random = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in random.permutation(len(rows)):
            r, x = rows[i], values[i]
            slope = y[i] * (w[r] @ x + bias) - 1 + alpha[i] / (2 * weight[i])
            now = max(0.0, alpha[i] - slope / (x @ x + 1 + 1 / (2 * weight[i])))
            if now != alpha[i]:
                step = (now - alpha[i]) * y[i]
                w[r] += step * x
                bias += step
                moved = max(moved, abs(now - alpha[i]))
                alpha[i] = now
        if moved < 1e-3:
            break
    return w, bias


def _margins(texts: pa.Array, weights: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    doc, bucket = indicators(texts)
    up = np.bincount(doc, weights=weights[bucket] * ratio[bucket], minlength=len(texts))
    return up / np.maximum(np.sqrt(np.bincount(doc, weights=ratio[bucket] ** 2, minlength=len(texts))), 1e-12)


def learn(labelled: DataFrame, towards_mean: float = 0.25) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(weights, log-ratios, logistic curve) from rows (doc_id, text, label, fold); fold 0 is for the curve."""
    sc = labelled.sparkSession.sparkContext
    ratio = log_ratios(class_counts(labelled.where("fold <> 0")))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            doc, bucket = indicators(piece.column("text"))
            ends = np.searchsorted(doc, np.arange(1, piece.num_rows + 1))
            found = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(bucket.astype(np.int32)))
            yield pa.record_batch([piece.column("label"), found], names=["label", "features"])

    chosen = labelled.where("fold <> 0").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    some = labelled.where("fold <> 0").join(F.broadcast(chosen.distinct()), "doc_id", "left_semi").select("text", "label").mapInArrow(sample, "label int, features array<int>").toArrow()
    rows = [x.values.to_numpy() for x in some.column("features")]
    y = np.where(some.column("label").to_numpy() == 1, 1, -1) if len(rows) else np.zeros(0, int)
    order = sorted(range(len(rows)), key=lambda i: (len(rows[i]), y[i], rows[i].tobytes()))  # tasks may end in any order
    w, _ = dual_descent([rows[i] for i in order], y[order] if len(rows) else y, ratio)
    w = (1 - towards_mean) * np.abs(w).mean() + towards_mean * w if len(rows) else np.ones(BUCKETS)
    shared = sc.broadcast((w.astype(np.float32), ratio.astype(np.float32)))

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            yield pa.record_batch([piece.column("doc_id"), piece.column("label"), pa.array(_margins(piece.column("text"), *shared.value))], names=["doc_id", "label", "margin"])

    held = labelled.where("fold = 0").select("doc_id", "text", "label").mapInArrow(margins, "doc_id long, label int, margin double")
    held = held.orderBy(F.xxhash64("doc_id"), "doc_id").limit(CURVE_ROWS).toPandas()
    return w.astype(np.float32), ratio.astype(np.float32), calibrate.fit(held[["margin"]].to_numpy(float), held.label.to_numpy(float))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, tuple]) -> DataFrame:
    """(doc_id, score) for each row of docs (doc_id, text): the probability of good quality, 0 to 1.

    Null and empty texts get what a margin of 0 gives; with no labelled rows, or one class only, all scores are its share. Extra columns are left out;
    equal texts get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, ratio, curve = shared.value
        for piece in pieces(batches, "text"):
            yield pa.record_batch([piece.column("doc_id"), pa.array(calibrate.probability(curve, _margins(piece.column("text"), w, ratio)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
