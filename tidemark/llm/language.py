"""Language identification as mixture inference.

Letter trigrams (other characters are spaces) are hashed to 2**16 buckets. Their counts per language come from all training texts. A document's language
proportions maximise the likelihood of its trigrams, by expectation-maximisation; of the sets of its most present languages, that with the highest
likelihood less ``(languages - 1) / 2 * ln(trigrams)`` is taken. The model is a table of languages x 2**16 probabilities, whatever the corpus' size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chars import code_points, letters, spaced
from tidemark.llm.common import mixed, pieces

BUCKETS = 1 << 16


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, bucket) of each trigram that has a letter."""
    points, ends = code_points(texts)
    alpha = letters()[points]
    points, ends = spaced(np.where(alpha, points, 32).astype(np.uint64), ends, 32)
    points = np.concatenate([[np.uint64(32)], points])  # each text is read from the space before it
    doc = np.zeros(len(points), np.int64)
    doc[ends[:-1] + 1] = 1
    doc = np.cumsum(doc)
    a, b, c = points[:-2], points[1:-1], points[2:]
    inside = np.flatnonzero((doc[1:-1] == doc[2:]) & ((b != 32) | ((a != 32) & (c != 32))))
    key = a[inside] << np.uint64(42) | b[inside] << np.uint64(21) | c[inside]
    return doc[2:][inside], (mixed(key) >> np.uint64(48)).astype(np.int64)


def language_counts(train: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows of train (text, lang); each task adds up before anything is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for piece in pieces(batches, "text"):
            doc, bucket = trigrams(piece.column("text"))
            lang = np.array(piece.column("lang").to_pylist(), object)
            for name in set(lang.tolist()):
                sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                sums[name] += np.bincount(bucket[(lang == name)[doc]], minlength=BUCKETS)
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "bucket", "n"])

    return train.select("text", "lang").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Mixture:
    """Names, log-probabilities (languages x buckets) and log-shares of the languages."""

    def __init__(self, names: list[str], counts: np.ndarray, smoothing: float = 0.5) -> None:
        self.names = names
        total = counts.sum(1, keepdims=True)
        self.log = np.log((counts + smoothing) / (total + smoothing * BUCKETS)).astype(np.float32)
        share = (total[:, 0] + 1.0) / (total.sum() + len(names)) if names else np.zeros(0)
        self.prior = np.log(share)

    def infer(self, texts: pa.Array, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(proportions by text and language, whether it has a trigram, posterior of the best language if there is only one)."""
        n, k = len(texts), len(self.names)
        share, best = np.zeros((n, k)), np.zeros(n)
        doc, bucket = trigrams(texts)
        if not len(doc) or not k:
            return share, np.bincount(doc, minlength=n) > 0, best
        key = doc << 16 | bucket
        key.sort()
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(new, len(key))).astype(np.float32)
        doc, log = key[new] >> 16, self.log[:, key[new] & (BUCKETS - 1)].T
        full, begin = np.unique(doc, return_index=True)
        total = np.add.reduceat(count, begin).astype(np.float64)
        single = np.add.reduceat(log * count[:, None], begin, dtype=np.float64)
        top = log.max(1, keepdims=True)
        p, row = np.exp(log - top), np.repeat(np.arange(len(full)), np.diff(np.append(begin, len(doc))))
        base = np.add.reduceat(count * top[:, 0], begin, dtype=np.float64)

        def part(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Of the texts in rows: their trigrams' places, each one's number among rows, its count, and where each text begins."""
            size = np.diff(np.append(begin, len(doc)))[rows]
            at = np.cumsum(size) - size
            pick = np.repeat(begin[rows] - at, size) + np.arange(size.sum())
            return pick, np.repeat(np.arange(len(rows)), size), count[pick], at

        def maximise(q: np.ndarray, r: np.ndarray, c: np.ndarray, at: np.ndarray, times: int) -> np.ndarray:
            """Proportions by EM from equal ones; q: likelihoods in the languages there are."""
            pi = np.full((len(at), q.shape[1]), 1 / q.shape[1], np.float32)
            for _ in range(times):
                share = pi[r] * q
                share *= (c / share.sum(1))[:, None]
                pi = np.add.reduceat(share, at).astype(np.float32)
                pi /= pi.sum(1, keepdims=True)
            return pi

        weighed = single + self.prior
        first = weighed.argmax(1)
        chosen = np.zeros((len(full), k))
        chosen[np.arange(len(full)), first] = 1
        value = single.max(1)
        odds = np.exp(weighed - weighed.max(1, keepdims=True))
        posterior = 1 / odds.sum(1)
        step = 0.5 * np.log(np.maximum(total, 2))
        if k > 1:
            # By Jensen's inequality no mixture exceeds a given one's likelihood by more than total * ln(largest mean ratio of a language to it)
            ratio = np.exp(log - np.take_along_axis(log, first[row][:, None], 1))
            gain = total * np.log(np.maximum(np.add.reduceat(ratio * count[:, None], begin, dtype=np.float64).max(1) / total, 1))
            limit = gain + np.take_along_axis(single, first[:, None], 1)[:, 0] + 1e-5 * total  # numbers are rounded
            rows = np.flatnonzero(limit - value > step)
            order = np.zeros((len(full), k), np.int64)
            if len(rows):
                pick, *rest = part(rows)
                order[rows] = np.argsort(-maximise(p[pick], *rest, 10), axis=1, kind="stable")
            for m in range(2, k + 1):
                if not len(rows):
                    break
                pick, r, c, at = part(rows)
                q, of = p[pick], order[rows, :m]
                some = np.take_along_axis(q, of[r], 1)
                pi = maximise(some, r, c, at, rounds)
                like = (pi[r] * some).sum(1)
                reached = np.add.reduceat(c * np.log(like), at, dtype=np.float64) + base[rows]
                better = reached - (m - 1) * step[rows] > value[rows]
                value[rows[better]] = (reached - (m - 1) * step[rows])[better]
                found = np.zeros((len(rows), k))
                np.put_along_axis(found, of, pi, 1)
                chosen[rows[better]] = found[better]
                most = np.add.reduceat(q * (c / like)[:, None], at, dtype=np.float64).max(1) / total[rows]
                limit[rows] = np.minimum(limit[rows], reached + total[rows] * (np.log(np.maximum(most, 1)) + 1e-5))
                rows = rows[limit[rows] - m * step[rows] > value[rows]]  # a larger set can't pay its penalty
        alone = (chosen > 0).sum(1) == 1
        share[full] = chosen
        best[full] = np.where(alone, posterior, 1.0)
        return share, np.bincount(full, minlength=n) > 0, best


def learn(train: DataFrame) -> Mixture:
    """From rows (text, lang); a null lang teaches nothing. The driver gets languages x 2**16 counts at most."""
    rows = language_counts(train.where(F.col("lang").isNotNull())).toArrow()
    lang, at = rows.column("lang").to_pandas(), rows.column("bucket").to_numpy()
    names = sorted(lang.unique().tolist())
    counts = np.zeros((len(names), BUCKETS))
    counts[np.searchsorted(names, lang.to_numpy(object)) if len(names) else np.zeros(0, int), at] = rows.column("n").to_numpy()
    return Mixture(names, counts)


def predict(docs: DataFrame, model: Mixture) -> DataFrame:
    """(doc_id, lang_pred, score, mixture) for each row of docs (doc_id, text).

    lang_pred is the language of the largest proportion (the first by name of equal ones), ``und`` with score 0 and an empty mixture for a null or empty
    text, one without letters, or if nothing was learned. score is that proportion, times the language's posterior if it is the only one. Extra columns are
    left out; repeated rows get equal answers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.names, "und"], object)
        for piece in pieces(batches, "text"):
            share, has, best = model.infer(piece.column("text"))
            has &= len(model.names) > 0
            first = np.where(has, share.argmax(1) if len(model.names) else 0, len(model.names))
            score = np.where(has, share.max(1, initial=0) * best, 0.0)
            mixture = [[(names[j], float(row[j])) for j in np.flatnonzero(row > 0)] for row in share]
            yield pa.record_batch(
                [piece.column("doc_id"), pa.array(names[first], pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(mixture, pa.map_(pa.string(), pa.float64()))],
                names=["doc_id", "lang_pred", "score", "mixture"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, mixture map<string,double>")
