"""Toxicity by class-conditional Kneser-Ney models.

Texts are read as symbols (letters, a space, a digit, a mark); each class has counts of the 5-grams that its training texts have, as many as there are. The models
discount these counts and back off to one shared model, whose Kneser-Ney continuation counts (in how many contexts a shorter n-gram stands) come from both classes:
an expression that neither class has often counts for little. Counts, continuation counts and models are tables of n-grams, joined by histories and suffixes.

What scoring needs is a table of log-ratios of the classes: of each 5-gram that is known, and of each history, for what has not been seen after it. It grows with
the corpus. Up to TABLE_GRAMS rows it is sent to the tasks; beyond that, stretches of documents ask for the n-grams that they have, and get those rows by a join.
A text's length-normalised log-likelihoods are compared as a whole and in its most toxic windows; a logistic curve, fitted on training rows that the counts left
out, makes a probability of these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import calibrate
from tidemark.llm.chars import code_points, spaced, symbols
from tidemark.llm.common import checked_broadcast, durable, id_crc, mixed, pieces, small_enough

ORDER = 5
DISCOUNT = 0.75
#: Widths, in symbols, of the windows whose best mean is a feature.
WINDOWS = (8, 24, 96)
#: Rows that the logistic curve is fitted on at most.
CALIBRATION_ROWS = 20_000
#: Rows of the table that are sent to all tasks, ten bytes each; bytes of text that ask for rows together beyond that.
TABLE_GRAMS, ASKING_BYTES = 4_000_000, 32 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NAMES = [f"f{i}" for i in range(1 + len(WINDOWS))]


@dataclass
class Grams:
    """Of each 5-gram of some texts: the text's number, its symbols (one row for each place), the keys of it and of its history."""

    doc: np.ndarray
    points: list[np.ndarray]
    key: np.ndarray
    history: np.ndarray


def grams(texts: pa.Array) -> Grams:
    """A text begins with the spaces before it: its first symbol has a history too. An empty text has nothing."""
    points, ends = code_points(texts)
    found, ends = spaced(symbols()[points], ends, 32)
    size = np.diff(np.append(0, ends))
    at = np.arange(len(found)) - np.repeat(ends - size, size)
    real = np.flatnonzero(~((at == 0) & (found == 32)))
    places = []
    for back in range(ORDER - 1, -1, -1):
        place = np.full(len(found), 32, np.uint32)
        place[back:] = np.where(at[back:] >= back, found[: len(found) - back], 32)
        places.append(place[real])
    total = np.zeros(len(real), np.uint64)
    for p in places[:-1]:
        total = total * _STEP + p
    return Grams(np.repeat(np.arange(len(ends)), size)[real], places, mixed(total * _STEP + places[-1] + np.uint64(5)), mixed(total + np.uint64(4)))


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(gram, key, history, n1, n0) over rows (text, label): history is the key of the first four symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def merged() -> tuple:
            key, first, at = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True)
            history, points = (np.concatenate([h[i] for h in held])[first] for i in (1, 2))
            return key, history, points, *(np.bincount(at, np.concatenate([h[i] for h in held]), len(key)).astype(np.int64) for i in (3, 4))

        for piece in pieces(batches, "text"):
            g = grams(piece.column("text"))
            label = piece.column("label").to_numpy()[g.doc]
            key, first, at = np.unique(g.key, return_index=True, return_inverse=True)
            held.append((key, g.history[first], np.stack([p[first] for p in g.points], axis=1), *(np.bincount(at[label == c], minlength=len(key)) for c in (1, 0))))
            if len(held) > 8 and sum(len(h[0]) for h in held[1:]) > len(held[0][0]):
                held = [merged()]
        if held:
            key, history, points, n1, n0 = merged()
            for i in range(0, len(key), 1 << 16):
                part = slice(i, i + (1 << 16))
                told = points[part].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                names = pa.array([told[j : j + ORDER] for j in range(0, len(told), ORDER)])
                yield pa.record_batch([names, pa.array(key[part].view(np.int64)), pa.array(history[part].view(np.int64)), pa.array(n1[part]), pa.array(n0[part])], names=["gram", "key", "history", "n1", "n0"])

    rows = labelled.select("text", F.col("label").cast("int")).mapInArrow(run, "gram string, key long, history long, n1 long, n0 long")
    return rows.groupBy("gram", "key", "history").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def shared_model(counts: DataFrame) -> DataFrame:
    """(g, p): P(last symbol | three before) of each 4-gram that stands at the end of a counted 5-gram, from the number of its left contexts, interpolated down to
    single symbols and to one over their number and one more."""
    levels, longer = [], counts.select(F.col("gram").alias("g"))
    for k in range(ORDER - 1, 0, -1):
        levels.append(durable(longer.groupBy(F.substring("g", 2, k).alias("g")).agg(F.count(F.lit(1)).alias("n")), f"contexts{k}"))
        longer = levels[-1].select("g")
    total, kinds = levels[-1].agg(F.sum("n"), F.count(F.lit(1))).first()
    p = levels[-1].select("g", ((F.col("n") - DISCOUNT + DISCOUNT * kinds / (kinds + 1)) / (total or 1)).alias("p"))
    for k, level in zip(range(2, ORDER), reversed(levels[:-1])):
        split = level.select("g", "n", F.substring("g", 1, k - 1).alias("h"), F.substring("g", 2, k - 1).alias("s"))
        sums = split.groupBy("h").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        lower = p.select(F.col("g").alias("s"), F.col("p").alias("lower"))
        p = durable(split.join(sums, "h").join(lower, "s").select("g", ((F.col("n") - DISCOUNT + DISCOUNT * F.col("kinds") * F.col("lower")) / F.col("total")).alias("p")), f"shared{k}")
    return p


def ratios(counts: DataFrame) -> DataFrame:
    """(key, ratio): log P(. | toxic) - log P(. | ordinary) of each counted 5-gram, and of what was never counted after each history, by the history's key."""
    # a class without this history goes by the shared model alone
    rest = lambda c: F.when(F.col(f"t{c}") > 0, DISCOUNT * F.col(f"k{c}") / F.col(f"t{c}")).otherwise(1.0)
    whole = lambda c: F.greatest(F.lit(0.0), F.col(f"n{c}") - DISCOUNT) / F.greatest(F.lit(1), F.col(f"t{c}")) + rest(c) * F.col("p")
    sums = [x for c in (1, 0) for x in (F.sum(f"n{c}").alias(f"t{c}"), F.count(F.when(F.col(f"n{c}") > 0, 1)).alias(f"k{c}"))]
    histories = durable(counts.groupBy("history").agg(*sums), "histories")
    lower = shared_model(counts).withColumnRenamed("g", "s")
    full = counts.withColumn("s", F.substring("gram", 2, ORDER - 1)).join(lower, "s").join(histories, "history")
    known = full.select("key", (F.log(whole(1)) - F.log(whole(0))).cast("float").alias("ratio"))
    return known.unionByName(histories.select(F.col("history").alias("key"), (F.log(rest(1)) - F.log(rest(0))).cast("float").alias("ratio")))


class Lookup:
    """An open-addressed table of keys and ratios: a third of the slots is taken at most."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, (3 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.mark, self.value = np.zeros(1 << bits, np.uint32), np.zeros(1 << bits, np.float16)
        slot, mark = self._of(keys.view(np.uint64))
        left = np.arange(len(keys))
        while len(left):
            free = left[self.mark[slot[left]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.mark[slot[put]], self.value[slot[put]] = mark[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.last

    def _of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (keys >> self.shift).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ratios, whether they are known)."""
        slot, mark = self._of(keys)
        out, has, left = np.zeros(len(keys)), np.zeros(len(keys), bool), np.arange(len(keys))
        while len(left):
            seen = self.mark[slot[left]]
            hit = left[seen == mark[left]]
            out[hit], has[hit] = self.value[slot[hit]], True
            left = left[(seen != 0) & (seen != mark[left])]
            slot[left] = (slot[left] + 1) & self.last
        return out, has

    def ratios(self, g: Grams) -> np.ndarray:
        out, has = self.find(g.key)
        rest = np.flatnonzero(~has)
        out[rest] = self.find(g.history[rest])[0]
        return out


def features(texts: pa.Array, lookup: Lookup) -> np.ndarray:
    """Mean log-ratio and best window means for each text; zeros without symbols."""
    g = grams(texts)
    n = np.bincount(g.doc, minlength=len(texts))
    out = np.zeros((len(texts), len(_NAMES)))
    full = np.flatnonzero(n)
    if not len(full):
        return out
    total = np.append(0, np.cumsum(lookup.ratios(g)))
    begin = (np.cumsum(n) - n)[full]
    end = begin + n[full]
    out[full, 0] = (total[end] - total[begin]) / n[full]
    for i, w in enumerate(WINDOWS, 1):
        stop = np.minimum(np.arange(len(g.key)) + w, np.repeat(end, n[full]))  # near the end, a window is shorter but weighs as if full
        out[full, i] = np.maximum.reduceat((total[stop] - total[:-1]) / w, begin)
    return out


def packed(table: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """The table's keys and ratios if it has at most TABLE_GRAMS rows."""
    if not small_enough(table, TABLE_GRAMS):
        return None
    rows = table.toArrow()
    return rows.column("key").to_numpy(), rows.column("ratio").to_numpy().astype(np.float16)


def with_features(docs: DataFrame, table: DataFrame, small: tuple[np.ndarray, np.ndarray] | None, columns: list[str], schema: str, made: Callable[[np.ndarray], list[pa.Array]]) -> DataFrame:
    """columns of docs and what made() gives for the features of their texts."""
    names = [*columns, *(x.split()[0] for x in schema.split(", "))]
    kinds = dict(docs.dtypes)
    out = ", ".join([*(f"{c} {kinds[c]}" for c in columns), schema])

    def answer(rows: pa.RecordBatch, lookup: Lookup) -> pa.RecordBatch:
        return pa.record_batch([*(rows.column(c) for c in columns), *made(features(rows.column("text"), lookup))], names=names)

    if small is not None:
        shared = docs.sparkSession.sparkContext.broadcast(small)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lookup = Lookup(*shared.value)
            for piece in pieces(batches, "text"):
                yield answer(piece, lookup)

        return docs.select("text", *columns).mapInArrow(run, out)

    stretches = max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ASKING_BYTES))
    dealt = durable(docs.select("text", *columns).withColumn("_stretch", F.pmod(F.xxhash64("text", *columns), F.lit(stretches))), "dealt", compression="zstd")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            g = grams(piece.column("text"))
            stretch = piece.column("_stretch").to_numpy()[g.doc]
            for s in np.unique(stretch):
                keys = np.unique(np.concatenate([g.key[stretch == s], g.history[stretch == s]])).view(np.int64)
                yield pa.record_batch([pa.array(np.full(len(keys), s)), pa.array(keys)], names=["_stretch", "key"])

    asked = dealt.select("text", "_stretch").mapInArrow(ask, "_stretch long, key long").distinct()
    told = asked.join(table, "key").select("_stretch", "key", "ratio")

    def both(rows: pa.Table, known: pa.Table) -> pa.Table:
        lookup = Lookup(known.column("key").to_numpy(), known.column("ratio").to_numpy().astype(np.float16))
        return pa.Table.from_batches([answer(p, lookup) for p in pieces(iter(rows.to_batches()), "text")] or [answer(rows.schema.empty_table().combine_chunks().to_batches()[0], lookup)])

    return dealt.groupBy("_stretch").cogroup(told.groupBy("_stretch")).applyInArrow(both, out)


def labelled_rows(docs: DataFrame, labels: DataFrame, column: str, curve_rows: int = CALIBRATION_ROWS) -> DataFrame:
    """(doc_id, text, label, fold) of labelled documents, kept in the shared folder as they are read several times. A repeated label counts once, the greater one.

    Fold 0, chosen by a hash of doc_id, is for the logistic curve and left out of counts: a fifth, or about curve_rows if that is less; all others are counted.
    """
    marks = durable(labels.where(F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.max(column).cast("int").alias("label")), "marks")
    share = min(0.2, curve_rows / max(1, marks.count()))
    fold = F.when(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)), 0).otherwise(1)
    return durable(docs.select("doc_id", "text").join(checked_broadcast(marks), "doc_id").withColumn("fold", fold), "labelled", compression="zstd")


@dataclass
class Model:
    table: DataFrame
    small: tuple[np.ndarray, np.ndarray] | None
    curve: tuple


def learn(labelled: DataFrame) -> Model:
    """From rows of labelled_rows()."""
    counts = durable(gram_counts(labelled.where("fold <> 0")), "grams")
    table = durable(ratios(counts), "ratios")
    small = packed(table)
    found = with_features(labelled.where("fold = 0"), table, small, ["doc_id", "label"], ", ".join(f"{n} double" for n in _NAMES), lambda x: [pa.array(c.copy()) for c in x.T])
    rows = found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION_ROWS).toPandas()
    return Model(table, small, calibrate.fit(rows[_NAMES].to_numpy(float), rows.label.to_numpy(float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of docs (doc_id, text): the probability of being toxic, 0 to 1.

    Null, empty and blank texts get what a mean log-ratio of 0 gives. With no labelled rows, or one class only, all scores are its share. Extra columns are
    left out; equal texts get equal scores.
    """
    curve = model.curve
    return with_features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model.table, model.small, ["doc_id"], "score double", lambda x: [pa.array(calibrate.probability(curve, x))])


def training(docs: DataFrame, labels: DataFrame, column: str, curve_rows: int = CALIBRATION_ROWS) -> DataFrame:
    """labelled_rows() of documents whose crc32(doc_id as text) mod 5 is not 0."""
    return labelled_rows(docs.where(id_crc("doc_id") % 5 != 0), labels, column, curve_rows)
