"""A second look at proposed intervals: prompt, model's answer, intervals of it."""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from base64 import b64encode
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from hashlib import sha256
from threading import Thread
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.render import plot, png

ANSWER = "struct<interval_index:array<array<double>>,confidence:array<double>,abnormal_description:string>"


class Verifier(Protocol):
    """A model's answer, as text, to a prompt and a PNG of the series."""

    def __call__(self, prompt: str, image: bytes) -> str: ...


class KeepAll:
    """Answers with the proposals that the prompt ends in. It stands in for a vision-language model, which users plug in."""

    def __call__(self, prompt: str, image: bytes) -> str:
        return '{"interval_index": ' + prompt.rpartition("PROPOSALS ")[2] + ', "abnormal_description": "as proposed"}'


def chat_request(prompt: str, image: bytes, model: str) -> str:
    """The JSON of a request to a chat service: one message with the text and the image as a data URL."""
    picture = {"type": "image_url", "image_url": {"url": "data:image/png;base64," + b64encode(image).decode()}}
    return json.dumps({"model": model, "messages": [{"role": "user", "content": [{"type": "text", "text": prompt}, picture]}]})


@dataclass(frozen=True)
class ChatVerifier:
    """Sends chat_request() by a function that users bring, which returns the answer's text."""

    send: Callable[[str], str]
    model: str

    def __call__(self, prompt: str, image: bytes) -> str:
        return self.send(chat_request(prompt, image, self.model))


@dataclass(frozen=True)
class AnswerLog:
    """Answers in a folder (a path or URI) that all executors see, each in a file named by a hash of what was asked.

    A file appears whole, by a rename. model tells apart what different models say.
    """

    folder: str
    model: str = ""

    def _place(self, prompt: str, image: bytes):
        from pyarrow import fs

        filesystem, base = fs.FileSystem.from_uri(self.folder)
        parts = [self.model.encode(), prompt.encode(), image]
        key = sha256(b"".join(len(p).to_bytes(8, "little") + p for p in parts)).hexdigest()
        return filesystem, posixpath.join(base, key[:2], key)

    def get(self, prompt: str, image: bytes) -> str | None:
        from pyarrow import fs

        filesystem, path = self._place(prompt, image)
        if filesystem.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with filesystem.open_input_stream(path) as f:
            return f.read().decode()

    def put(self, prompt: str, image: bytes, answer: str) -> None:
        filesystem, path = self._place(prompt, image)
        filesystem.create_dir(posixpath.dirname(path), recursive=True)
        fresh = f"{path}.{uuid.uuid4().hex}"
        with filesystem.open_output_stream(fresh) as f:
            f.write(answer.encode())
        filesystem.move(fresh, path)


def _within(seconds: float | None, verifier: Verifier, prompt: str, image: bytes) -> str:
    """The answer, or TimeoutError after so many seconds; a request that is late is left behind."""
    if seconds is None:
        return verifier(prompt, image)
    told: dict[str, object] = {}

    def ask() -> None:
        try:
            told["answer"] = verifier(prompt, image)
        except Exception as e:
            told["error"] = e

    thread = Thread(target=ask, daemon=True)
    thread.start()
    thread.join(seconds)
    if "error" in told:
        raise told["error"]
    if "answer" not in told:
        raise TimeoutError(f"no answer in {seconds} s")
    return told["answer"]


@dataclass(frozen=True)
class Asking:
    """How a task asks: from a log first, if there is one; so many requests at a time, each again after a failure, later each time, and each with a time limit."""

    log: AnswerLog | None = None
    at_once: int = 1
    again: int = 0
    pause: float = 1.0
    limit: float | None = None

    def __call__(self, verifier: Verifier, prompt: str, image: bytes) -> str | None:
        """The answer, which is in the log before it is used; None, which isn't logged, if all attempts fail."""
        for attempt in range(self.again + 1):
            try:
                if attempt:
                    time.sleep(self.pause * 2 ** (attempt - 1))
                found = self.log.get(prompt, image) if self.log else None
                if found is None:
                    found = _within(self.limit, verifier, prompt, image)
                    if self.log and found is not None:
                        self.log.put(prompt, image, found)
                return found
            except Exception:  # a model's failure must not end the job
                continue
        return None


def prompts(proposals: DataFrame) -> DataFrame:
    """(series_id, prompt) of index pairs (series_id, s, e)."""
    listed = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("s", "e"))), lambda p: F.array(p["s"], p["e"])))
    text = (
        "The plot shows one series, its value against its index, whose numbers are under the axis. Another method has proposed intervals of indices, at the end of this text, that may be anomalous. "
        "Look at the whole plot. Leave out proposals that fit the series' usual course, such as a part of what repeats; mend ends that are off; add intervals that stand out and weren't proposed. "
        "Answer with one JSON object: interval_index, a list of [first, last] index of each anomaly, empty if there is none; confidence, a list with a number for each: 1 if it may be chance, 2 if it "
        "is likely an anomaly, 3 if it is plainly one; abnormal_description, a sentence on what is unusual. PROPOSALS "
    )
    return proposals.groupBy("series_id").agg(F.concat(F.lit(text), listed).alias("prompt"))


def answers(prompted: DataFrame, series: DataFrame, verifier: Verifier, height: int = 342, width: int = 1200, asking: Asking = Asking()) -> DataFrame:
    """(series_id, raw): each series with proposals is drawn and asked about once, on an executor. A failure gives null. With a log in asking, a task that runs
    again, or a later job, asks only what has no answer yet; series whose prompts and plots are equal share one.

    Of the points that share a column of the plot, only the first, last, least and greatest are gathered, so a series of any length is a few thousand points.
    """

    def ask(prompt: str, index: np.ndarray, values: np.ndarray) -> str | None:
        try:
            image = png(plot(np.array(index, float), np.array(values, float), height, width))
        except Exception:  # nor must a plot's
            return None
        return asking(verifier, prompt, image)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(asking.at_once) as pool:
            for b in batches:
                out = list(pool.map(ask, b.prompt, b["index"], b["values"]))
                yield pd.DataFrame({"series_id": b.series_id, "raw": pd.Series(out, index=b.index, dtype=object)})

    asked = series.join(prompted.select("series_id"), "series_id", "left_semi").select("series_id", "idx", "value", F.expr(f"idx * {width} div n").alias("at"))
    point = F.struct("idx", "value")
    few = asked.groupBy("series_id", "at").agg(F.min(point).alias("a"), F.max(point).alias("b"), F.min_by(point, "value").alias("c"), F.max_by(point, "value").alias("d"))
    few = few.select("series_id", F.explode(F.array_distinct(F.array("a", "b", "c", "d"))).alias("p")).where("p is not null")
    rows = few.groupBy("series_id").agg(F.sort_array(F.collect_list("p")).alias("p")).select("series_id", F.col("p.idx").alias("index"), F.col("p.value").alias("values"))
    return rows.join(prompted, "series_id").mapInPandas(run, "series_id string, raw string")


def parsed(raw: DataFrame) -> DataFrame:
    """Adds answer and said: the JSON of the whole text or of its outermost braces, and whether interval_index is there and no null."""
    inner = F.regexp_extract("raw", r"(?s)(\{.*\})", 1)
    text = F.when(F.json_object_keys("raw").isNotNull(), F.col("raw")).otherwise(inner)
    out = raw.withColumn("_json", text).withColumn("answer", F.from_json("_json", ANSWER))
    return out.withColumn("said", F.coalesce(F.array_contains(F.json_object_keys("_json"), "interval_index") & F.col("answer.interval_index").isNotNull(), F.lit(False))).drop("_json")


def answered(raw: DataFrame) -> DataFrame:
    """(series_id, pos, s, e, confidence): a row for each pair; a confidence that is missing is 1."""
    pairs = parsed(raw).where("said").select("series_id", "answer.confidence", F.posexplode("answer.interval_index").alias("pos", "pair"))
    sure = F.coalesce(F.try_element_at("confidence", F.col("pos") + 1), F.lit(1.0))
    return pairs.where(F.size("pair") >= 2).select("series_id", "pos", F.element_at("pair", 1).cast("long").alias("s"), F.element_at("pair", 2).cast("long").alias("e"), sure.alias("confidence"))


def verified(raw: DataFrame, proposals: DataFrame, indexed: DataFrame) -> DataFrame:
    """(series_id, start, end, severity): what the answers say, within the series and in their order of ends; the proposals where there is no usable answer.

    An empty list says that there is no anomaly. proposals: (series_id, start, end, severity).
    """
    lengths = indexed.select("series_id", "n").distinct()
    inside = lambda c: F.greatest(F.lit(0), F.least(F.col(c), F.col("n") - 1))
    told = answered(raw).join(lengths, "series_id").select("series_id", inside("s").alias("s"), inside("e").alias("e"), F.col("confidence").alias("severity"))
    at = indexed.select("series_id", F.col("idx").alias("s"), F.col("ts").alias("start"))
    until = indexed.select("series_id", F.col("idx").alias("e"), F.col("ts").alias("end"))
    told = told.join(at, ["series_id", "s"]).join(until, ["series_id", "e"]).select("series_id", "start", "end", "severity")
    silent = proposals.join(parsed(raw).where("said").select("series_id"), "series_id", "left_anti")
    return told.unionByName(silent.select("series_id", "start", "end", "severity"))
