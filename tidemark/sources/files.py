"""Series, ground truth and result files in and out."""

from __future__ import annotations

import csv
import io
import posixpath
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.evaluate import filename_fields
from tidemark.operators.render import png

_STEM = r"([^/]+)\.csv$"


def read_series(spark: SparkSession, path: str, ts: str = "double") -> DataFrame:
    """(series_id, ts, value) of all CSV files (timestamp, value) under path; series_id is the file's stem. Rows that can't be read are null."""
    df = spark.read.schema(f"timestamp {ts}, value double").option("header", True).option("pathGlobFilter", "*.csv").csv(path)
    return df.select(F.regexp_extract("_metadata.file_name", _STEM, 1).alias("series_id"), F.col("timestamp").alias("ts"), "value")


def read_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((series_id, start, end), (series_id, n_ground_truth)) from lines ``signal,"[[start, end], ...]"`` under a header. A line that can't be read is in neither."""
    lines = spark.read.option("header", False).text(path).select(F.regexp_extract("value", r'^([^,]*),', 1).alias("series_id"), F.regexp_extract("value", r'^[^,]*,"?(.*?)"?\s*$', 1).alias("pairs"))
    rows = lines.withColumn("pairs", F.from_json("pairs", "array<array<double>>")).where("series_id <> '' and pairs is not null")
    return rows.select("series_id", F.explode("pairs").alias("p")).select("series_id", F.element_at("p", 1).alias("start"), F.element_at("p", 2).alias("end")), rows.select("series_id", F.size("pairs").cast("long").alias("n_ground_truth"))


def read_dataset_index(spark: SparkSession, path: str, wanted: list[str] | None = None) -> DataFrame:
    """(dataset, signal) from lines ``dataset,"('a', 'b')"``; wanted datasets only, if any are named."""
    rows = spark.read.text(path).select(F.regexp_extract("value", r"^([^,]*),", 1).alias("dataset"), F.explode(F.expr("regexp_extract_all(value, \"'([^']+)'\", 1)")).alias("signal"))
    return rows.where(F.col("dataset").isin(wanted)) if wanted else rows


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("start double, end double, severity double").option("header", True).option("enforceSchema", False).csv(path).select("start", "end")


def read_truth_json(spark: SparkSession, path: str) -> DataFrame:
    """(start, end) from a file that holds ``[[start, end], ...]``."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<double>>")).alias("p"))
    return rows.select(F.element_at("p", 1).alias("start"), F.element_at("p", 2).alias("end"))


def write_results(results: DataFrame, path: str) -> None:
    """Result rows by dataset, model and alpha; those of other datasets, models and alphas stay."""
    results.write.option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "model", "alpha").mode("overwrite").parquet(path)


_RESULT = {"signal": str, "model": str, "alpha": float, "status": str, "precision": float, "recall": float, "f1": float}


def _parsed(name: str, text: str) -> Iterator[dict]:
    """The rows of one result file by the names in its own header, and a row with line and error for each line, or a file, that can't be read."""
    rows = csv.reader(io.StringIO(text))
    header = [c.strip().removeprefix("\ufeff") for c in next(rows, [])]
    if "signal" not in header or len(set(header)) < len(header):
        yield {"file": name, "line": 1, "error": "no column signal" if "signal" not in header else "columns of one name"}
        return
    try:
        for row in rows:
            if len(row) != len(header):
                if row:
                    yield {"file": name, "line": rows.line_num, "error": f"{len(row)} fields, not {len(header)}"}
                continue
            found, told, wrong = dict(zip(header, row)), {"status": None if "status" in header else "success"}, []
            for c, kind in _RESULT.items():
                try:
                    told[c] = kind(found[c]) if found.get(c) else told.get(c)
                except ValueError:
                    wrong.append(c)
            yield {"file": name, "line": rows.line_num, **told, "error": f"no number: {', '.join(wrong)}" if wrong else None}
    except csv.Error as e:
        yield {"file": name, "line": rows.line_num, "error": str(e)}


def _read_results(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, line, columns of _RESULT, error) of all lines of CSV files, each file read by its own header. A file is one task's work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file", "line", *_RESULT, "error"]
        for b in batches:
            for name, text in zip(b.file, b.value):
                rows = list(_parsed(name, text))
                yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype="float64" if _RESULT.get(c) is float else "object") for c in columns}).astype({"line": "int64"})

    kinds = ", ".join(f"{c} {'double' if k is float else 'string'}" for c, k in _RESULT.items())
    texts = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    read = texts.mapInPandas(run, f"file string, line long, {kinds}, error string")
    return read.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, k in _RESULT.items() if k is float})

def read_result_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Result rows of CSV files ``results_<dataset>[_<model>]_alpha_<alpha>.csv``, by the names in each file's header, whatever the columns' order.

    dataset is that of the file's name; model and alpha are, where a file has no such column. Without a column status, rows count as success. What can't be read is in
    result_file_errors(): a file without a column signal and lines with too many or too few fields have no row; a value that isn't a number is null.
    """
    rows = _read_results(spark, pattern).where("signal is not null").withColumn("stem", F.regexp_extract("file", _STEM, 1))
    named = filename_fields(rows.select("stem").distinct()).select("stem", "dataset", F.col("model").alias("_model"), F.col("alpha").alias("_alpha"))
    out = rows.join(named, "stem").withColumn("model", F.coalesce("model", "_model")).withColumn("alpha", F.coalesce("alpha", "_alpha"))
    return out.select("dataset", *_RESULT)


def result_file_errors(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, line, error) of what read_result_files() can't read."""
    return _read_results(spark, pattern).where("error is not null").select("file", "line", "error")


def truth_errors(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of the lines that read_truth() can't read, besides the header."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    pairs = F.from_json(F.regexp_extract("text", r'^[^,]*,"?(.*?)"?\s*$', 1), "array<array<double>>")
    return lines.where((pairs.isNull() | (F.regexp_extract("text", r"^([^,]*),", 1) == "")) & (F.trim("text") != "") & ~F.lower("text").startswith("signal,"))


def write_summary(summary: DataFrame, path: str) -> None:
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_windows(windows: DataFrame, path: str) -> None:
    """Window rows (points, images or tokens) as Parquet, for later use."""
    windows.write.mode("overwrite").parquet(path)


def write_images(imaged: DataFrame, folder: str, side: int = 224, override: bool = False) -> DataFrame:
    """A PNG of each window (series_id, window_id, image) at ``folder/series_id/window_id.png``; (series_id, window_id, path, written) once the result is read.

    folder is a URI or path that all executors see. Files that are there stay, unless override is set.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        from pyarrow import fs

        filesystem, base = fs.FileSystem.from_uri(folder)
        for b in batches:
            paths, written = [], []
            for s, w, x in zip(b.series_id, b.window_id, b.image):
                inside = f"{quote(str(s), safe='')}/{w}.png"
                at = posixpath.join(base, inside)
                fresh = override or filesystem.get_file_info(at).type == fs.FileType.NotFound
                if fresh:
                    filesystem.create_dir(posixpath.dirname(at), recursive=True)
                    with filesystem.open_output_stream(at) as out:
                        out.write(png(np.frombuffer(x, np.uint8).reshape(side, side) / 255))
                paths.append(f"{folder.rstrip('/')}/{inside}")
                written.append(fresh)
            yield b[["series_id", "window_id"]].assign(path=paths, written=written)

    return imaged.mapInPandas(run, "series_id string, window_id long, path string, written boolean")
