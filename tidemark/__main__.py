"""Command line: experiment (a folder of series to result rows), evaluate (intervals against ground truth), aggregate (result rows to a summary)."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.evaluate import best_f1_summary, interval_rates
from tidemark.plans.detector import ScreeningDetector, TwoStageDetector, sweep
from tidemark.sources import files


def experiment(spark: SparkSession, series: str, truth: str, dataset: str, out: str, two_stage: bool = False) -> DataFrame:
    """Writes the result rows of all series under a folder for each alpha; returns mean rates by model and alpha."""
    intervals, roster = files.read_truth(spark, truth)
    screening = ScreeningDetector(window_size=240)
    found = sweep(screening.scores(files.read_series(spark, series)), intervals, roster, dataset, two_stage=TwoStageDetector(screening) if two_stage else None)
    files.write_results(found, out)
    written = spark.read.parquet(out).where((F.col("dataset") == dataset) & (F.col("status") == "success"))
    return written.groupBy("model", "alpha").agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1"))).orderBy("model", "alpha")


def evaluated(spark: SparkSession, truth: str, detected: str) -> DataFrame:
    """Precision, recall and F1 of one series' intervals (CSV) against its ground truth (JSON)."""
    one = lambda df: df.withColumn("series_id", F.lit("series"))
    roster = one(spark.range(1)).select("series_id")
    return interval_rates(one(files.read_intervals(spark, detected)), one(files.read_truth_json(spark, truth)), roster).select("precision", "recall", F.col("f1").alias("F1"))


def aggregate(spark: SparkSession, pattern: str, out: str) -> DataFrame:
    """Writes the summary of result files of success, and returns it; shows what couldn't be read."""
    errors = files.result_file_errors(spark, pattern)
    if not errors.isEmpty():
        errors.show(truncate=False)
    summary = best_f1_summary(files.read_result_files(spark, pattern).where("status = 'success'"))
    files.write_summary(summary, out)
    return summary


def main() -> None:
    parser = argparse.ArgumentParser(prog="tidemark")
    todo = parser.add_subparsers(dest="todo", required=True)
    for name, places in (("experiment", ("series", "truth", "dataset", "out")), ("evaluate", ("truth", "detected")), ("aggregate", ("pattern", "out"))):
        sub = todo.add_parser(name)
        for place in places:
            sub.add_argument(place)
        if name == "experiment":
            sub.add_argument("--two-stage", action="store_true")
    asked = vars(parser.parse_args())
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    {"experiment": experiment, "evaluate": evaluated, "aggregate": aggregate}[asked.pop("todo")](spark, **asked).show(truncate=False)


if __name__ == "__main__":
    main()
