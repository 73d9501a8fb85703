"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a fresh local folder, which only a local session may have: executors elsewhere wouldn't see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if master.partition("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that the executors of {master or 'this cluster'} share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it back, so a lost executor costs no recomputation.

    The files stay, as rows that are returned may still be read from them; who owns the folder clears it when a job has ended.
    """
    spark, schema = df.sparkSession, df.schema
    path = fresh_path(spark, name)
    df.write.options(**({"compression": compression} if compression else {})).parquet(path)
    return spark.read.schema(schema).parquet(path)
