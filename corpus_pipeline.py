"""From raw documents to token files: five stages, each written as Parquet and read again as the next one's documents.

Rows are judged one by one, by their text: ids may be null or repeat. Rows with the same text share its fate in the stages language and test_items; columns other
than doc_id, text, lang and source go along untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language
from tidemark.llm.common import checked_broadcast, durable, fresh_path, id_crc, table
from tidemark.llm.decontaminate import contaminated
from tidemark.llm.jaccard_join import one_of_each
from tidemark.llm.mixing import mix
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.token_files import token_output

#: Share of its language that a document needs to stay.
LEAST_SHARE = 0.3
#: Target weights of the sources, those of op8's query.
WEIGHTS = {"src0": 4.0, "src1": 2.0}


def _by_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the text's hash for an id, which operators hand back."""
    return docs.select(F.xxhash64("text").alias("doc_id"), "text")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less those whose text's hash is a doc_id of gone. The texts stay where they are unless those are too many to broadcast. A clean text goes with a
    rejected one only if their 64-bit hashes are equal."""
    gone = checked_broadcast(durable(gone.select(F.col("doc_id").alias("_gone")).distinct(), "gone"))
    return docs.join(gone, F.xxhash64(docs["text"]) == gone["_gone"], "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: no letter (null and empty texts too), or no language with LEAST_SHARE of the text. Null ids and languages teach
    nothing, but their documents are judged. If nothing was learned, all go. Equal rows go or stay together. No documents give none."""
    found = language.predict(_by_text(docs), language.learn(docs.where(id_crc("doc_id") % 4 != 2)))
    return _without(docs, found.where((F.col("lang_pred") == "und") | (F.col("score") < LEAST_SHARE)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links join stays, that of the smallest doc_id (null ids last, then by a hash); of equal rows one. Texts without words,
    null or empty, link with nothing and all stay. No documents give none."""
    return one_of_each(docs, percent=80, k=5)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item, whole or edited. Null and empty texts hold none; with no items all stay. Equal rows go or stay together."""
    return _without(docs, contaminated(_by_text(docs), table(spark, sf_dir, "benchmark")))


def _placed(docs: DataFrame) -> DataFrame:
    """docs with _position, in the schedule by WEIGHTS. Rows that are equal in id, text and source share the position of the first."""
    key = F.xxhash64("doc_id", "text", "source")
    order = mix(durable(docs.select(key.alias("doc_id"), "source"), "keys"), WEIGHTS)
    order = order.groupBy(F.col("doc_id").alias("_key")).agg(F.min("position").alias("_position"))
    return docs.join(order, F.xxhash64(docs["doc_id"], docs["text"], docs["source"]) == order["_key"]).drop(order["_key"])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the schedule by WEIGHTS: files in order of their number hold it. A null source is a source of its own, and a source without
    a weight gets one by its size. Null ids and texts and repeated rows are documents like others. No documents give none."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = _placed(docs)
    return placed.repartitionByRange(n, placed["_position"]).sortWithinPartitions(placed["_position"]).select(*(docs[c] for c in docs.columns))


def _file_order() -> Column:
    """A row's place in a table that was written in order: the number of its file, then of the row."""
    number = lambda pattern: F.regexp_extract("_metadata.file_name", pattern, 1).cast("decimal(20,0)")
    return F.struct(number(r"^part-(\d+)").alias("part"), F.coalesce(number(r"-c(\d+)\."), F.lit(0)).alias("file"), F.col("_metadata.row_index").alias("row"))


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in files, in the mixture's order, and what they hold of each document. docs is read from the files that the stage before has written, whose order
    it is; for rows that aren't, the schedule is made again. A null text is empty and has an end id only. No documents give no files and no rows."""
    try:
        ordered = docs.select("doc_id", "text", _file_order().alias("_position"))
        ordered.schema  # noqa: B018  tells whether there are files
    except AnalysisException:
        ordered = _placed(docs).select(docs["doc_id"], docs["text"], "_position")
    return token_output(ordered, tokenizer_path(), end_id=0, order="_position")


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("test_items", drop_test_items),
    ("mixture", mix_sources),
    ("token_files", write_token_files),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out, path = stage(spark, docs, sf_dir), fresh_path(spark, name)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
