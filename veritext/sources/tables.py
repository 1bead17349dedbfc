"""Driver tables and the stand-in views built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def spread(df: DataFrame, keys: list[str], min_partitions: int | None = None) -> DataFrame:
    """Hash-spread a frame whose scan yields fewer partitions than the cluster
    runs in parallel (e.g. one large file with one row group), so per-row work
    (regex, tokenising, encoding) is not serialised in one task.  On inputs
    already split finer than that (the normal case at scale) it is a no-op.
    Hashing on the row keys (unique ids) avoids the sort that a round-robin
    repartition performs to stay deterministic on retry.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target, *keys) if df.rdd.getNumPartitions() < target else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df, TEXT_TABLES[name]) if name in TEXT_TABLES else df


# Tables with heavy per-row text work downstream, with their row keys.
TEXT_TABLES = {"documents": ["doc_id"], "pages": ["page_id"], "conversations": ["conv_id", "turn"]}


def phrase_documents(documents: DataFrame) -> DataFrame:
    """The document corpus as phrase search sees it: ``filename, content``.

    Text files are named ``<source>_<doc_id>.txt``.
    """
    return documents.select(
        F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.col("text").alias("content"))


def questions(benchmark: DataFrame) -> DataFrame:
    """The benchmark items as a batch of questions: ``question_id, question``."""
    return benchmark.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
