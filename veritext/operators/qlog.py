"""Question log (L1-L4): append, view, metrics, clear.

The log is an append-only table (parquet under a shared path).  Pairs of a
user turn and the assistant turn right after it are found with an equi-join
on (conversation, turn + 1), so a very long conversation is split by turn
instead of landing in one window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext import fixed as FX

HEADER_CHARS = FX.HEADER_CHARS
CHUNK = "struct<rank:bigint,chunk_id:string,content:string,source:string,retrieval_score:double,rerank_score:double>"
LOG_SCHEMA = (f"question_id bigint, question string, answer string, confidence double, reranking_used boolean, "
              f"response_time double, ts timestamp, chunks array<{CHUNK}>, context string, "
              f"pipeline_stats struct<retrieved:bigint,final:bigint,reranking_used:boolean>")


def conversation_pairs(conversations: DataFrame) -> DataFrame:
    """L1 input: ``conv_id, turn, question, answer`` (user turn + next assistant turn)."""
    u = conversations.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = conversations.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"])


def log_entries(records: DataFrame, response_time: Column | None = None) -> DataFrame:
    """Answer records with their whole result as log rows, stamped with the current time."""
    return records.select(
        "question_id", "question", "answer", "confidence",
        F.col("pipeline_stats.reranking_used").alias("reranking_used"),
        (response_time if response_time is not None else F.lit(None).cast("double")).alias("response_time"),
        F.current_timestamp().alias("ts"),
        F.col("chunks").cast(f"array<{CHUNK}>").alias("chunks"), "context", "pipeline_stats")


def log_append(entries: DataFrame, path: str) -> None:
    """L1: append rows to the log table."""
    entries.write.mode("append").parquet(path)


def log_clear(spark: SparkSession, path: str) -> None:
    """L4: replace the log with an empty, typed table."""
    spark.createDataFrame([], LOG_SCHEMA).write.mode("overwrite").parquet(path)


def header(question: Column, when: Column | None = None) -> Column:
    q = F.concat(F.substring(question, 1, HEADER_CHARS), F.lit("..."))
    return q if when is None else F.concat(when, F.lit(" - "), q)


def log_view(log: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """L2: newest first (or in ``order``), with a header of the time, where the
    log has one, and the question's first characters."""
    ts = F.date_format("ts", "HH:mm:ss") if "ts" in log.columns else None
    return (log.select("*", header(F.col("question"), ts).alias("header"))
            .orderBy(*(order or [F.col("ts").desc()])))


def percent_text(x: Column) -> Column:
    """Whole percent via decimal rounding, e.g. 0.583 -> '58%'."""
    return F.concat(F.round((x * 100).cast("decimal(18,6)"), 0).cast("decimal(18,0)").cast("string"), F.lit("%"))


def log_metrics(log: DataFrame) -> DataFrame:
    """L3: response time with 2 decimals, confidence in whole percent, reranking yes/no."""
    return log.select(
        "question_id",
        F.concat(F.round(F.col("response_time").cast("decimal(18,6)"), 2).cast("string"), F.lit("s")).alias("response_time_text"),
        percent_text(F.col("confidence")).alias("confidence_text"),
        F.when(F.col("reranking_used"), F.lit("yes")).otherwise(F.lit("no")).alias("reranking"))
