"""The corpus pipeline: documents in, packed training sequences out.

Each stage calls one operator of ``veritext.llm`` on all that the stage before
it kept; ``run`` writes a stage's result as Parquet and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.llm import lines, mixing, neardup, packing, quality
from veritext.llm.queries import CLEAN, QUALITY_THRESHOLD, SEQUENCE_TOKENS, TARGETS, domains, tokenizer_path
from veritext.llm.shared import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Every row is judged by its own whole text: null and empty texts score as
    such, rows that repeat an id or lack one are judged each.  An empty table
    gives no rows; further columns stay as they are.
    """
    scored = quality.with_quality(docs, score_col="__quality")
    return scored.filter(F.col("__quality") >= QUALITY_THRESHOLD).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat a kept one; n_chars follows the text.

    Null, empty and blank texts and rows without id stay as they are; rows of
    one id are told apart by their texts, and rows that repeat both lose the
    same lines.  A document that loses every filled line goes.  Lines of any
    length are compared whole; further columns stay as they are.
    """
    kept = lines.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id.

    Rows are told apart by id and text: rows of one id with different texts
    are different documents, rows that repeat both are one, of which one stays.
    Rows without id, and texts without words, are copies of nothing and stay.
    Texts of any length are compared whole; further columns stay as they are.
    """
    row, columns = F.xxhash64(F.coalesce("text", F.lit(""))), docs.columns
    repeated = stored(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "near-repeated")
    if repeated.isEmpty():
        copies = neardup.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
        return docs.join(copies, "doc_id", "left_anti").select(*columns)
    # every different row gets a number that grows with its id, by which the copies are found
    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", row.alias("__near_row")).distinct()
    order = [F.col("doc_id").asc(), F.col("__near_row").asc()]
    numbers = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__near_number", F.monotonically_increasing_id())
    numbers = stored(numbers, "near-numbers")
    here = docs.select("doc_id", "text", row.alias("__near_row")).dropDuplicates(["doc_id", "__near_row"])
    found = neardup.near_duplicates(here.join(numbers, ["doc_id", "__near_row"]), id_col="__near_number").filter(~F.col("kept"))
    copies = stored(numbers.join(found.select("__near_number"), "__near_number", "left_semi"), "near-copies")
    copies = copies.select(F.col("doc_id").alias("__near_id"), "__near_row")
    kept = docs.join(copies, (F.col("doc_id") == F.col("__near_id")) & (row == F.col("__near_row")), "left_anti").select(*columns)
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*columns)
    return kept.join(repeated, "doc_id", "left_anti").select(*columns).union(once)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say.

    Rows that repeat an id, or have none, share a rate; null and empty texts
    have no tokens and the rate of the mean posterior.  Texts of any length
    count whole; further columns stay as they are.
    """
    return mixing.mix(docs, domains(spark, sf_dir), TARGETS, keep=CLEAN)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of the packed sequences.

    Every row is a document of its own, whatever its id; a null or empty text
    is the separator alone, a long one many pieces.  Further columns are left
    out; an empty table gives no rows.
    """
    packed = packing.pack(docs, tokenizer_path(), capacity=SEQUENCE_TOKENS)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("mixing", mixing_stage),
          ("packing", packing_stage)]

#: SQL cannot express these stages; tests/llm hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
