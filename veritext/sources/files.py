"""File sources and sinks: HTML folders, chunk JSON, text corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritext.sources.json_arrays import read_json_array, write_json_array

CHUNK_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("article", T.StringType()),
    T.StructField("paragraph", T.StringType()),
])


def scan_pages(spark: SparkSession, folder: str, strict_html_only: bool = False) -> DataFrame:
    """HTML files of a folder as ``page_id, path, file_name, html, valid_utf8``.

    Default rule: ``.html`` or ``.htm``, any case; ``strict_html_only``:
    ``.html`` exactly.  Bytes are checked for valid UTF-8 before decoding
    (invalid sequences become U+FFFD and the page is flagged for T6).
    """
    glob = "*.html" if strict_html_only else "*.{[hH][tT][mM],[hH][tT][mM][lL]}"     # other files are not opened
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("pathGlobFilter", glob).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select(F.xxhash64("path").alias("page_id"), "path", name.alias("file_name"),
                      F.make_valid_utf8(F.col("content").cast("string")).alias("html"),
                      F.is_valid_utf8(F.col("content").cast("string")).alias("valid_utf8"))


def read_chunks_json(spark: SparkSession, path: str) -> DataFrame:
    """Chunk records (JSON Lines, or one JSON array per file)."""
    return spark.read.schema(CHUNK_SCHEMA).option("multiLine", False).json(path)


def read_chunks_json_array(spark: SparkSession, path: str) -> DataFrame:
    """S2, array form: each file holds one JSON array of chunk objects; large files are read by several tasks."""
    return read_json_array(spark, path, CHUNK_SCHEMA)


def write_chunks_json(chunks: DataFrame, path: str) -> None:
    """Chunk records as JSON Lines; non-ASCII text is written as is."""
    chunks.select(*[c.name for c in CHUNK_SCHEMA.fields]).write.mode("overwrite").json(path)


def write_chunks_json_array(chunks: DataFrame, path: str) -> None:
    """S4, array form: one JSON array a file; null fields are written."""
    write_json_array(chunks.select(*[c.name for c in CHUNK_SCHEMA.fields]), path)


def write_text_corpus(corpus: DataFrame, path: str) -> None:
    """S3 sink: one text per file name (``file_name=<name>/part-*.txt``).

    The text writer ends every row with a line separator; ``read_text_corpus``
    removes exactly that one, so the round trip is exact.
    """
    corpus.select("file_name", "text").repartition("file_name").write.mode("overwrite") \
        .partitionBy("file_name").text(path)


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``file_name, text`` from ``write_text_corpus`` output."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select("file_name", F.regexp_replace("value", "\n$", "").alias("text"))
