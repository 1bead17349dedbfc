"""JSON array files read by several tasks each (S2, S4 in their array form).

A reader of whole JSON values needs one task a file.  Here the text reader
cuts the files at closing braces, which it does in byte ranges; a closing
brace never follows an escaping backslash, so no escape is cut.  Whether a
piece begins inside a string, and how deep, follows from the pieces before it:
quotes, braces and finished records are summed within a byte range, the
ranges' sums (a row each) are summed along the file, and every piece gets its
state from both.  Pieces that hold a whole record go on at once, those of a
record that is cut (braces in strings, nested objects) are joined by its number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritext.session import side, stored

RANGE = ["file", "start"]


def _outside(text: Column) -> Column:
    """The text without its strings; a string that is not closed reaches to the end."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), r'(?s)"[^"]*+("|$)', "")


def _before(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all earlier pieces of the file as ``name``."""
    rows = rows.withColumn("__value", value)
    along = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(*RANGE).agg(F.sum("__value").alias("__sum"))
    ranges = stored(ranges.select(*RANGE, F.coalesce(F.sum("__sum").over(along), F.lit(0)).alias("__earlier")), "json-ranges")
    within = Window.partitionBy(*RANGE).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("__within", F.coalesce(F.sum("__value").over(within), F.lit(0)))
    return summed.join(side(ranges), RANGE).withColumn(name, F.col("__earlier") + F.col("__within")).drop("__value", "__within", "__earlier")


def json_array_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, record): the text of every object in the arrays, numbered along its file from 0.

    Files may be pretty-printed or on one line.  Elements that are no objects
    give no row, empty files none; a file that ends within a record gives that
    record unfinished.
    """
    raw = spark.read.option("lineSep", "}").text(path)
    pieces = stored(raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                               F.monotonically_increasing_id().alias("piece"), F.col("value").alias("text")), "json-pieces")
    bare = F.regexp_replace("text", r"(?s)\\.", "")
    quotes = pieces.select(*RANGE, "piece", "text", (F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))).cast("long").alias("quotes"))
    told = _before(quotes, F.col("quotes"), "earlier_quotes")
    inside = F.col("earlier_quotes") % 2 == 1
    outside = _outside(F.when(inside, F.concat(F.lit('"'), F.col("text"))).otherwise(F.col("text")))
    opened = (F.length(outside) - F.length(F.replace(outside, F.lit("{"), F.lit("")))).cast("long")
    closes = (F.col("earlier_quotes") + F.col("quotes")) % 2 == 0
    braces = stored(told.select(*RANGE, "piece", opened.alias("opened"), closes.alias("closes")), "json-braces")
    depths = _before(braces, F.col("opened") - F.col("closes").cast("long"), "depth")
    ends = F.col("closes") & (F.col("depth") + F.col("opened") == 1)
    numbered = _before(stored(depths.withColumn("ends", ends), "json-depths"), F.col("ends").cast("long"), "number")
    held = numbered.filter((F.col("depth") > 0) | (F.col("opened") > 0))
    rows = pieces.join(held.select(*RANGE, "piece", "number", ((F.col("depth") == 0) & F.col("ends")).alias("whole")), [*RANGE, "piece"])
    rows = stored(rows, "json-rows")
    begun = lambda text: F.concat(F.regexp_replace(text, r"(?s)^[^{]*+", ""), F.lit("}"))
    whole = rows.filter("whole").select("file", "number", begun(F.col("text")).alias("record"))
    cut = rows.filter(~F.col("whole")).groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("start", "piece", "text"))).alias("parts"))
    return whole.union(cut.select("file", "number", begun(F.array_join(F.transform("parts", lambda p: p["text"]), "}"))))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The objects of JSON array files as rows of ``schema``; a record that
    cannot be parsed is a row of nulls."""
    records = json_array_records(spark, path)
    return records.select(F.from_json("record", schema).alias("r")).select("r.*")


def _as_array(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    first = True
    for batch in batches:
        if len(batch):
            lines = batch["value"].where([first and i == 0 for i in range(len(batch))], "," + batch["value"])
            if first:
                lines.iloc[0] = "[" + lines.iloc[0]
            first = False
            yield pd.DataFrame({"value": lines})
    yield pd.DataFrame({"value": ["[]" if first else "]"]})


def write_json_array(df: DataFrame, path: str) -> None:
    """The rows as JSON arrays of objects, one array a file; null fields are written."""
    lines = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    lines.mapInPandas(_as_array, "value string").write.mode("overwrite").text(path)
