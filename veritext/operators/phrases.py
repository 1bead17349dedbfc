"""Phrase statistics (P1-P4): which documents hold a phrase, and how often.

Semantics
---------
* candidate (P1): the phrase's tokens occur as consecutive whole tokens of
  the document, case-insensitively;
* count (P2): non-overlapping, case-insensitive substring occurrences in the
  raw text (so in-word hits count as well); a document is reported only when
  it is a candidate and the count is positive;
* report (P3): one trailing ``.txt`` is removed from the file name, rows are
  ordered by count descending, then name; a blank phrase gives no rows.

Scale
-----
Single phrase: one narrow pass over the corpus; the cheap substring test runs
first, tokenisation only on the documents that pass it.  Batch (P4): the
phrase table is broadcast only under a checked row bound (blocks beyond it);
each document explodes just the few of its tokens that anchor some phrase,
so no document text is shuffled and no document x phrase product is formed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritext.functions.text import py_strip, tokens

# Phrases per block: the block's anchor tokens become one literal array in
# the plan and the phrase rows a broadcast, so both stay small.
MAX_BROADCAST_PHRASES = 10_000


def _padded_tokens(col: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(tokens(col), " "), F.lit(" "))


def substring_count(text_lc: Column, needle_lc: Column) -> Column:
    """Non-overlapping occurrences of ``needle_lc`` in ``text_lc``."""
    return F.try_divide(F.length(text_lc) - F.length(F.replace(text_lc, needle_lc, F.lit(""))),
                        F.length(needle_lc)).cast("bigint")


def report_name(filename: Column) -> Column:
    return F.regexp_replace(filename, r"\.txt$", "")


def phrase_counts(docs: DataFrame, phrase: str, filename: str = "filename",
                  content: str = "content") -> DataFrame:
    """P1-P3 for one phrase: ``document string, count bigint``."""
    if not phrase or not phrase.strip():
        return docs.sparkSession.createDataFrame([], "document string, count bigint")
    p_lc = F.lower(F.lit(phrase))
    p_tok = _padded_tokens(F.lit(phrase))
    lc = F.lower(F.col(content))
    hits = (docs.select(F.col(filename).alias("_fn"), lc.alias("_lc"))
            .filter(F.col("_lc").contains(p_lc))
            .filter(_padded_tokens(F.col("_lc")).contains(p_tok))
            .select(report_name(F.col("_fn")).alias("document"),
                    substring_count(F.col("_lc"), p_lc).alias("count"))
            .filter(F.col("count") > 0))
    return hits.orderBy(F.col("count").desc(), F.col("document"))


def _anchor(tok: Column) -> Column:
    # Longest token of the phrase (first such in order) anchors the lookup:
    # any token would do for correctness, a long one matches fewer documents.
    return F.aggregate(tok, F.lit(""), lambda acc, t: F.when(F.length(t) > F.length(acc), t).otherwise(acc))


def phrase_counts_batch(docs: DataFrame, phrases: DataFrame, phrase_id: str = "phrase_id",
                        phrase: str = "phrase", filename: str = "filename",
                        content: str = "content") -> DataFrame:
    """``phrase_id, document, count`` for a table of phrases."""
    ph = (phrases.select(F.col(phrase_id).alias("phrase_id"), F.col(phrase).alias("phrase"))
          .filter(py_strip("phrase") != "")
          .withColumn("p_lc", F.lower("phrase"))
          .withColumn("p_tok", tokens(F.col("phrase")))
          .filter(F.size("p_tok") > 0)
          .withColumn("anchor", _anchor(F.col("p_tok")))
          .withColumn("p_pad", F.concat(F.lit(" "), F.array_join("p_tok", " "), F.lit(" ")))
          .select("phrase_id", "p_lc", "p_pad", "anchor"))
    n = ph.count()
    if n == 0:
        return docs.sparkSession.createDataFrame([], "phrase_id bigint, document string, count bigint")
    blocks = max(1, -(-n // MAX_BROADCAST_PHRASES))
    if blocks > 1:
        ph = ph.withColumn("_blk", F.pmod(F.xxhash64("phrase_id"), F.lit(blocks)))
    parts = []
    for b in range(blocks):
        blk = ph if blocks == 1 else ph.filter(F.col("_blk") == b).drop("_blk")
        parts.append(_batch_block(docs, blk, filename, content))
    return reduce(DataFrame.unionByName, parts)


def _batch_block(docs: DataFrame, ph: DataFrame, filename: str, content: str) -> DataFrame:
    # The anchor set is at most MAX_BROADCAST_PHRASES strings (checked above).
    anchors = [r[0] for r in ph.select("anchor").distinct().collect()]
    lc = F.lower(F.col(content))
    d = docs.select(F.col(filename).alias("_fn"), lc.alias("_lc"))
    d = d.withColumn("_tok", tokens(F.col("_lc")))
    d = d.withColumn("_hit", F.array_intersect(F.array_distinct("_tok"), F.lit(sorted(anchors))))
    d = d.filter(F.size("_hit") > 0)
    d = d.select("_fn", "_lc", F.concat(F.lit(" "), F.array_join("_tok", " "), F.lit(" ")).alias("_pad"),
                 F.explode("_hit").alias("anchor"))
    j = d.join(F.broadcast(ph), "anchor")
    j = j.filter(F.col("_lc").contains(F.col("p_lc")) & F.col("_pad").contains(F.col("p_pad")))
    return (j.select("phrase_id", report_name(F.col("_fn")).alias("document"),
                     substring_count(F.col("_lc"), F.col("p_lc")).alias("count"))
            .filter(F.col("count") > 0))


def phrase_doc_totals(batch_counts: DataFrame) -> DataFrame:
    """Per phrase: number of documents holding it and total occurrences."""
    return batch_counts.groupBy("phrase_id").agg(F.count(F.lit(1)).alias("n_documents"),
                                                 F.sum("count").alias("total_count"))
