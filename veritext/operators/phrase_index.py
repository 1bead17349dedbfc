"""Phrase search over a stored positional index (P1-P4 for a batch).

Layout
------
* ``texts``: the documents under numbers of their own, in folders by ``part``
  of the number, so that counting reads the folders of candidates only.
* ``positions``: one row per token occurrence (term, document, place), in
  folders by a bucket of the term and sorted by term, document, place.  A
  frequent term is many rows and never one list, so its folder is written and
  read by as many tasks as its size asks for.
* ``terms``: occurrences of every term.

Query
-----
A phrase starts at the occurrences of its rarest term: each gives a document
and a place where the phrase would begin.  Each such start asks for one exact
row (term, document, place) of the next rarest term, and what is left asks so
for all remaining terms at once; a start is a candidate if every term answers.
A frequent term is thus looked up and never listed.  The occurrences are then
counted in the candidates' texts as the scan does (``phrases``), with the same
result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritext.functions.text import py_strip, tokens
from veritext.operators.phrases import report_name, substring_count
from veritext.session import side, stored

BUCKETS = 64                    # folders of terms
PART_DOCS, LEAST_PARTS, MOST_PARTS = 20_000, 16, 4096   # documents of a folder of texts, about; folders


@dataclass
class PhraseIndex:
    texts: DataFrame            # doc, filename, content, part
    positions: DataFrame        # term, doc, pos, bucket
    terms: DataFrame            # term, n
    parts: int


def _bucket(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _part(doc: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(parts)).cast("int")


def build_phrase_index(docs: DataFrame, path: str, filename: str = "filename", content: str = "content") -> None:
    """Write the index of ``docs`` below ``path``.

    Null texts hold no phrase and are left out; repeated rows are documents of
    their own.  Folders are rebalanced, not hashed to one task each: those of
    frequent terms are split by size.
    """
    spark = docs.sparkSession
    numbered = stored(docs.select(F.monotonically_increasing_id().alias("doc"), F.col(filename).alias("filename"),
                                  F.col(content).alias("content")).filter(F.col("content").isNotNull()), "phrase-docs")
    parts = min(MOST_PARTS, max(LEAST_PARTS, -(-numbered.count() // PART_DOCS)))
    (numbered.withColumn("part", _part("doc", parts)).hint("rebalance", F.col("part")).sortWithinPartitions("part", "doc")
     .write.mode("overwrite").partitionBy("part").parquet(f"{path}/texts"))
    places = numbered.select("doc", F.posexplode(tokens(F.lower("content"))).alias("pos", "term"))
    (places.withColumn("bucket", _bucket("term")).hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term", "doc", "pos")
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/positions"))
    rows = spark.read.schema("term string, doc long, pos int, bucket int").parquet(f"{path}/positions")
    rows.groupBy("term").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/terms")
    spark.range(1).select(F.lit(parts).alias("parts")).write.mode("overwrite").parquet(f"{path}/layout")


def open_phrase_index(spark: SparkSession, path: str) -> PhraseIndex:
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
    return PhraseIndex(read("texts", "doc long, filename string, content string, part int"),
                       read("positions", "term string, doc long, pos int, bucket int"), read("terms", "term string, n long"),
                       read("layout", "parts int").first()[0])


def _rows_of(index: PhraseIndex, wanted: DataFrame) -> DataFrame:
    """The positions in the folders of the wanted terms; the list has at most ``BUCKETS`` entries."""
    buckets = sorted(r[0] for r in wanted.select(_bucket("term")).distinct().collect())
    return index.positions.filter(F.col("bucket").isin(buckets)).drop("bucket")


def _answered(index: PhraseIndex, starts: DataFrame, words: DataFrame) -> DataFrame:
    """(no, doc, start): the starts at which all of ``words`` (no, term, offset, asked: how many of the phrase) stand."""
    asked = stored(starts.join(side(words), "no").withColumn("pos", F.col("start") + F.col("offset")), "phrase-asked")
    found = _rows_of(index, words).join(side(asked), ["term", "doc", "pos"])
    return found.groupBy("no", "doc", "start").agg(F.count(F.lit(1)).alias("n"), F.first("asked").alias("asked")).filter("n = asked").select("no", "doc", "start")


def phrase_candidates(index: PhraseIndex, phrases: DataFrame) -> DataFrame:
    """(no, doc): the documents that hold all tokens of a phrase (no, p_tok) as neighbours."""
    words = phrases.select("no", F.size("p_tok").alias("size"), F.posexplode("p_tok").alias("offset", "term"))
    known = words.join(index.terms, "term", "left")
    rarest = Window.partitionBy("no").orderBy("n", "offset")
    words = stored(known.withColumn("rank", F.row_number().over(rarest)), "phrase-words")
    missing = words.filter("n is null").select("no").distinct()
    words = stored(words.join(missing, "no", "left_anti"), "phrase-words")

    first = words.filter("rank = 1").select("no", "term", "offset", "size")
    starts = _rows_of(index, first).join(side(first), "term").select("no", "doc", (F.col("pos") - F.col("offset")).alias("start"), "size").filter("start >= 0")
    starts = stored(starts, "phrase-starts")
    done = starts.filter("size = 1").select("no", "doc")
    second = words.filter("rank = 2").select("no", "term", "offset", F.lit(1).alias("asked"))
    left = stored(_answered(index, starts.filter("size > 1").drop("size"), second), "phrase-starts")
    rest = words.filter("rank > 2").select("no", "term", "offset", (F.col("size") - 2).alias("asked"))
    pairs = words.filter("size = 2").select("no").distinct()
    return done.union(left.join(pairs, "no", "left_semi").select("no", "doc")).union(_answered(index, left, rest).select("no", "doc")).distinct()


def phrase_counts_indexed(index: PhraseIndex, phrases: DataFrame, phrase_id: str = "phrase_id", phrase: str = "phrase") -> DataFrame:
    """P4 over the index: ``phrase_id, document, count``, as ``phrases.phrase_counts_batch`` gives them.

    Null and blank phrases, and those without a token, give no rows; a
    repeated phrase row gives its rows again.
    """
    ph = phrases.select(F.monotonically_increasing_id().alias("no"), F.col(phrase_id).alias("phrase_id"), F.col(phrase).alias("phrase"))
    ph = ph.filter(py_strip("phrase") != "").withColumn("p_tok", tokens(F.col("phrase"))).filter(F.size("p_tok") > 0)
    ph = stored(ph.withColumn("p_lc", F.lower("phrase")).drop("phrase"), "phrases")
    hits = stored(phrase_candidates(index, ph.select("no", "p_tok")), "phrase-hits")
    parts = sorted(r[0] for r in hits.select(_part("doc", index.parts)).distinct().collect())      # at most MOST_PARTS
    texts = index.texts.filter(F.col("part").isin(parts)).select("doc", "filename", F.lower("content").alias("lc"))
    counted = (texts.join(side(hits), "doc").join(ph.select("no", "phrase_id", "p_lc"), "no")
               .select("phrase_id", report_name(F.col("filename")).alias("document"), substring_count(F.col("lc"), F.col("p_lc")).alias("count")))
    return counted.filter(F.col("count") > 0)
