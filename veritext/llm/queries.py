"""The operators' queries on the driver tables, and their SQL where SQL can
express them.  Each query applies its operator with production parameters to
the whole table and derives the digest columns from what the operator gives.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.llm import ann, fingerprints, html_text, lexical_scan, lines, mixing, neardup, packing, passages, prefix_trie, quality, token_counts, warc

Query = Callable[[SparkSession, str], DataFrame]

#: The tokenizer of the packing and counting queries, and their limit.
TOKENIZER = "byte_bpe_50k.json"
SEQUENCE_TOKENS = 1024
#: Documents that score less are rejected.
QUALITY_THRESHOLD = 0.5
#: Domains of the labelled table, and the share of all tokens that each is to have.
TARGETS = {"good": 0.96, "good_toxic": 0.01, "poor": 0.02, "poor_toxic": 0.01}
#: The domain that is never used less than it is there.
CLEAN = "good"


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled table as (doc_id, domain)."""
    kind = F.when(F.col("quality") == 1, F.lit("good")).when(F.col("quality") == 0, F.lit("poor"))
    toxic = F.when(F.col("toxic") == 1, F.lit("_toxic")).otherwise("")
    return _table(spark, sf_dir, "labels").select("doc_id", F.concat(kind, toxic).alias("domain"))


def op1_warc(spark, sf_dir):
    base = warc.archive_folder(spark)
    index = warc.write_warc(_table(spark, sf_dir, "pages"), base)
    records = warc.read_warc(index, base)
    broken = F.raise_error(F.concat(F.lit("record read back differs: "), F.col("record_id")))
    return records.select(
        F.expr("try_cast(record_id AS BIGINT)").alias("page_id"), F.col("n_bytes").alias("payload_bytes"),
        F.when(F.col("intact"), F.col("digest")).otherwise(broken).alias("payload_digest"), "record_type",
        F.expr("try_cast(refers_to AS BIGINT)").alias("refers_to"))


def op2_pack(spark, sf_dir):
    packed = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), capacity=SEQUENCE_TOKENS)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op3_neighbours(spark, sf_dir):
    return ann.nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op4_token_counts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.with_token_counts(docs, tokenizer_path())
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens",
                          (F.col("n_tokens") > SEQUENCE_TOKENS).alias("over_limit"))


def op5_quality(spark, sf_dir):
    scored = quality.with_quality(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "quality_score", (F.col("quality_score") >= QUALITY_THRESHOLD).alias("kept"))


def op6_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_main_text(spark, sf_dir):
    pages = html_text.with_main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_mixing(spark, sf_dir):
    rates = mixing.mixing_rates(_table(spark, sf_dir, "documents"), domains(spark, sf_dir), TARGETS, keep=CLEAN)
    shares = [F.coalesce(F.try_element_at("p", F.lit(d)), F.lit(0.0)).alias(f"p_{d}") for d in TARGETS]
    return rates.select("doc_id", "tokens", *shares, "rate")


def op9_lines(spark, sf_dir):
    found = lines.line_components(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "line_no", F.col("keeper_id").alias("keeper_doc_id"), "keeper_line_no", "kept")


def op10_fingerprints(spark, sf_dir):
    found = fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint",
                        "edited_fingerprint", "near_edited", "near_next")


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_ranked(spark, sf_dir):
    return lexical_scan.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


def op13_passages(spark, sf_dir):
    found = passages.without_passages(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def queries() -> dict[str, Query]:
    return {"op1_warc": op1_warc, "op2_pack": op2_pack, "op3_neighbours": op3_neighbours, "op4_token_counts": op4_token_counts,
            "op5_quality": op5_quality, "op6_near_duplicates": op6_near_duplicates, "op7_main_text": op7_main_text,
            "op8_mixing": op8_mixing, "op9_lines": op9_lines,
            "op10_fingerprints": op10_fingerprints, "op11_prefix_trie": op11_prefix_trie, "op12_ranked": op12_ranked, "op13_passages": op13_passages}


#: Bare base32 of a SHA-1: 20 bits at a time, as four characters each.
OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS h FROM p),
f AS (SELECT h, payload_bytes, min(page_id) AS first_id FROM d GROUP BY h, payload_bytes)
SELECT d.page_id, CAST(d.payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(d.h, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS INTEGER)) & 31 AS INTEGER), 1)
    FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN d.page_id = f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id = f.first_id THEN NULL ELSE f.first_id END AS refers_to
FROM d JOIN f ON d.h = f.h AND d.payload_bytes = f.payload_bytes
"""


#: A CRC-32 bit by bit; nodes are lists of turns, and a subtree's nodes have the top's list as their beginning.
OP11_SQL = """
WITH own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
lead AS (
  SELECT conv_id, turns, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END::BIGINT))), 4294967295::BIGINT) % 6 AS h
  FROM own),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(list_slice(b.turns, 1, c.h), []), list_slice(c.turns, c.h + 1, len(c.turns))) AS turns
  FROM lead c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
prefix AS (
  SELECT conv_id, depth, list_slice(turns, 1, depth) AS p, depth = len(turns) AS ends
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM rebuilt)),
node AS (
  SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ends
  FROM prefix GROUP BY p, depth),
linked AS (
  SELECT n.*, up.conv_id AS parent_conv_id, (n.n_convs - 1) * CASE WHEN n.depth > 0 THEN length(n.p[n.depth].text) ELSE 0 END AS gain
  FROM node n LEFT JOIN node up ON up.depth = n.depth - 1 AND up.p = list_slice(n.p, 1, n.depth - 1)),
counted AS (
  SELECT l.*, (SELECT count(*) FROM linked c WHERE c.depth = l.depth + 1 AND list_slice(c.p, 1, l.depth) = l.p) AS n_children FROM linked l),
below AS (
  SELECT t.conv_id, t.depth, count(*) FILTER (WHERE u.n_children = 0) AS n_leaves, CAST(sum(u.gain) AS BIGINT) AS saved_tokens
  FROM counted t JOIN counted u ON u.depth >= t.depth AND list_slice(u.p, 1, t.depth) = t.p GROUP BY t.conv_id, t.depth)
SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, c.parent_conv_id, c.n_convs, c.n_children, b.n_leaves, b.saved_tokens, sha256(c.ends) AS ends_sha256
FROM counted c JOIN below b ON b.conv_id = c.conv_id AND b.depth = c.depth
"""

OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS nr,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
tf AS (SELECT nr, term, count(*) AS tf FROM (SELECT nr, unnest(terms) AS term FROM words) GROUP BY nr, term),
size AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM words WHERE len(terms) > 0),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w
  FROM tf, size WHERE term IN (SELECT term FROM wanted) GROUP BY term, docs),
norm AS (SELECT nr, doc_id, 100 - 50 + (50 * len(terms) * docs) // total AS m FROM words, size WHERE len(terms) > 0),
scored AS (
  SELECT item_id, doc_id, nr, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM wanted JOIN weight USING (term) JOIN tf USING (term) JOIN norm USING (nr) GROUP BY item_id, doc_id, nr),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS nr, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
w AS (
  SELECT nr, doc_id, place, md5(array_to_string(list_slice(words, place, place + 49), ' ')) AS h
  FROM (SELECT nr, doc_id, words, unnest(range(1, len(words) - 48)) AS place FROM d WHERE doc_id IS NOT NULL AND len(words) >= 50)),
f AS (SELECT h, min(doc_id) AS first_id FROM w GROUP BY h),
gone AS (
  SELECT nr, list(DISTINCT word) AS gone
  FROM (SELECT nr, unnest(range(place, place + 50)) AS word FROM w JOIN f USING (h) WHERE first_id < doc_id) GROUP BY nr),
kept AS (
  SELECT doc_id, words, coalesce(gone, []) AS gone FROM d LEFT JOIN gone USING (nr))
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string([words[i] FOR i IN range(1, len(words) + 1) IF NOT list_contains(gone, i)], ' '), '')) AS kept_sha256
FROM kept
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op11_prefix_trie": OP11_SQL, "op12_ranked": OP12_SQL, "op13_passages": OP13_SQL}
