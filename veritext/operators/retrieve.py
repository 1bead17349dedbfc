"""Retrieval: exact vector top-k, BM25, fuzzy terms, routing, labels.

Vector search scores every index row (cosine + 1, range 0..2) like the
exhaustive script score it replaces.  One query: a scalar subquery supplies
the vector and ``orderBy(...).limit(k)`` plans as TakeOrderedAndProject (each
partition keeps k rows).  A batch of queries: the query matrix is broadcast
(row count checked, blocks beyond the bound), every index partition scores
its Arrow batches with one matrix product and keeps only k rows per query,
and a ``row_number`` window (planned as WindowGroupLimit) merges them.  No
query x row product is ever materialised as rows.

Scores are rounded to 6 decimals before ranking and ties are broken by the
row id, so the order is total and engine-independent.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritext import fixed as FX
from veritext.functions.vectors import TopK, cosine_plus_one, round_score
from veritext.session import stored

UNKNOWN_SOURCE = FX.UNKNOWN_SOURCE
BM25_SOURCE = FX.BM25_SOURCE
MAX_QUERY_BLOCK = 2048               # queries broadcast to the index per pass
MERGE_PARTS = 64                     # parts of the first of two merges of a query's partition winners
SCORE_CELLS = 4_000_000              # rows x queries scored at once per task
MATRIX_CELLS = 1_000_000             # vector elements that a task unpacks at once


# -------------------------------------------------------------- query vectors

def centroids(df: DataFrame, group: list[str], vec: str = "embedding", out: str = "query_vec") -> DataFrame:
    """Mean vector per group (``group=[]``: one global mean).

    Element sums are partial aggregates keyed by (group, position), so a hot
    group is pre-aggregated on every partition before the shuffle.
    """
    e = df.select(*group, F.posexplode(vec).alias("_i", "_x"))
    per = e.groupBy(*group, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    agg = per.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_i", "_m"))).alias("_v"))
    return agg.select(*group, F.transform("_v", lambda s: s["_m"]).alias(out))


# ------------------------------------------------------------------ R1 / R2

def semantic_topk(index: DataFrame, query: DataFrame, k: int = 50, id_col: str = "id",
                  vec: str = "embedding", qvec: str = "query_vec") -> DataFrame:
    """Top-k rows of ``index`` for the single vector in ``query``.

    ``rank bigint, <id_col>, score double``.
    """
    # The vector arrives as a scalar subquery (evaluated once, no join); it is
    # projected into a column first because subqueries may not sit inside
    # higher-order functions.
    with_q = index.select(id_col, vec, query.select(qvec).scalar().alias("_q"))
    scored = with_q.select(id_col, F.round(cosine_plus_one(F.col(vec), F.col("_q")), 6).alias("score"))
    top = scored.filter(F.col("score").isNotNull()).orderBy(F.col("score").desc(), F.col(id_col)).limit(k)
    w = Window.orderBy(F.col("score").desc(), F.col(id_col))   # over k rows only
    return top.select(F.row_number().over(w).cast("bigint").alias("rank"), id_col, "score")


def arrow_type(spark: SparkSession, kind: T.DataType) -> pa.DataType:
    return spark.createDataFrame([], T.StructType([T.StructField("x", kind)])).toArrow().schema.field(0).type


def topk_frame(rows: list, qids: list, qid_name: str, id_col: str) -> pd.DataFrame:
    """Rows of ``TopK.rows()`` as a frame; plain object columns so that Arrow
    gets one contiguous array per column (not a pandas Arrow-backed string)."""
    return pd.DataFrame({qid_name: pd.Series([qids[q] for q, _, _ in rows], dtype=object),
                         id_col: pd.Series([i for _, i, _ in rows], dtype=object),
                         "score": pd.Series([s for _, _, s in rows], dtype="float64")})


def _block_scores(index: DataFrame, qids: list, qmat: np.ndarray, k: int, id_col: str, vec: str,
                  qid_name: str, qid_type: T.DataType) -> DataFrame:
    sc = index.sparkSession.sparkContext
    norms = np.linalg.norm(qmat, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        qn = np.where(norms > 0, qmat / norms, np.nan)
    bq = sc.broadcast((list(qids), qn))
    id_type = index.schema[id_col].dataType
    schema = T.StructType([T.StructField(qid_name, qid_type), T.StructField(id_col, id_type),
                           T.StructField("score", T.DoubleType())])

    arrow = pa.schema([(f.name, arrow_type(index.sparkSession, f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_q, qm = bq.value
        top = TopK(len(ids_q), k)
        step = max(1, min(SCORE_CELLS // max(1, len(ids_q)), MATRIX_CELLS // max(1, qm.shape[1])))
        for batch in batches:
            for s in range(0, batch.num_rows, step):
                part = batch.slice(s, step)
                part = part.filter(part.column(vec).is_valid())
                if not part.num_rows:
                    continue
                m = np.asarray(part.column(vec).flatten(), "f8").reshape(part.num_rows, -1)
                n = np.linalg.norm(m, axis=1, keepdims=True)
                with np.errstate(invalid="ignore", divide="ignore"):
                    scores = (m / np.where(n > 0, n, np.nan)) @ qm.T + 1.0
                top.add(np.array(part.column(id_col).to_pylist(), dtype=object), round_score(scores))
        yield pa.RecordBatch.from_pandas(topk_frame(list(top.rows()), ids_q, qid_name, id_col), schema=arrow, preserve_index=False)

    return index.select(id_col, vec).mapInArrow(run, schema)


def semantic_topk_batch(index: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "id",
                        vec: str = "embedding", qid: str = "query_id", qvec: str = "query_vec") -> DataFrame:
    """R2: top-k index rows per query vector.  ``<qid>, rank, <id_col>, score``.

    Every vector compared must have the size of the query vectors: a query of
    another size, or an index without a row of that size, is an error (the
    route sends such questions to BM25).  Index rows of another size, which
    E3 rejects, are no candidates.
    """
    qs = stored(queries.select(qid, qvec).filter(F.col(qvec).isNotNull()), "queries")
    n = qs.count()
    qid_type = qs.schema[qid].dataType
    if n == 0:
        return index.sparkSession.createDataFrame([], T.StructType([
            T.StructField(qid, qid_type), T.StructField("rank", T.LongType()),
            T.StructField(id_col, index.schema[id_col].dataType), T.StructField("score", T.DoubleType())]))
    sizes = [x[0] for x in qs.select(F.size(qvec)).distinct().limit(2).collect()]
    index = index.filter(F.size(vec) == sizes[0])
    if len(sizes) > 1 or not index.select(id_col).head(1):          # one partition as a rule, where the vectors are made on the way
        raise ValueError(f"query vectors of sizes {sizes} do not match the index")
    blocks = -(-n // MAX_QUERY_BLOCK)
    parts = []
    for b in range(blocks):
        blk = qs if blocks == 1 else qs.filter(F.pmod(F.xxhash64(qid), F.lit(blocks)) == b)
        rows = blk.collect()        # at most ~MAX_QUERY_BLOCK vectors (checked above)
        if not rows:
            continue
        qmat = np.array([np.asarray(r[1], dtype=np.float64) for r in rows])
        parts.append(_block_scores(index, [r[0] for r in rows], qmat, k, id_col, vec, qid, qid_type))
    return merge_topk(reduce(DataFrame.unionByName, parts), qid, id_col, k)


def merge_topk(local: DataFrame, qid: str, id_col: str, k: int) -> DataFrame:
    """The k best rows per query of the partitions' winners, on two levels.

    Every index partition hands on k rows a query.  They first compete in
    ``MERGE_PARTS`` parts a query, so the last window of a query never holds
    more than ``MERGE_PARTS`` x k rows, however many partitions there are.
    """
    order = [F.col("score").desc(), F.col(id_col)]
    part = local.withColumn("_part", F.pmod(F.xxhash64(id_col), F.lit(MERGE_PARTS)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy(qid, "_part").orderBy(*order))).filter(F.col("rank") <= k)
    best = part.withColumn("rank", F.row_number().over(Window.partitionBy(qid).orderBy(*order)).cast("bigint"))
    return best.filter(F.col("rank") <= k).select(qid, "rank", id_col, "score")


# ----------------------------------------------------------------------- R3

def _present(c: Column) -> Column:
    return c.isNotNull() & (c.cast("string") != "")


def source_label(article="article", paragraph="paragraph", id_col="id") -> Column:
    """``art. A - § P - id`` from the parts present; a constant if none."""
    a, p, i = (F.col(x) if isinstance(x, str) else x for x in (article, paragraph, id_col))
    parts = F.concat_ws(FX.LABEL_JOINER, F.when(_present(a), F.concat(F.lit(FX.ARTICLE_PREFIX), a.cast("string"))),
                        F.when(_present(p), F.concat(F.lit(FX.PARAGRAPH_PREFIX), p.cast("string"))),
                        F.when(_present(i), i.cast("string")))
    return F.coalesce(F.nullif(parts, F.lit("")), F.lit(UNKNOWN_SOURCE))


def bm25_source_label(title="title") -> Column:
    """BM25 hits are labelled by their title (even ``''``), else a constant."""
    t = F.col(title) if isinstance(title, str) else title
    return F.coalesce(t, F.lit(BM25_SOURCE))
