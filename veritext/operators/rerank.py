"""Reranking (R7-R10): score (question, candidate) pairs, keep the best k.

The scorer is a plug point.  The built-in one is a lexical overlap logit that
runs as column expressions: with ``nq`` distinct question tokens and
``shared`` of them present among the first ``512 - nq`` candidate tokens
(the pair is truncated to 512 tokens), ``score = ln((shared + .5) /
(nq - shared + .5))``.  A model scorer runs through ``mapInPandas`` and is
built once per Python worker.

Ranking is per question over (score desc, retrieval rank asc): a stable sort
of the retrieved list.  Every window here is partitioned by question and
holds at most the retrieval top-K rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritext import fixed as FX
from veritext.functions.text import py_strip, tokens
from veritext.operators.batching import ModelBatches, call_batched

MAX_PAIR_TOKENS = FX.MAX_PAIR_TOKENS


def lexical_logit(question: Column, content: Column, max_tokens: int = MAX_PAIR_TOKENS) -> Column:
    return logit_from_tokens(F.array_distinct(tokens(question)), tokens(content), max_tokens)


def logit_from_tokens(q: Column, doc_tokens: Column, max_tokens: int = MAX_PAIR_TOKENS) -> Column:
    """The built-in logit from distinct question tokens and document tokens."""
    nq = F.size(q)
    d = F.slice(doc_tokens, 1, F.greatest(F.lit(max_tokens) - nq, F.lit(0)))
    shared = F.size(F.array_intersect(q, d))
    return F.log((shared + F.lit(0.5)) / (nq - shared + F.lit(0.5)))


_WORKER_SCORERS: dict = {}


def rerank_scores(pairs: DataFrame, question: str = "question", content: str = "content",
                  scorer=None, out: str = "rerank_score", error: str | None = None, batches: ModelBatches | None = None,
                  profile=None) -> DataFrame:
    """R7 (+R10): adds ``rerank_score``; blank questions get null (not scored).

    ``scorer``: ``None`` for the built-in logit, or ``(factory, args)`` for an
    object with ``score(questions: list[str], docs: list[str]) -> ndarray``.
    A pair that it fails on, or scores NaN, stands alone with a null score and ``reranked`` false;
    ``error`` names a column for the reason.  ``batches`` limits its calls to
    pairs of similar length; ``profile`` is a ResourceProfile for this stage alone.
    """
    ok = F.col(question).isNotNull() & (py_strip(question) != "")
    if scorer is None:
        # Token arrays are projected once (not re-derived inside the score),
        # and the "was scored" flag is a cheap column that later filters use.
        t = pairs.withColumn("reranked", ok)
        if "q_tokens" not in pairs.columns:
            t = t.withColumn("q_tokens", F.array_distinct(tokens(F.col(question))))
        t = t.withColumn("_d", tokens(F.col(content)))
        t = t.withColumn(out, F.when(F.col("reranked"), logit_from_tokens(F.col("q_tokens"), F.col("_d"))))
        return t.drop("_d", "q_tokens")
    fields = [T.StructField(out, T.DoubleType(), True)] + ([T.StructField(error, T.StringType(), True)] if error else [])
    schema = T.StructType([*pairs.schema.fields, *fields, T.StructField("reranked", T.BooleanType(), False)])

    def run(frames):
        sc = _WORKER_SCORERS.get(scorer)
        if sc is None:
            factory, args = scorer
            sc = _WORKER_SCORERS[scorer] = factory(*args)
        call = lambda items: sc.score([q for q, _ in items], [c for _, c in items])
        for pdf in frames:
            ok = (pdf[question].fillna("").str.strip() != "").to_numpy()
            items = list(zip(pdf.loc[ok, question], pdf.loc[ok, content].fillna(""), strict=True))
            lengths = [batches.length(f"{q} {c}") for q, c in items] if batches else []
            scores, errors = call_batched(call, items, lengths, batches)
            vals, why = [None] * len(pdf), [None] * len(pdf)
            for i, v, e in zip(np.flatnonzero(ok), scores, errors, strict=True):
                vals[i], why[i] = None if v is None or np.isnan(v) else float(v), e
            res = pdf.copy()
            res[out] = pd.array(vals, dtype="Float64")
            if error:
                res[error] = pd.Series(why, index=pdf.index, dtype=object)
            res["reranked"] = [v is not None for v in vals]
            yield res

    return pairs.mapInPandas(run, schema, profile=profile)


def rerank_topk(scored: DataFrame, k: int = 3, qid: str = "question_id", rank: str = "retrieval_rank",
                score: str = "rerank_score") -> DataFrame:
    """Best k per question by score, ties in retrieval order; adds ``rank``.

    Questions whose scores are all null (rejected input) are left out here;
    ``final_chunks`` gives them the retrieval-order fallback (R9).
    """
    w = Window.partitionBy(qid).orderBy(F.col(score).desc(), F.col(rank))
    flag = F.col("reranked") if "reranked" in scored.columns else F.col(score).isNotNull()
    return (scored.filter(flag)
            .withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k))


def rerank_fallback(retrieved: DataFrame, k: int = 3, qid: str = "question_id",
                    rank: str = "retrieval_rank") -> DataFrame:
    """First k in retrieval order, no rerank score."""
    return (retrieved.filter(F.col(rank) <= k).withColumn("rank", F.col(rank).cast("bigint"))
            .withColumn("rerank_score", F.lit(None).cast("double")))


def final_chunks(scored: DataFrame, k: int = 3, use_reranking: bool = True, qid: str = "question_id") -> DataFrame:
    """R8 where the question was reranked, R9 elsewhere; adds ``reranking_used``.

    A question with a pair that the scorer failed on (``reranked`` false) was
    not reranked: all of it falls back, as when its one call had failed.
    """
    if not use_reranking:
        return rerank_fallback(scored.drop("rerank_score"), k, qid).withColumn("reranking_used", F.lit(False))
    # One window serves both: a question's scored rows come first, by score;
    # where none was scored, the order is that of retrieval.
    whole = F.min(F.coalesce(F.col("reranked"), F.lit(False))).over(Window.partitionBy(qid)) if "reranked" in scored.columns else None
    rows = scored.withColumn("_scored", F.col("rerank_score").isNotNull() if whole is None else whole)
    best = Window.partitionBy(qid).orderBy(F.col("_scored").desc(), F.when(F.col("_scored"), F.col("rerank_score")).desc_nulls_last(), "retrieval_rank")
    rows = rows.withColumn("rank", F.row_number().over(best).cast("bigint")).withColumn(
        "reranking_used", F.max("_scored").over(Window.partitionBy(qid)))
    kept = (F.col("rank") <= k) & (F.col("_scored") == F.col("reranking_used"))
    return rows.filter(kept).withColumn("rerank_score", F.when(F.col("reranking_used"), F.col("rerank_score"))).drop("_scored")
