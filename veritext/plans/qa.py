"""Question answering over a chunk index, for a whole batch of questions.

questions -> embed -> route (vector top-K, or BM25 for questions without a
usable vector: R6) -> fetch chunk rows -> rerank -> final top-k ->
context / confidence / stats / prompt -> one record per question.

The retrieval output is small (questions x K rows); it is written once to the
shared folder and joined back to the index, as a broadcast if its size is
within the bound, else by a shuffle.  All later steps are keyed by
question_id, and nothing stays cached.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritext import fixed as FX
from veritext.operators import answer as A
from veritext.operators import embed as E
from veritext.operators import lexical as L
from veritext.operators import rerank as RR
from veritext.operators import retrieve as R
from veritext.operators.postings import postings_topk
from veritext.functions.text import tokens
from veritext.session import side, stored

@dataclass
class QAConfig:
    retrieval_top_k: int = FX.RETRIEVAL_TOP_K
    rerank_top_k: int = FX.RERANK_TOP_K
    max_context_length: int = A.MAX_CONTEXT_CHARS
    use_reranking: bool = True
    fuzzy_fallback: bool = True
    dims: int = E.DEFAULT_DIMS
    encoder: tuple | None = None     # (factory, args) of the question encoder; hashing if None
    scorer: tuple | None = None      # (factory, args) of the reranker; lexical logit if None

    def encoder_spec(self):
        return self.encoder or (E.HashingEncoder, (self.dims,))


def route(index: DataFrame, questions: DataFrame, cfg: QAConfig, lexical=None) -> DataFrame:
    """R2 + R4 + R6: ``question_id, retrieval_rank, chunk_id, retrieval_score, method``.

    ``lexical``: the stored term tables of the index (``plans.index.TermTables``), or what
    gives them and is called if a question needs them; without it the BM25
    fallback scans the index.
    """
    # The encoder runs once.  A vector of another size than the index's is as
    # unusable as none: the semantic search fails and BM25 takes over.
    first = index.select(F.size("embedding").alias("d")).first()
    qv = stored(E.embed_texts(questions, "question", cfg.encoder_spec(), out="query_vec"), "question-vectors")
    qv = E.validate_vectors(qv, "query_vec", first["d"] if first else cfg.dims)
    sem_q = qv.filter("valid").select("question_id", "query_vec")
    sem = R.semantic_topk_batch(index, sem_q, cfg.retrieval_top_k, id_col="chunk_id", qid="question_id")
    sem = sem.select("question_id", F.col("rank").alias("retrieval_rank"), "chunk_id",
                     F.col("score").alias("retrieval_score"), F.lit("semantic").alias("method"))
    rest = qv.filter(~F.col("valid")).select("question_id", "question")
    if not cfg.fuzzy_fallback or rest.isEmpty():
        return sem
    terms = lexical() if callable(lexical) else lexical
    vocab = terms.df if terms is not None else L.vocabulary(index)
    fuzzy = stored(L.fuzzy_terms(L.question_terms(rest), vocab), "fuzzy-terms")
    w = L.query_weights(rest, fuzzy=fuzzy)
    lex = postings_topk(terms.postings, terms.df, w, cfg.retrieval_top_k) if terms is not None else L.bm25_topk(index, w, cfg.retrieval_top_k, id_col="chunk_id")
    lex = lex.select("question_id", F.col("rank").alias("retrieval_rank"), "chunk_id",
                     F.col("score").alias("retrieval_score"), F.lit("bm25").alias("method"))
    return sem.unionByName(lex)


def retrieve(index: DataFrame, questions: DataFrame, cfg: QAConfig, lexical=None) -> DataFrame:
    """Retrieved rows with content and source label."""
    hits = side(stored(route(index, questions, cfg, lexical), "hits"), row_bytes=200)
    rows = index.select("chunk_id", "text", "title", "article", "paragraph", "id").join(hits, "chunk_id")
    src = F.when(F.col("method") == "bm25", R.bm25_source_label("title")).otherwise(R.source_label())
    return rows.select("question_id", "retrieval_rank", "chunk_id", F.col("text").alias("content"),
                       src.alias("source"), "retrieval_score", "method")


def answer(index: DataFrame, questions: DataFrame, cfg: QAConfig | None = None,
           lexical=None) -> dict[str, DataFrame]:
    """All stages of the answer pipeline, by name."""
    cfg = cfg or QAConfig()
    retrieved = stored(retrieve(index, questions, cfg, lexical), "retrieved")
    qtok = questions.select("question_id", "question",
                            F.array_distinct(tokens(F.col("question"))).alias("q_tokens"))
    pairs = retrieved.join(qtok, "question_id")       # question tokens derived once per question
    if cfg.use_reranking:
        scored = RR.rerank_scores(pairs, scorer=cfg.scorer)
        scored = scored if cfg.scorer is None else stored(scored, "scored")       # a model runs once
    else:
        scored = pairs.drop("q_tokens").withColumn("rerank_score", F.lit(None).cast("double"))
    final = stored(RR.final_chunks(scored, cfg.rerank_top_k, cfg.use_reranking), "final")
    records = A.answer_records(questions, retrieved, final, cfg.max_context_length)
    return {"retrieved": retrieved, "scored": scored, "final": final, "records": records}
