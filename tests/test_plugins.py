"""Plug points: a custom encoder and a custom rerank scorer; the text-corpus sink."""

import os
import sys
import tempfile

import numpy as np
from pyspark import cloudpickle

from veritext.operators import corpus as C
from veritext.operators import embed as E
from veritext.operators import rerank as RR
from veritext.sources import files as S


class LengthEncoder:
    """Toy model: (length, vowels) of the text, normalised."""

    def __init__(self, dims=2):
        self.dims = dims

    def encode(self, texts):
        m = np.array([[len(t), sum(c in "aeiou" for c in t)] for t in texts], dtype=float)
        return m / np.linalg.norm(m, axis=1, keepdims=True)


class OverlapScorer:
    """Toy model: number of shared characters."""

    def score(self, questions, docs):
        return np.array([len(set(q) & set(d)) for q, d in zip(questions, docs)], dtype=float)


# The toy models below are defined in this test module, which Python workers
# cannot import: ship them by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_custom_encoder(spark):
    df = spark.createDataFrame([(1, "aaa"), (2, "   "), (3, "bcd")], "k long, text string")
    got = {r.k: r.embedding for r in E.embed_texts(df, "text", (LengthEncoder, (2,))).collect()}
    assert got[2] is None
    assert np.allclose(got[1], [1 / np.sqrt(2), 1 / np.sqrt(2)]) and np.allclose(got[3], [1.0, 0.0])


def test_custom_scorer_and_rejected_question(spark):
    pairs = spark.createDataFrame([(1, 1, "abc", "abx"), (1, 2, "abc", "abc"), (2, 1, " ", "abc")],
                                  "question_id long, retrieval_rank long, question string, content string")
    scored = RR.rerank_scores(pairs, scorer=(OverlapScorer, ()))
    got = {(r.question_id, r.retrieval_rank): (r.rerank_score, r.reranked) for r in scored.collect()}
    assert got == {(1, 1): (2.0, True), (1, 2): (3.0, True), (2, 1): (None, False)}
    final = {(r.question_id, r["rank"]): (r.retrieval_rank, r.reranking_used)
             for r in RR.final_chunks(scored, 3).collect()}
    assert final == {(1, 1): (2, True), (1, 2): (1, True), (2, 1): (1, False)}


def test_text_corpus_sink(spark):
    pages = spark.createDataFrame([(1, "<h1>A</h1>one"), (2, "<h1>A</h1>two"), (3, "<h1>B/C</h1>x")],
                                  "page_id long, html string")
    out = tempfile.mkdtemp(prefix="vt-corpus-")
    S.write_text_corpus(C.text_corpus(pages), out)
    names = sorted(d for d in os.listdir(out) if d.startswith("file_name="))
    assert names == ["file_name=A.txt", "file_name=B_C.txt"]
    back = {r.file_name: r.text for r in S.read_text_corpus(spark, out).collect()}
    assert back == {"A.txt": "A\ntwo", "B_C.txt": "B/C\nx"}


class FlakyEncoder:
    """Hashing encoder that yields an all-zero (unusable) vector for texts
    containing 'fail', as a model service that returns nothing would."""

    def __init__(self, dims=256):
        self.dims = dims
        self.inner = E.HashingEncoder(dims)

    def encode(self, texts):
        out = self.inner.encode(texts)
        out[[("fail" in t) for t in texts]] = 0.0
        return out


def test_route_falls_back_to_bm25(spark):
    from pyspark.sql import functions as F

    from tests.conftest import SF_SMALL
    from veritext.plans import catalogue, qa

    index = catalogue._chunk_index(spark, SF_SMALL)
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    qs = bench.select(F.col("item_id").alias("question_id"),
                      F.when(F.col("item_id") == 0, F.concat(F.lit("fail "), F.col("text")))
                      .otherwise(F.col("text")).alias("question"))
    cfg = qa.QAConfig(retrieval_top_k=10, rerank_top_k=3, encoder=(FlakyEncoder, (256,)))
    res = qa.answer(index, qs, cfg, lexical=catalogue._term_tables(spark, SF_SMALL))
    methods = {(r.question_id, r.method) for r in res["retrieved"].select("question_id", "method").distinct().collect()}
    assert (0, "bm25") in methods and (0, "semantic") not in methods
    assert all(m == "semantic" for q, m in methods if q != 0)
    rec = {r.question_id: r for r in res["records"].collect()}
    assert rec[0].pipeline_stats.retrieved == 10 and rec[0].chunks
    # a BM25 hit is labelled by its title, else the constant
    assert all(c.source == "BM25" for c in rec[0].chunks)
