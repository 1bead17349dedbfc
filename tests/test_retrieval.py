"""Vectors, retrieval, rerank and answer assembly (FIXTURES.md C6-C14, C16, C17)."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL, one
from veritext.functions.vectors import cosine_plus_one
from veritext.operators import answer as A
from veritext.operators import embed as E
from veritext.operators import lexical as L
from veritext.operators import rerank as RR
from veritext.operators import retrieve as R


def test_cosine_plus_one(spark):
    rows = [([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 3.0]), ([1.0, 0.0], [-1.0, 0.0]), ([1.0, 0.0], [1.0, 1.0])]
    got = one(spark, F.round(cosine_plus_one("q", "v"), 6), rows, "q array<double>, v array<double>")
    assert got == [2.0, 1.0, 0.0, 1.707107]


def test_validation_rejects_bad_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [float("nan"), 1.0])],
                               "id long, embedding array<double>")
    got = {r.id: r.reason for r in E.validate_vectors(df, dims=2).collect()}
    assert got == {1: None, 2: "zero_norm", 3: "wrong_dimension", 4: "missing", 5: "null_or_nan"}


def test_embedding_keeps_alignment(spark):
    df = spark.createDataFrame([(1, "a"), (2, "  "), (3, "b")], "k long, text string")
    got = {r.k: r.embedding for r in E.embed_texts(df, "text", (E.HashingEncoder, (16,))).collect()}
    assert got[2] is None and got[1] is not None and got[3] is not None
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-12


def test_distinct_equals_direct(spark):
    df = spark.createDataFrame([(1, "x y"), (2, "x y"), (3, " x y "), (4, "z")], "k long, text string")
    a = {r.k: r.embedding for r in E.embed_texts(df, "text", (E.HashingEncoder, (32,))).collect()}
    b = {r.k: r.embedding for r in E.embed_distinct(df, "text", (E.HashingEncoder, (32,))).collect()}
    assert a == b


def test_block_topk_equals_brute_force(spark):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    qs = R.centroids(emb, ["label"])
    got = {(r.label, r["rank"]): (r.vec_id, r.score)
           for r in R.semantic_topk_batch(emb.repartition(5), qs, 7, id_col="vec_id", qid="label").collect()}
    vecs = {r.vec_id: np.array(r.embedding, dtype=float) for r in emb.collect()}
    for q in qs.collect():
        qv = np.array(q.query_vec)
        sc = sorted(((round(float(v @ qv / (np.linalg.norm(v) * np.linalg.norm(qv))) + 1, 6), i) for i, v in vecs.items()),
                    key=lambda t: (-t[0], t[1]))[:7]
        for rank, (s, i) in enumerate(sc, 1):
            assert got[(q.label, rank)][0] == i
            assert abs(got[(q.label, rank)][1] - s) < 2e-6


def test_single_query_topk(spark):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    r1 = [(r.vec_id, r.score) for r in R.semantic_topk(emb, R.centroids(emb, []), 5, id_col="vec_id").orderBy("rank").collect()]
    one_q = R.centroids(emb, []).withColumn("qid", F.lit(0))
    r2 = [(r.vec_id, r.score) for r in
          R.semantic_topk_batch(emb, one_q, 5, id_col="vec_id", qid="qid").orderBy("rank").collect()]
    assert [v for v, _ in r1] == [v for v, _ in r2]


def test_source_labels(spark):
    rows = [("1", "2", "d1", None), (None, "", "d2", None), (None, None, None, None), (None, None, None, "")]
    df = spark.createDataFrame(rows, "article string, paragraph string, id string, title string")
    assert [r[0] for r in df.select(R.source_label()).collect()] == ["art. 1 - § 2 - d1", "d2", "Nieznane źródło",
                                                                     "Nieznane źródło"]
    assert [r[0] for r in df.select(R.bm25_source_label()).collect()] == ["BM25", "BM25", "BM25", ""]


def test_bm25_fixture(spark):
    idx = spark.createDataFrame([("a", "opłata stanowi dochód"), ("b", "opłata opłata"), ("c", "inny tekst o prawie")],
                                "chunk_id string, text string")
    qs = spark.createDataFrame([(1, "opłata")], "question_id long, question string")
    got = {r.chunk_id: r.score for r in L.bm25_topk(idx, L.query_weights(qs), 10).collect()}
    assert got == {"a": 0.213638, "b": 0.32414}


def _edits(a, b):
    """Damerau-Levenshtein distance (a swap of neighbours is one edit)."""
    last, d = {}, {(-1, -1): len(a) + len(b)}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = len(a) + len(b), i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = len(a) + len(b), j
    for i, ca in enumerate(a, 1):
        seen = 0
        for j, cb in enumerate(b, 1):
            k, m = last.get(cb, 0), seen
            if ca == cb:
                seen = j
            d[i, j] = min(d[i - 1, j - 1] + (ca != cb), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[ca] = i
    return d[len(a), len(b)]


def test_fuzzy_terms_brute_force(spark):
    vocab_words = ["ustawa", "ustawy", "ustwaa", "kitten", "sitting", "kot", "kat", "ko", "koty", "prawo", "prawa",
                   "opłata", "opłaty", "oplata", "x", "ab"]
    q_words = ["ustawa", "kitten", "kot", "ko", "opłata", "ab"]
    vocab = spark.createDataFrame([(w,) for w in vocab_words], "vterm string")
    qt = spark.createDataFrame([(1, w, 1) for w in q_words], "question_id long, term string, n long")
    got = {(r.term, r.vterm): r.edits for r in L.fuzzy_terms(qt, vocab).collect()}

    def k(w):
        return 0 if len(w) <= 2 else 1 if len(w) <= 5 else 2
    want = {(t, v): _edits(t, v) for t in q_words for v in vocab_words if _edits(t, v) <= k(t)}
    assert got == want
    assert got[("ustawa", "ustwaa")] == 1                     # a swap is one edit
    assert ("kitten", "sitting") not in got


def test_fuzzy_random_terms_brute_force(spark):
    import random

    rng = random.Random(2)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 26))) for _ in range(120)}
    for w in list(words):
        for _ in range(4):
            x = list(w)
            for _ in range(rng.randrange(1, 4)):
                i = rng.randrange(len(x)) if x else 0
                kind = rng.randrange(4)
                if kind == 0:
                    x.insert(i, rng.choice("abcé"))
                elif x and kind == 1:
                    del x[i]
                elif x and kind == 2:
                    x[i] = rng.choice("abcé")
                elif len(x) > i + 1:
                    x[i], x[i + 1] = x[i + 1], x[i]
            if x:
                words.add("".join(x))
    words |= {"x" * 10_000, "x" * 9_999 + "y"}
    q_words = sorted(words)[::3] + ["x" * 10_000]
    vocab = spark.createDataFrame([(w,) for w in sorted(words)], "vterm string")
    qt = spark.createDataFrame([(1, w, 1) for w in q_words], "question_id long, term string, n long")
    got = {(r.term, r.vterm): r.edits for r in L.fuzzy_terms(qt, vocab).collect()}
    limit = lambda w: 0 if len(w) <= 2 else 1 if len(w) <= 5 else 2
    want = {(t, v): e for t in q_words for v in words if len(v) < 100 and len(t) < 100 and abs(len(t) - len(v)) <= 2 and (e := _edits(t, v)) <= limit(t)}
    assert {p: e for p, e in got.items() if len(p[0]) < 100} == want
    assert got[("x" * 10_000, "x" * 9_999 + "y")] == 1


def test_lexical_logit_values(spark):
    q = "a b c d"
    docs = ["x", "a", "a b", "a b c", "a b c d"]
    got = one(spark, F.round(RR.lexical_logit(F.lit(q), F.col("t")), 6), [(d,) for d in docs], "t string")
    assert got == [-2.197225, -0.847298, 0.0, 0.847298, 2.197225]


def test_rerank_stable_order(spark):
    df = spark.createDataFrame([(1, i + 1, s) for i, s in enumerate([1.0, 2.0, 2.0, 0.0])],
                               "question_id long, retrieval_rank long, rerank_score double")
    top = RR.rerank_topk(df, 3).orderBy("rank").collect()
    assert [r.retrieval_rank - 1 for r in top] == [1, 2, 0]


def test_effective_score_and_confidence(spark):
    df = spark.createDataFrame([(None, 1.5), (0.0, 1.5), (-1.0, 1.5)], "rerank_score double, retrieval_score double")
    assert [r[0] for r in df.select(A.effective_score()).collect()] == [1.5, 1.5, -1.0]

    def conf(scores):
        qs = spark.createDataFrame([(1,)], "question_id long")
        if scores:
            fin = spark.createDataFrame([(1, float(s), None) for s in scores], "question_id long, retrieval_score double, rerank_score double")
        else:
            fin = spark.createDataFrame([], "question_id long, retrieval_score double, rerank_score double")
        v = A.confidence(fin, qs).first().confidence
        return None if v is None else round(v, 6)
    assert conf([2, 1, 0.5]) == 0.583333 and conf([1]) == 1.0 and conf([-1, -2]) == 1.5
    assert conf([0, 1.5]) == 0.5 and conf([]) == 0.0 and conf([0.0]) is None


@pytest.mark.parametrize("limit,kept", [(60, 1), (80, 1), (100, 2), (46, 0)])
def test_context_budget(spark, limit, kept):
    rows = [(1, 1, "art. 1 - § 2 - d1", "alfa beta", 1.5, None), (1, 2, "d2", "x" * 30, 0.25, None),
            (1, 3, "d3", "y", 0.125, None)]
    fin = spark.createDataFrame(rows, "question_id long, rank long, source string, content string, "
                                      "retrieval_score double, rerank_score double")
    frags = {r["rank"]: len(r.fragment) for r in A.fragments(fin).collect()}
    assert frags == {1: 47, 2: 53, 3: 24}
    ctx = A.contexts(fin, spark.createDataFrame([(1,)], "question_id long"), limit).first()
    assert ctx.n_fragments == kept
    if kept == 0:
        assert ctx.context == ""


def test_empty_retrieval_record(spark):
    qs = spark.createDataFrame([(1, "q")], "question_id long, question string")
    empty_r = spark.createDataFrame([], "question_id long, retrieval_rank long, chunk_id string, content string, "
                                        "source string, retrieval_score double, method string")
    empty_f = spark.createDataFrame([], "question_id long, rank long, chunk_id string, content string, source string, "
                                        "retrieval_score double, rerank_score double, reranking_used boolean")
    rec = A.answer_records(qs, empty_r, empty_f).first()
    assert rec.confidence == 0.0 and rec.chunks == [] and rec.answer == "Brak dokumentów"
    assert (rec.pipeline_stats.retrieved, rec.pipeline_stats.final, rec.pipeline_stats.reranking_used) == (0, 0, False)


def test_merge_on_two_levels(spark):
    """Partition winners of many partitions: a question's last window gets at
    most MERGE_PARTS x k rows."""
    k, parts = 3, 1000
    rows = spark.range(parts * k).select((F.col("id") % 2).alias("qid"), F.col("id").alias("vec_id"),
                                         ((F.col("id") * 7919) % 1009).cast("double").alias("score"))
    got = [(r.qid, r["rank"], r.vec_id, r.score) for r in R.merge_topk(rows.repartition(200), "qid", "vec_id", k).collect()]
    want = []
    for q in (0, 1):
        best = sorted(((-(i * 7919 % 1009), i) for i in range(parts * k) if i % 2 == q))[:k]
        want += [(q, n, i, float(-s)) for n, (s, i) in enumerate(best, 1)]
    assert sorted(got) == sorted(want)
    plan = R.merge_topk(rows, "qid", "vec_id", k)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("_part") and plan.count("Window ") == 2


def test_topk_helper_with_ties(monkeypatch):
    from veritext.functions.vectors import TopK

    monkeypatch.setattr(TopK, "HELD", 40)
    rng = np.random.default_rng(3)
    scores = rng.integers(0, 6, (500, 4)).astype(float)
    scores[rng.random((500, 4)) < 0.2] = np.nan
    ids = np.array([f"c{i}" for i in rng.permutation(500)], dtype=object)
    top = TopK(4, 7)
    for at in range(0, 500, 33):
        top.add(ids[at:at + 33], scores[at:at + 33])
    got = sorted(top.rows())
    want = sorted((q, i, s) for q in range(4) for s, i in [(-a, b) for a, b in sorted((-s, i) for s, i in zip(scores[:, q], ids) if s == s)[:7]])
    assert got == want


def test_vectors_of_another_size(spark):
    index = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0]), ("c", [0.0, 1.0])], "chunk_id string, embedding array<double>")
    qs = lambda v: spark.createDataFrame([(1, v)], "query_id long, query_vec array<double>")
    assert [r.chunk_id for r in R.semantic_topk_batch(index, qs([1.0, 0.1]), 5, id_col="chunk_id").collect()] == ["a", "c"]
    with pytest.raises(ValueError, match="do not match"):
        R.semantic_topk_batch(index, qs([1.0, 0.0, 0.0]), 5, id_col="chunk_id")


def test_shared_term_ids_are_told_apart(spark):
    """A chunk term with a query term's id but another string is no match."""
    idx = L.with_term_counts(spark.createDataFrame([("a", "x y"), ("b", "z y")], "chunk_id string, text string"))
    fake = idx.withColumn("term_ids", F.transform("terms", lambda t: F.xxhash64(F.when(t == "z", "x").otherwise(t))))
    stats, _ = L.term_stats(fake)
    df = spark.createDataFrame([("x", 1), ("y", 2), ("z", 1)], "vterm string, df long")
    weights = spark.createDataFrame([(1, "x", 1.0)], "question_id long, vterm string, weight double")
    rows = [(1, "x", 1.0, 0.5)]
    schema = "question_id long, chunk_id string, score double"
    clash = {idx.select(F.xxhash64(F.lit("x"))).first()[0]}
    from pyspark.sql import types as T

    got = L._score_block(fake, rows, 5, "chunk_id", "question_id", T._parse_datatype_string(schema), 2.0, L.K1, L.B, clash)
    assert [r.chunk_id for r in got.collect()] == ["a"]
    assert [r.chunk_id for r in L.bm25_topk(idx, weights, 5, stored_stats=(stats, df)).collect()] == ["a"]


def test_models_run_once(spark, tmp_path):
    """Encoder and scorer see every text once in a batch of questions."""
    from veritext.plans import qa

    class Noting:
        def __init__(self, path):
            self.path, self.dims, self.inner = path, 16, E.HashingEncoder(16)

        def note(self, n):
            with open(self.path, "a") as f:
                f.write("x" * n)

        def encode(self, texts):
            self.note(len(texts))
            return self.inner.encode(texts)

        def score(self, questions, docs):
            self.note(len(docs))
            return np.arange(len(docs), dtype=float)

    import sys
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    docs = spark.createDataFrame([(f"{i}", f"w{i} shared") for i in range(6)], "chunk_id string, text string")
    index = E.embed_texts(docs, "text", (E.HashingEncoder, (16,))).select(
        "*", F.col("chunk_id").alias("id"), *[F.lit(None).cast("string").alias(c) for c in ("title", "article", "paragraph")])
    qs = spark.createDataFrame([(1, "w1 shared"), (2, "w2 shared")], "question_id long, question string")
    enc, sco = str(tmp_path / "enc"), str(tmp_path / "sco")
    cfg = qa.QAConfig(retrieval_top_k=4, rerank_top_k=2, dims=16, encoder=(Noting, (enc,)), scorer=(Noting, (sco,)))
    res = qa.answer(index, qs, cfg)
    res["records"].collect(), res["final"].collect()
    assert len(open(enc).read()) == 2 and len(open(sco).read()) == 8
