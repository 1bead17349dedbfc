"""Model calls of similar length, and pairs that a scorer fails on."""

import random
import sys

import numpy as np
from pyspark import cloudpickle

from veritext.operators import embed as E
from veritext.operators import rerank as RR
from veritext.operators.batching import ModelBatches, call_batched

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Picky:
    """Scores by shared characters; fails on a call that holds the word 'bad', or of more than 8 pairs."""

    def score(self, questions, docs):
        if any("bad" in d for d in docs) or len(docs) > 8:
            raise RuntimeError("no score")
        return np.array([len(set(q) & set(d)) for q, d in zip(questions, docs)], dtype=float)


def padding(calls, lengths):
    padded = sum(len(c) * max(lengths[i] for i in c) for c in calls)
    return 1 - sum(lengths) / padded


def test_calls_cover_rows_once_within_limits_and_waste_little():
    rng = random.Random(2)
    lengths = [max(1, min(512, int(rng.lognormvariate(4, 1)))) for _ in range(5000)]
    limits = ModelBatches(rows=64, padded=4096)
    calls = limits.calls(lengths)
    assert sorted(i for c in calls for i in c) == list(range(5000))
    assert all(len(c) <= 64 and (len(c) == 1 or len(c) * max(lengths[i] for i in c) <= 4096) for c in calls)
    in_order = [range(i, min(i + 32, 5000)) for i in range(0, 5000, 32)]
    assert padding(calls, lengths) < 0.05 and padding(in_order, lengths) > 0.5
    assert limits.calls([]) == [] and [list(c) for c in ModelBatches(padded=4).calls([9])] == [[0]]


def test_results_return_to_their_rows_and_failures_stand_alone():
    calls = []

    def call(items):
        calls.append(len(items))
        if 500 in items:
            raise ValueError("bad row")
        return [2 * x for x in items]

    results, errors = call_batched(call, list(range(1000)), [x % 7 + 1 for x in range(1000)], ModelBatches(rows=1000, padded=10**6))
    assert results == [None if x == 500 else 2 * x for x in range(1000)]
    assert [i for i, e in enumerate(errors) if e] == [500] and len(calls) <= 2 * 10 + 1


def test_question_with_a_failing_pair_falls_back(spark):
    pairs = spark.createDataFrame([(q, r, "abc", "bad" if (q, r) == (2, 2) else "abcdef"[:r] * q) for q in (1, 2, 3) for r in (1, 2, 3)] + [(4, 1, None, "x")],
                                  "question_id long, retrieval_rank long, question string, content string")
    scored = RR.rerank_scores(pairs, scorer=(Picky, ()), error="why", batches=ModelBatches(rows=8)).cache()
    got = {(r.question_id, r.retrieval_rank): (r.rerank_score, r.why) for r in scored.collect()}
    assert got[2, 2] == (None, "RuntimeError: no score") and got[2, 3] == (3.0, None) and got[4, 1] == (None, None)
    final = {(r.question_id, r["rank"]): (r.retrieval_rank, r.rerank_score, r.reranking_used) for r in RR.final_chunks(scored, 2).collect()}
    assert final == {(1, 1): (3, 3.0, True), (1, 2): (2, 2.0, True), (3, 1): (3, 3.0, True), (3, 2): (2, 2.0, True),
                     (2, 1): (1, None, False), (2, 2): (2, None, False), (4, 1): (1, None, False)}


def test_batched_vectors_equal_unbatched(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(0, 40)))) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, text string")
    make = lambda **kw: {r.k: r.embedding for r in E.embed_texts(df, "text", (E.HashingEncoder, (16,)), **kw).collect()}
    assert make(batches=ModelBatches(rows=7, padded=100)) == make()
