"""Inverted multi-index."""

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from veritext.llm import ann, queries


def exact(ids, x, q, k):
    dist = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
    return [(int(ids[i]), dist[i]) for i in np.lexsort((ids, dist)) if ids[i] != q][:k]


def test_recall_and_scores(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = queries.op3_neighbours(spark, SF_SMALL).collect()
    hits = wanted = 0
    for q in ids[ids % 100 == 0]:
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        right = dict(exact(ids, x, q, 10))
        hits, wanted = hits + sum(r.vec_id in right for r in own), wanted + 10
        assert all(abs(r.score - np.sqrt(((x[ids == q][0] - x[ids == r.vec_id][0]) ** 2).sum())) < 1e-12 for r in own)
    assert hits / wanted >= 0.9


def test_odd_vectors_ties_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [1.0, 2.0, 3.0]), (9, [-1.0, 0.0]), (9, [-1.0, 0.0]), (None, [1.0, 1.0]), (100, [0.0, 1.0]), (200, []), (300, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit("x"))
    got = ann.nearest_neighbours(df, F.col("vec_id") % 100 == 0, probed=1.0).collect()
    lists = {q: [(r.vec_id, round(r.score, 6)) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 100)}
    assert {r.query_id for r in got} == {0, 100}
    assert lists[100] == [(1, 0.0), (2, 0.0), (0, 1.414214), (9, 1.414214), (9, 1.414214)]
    assert lists[0] == [(1, 1.414214), (2, 1.414214), (100, 1.414214), (9, 2.0), (9, 2.0)]
    assert ann.nearest_neighbours(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert ann.nearest_neighbours(df.filter("vec_id = 3"), F.col("vec_id") == 3).count() == 0


def test_walk_is_by_summed_distance():
    rng = np.random.default_rng(0)
    a, b, sizes = rng.random(6), rng.random(5), rng.integers(0, 3, 30)
    order = [c for c in sorted(range(30), key=lambda c: a[c // 5] + b[c % 5]) if sizes[c]]
    cells = ann.walk(a, b, sizes, int(sizes.sum()))
    assert cells == order
    assert ann.walk(a, b, sizes, 4) == order[:len(ann.walk(a, b, sizes, 4))]


def test_blocks_split_queries(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    df = spark.createDataFrame([(i, [float(i % 5 + 1), 1.0]) for i in range(60)], "vec_id long, embedding array<double>")
    index = ann.MultiIndex(df)
    got = index.search(index.rows, k=3, probed=1.0).collect()
    assert len(got) == 180 and all(r.score == 0 for r in got)
