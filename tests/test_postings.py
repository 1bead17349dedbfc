"""BM25 over postings: the rows of a full scan, from the files of the question's terms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritext.operators import lexical as L
from veritext.operators import postings as P


@pytest.fixture(scope="module")
def words():
    """A skewed vocabulary: few words in nearly every chunk, most in a few."""
    rng = random.Random(11)
    return lambda n: " ".join(f"w{int(rng.paretovariate(0.35)) % 900}" for _ in range(n))


@pytest.fixture(scope="module")
def store(spark, words, tmp_path_factory):
    texts = [(f"c{i:05d}", words(5 + i % 60)) for i in range(3000)] + [("empty", ""), ("null", None)] + [(f"same{i}", "w1 w2 w777") for i in range(80)]
    index = L.with_term_counts(spark.createDataFrame(texts, "chunk_id string, text string").withColumn("text", F.coalesce("text", F.lit("")))).cache()
    stats, df = L.term_stats(index)
    path = str(tmp_path_factory.mktemp("lists"))
    P.build_postings(index, path, stats)
    return index, stats, df.cache(), P.open_postings(spark, path), path


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("k", [1, 10, 60])
def test_postings_equal_the_scan(spark, store, words, k):
    index, stats, df, lists, _ = store
    questions = [(i, words(3 + i % 20)) for i in range(40)] + [(100, "w1 w2 w777"), (101, "unknown terms"), (102, ""), (103, "w1 w1 w1 w899")]
    weights = L.query_weights(spark.createDataFrame(questions, "question_id long, question string"))
    want = rows(L.bm25_topk(index, weights, k, stored_stats=(stats, df)))
    assert rows(P.postings_topk(lists, df, weights, k)) == want and len(want) > 40
    other = rows(L.bm25_topk(index, weights, k, stored_stats=(stats, df), k1=0.4, b=0.1))
    assert rows(P.postings_topk(lists, df, weights, k, k1=0.4, b=0.1)) == other != want


def test_questions_in_blocks(spark, store, words, monkeypatch):
    _, _, df, lists, _ = store
    weights = L.query_weights(spark.createDataFrame([(i, words(12)) for i in range(9)], "question_id long, question string"))
    want = rows(P.postings_topk(lists, df, weights, 5))
    monkeypatch.setattr(P, "WEIGHT_ROWS", 7)
    assert rows(P.postings_topk(lists, df, weights, 5)) == want
    assert P.postings_topk(lists, df, weights.limit(0), 5).count() == 0


def test_bounds_end_the_lists_early(spark, store):
    """With one rare term the long list is looked up for its chunks only."""
    _, _, _, lists, _ = store
    whole = lists.postings.withColumn("shard", F.lit(0)).filter("term IN ('w1', 'w899', 'w2')")
    table = whole.orderBy(F.desc(F.size("ords"))).dropDuplicates(["term"]).select("term", "shard", "ords", "tfs", "dls", "bounds").toArrow()
    shard = P._Shard(table, P.K1, P.B, P.K1, P.B, lists.avgdl)
    a, e = shard.at["w1"]
    assert e - a > 50
    shard.best([("w1", 1.0, 0.01), ("w2", 1.0, 9.0), ("w899", 1.0, 9.0)], 1)
    assert shard.looked_up < (e - a) / 2 and shard.scanned < len(shard.ords)
    for t, (a, e) in shard.at.items():                          # the bounds hold for every entry
        parts = shard.tf[a:e] / shard.norm[a:e]
        assert (parts <= np.repeat(shard.bounds[t], P.BLOCK)[:e - a] + 1e-15).all()


def scanned_files(df):
    """Files that the scans of a collected frame have read (adaptive execution off)."""
    df.collect()
    leaves, found = df._jdf.queryExecution().executedPlan().collectLeaves(), 0
    for i in range(leaves.size()):
        metric = leaves.apply(i).metrics().get("numFiles")
        found += metric.get().value() if metric.isDefined() else 0
    return found


def test_files_read_follow_the_terms(spark, store):
    _, _, df, lists, _ = store
    one = spark.createDataFrame([("w899",)], "term string")
    some = df.select(F.col("vterm").alias("term")).limit(20)
    bucket = one.select(P.bucket_of("term")).first()[0]
    buckets = [r[0] for r in some.select(P.bucket_of("term")).distinct().collect()]
    files = lambda chosen: lists.postings.filter(F.col("bucket").isin(chosen)).select(F.input_file_name()).distinct().count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        few, many = scanned_files(P.rows_of_terms(lists, one)), scanned_files(P.rows_of_terms(lists, some))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    whole = lists.postings.select(F.input_file_name()).distinct().count()
    assert few == files([bucket]) and many == files(buckets) and few < many < whole


def test_empty_index(spark, tmp_path):
    index = L.with_term_counts(spark.createDataFrame([], "chunk_id string, text string"))
    stats, df = L.term_stats(index)
    P.build_postings(index, str(tmp_path), stats)
    weights = spark.createDataFrame([(1, "a", 1.0)], "question_id long, vterm string, weight double")
    assert P.postings_topk(P.open_postings(spark, str(tmp_path)), df, weights, 5).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_build_shuffles_no_chunks(spark, tmp_path, monkeypatch):
    """Lists are made where the chunks are read; the only shuffles are of sums and of terms."""
    from pyspark.sql import DataFrameWriter

    index = spark.createDataFrame([(f"c{i}", f"a b{i % 7} c{i}") for i in range(500)], "chunk_id string, text string").repartition(3)
    src = str(tmp_path / "index")
    index.write.parquet(src)
    index, plans, real = spark.read.parquet(src), [], DataFrameWriter.parquet
    stats, _ = L.term_stats(index)
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: plans.append(plan_of(self._df)) or real(self, path, *a, **b))
    P.build_postings(index, str(tmp_path / "lists"), stats)
    assert any("MapInArrow" in p for p in plans) and not any("Exchange" in p for p in plans)


def test_repeated_and_missing_ids(spark, tmp_path, monkeypatch):
    """Rows of one id are found each by its own text; rows without id count in the frequencies only."""
    rows_ = [("a", "x y"), ("a", "x z z"), (None, "x y"), ("b", "q"), ("b", "q"), ("c", ""), ("d", "x"), (None, "only")]
    index = spark.createDataFrame(rows_, "chunk_id string, text string").coalesce(1)
    monkeypatch.setattr(P, "SHARD_CHUNKS", 2)
    stats, df = L.term_stats(index)
    P.build_postings(index, str(tmp_path), stats)
    store = P.open_postings(spark, str(tmp_path))
    assert rows(P.document_frequencies(spark, str(tmp_path))) == rows(df)
    assert store.chunks.groupBy("shard").count().agg(F.max("count")).first()[0] <= 2
    weights = spark.createDataFrame([(1, "x", 1.0), (1, "z", 1.0), (2, "q", 1.0), (3, "only", 1.0)], "question_id long, vterm string, weight double")
    known = L.bm25_topk(index.filter("chunk_id IS NOT NULL"), weights, 10, stored_stats=(stats, df))
    found = P.postings_topk(store, df, weights, 10)
    plain = lambda d: rows(d.select("question_id", "chunk_id", "score"))
    assert plain(found) == plain(known) and len(plain(found)) == 5


def test_passes_over_the_parts(spark, store, words, monkeypatch, tmp_path):
    """Several passes give the rows of one, and a pass reads the folders of its parts only."""
    index, stats, df, _, _ = store
    monkeypatch.setattr(P, "SHARD_CHUNKS", 200)
    monkeypatch.setattr(P, "PART_TASKS", 1)
    P.build_postings(index.repartition(6), str(tmp_path), stats)
    lists = P.open_postings(spark, str(tmp_path))
    assert len(P._passes(lists, 1)) > 2 and P._passes(lists, 10_000) == [(0, lists.parts - 1)]
    weights = L.query_weights(spark.createDataFrame([(i, words(9)) for i in range(12)], "question_id long, question string"))
    one = rows(P.postings_topk(lists, df, weights, 7))
    made, real = [], P.stored
    monkeypatch.setattr(P, "_passes", lambda s, cores, f=P._passes: f(s, 1))
    monkeypatch.setattr(P, "stored", lambda d, name: made.append(name) or real(d, name))
    assert rows(P.postings_topk(lists, df, weights, 7)) == one == rows(L.bm25_topk(index, weights, 7, stored_stats=(stats, df)))
    assert made.count("postings-winners") > 2
