"""Plan shape and partitioning properties of the registered queries."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from veritext.operators import corpus as C
from veritext.operators import lexical as L
from veritext.operators import phrases as P
from veritext.sources.tables import phrase_documents, questions


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_pair_products_in_any_query(spark):
    from veritext.plans import catalogue

    for name, q in catalogue.queries().items():
        plan = _plan(q(spark, SF_SMALL))
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name


def test_scans_are_pruned(spark):
    import __spark_entry__ as E

    plan = _plan(E.queries()["phrase_counts"](spark, SF_SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in plan \
        or "ReadSchema: struct<doc_id:bigint,source:string,text:string>" in plan \
        or "ReadSchema: struct<text:string,source:string,doc_id:bigint>" in plan, plan
    assert "lang" not in plan.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_results_do_not_depend_on_partitioning(spark, parts):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").repartition(parts)
    ref = spark.read.parquet(f"{SF_SMALL}/documents.parquet").coalesce(1)

    def phrase(d):
        return sorted(tuple(r) for r in P.phrase_counts(phrase_documents(d), "the of").collect())

    def chunks(d):
        return sorted((r.chunk_id, r.text) for r in C.split_chunks(d).collect())

    def bm25(d):
        ch = C.split_chunks(d)
        qs = questions(spark.read.parquet(f"{SF_SMALL}/benchmark.parquet"))
        return sorted(tuple(r) for r in L.bm25_topk(ch, L.query_weights(qs), 10).collect())

    assert phrase(docs) == phrase(ref)
    assert chunks(docs) == chunks(ref)
    assert bm25(docs) == bm25(ref)


def test_whitespace_normalisation_idempotent(spark):
    from veritext.functions.text import normalize_whitespace

    df = spark.createDataFrame([("a  b\n \t\n\nc   d\ne",), ("x\n\n\n\ny",)], "t string")
    once = df.select(normalize_whitespace("t").alias("t"))
    twice = once.select(normalize_whitespace("t").alias("t"))
    assert once.collect() == twice.collect()


@pytest.mark.parametrize("parts", [1, 5, 13])
def test_ordinal_is_dense_and_ordered(spark, parts):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("g"))
    df = df.repartition(parts)
    got = sorted((r.ordinal, r.k, r.g) for r in C.with_ordinal(df, [F.col("g"), F.col("k")]).collect())
    assert [o for o, _, _ in got] == list(range(1, 1001))
    assert [(g, k) for _, k, g in got] == sorted((g, k) for _, k, g in got)
