"""What the pipeline's stages must keep, and what repeated rows must not."""

import warnings
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veritext.llm import mixing, queries
from tests.conftest import SF_SMALL


def test_mixing_stage_keeps_clean_documents(spark):
    """Nearly all tokens are clean: no clean document is lost, no other is used more often."""
    domains = queries.domains(spark, SF_SMALL)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    clean = docs.join(domains.filter("domain = 'good'"), "doc_id", "left_semi")
    some = docs.join(domains.filter("domain != 'good'").orderBy("doc_id").limit(2), "doc_id", "left_semi")
    mostly = clean.union(some).select(docs.columns)
    rates = mixing.mixing_rates(mostly, domains, queries.TARGETS, keep=queries.CLEAN).join(domains, "doc_id").collect()
    used = Counter(r.doc_id for r in corpus_pipeline.mixing_stage(spark, mostly, SF_SMALL).collect())
    assert len(rates) > 50
    for r in rates:
        if r.domain == "good" and r.p["good"] > 0.99:
            assert r.rate >= 0.999999 and used[r.doc_id] >= 1
        elif r.domain != "good" and r.p["good"] < 0.01:
            assert r.rate <= 1.000001


def test_rates_of_a_kept_domain(spark):
    rows = [(100, [1.0, 0.0, 0.0])] * 97 + [(100, [0.0, 1.0, 0.0])] * 2 + [(100, [0.0, 0.0, 1.0])]
    table = spark.createDataFrame(rows, "tokens long, p array<double>")
    rates = mixing.fit_rates(table, [0.9, 0.06, 0.04], keep=0)
    assert {r.p.index(1.0): r.rate for r in rates.collect()} == {0: 1.0, 1: 1.0, 2: 1.0}
    got = {r.p.index(1.0): r.rate for r in mixing.fit_rates(table, [0.99, 0.01, 0.0], keep=0).collect()}
    assert got[0] > 1 and abs(got[1] - 0.5) < 1e-3 and got[2] < 1e-3


def test_missed_targets_are_reported(spark):
    """Targets out of reach end the rounds with a warning, or when the misses stay; met ones say nothing."""
    table = spark.createDataFrame([(10, [0.9, 0.1]), (10, [0.8, 0.2])], "tokens long, p array<double>")
    with pytest.warns(UserWarning, match="3 rounds leave a target missed"):
        mixing.fit_rates(table, [0.0, 1.0], rounds=3)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        mixing.fit_rates(table, [0.86, 0.14])


def test_lines_of_rows_that_share_an_id(spark):
    """Masks are built by row, so that lines of one text do not shift those of another."""
    a = "alpha one of the first text\nshared line that both of them have\nbeta three of the first text"
    b = "gamma line of the other text\ndelta line of the other text\nshared line that both of them have\nepsilon line that stays here"
    docs = spark.createDataFrame([(1, a), (1, b), (1, b), (2, "shared line that both of them have\nzeta line on its own here")], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.line_stage(spark, docs, SF_SMALL).collect())
    rest = b.replace("shared line that both of them have\n", "")
    assert got == sorted([(1, a), (1, rest), (1, rest), (2, "zeta line on its own here")])


def test_repeated_rows_are_dropped_once(spark):
    text = " ".join(f"word{i}" for i in range(50))
    other = " ".join(f"term{i}" for i in range(50))
    docs = spark.createDataFrame([(1, text), (1, text), (1, other), (2, text), (3, "a b c"), (None, "x"), (None, "x")], "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_stage(spark, docs, SF_SMALL).collect())
    assert got[(1, text)] == 1 and got[(1, other)] == 1 and got[(3, "a b c")] == 1 and got[(None, "x")] == 2 and got[(2, text)] == 0


def test_rows_of_one_id_are_told_apart_by_their_texts(spark):
    """A row that copies another goes by itself, not with what else has its id."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in ("a", "b", "c"))
    rows = [(0, a, "x"), (1, a, "x"), (1, b, "y"), (2, b, "x"), (2, c, "x"), (2, c, "x"), (None, c, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __near_key string")
    kept = corpus_pipeline.near_stage(spark, docs, SF_SMALL)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(0, a), (1, b), (2, c), (None, c)])
