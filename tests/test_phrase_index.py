"""Phrase search over the positional index against the scan."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veritext.operators import phrase_index as PI
from veritext.operators import phrases as P


def rows(df):
    return Counter((r.phrase_id, r.document, r["count"]) for r in df.collect())


@pytest.fixture()
def opened(spark, tmp_path):
    def build(data):
        docs = spark.createDataFrame(data, "filename string, content string")
        PI.build_phrase_index(docs, str(tmp_path / "index"))
        return docs, PI.open_phrase_index(spark, str(tmp_path / "index"))
    return build


def test_hard_phrases_equal_the_scan(spark, opened):
    docs, index = opened([("a.txt", "Art. art ART party"), ("b.txt", "Xart"), ("c.txt.txt", "the, of the of"), ("d.txt", "the of the"),
                          ("d.txt", "the of the"), ("e.txt", None), ("f.txt", ""), ("g.txt", "to be or not to be or not to be"), (None, "art")])
    phrases = spark.createDataFrame([(1, "art"), (2, "the of"), (3, " "), (4, None), (5, "to be or not to be"), (6, "..."), (7, "no such art"),
                                     (2, "the of"), (8, "be to"), (None, "ART"), (9, "the the")], "phrase_id long, phrase string")
    assert rows(PI.phrase_counts_indexed(index, phrases)) == rows(P.phrase_counts_batch(docs, phrases))


def test_random_phrases_equal_the_scan(spark, opened):
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice(["a", "a", "a", "b", "b", "c", "dd", "e,", "F"]) for _ in range(n))
    docs, index = opened([(f"{i}.txt", text(rng.randrange(0, 40))) for i in range(120)])
    phrases = spark.createDataFrame([(i, text(rng.randrange(1, 6)).strip(",")) for i in range(80)], "phrase_id long, phrase string")
    right = rows(P.phrase_counts_batch(docs, phrases))
    assert rows(PI.phrase_counts_indexed(index, phrases)) == right and len(right) > 200


def test_empty_tables(spark, opened):
    docs, index = opened([])
    phrases = spark.createDataFrame([(1, "art")], "phrase_id long, phrase string")
    assert PI.phrase_counts_indexed(index, phrases).collect() == []
    assert PI.phrase_counts_indexed(index, phrases.limit(0)).collect() == []


def test_files_read_follow_terms_and_candidates(spark, opened):
    """A frequent first term is not listed, and texts are read in the candidates' folders only."""
    docs, index = opened([(f"{i}.txt", f"the common words and w{i} here") for i in range(400)])
    phrases = spark.createDataFrame([(1, "the common words and w17 here")], "phrase_id long, phrase string")
    assert rows(PI.phrase_counts_indexed(index, phrases)) == Counter({(1, "17", 1): 1})
    ph = phrases.selectExpr("phrase_id as no", "split(phrase, ' ') as p_tok")
    assert [tuple(r) for r in PI.phrase_candidates(index, ph).select("no").collect()] == [(1,)]
    wanted = spark.createDataFrame([("w17",)], "term string")
    files = [r[0] for r in PI._rows_of(index, wanted).select(F.input_file_name()).distinct().collect()]
    assert {f.split("bucket=")[1].split("/")[0] for f in files} == {str(wanted.select(PI._bucket("term")).first()[0])}
