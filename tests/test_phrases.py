"""Phrase statistics (FIXTURES.md C15)."""

from veritext.operators import phrases as P


def _docs(spark, rows):
    return spark.createDataFrame(rows, "filename string, content string")


def test_single_phrase_cases(spark):
    docs = _docs(spark, [("a.txt", "Art. art ART party"), ("b.txt", "Xart"), ("c.txt.txt", "the, of the of"),
                         ("d.txt", "the, of"), ("e.txt", "aaaa")])
    art = {r.document: r["count"] for r in P.phrase_counts(docs, "art").collect()}
    assert art == {"a": 4}
    the_of = {r.document: r["count"] for r in P.phrase_counts(docs, "the of").collect()}
    assert the_of == {"c.txt": 1}
    assert P.phrase_counts(docs, "aa").collect() == []
    assert P.phrase_counts(docs, "   ").collect() == []


def test_order_is_count_desc(spark):
    docs = _docs(spark, [("a.txt", "x y x y"), ("b.txt", "x y x y x y"), ("c.txt", "x y")])
    assert [r.document for r in P.phrase_counts(docs, "x y").collect()] == ["b", "a", "c"]


def test_batch_equals_single(spark):
    docs = _docs(spark, [("a.txt", "Art. art ART party"), ("c.txt", "the, of the of"), ("d.txt", "the of the")])
    phrases = spark.createDataFrame([(1, "art"), (2, "the of"), (3, " ")], "phrase_id long, phrase string")
    batch = {(r.phrase_id, r.document): r["count"] for r in P.phrase_counts_batch(docs, phrases).collect()}
    single = {}
    for pid, ph in [(1, "art"), (2, "the of")]:
        for r in P.phrase_counts(docs, ph).collect():
            single[(pid, r.document)] = r["count"]
    assert batch == single
