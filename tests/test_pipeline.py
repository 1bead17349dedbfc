"""End-to-end: driver entry, file sources, streaming loop, index build."""

import os
import tempfile

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from veritext.operators import qlog as QL
from veritext.plans import catalogue
from veritext.plans.qa import QAConfig
from veritext.sources import files as S
from veritext.streaming.questions import answer_stream


def test_entry_schema(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    names = [f.name for f in df.schema.fields]
    assert names == ["question_id", "question", "answer", "chunks", "context", "prompt", "confidence", "pipeline_stats"]
    rows = df.collect()
    assert len(rows) == spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").count()
    for r in rows:
        ranks = [c["rank"] for c in r.chunks]
        assert ranks == list(range(1, len(ranks) + 1))          # contiguous from 1
        assert r.pipeline_stats.final == len(r.chunks) <= 3
        assert len(r.context) <= 4000 + 2


def test_every_query_has_oracle_or_is_listed():
    from veritext.plans import oracle

    no_sql = set(catalogue.queries()) - set(oracle.oracle_sql())
    assert no_sql == {"answer_records"}          # nested; answer_record_digests is its flat form


def test_scan_pages_folder(spark):
    d = tempfile.mkdtemp(prefix="vt-pages-")
    with open(os.path.join(d, "a.html"), "w", encoding="utf-8") as f:
        f.write("<h1>Tytuł</h1><p>x</p>")
    with open(os.path.join(d, "b.HTM"), "wb") as f:
        f.write(b"<h1>B</h1>\xff\xfe")
    with open(os.path.join(d, "c.txt"), "w") as f:
        f.write("not html")
    pages = S.scan_pages(spark, d)
    got = {r.file_name: (r.valid_utf8, r.html) for r in pages.collect()}
    assert set(got) == {"a.html", "b.HTM"}
    assert got["a.html"] == (True, "<h1>Tytuł</h1><p>x</p>") and got["b.HTM"][0] is False
    assert {r.file_name for r in S.scan_pages(spark, d, strict_html_only=True).collect()} == {"a.html"}


def test_chunks_json_round_trip(spark):
    d = tempfile.mkdtemp(prefix="vt-json-")
    rows = [("d1", "Tytuł", "zażółć", "1", None), ("d2", None, "b", None, "2")]
    df = spark.createDataFrame(rows, S.CHUNK_SCHEMA)
    S.write_chunks_json(df, d)
    back = sorted(tuple(r) for r in S.read_chunks_json(spark, d).collect())
    assert back == sorted(rows)
    raw = "".join(open(os.path.join(d, f), encoding="utf-8").read() for f in os.listdir(d) if f.endswith(".json"))
    assert "zażółć" in raw                       # non-ASCII written as is


def test_streaming_answers_and_log(spark):
    base = tempfile.mkdtemp(prefix="vt-stream-")
    qdir, log, ck = (os.path.join(base, x) for x in ("q", "log", "ck"))
    qs = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    qs.limit(5).write.parquet(qdir)          # a few questions arrive as one file
    index = catalogue._chunk_index(spark, SF_SMALL)
    q = answer_stream(spark, qdir, index, log, ck, QAConfig(retrieval_top_k=10, rerank_top_k=3))
    q.awaitTermination(300)
    logged = spark.read.parquet(log)
    assert logged.count() == 5
    m = QL.log_metrics(logged).collect()
    assert all(r.confidence_text.endswith("%") and r.reranking in ("yes", "no") for r in m)
    assert all(r.chunks and r.context and r.pipeline_stats.final == len(r.chunks) for r in logged.collect())   # the whole result
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0     # nothing stays cached


def test_log_append_view_clear(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="vt-log-"), "log")
    records = catalogue.queries()["answer_records"](spark, SF_SMALL).limit(3)
    QL.log_append(QL.log_entries(records, F.lit(1.5)), path)
    QL.log_append(QL.log_entries(records, F.lit(0.25)), path)
    log = spark.read.parquet(path)
    view = QL.log_view(log).collect()
    assert len(view) == 6 and [r.ts for r in view] == sorted((r.ts for r in view), reverse=True)
    assert all(r.header == f"{r.ts:%H:%M:%S} - {r.question[:50]}..." for r in view)
    assert {r.response_time_text for r in QL.log_metrics(log).collect()} == {"1.50s", "0.25s"}
    QL.log_clear(spark, path)
    assert spark.read.parquet(path).count() == 0 and set(spark.read.parquet(path).columns) == set(log.columns)


def test_folder_to_documents(spark):
    d = tempfile.mkdtemp(prefix="vt-folder-")
    for name, body in (("one.html", "<h1>Ustawa</h1><p>tekst</p>"), ("two.htm", "<p>w&oacute;dki</p>"), ("bad.html", " \n")):
        with open(os.path.join(d, name), "w", encoding="utf-8") as f:
            f.write(body)
    from veritext.operators import corpus as C

    pages = S.scan_pages(spark, d)
    docs = {r.doc_id: r for r in C.build_documents(pages).collect()}
    assert set(docs) == {"one", "two"} and docs["two"].text == "wódki"
    assert docs["one"].metadata.source_file == "one.html" and docs["one"].metadata.source_path.endswith("/one.html")
    assert C.report_counts(pages, C.build_documents(pages)).first().asDict() == {"found": 3, "created": 2}


def test_index_is_reused_and_follows_its_input(spark):
    from veritext.plans import index as I

    src = os.path.join(tempfile.mkdtemp(prefix="vt-index-"), "documents.parquet")
    write = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(src)
    load = lambda: I.stored_chunk_index(spark, src, spark.read.parquet(src), 16)
    write([(1, "a b"), (2, "c")])
    first = load()
    I._BUILT.clear()                                    # as another session
    path = I._index_path(spark, src, 16)
    assert I._built(spark, path) and load().count() == first.count() == 2
    write([(1, "a b"), (2, "c"), (3, "d")])
    assert load().count() == 3


def test_checkpoint_folder_is_needed_on_a_cluster(spark, monkeypatch):
    import pytest

    from veritext import session

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
