"""Steps whose time, memory or disk must not grow faster than their input."""

import numpy as np
import pyarrow as pa
import pytest

from veritext.operators import cells as C
from veritext.operators import embed as E
from veritext.operators import postings as P
from veritext.operators import retrieve as R
from veritext.plans import index as I
from veritext.plans import qa


def shard_of(lists, chunks):
    """A shard of ``lists`` (term: sorted numbers), counts and lengths of one."""
    size = lambda o: -(-len(o) // P.BLOCK)
    table = pa.table({"term": list(lists), "ords": pa.array([o.tolist() for o in lists.values()], pa.list_(pa.int32())),
                      "tfs": pa.array([[1 + i % 3 for i in o] for o in lists.values()], pa.list_(pa.int32())),
                      "dls": pa.array([[5 + i % 7 for i in o] for o in lists.values()], pa.list_(pa.int32())),
                      "bounds": pa.array([[1.0] * size(o) for o in lists.values()], pa.list_(pa.float64()))})
    return P._Shard(table, P.K1, P.B, P.K1, P.B, 8.0)


def test_many_short_lists_cost_few_passes_over_the_shard(monkeypatch):
    """an expanded question's terms are many, with few chunks each."""
    rng, chunks = np.random.default_rng(3), 5000
    lists = {f"t{i}": np.sort(rng.choice(chunks, 40, replace=False)) for i in range(600)}
    lists |= {f"long{i}": np.sort(rng.choice(chunks, 2500, replace=False)) for i in range(3)}
    terms = [(t, 0.2 + 0.001 * i, 2.0) for i, t in enumerate(lists)]
    shard, passes, real = shard_of(lists, chunks), [], np.partition
    monkeypatch.setattr(np, "partition", lambda a, n: passes.append(len(a)) or real(a, n))
    found, scores = shard.best(terms, 10)
    assert sum(passes) < 10 * sum(map(len, lists.values()))          # before: a pass a term
    want = np.zeros(chunks)
    for t, w, idf in terms:
        a, e = shard.at[t]
        want[shard.ords[a:e]] += w * idf * shard.tf[a:e] / shard.norm[a:e]
    order = np.lexsort((np.arange(chunks), -np.round(want, 6)))[:10]
    assert found.tolist() == order.tolist() and np.allclose(scores, want[order], atol=2e-6)


def test_term_tables_are_built_when_asked_for(spark, tmp_path, monkeypatch):
    """questions with vectors need no postings."""
    src = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(1, "alpha beta\ngamma delta"), (2, "beta gamma")], "doc_id long, text string").write.parquet(src)
    read, built, real = spark.read.parquet(src), [], I.build_term_tables
    monkeypatch.setattr(I, "build_term_tables", lambda *a: built.append(1) or real(*a))
    index = I.stored_chunk_index(spark, src, read, 16)
    lexical = lambda: I.stored_term_tables(spark, src, read, 16)
    cfg = qa.QAConfig(retrieval_top_k=2, dims=16)
    asked = spark.createDataFrame([(1, "beta"), (2, "alpha")], "question_id long, question string")
    assert {r.method for r in qa.route(index, asked, cfg, lexical).collect()} == {"semantic"} and not built
    other = qa.QAConfig(retrieval_top_k=2, dims=16, encoder=(E.HashingEncoder, (8,)))
    assert {r.method for r in qa.route(index, asked, other, lexical).collect()} == {"bm25"} and built == [1]
    lexical()
    assert built == [1]


def test_build_tasks_follow_the_size_of_the_input(spark, tmp_path, monkeypatch):
    """one file, one row group, several tasks."""
    src = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(i, f"word{i} " * 20) for i in range(400)], "doc_id long, text string").coalesce(1).write.parquet(src)
    read = spark.read.parquet(src)
    assert I.in_tasks(spark, src, read).rdd.getNumPartitions() == 1
    monkeypatch.setattr(I, "TASK_BYTES", 500)
    cut = I.in_tasks(spark, src, read)
    assert cut.rdd.getNumPartitions() > 4 and sorted(cut.collect()) == sorted(read.collect())


class Sized:
    """Vectors of the text's own size; notes the most texts of a call."""

    most = 0

    def encode(self, texts):
        Sized.most = max(Sized.most, len(texts))
        return [np.arange(len(t), dtype="f4") for t in texts]


def test_encoder_calls_and_batches_are_bounded():
    """An Arrow batch of texts is encoded in parts, its vectors are held once."""
    texts = ["x" * (i % 5) for i in range(2000)]
    made = E._encoded(Sized(), pa.array(texts), None).to_pylist()
    assert [r["vector"] for r in made] == [list(map(float, range(len(t)))) if t else None for t in texts]
    assert 0 < Sized.most <= E.ENCODE_ROWS and all(r["error"] is None for r in made)


def test_encoder_keeps_a_bounded_vocabulary(monkeypatch):
    monkeypatch.setattr(E, "CACHED_TOKENS", 10)
    few, texts = E.HashingEncoder(64), [f"a{i} b{i} c{i % 3}" for i in range(50)]
    got = few.encode(texts)
    monkeypatch.undo()
    assert len(few._bucket) == 10 and (got == E.HashingEncoder(64).encode(texts)).all()


def test_vectors_are_unpacked_in_parts(spark, monkeypatch):
    """a scan in small parts gives the rows of one in large parts."""
    rng = np.random.default_rng(5)
    data = [(i, rng.normal(size=8).tolist() if i % 9 else None) for i in range(300)]
    index = spark.createDataFrame(data, "id long, embedding array<double>")
    queries = spark.createDataFrame([(q, rng.normal(size=8).tolist()) for q in range(4)], "query_id long, query_vec array<double>")
    rows = lambda: sorted(map(tuple, R.semantic_topk_batch(index, queries, 7).collect()))
    whole = rows()
    monkeypatch.setattr(R, "MATRIX_CELLS", 16)
    assert rows() == whole and len(whole) == 28


@pytest.mark.parametrize("share", [0.05, 1.0])
def test_stored_cells_hold_what_is_not_zero(spark, tmp_path, share):
    """hashed vectors are shuffled, sorted and written without their zeros."""
    rng, dims = np.random.default_rng(6), 64
    m = rng.normal(size=(200, dims)) * (rng.random((200, dims)) < share)
    m[:, 0] = 1.0
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<double>")
    C.build_cells(index, str(tmp_path), n_cells=5)
    made = C.open_cells(spark, str(tmp_path))
    held = made.rows.selectExpr("sum(coalesce(size(places), 0) + coalesce(size(vector), 0))").first()[0]
    assert held == np.count_nonzero(m)
    queries = spark.createDataFrame([(q, m[q].tolist()) for q in range(6)], "query_id long, query_vec array<double>")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(C.cells_topk(made, queries, 9)) == rows(R.semantic_topk_batch(index, queries, 9))


def test_validation_without_lambdas(spark):
    """every reason, as the element-wise conditions give it."""
    nan = float("nan")
    data = [("ok", [0.0, 1.0]), ("negative", [0.0, -1.0]), ("none", None), ("short", [1.0]), ("empty", []), ("nan", [nan, 1.0]), ("nan_zero", [nan, 0.0]),
            ("null", [None, 1.0]), ("null_zero", [None, 0.0]), ("nulls", [None, None]), ("zero", [0.0, 0.0]), ("minus_zero", [-0.0, 0.0]), ("inf", [float("inf"), 0.0])]
    for kind in ("double", "float"):
        df = spark.createDataFrame(data, f"k string, v array<{kind}>")
        got = {r.k: r.reason for r in E.validate_vectors(df, "v", 2).collect()}
        assert got == {"ok": None, "negative": None, "none": "missing", "short": "wrong_dimension", "empty": "wrong_dimension", "nan": "null_or_nan", "nan_zero": "null_or_nan",
                       "null": "null_or_nan", "null_zero": "null_or_nan", "nulls": "null_or_nan", "zero": "zero_norm", "minus_zero": "zero_norm", "inf": None}
    plan = E.validate_vectors(df, "v", 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
