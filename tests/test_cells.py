"""Exact top-k by cells: the rows of a full scan, with cells skipped where there are clusters."""

import numpy as np
import pytest

from veritext.operators import cells as C
from veritext.operators import retrieve as R


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def vectors(spark):
    """Tight clusters, a group of copies, and vectors that are no candidates."""
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(12, 16))
    data = [(i, (middle[i % 12] + 0.05 * rng.normal(size=16)).tolist()) for i in range(1500)]
    data += [(2000 + i, middle[3].tolist()) for i in range(700)]
    data += [(5000, None), (5001, [0.0] * 16), (5002, [1.0] * 3), (5003, [float("nan")] * 16)]
    index = spark.createDataFrame(data, "id long, embedding array<double>").repartition(5)
    asked = [(f"q{i}", (middle[i % 12] + 0.02 * rng.normal(size=16)).tolist()) for i in range(20)] + [("zero", [0.0] * 16), ("none", None), ("copy", middle[3].tolist())]
    return index, spark.createDataFrame(asked, "query_id string, query_vec array<double>")


@pytest.mark.parametrize("n_cells, k", [(None, 10), (40, 50), (1, 5), (300, 1000)])
def test_cells_equal_the_scan(spark, vectors, tmp_path, n_cells, k):
    index, queries = vectors
    C.build_cells(index, str(tmp_path), n_cells=n_cells)
    made = C.open_cells(spark, str(tmp_path))
    usable = index.filter("id < 5000")
    assert rows(C.cells_topk(made, queries, k)) == rows(R.semantic_topk_batch(usable, queries, k))
    skipped = 1 - made.report["rows_read"] / made.report["rows"]
    print(f"{made.report} skipped {skipped:.2f} of all rows")
    assert made.report["pairs_read"] <= made.report["pairs"]
    if n_cells == 40:
        assert skipped > 0.5


def test_centres_do_not_change_the_rows(spark, vectors, tmp_path):
    """Centres from a handful of vectors, far from most rows."""
    index, queries = vectors
    C.build_cells(index, str(tmp_path), n_cells=6, sample=8)
    assert rows(C.cells_topk(C.open_cells(spark, str(tmp_path)), queries, 7)) == rows(R.semantic_topk_batch(index.filter("id < 5000"), queries, 7))


def test_wrong_sizes_and_empty_tables(spark, vectors, tmp_path):
    index, queries = vectors
    C.build_cells(index, f"{tmp_path}/a")
    made = C.open_cells(spark, f"{tmp_path}/a")
    with pytest.raises(ValueError, match="do not match"):
        C.cells_topk(made, spark.createDataFrame([("q", [1.0, 2.0])], "query_id string, query_vec array<double>"))
    assert C.cells_topk(made, queries.limit(0)).count() == 0
    C.build_cells(index.limit(0), f"{tmp_path}/b")
    assert C.cells_topk(C.open_cells(spark, f"{tmp_path}/b"), queries).count() == 0
