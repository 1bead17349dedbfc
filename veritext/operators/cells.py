"""Exact vector top-k that skips cells by the triangle inequality.

The unit vectors of an index are dealt to cells, each around a centre; a cell
is stored in a folder of its own with every row's distance to the centre, and
a small table holds the centres with their smallest and largest distances.
For a query q, no row of a cell is nearer to it than the distances d(q, c) and
d(x, c) to the centre differ, which bounds the cosine from above.

1. A query scores the cells nearest to it until they hold k rows: the k-th
   best score there is a floor of the result.
2. Of the other cells it reads those whose bound reaches the floor, and in
   them the rows whose own distance to the centre allows it.

Centres come from a bounded sample; they decide what is skipped, never the
result, which is that of scoring every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritext.functions.vectors import TopK, round_score
from veritext.operators.retrieve import MATRIX_CELLS, MAX_QUERY_BLOCK, SCORE_CELLS, arrow_type, merge_topk, topk_frame
from veritext.session import stored

SAMPLE = 20_000                 # vectors that the centres are fitted on, about
MOST_CELLS = 4096               # centres are held whole by the driver and every task
ROUNDS = 6
MARGIN = 1e-5                   # more than rounding to 6 decimals and the bounds' own error
PACKED = T.StructType([T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType())),
                       T.StructField("vector", T.ArrayType(T.DoubleType()))])


@dataclass
class Cells:
    """A stored cell index; what the last search skipped is in ``report``."""

    rows: DataFrame
    centres: np.ndarray
    nearest: np.ndarray          # smallest and largest distance to the centre, rows
    farthest: np.ndarray
    sizes: np.ndarray
    id_col: str
    report: dict = field(default_factory=dict)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), "f8").reshape(-1, dims)


def _packed(m: np.ndarray) -> list[pa.Array]:
    """``PACKED`` columns of the rows of ``m``: hashed vectors, which are mostly zeros, as the places
    and values of the others, and fuller ones whole; the shuffle and its sort hold them like this."""
    filled = m != 0
    count = filled.sum(axis=1)
    sparse = 3 * count < 2 * m.shape[1]
    of = lambda sizes, flat, there: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype("i4")), pa.array(flat), mask=pa.array(~there))
    row, place = np.nonzero(filled & sparse[:, None])
    few = np.where(sparse, count, 0)
    return [of(few, place.astype("i4"), sparse), of(few, m[row, place], sparse), of(np.where(sparse, 0, m.shape[1]), m[~sparse].ravel(), ~sparse)]


def _unpacked(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    places, values, whole = (batch.column(f.name) for f in PACKED)
    m = np.zeros((batch.num_rows, dims))
    sparse = np.asarray(places.is_valid().to_numpy(zero_copy_only=False), bool)
    sizes = np.asarray(places.value_lengths().fill_null(0))
    m[np.repeat(np.arange(batch.num_rows), sizes), np.asarray(places.flatten())] = np.asarray(values.flatten(), "f8")
    m[~sparse] = np.asarray(whole.flatten(), "f8").reshape(-1, dims)
    return m


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _slices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts that unpack to ``MATRIX_CELLS`` elements at most."""
    step = max(1, MATRIX_CELLS // max(1, dims))
    for batch in batches:
        for a in range(0, batch.num_rows, step):
            yield batch.slice(a, step)


def fit_centres(sample: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """``n`` centres at most, by a few rounds of k-means."""
    points = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(n, len(points)), replace=False)]
    for _ in range(ROUNDS):
        own = _nearest(sample, centres)
        for c in np.unique(own):
            centres[c] = sample[own == c].mean(axis=0)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (centres ** 2).sum(axis=1)
    step = max(1, SCORE_CELLS // max(1, len(centres)))
    return np.concatenate([(square - 2 * points[a:a + step] @ centres.T).argmin(axis=1) for a in range(0, len(points), step)]) if len(points) else np.zeros(0, "i8")


def build_cells(index: DataFrame, path: str, id_col: str = "id", vec: str = "embedding", n_cells: int | None = None, sample: int = SAMPLE) -> None:
    """Write the cells of all rows of ``index`` whose vectors have the usual size and a norm."""
    usable = F.col(vec).isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x)) & F.exists(vec, lambda x: x != 0)
    sizes = index.filter(usable).groupBy(F.size(vec).alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").limit(1).collect()
    dims, n = (sizes[0]["dims"], sizes[0]["n"]) if sizes else (1, 0)
    rows = index.filter(usable & (F.size(vec) == dims)).select(id_col, F.col(vec).cast("array<double>").alias("vector"))
    held = rows.sample(min(1.0, sample / max(1, n)), seed=5).select("vector").toArrow()["vector"].combine_chunks()
    held = _unit(_matrix(held, dims)) if len(held) else np.eye(1, dims)
    centres = fit_centres(held, max(1, min(MOST_CELLS, int(n ** 0.5) if n_cells is None else n_cells)))
    shared = index.sparkSession.sparkContext.broadcast(centres)
    out = T.StructType([index.schema[id_col], *PACKED, T.StructField("cell", T.IntegerType()), T.StructField("distance", T.DoubleType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, dims):
            m = _matrix(part.column("vector"), dims)
            unit = _unit(m)
            cell = _nearest(unit, shared.value)
            distance = np.linalg.norm(unit - shared.value[cell], axis=1)
            yield pa.RecordBatch.from_arrays([part.column(id_col), *_packed(m), pa.array(cell.astype("i4")), pa.array(distance)], names=out.names)

    # a cell that holds a large share of all rows is cut by distance and id
    dealt = rows.mapInArrow(assign, out).repartitionByRange("cell", "distance", id_col).sortWithinPartitions("cell", "distance")
    dealt.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    schema = T.StructType([f for f in out if f.name != "cell"] + [out["cell"]])
    written = index.sparkSession.read.schema(schema).parquet(f"{path}/rows")
    per = {r["cell"]: r for r in written.groupBy("cell").agg(F.min("distance").alias("a"), F.max("distance").alias("b"), F.count("*").alias("n")).collect()}
    table = [(c, centres[c].tolist(), r["a"], r["b"], r["n"], id_col) for c, r in sorted(per.items())]                       # MOST_CELLS at most
    index.sparkSession.createDataFrame(table, "cell int, centre array<double>, nearest double, farthest double, n long, id_col string").write.mode("overwrite").parquet(f"{path}/cells")


def open_cells(spark: SparkSession, path: str, id_col: str = "id") -> Cells:
    table = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r["cell"])
    if not table:
        return Cells(spark.createDataFrame([], f"{id_col} long, places array<int>, values array<double>, vector array<double>, distance double, cell int"), np.zeros((0, 1)), np.zeros(0), np.zeros(0), np.zeros(0), id_col)
    rows = spark.read.parquet(f"{path}/rows")
    column = lambda name: np.array([r[name] for r in table])
    places = np.full(table[-1]["cell"] + 1, -1)
    places[column("cell")] = np.arange(len(table))
    # cells without rows are gone; the others are numbered on
    spread = lambda values, fill: np.where(places[:, None] >= 0, values[places], fill) if values.ndim > 1 else np.where(places >= 0, values[places], fill)
    return Cells(rows, spread(column("centre"), np.inf), spread(column("nearest"), np.inf), spread(column("farthest"), 0.0), spread(column("n"), 0), table[0]["id_col"])


def _score(cells: Cells, wanted: np.ndarray, unit: np.ndarray, near: np.ndarray, floor: np.ndarray, qids: list, k: int, qid: str, qid_type: T.DataType) -> DataFrame:
    """(qid, id, score): the best k rows of each query in the cells of ``wanted`` (queries x cells), per task.

    ``near`` is the queries' distances to the centres, ``floor`` the scores to reach.
    """
    dims, id_col = unit.shape[1], cells.id_col
    read = np.flatnonzero(wanted.any(axis=0))
    shared = cells.rows.sparkSession.sparkContext.broadcast({int(c): (np.flatnonzero(wanted[:, c]), near[wanted[:, c], c]) for c in read})
    queries = cells.rows.sparkSession.sparkContext.broadcast((unit, floor, qids))
    out = T.StructType([T.StructField(qid, qid_type), cells.rows.schema[id_col], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, floor, qids = queries.value
        top = TopK(len(qids), k)
        for batch in _slices(batches, dims):
            cell, ids = batch.column("cell").to_numpy(), np.array(batch.column(id_col).to_pylist(), dtype=object)
            m, distance = _unpacked(batch, dims), batch.column("distance").to_numpy()
            for c in np.unique(cell):
                who, away = shared.value[int(c)]
                mine = np.flatnonzero(cell == c)
                step = max(1, SCORE_CELLS // len(qids))
                for at in range(0, len(mine), step):
                    part = mine[at:at + step]
                    gap = away[None, :] - distance[part][:, None]
                    able = 2 - gap ** 2 / 2 >= floor[who][None, :] - MARGIN
                    some = able.any(axis=1)
                    if some.any():
                        scores = np.full((int(some.sum()), len(qids)), np.nan)
                        scores[:, who] = round_score(_unit(m[part[some]]) @ unit[who].T + 1.0)
                        top.add(ids[part[some]], scores)
        found = topk_frame(list(top.rows()), qids, qid, id_col)
        yield pa.RecordBatch.from_pandas(found, schema=arrow, preserve_index=False)

    arrow = pa.schema([(qid, arrow_type(cells.rows.sparkSession, qid_type)), (id_col, arrow_type(cells.rows.sparkSession, out[1].dataType)), ("score", pa.float64())])
    return cells.rows.filter(F.col("cell").isin([int(c) for c in read])).mapInArrow(run, out)


def cells_topk(cells: Cells, queries: DataFrame, k: int = 50, qid: str = "query_id", qvec: str = "query_vec") -> DataFrame:
    """R2 over a cell index: ``<qid>, rank, <id_col>, score``, the rows that scoring everything gives.

    Queries without a vector, or with one that has no norm, get no rows; one
    of another size than the index is an error.  ``cells.report`` tells how
    many (query, cell) pairs and rows there are and how many were skipped.
    """
    spark, kind = queries.sparkSession, queries.schema[qid].dataType
    empty = T.StructType([T.StructField(qid, kind), T.StructField("rank", T.LongType()), cells.rows.schema[cells.id_col], T.StructField("score", T.DoubleType())])
    asked = stored(queries.select(qid, F.col(qvec).cast("array<double>").alias(qvec)).filter(F.col(qvec).isNotNull()), "cell-queries")
    n = asked.count()
    blocks, parts = -(-n // MAX_QUERY_BLOCK), []
    cells.report = {"pairs": 0, "pairs_read": 0, "rows": 0, "rows_read": 0}
    for b in range(blocks if len(cells.sizes) else 0):
        rows = (asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64(qid), F.lit(blocks)) == b)).collect()               # about MAX_QUERY_BLOCK vectors
        rows = [r for r in rows if np.any(np.asarray(r[1], "f8") != 0)]
        if not rows:
            continue
        if {len(r[1]) for r in rows} != {cells.centres.shape[1]}:
            raise ValueError(f"query vectors of sizes {sorted({len(r[1]) for r in rows})} do not match the index")
        unit, qids = _unit(np.array([r[1] for r in rows], "f8")), [r[0] for r in rows]
        there = cells.sizes > 0
        near = np.full((len(qids), len(there)), np.inf)
        c = cells.centres[there]
        near[:, there] = np.sqrt(np.maximum(0, 1 + (c ** 2).sum(axis=1) - 2 * unit @ c.T))
        least = np.maximum(0, np.maximum(near - cells.farthest, cells.nearest - near))                                       # no row is nearer
        bound = np.where(there, 2 - np.where(there, least, 0) ** 2 / 2, -np.inf)
        # the cells nearest to a query, until they hold k rows
        order = np.argsort(-bound - 1e-9 * np.where(there, -near, -4), axis=1, kind="stable")
        before = np.cumsum(cells.sizes[order], axis=1) - cells.sizes[order]
        first = np.zeros_like(bound, bool)
        np.put_along_axis(first, order, before < k, axis=1)
        first &= there
        low = np.full(len(qids), -np.inf)
        start = stored(_score(cells, first, unit, near, low, qids, k, qid, kind), "cell-first")
        got = merge_topk(start, qid, cells.id_col, k).filter(F.col("rank") == k).select(qid, "score").collect()              # a row a query at most
        place = {q: i for i, q in enumerate(qids)}
        for r in got:
            low[place[r[0]]] = r[1]
        second = there & ~first & (bound >= low[:, None] - MARGIN)
        parts += [start, _score(cells, second, unit, near, low, qids, k, qid, kind)] if second.any() else [start]
        sums = {"pairs": int(there.sum()) * len(qids), "pairs_read": int((first | second).sum()), "rows": int(cells.sizes.sum()) * len(qids),
                "rows_read": int(((first | second) * cells.sizes).sum())}
        cells.report = {key: cells.report[key] + value for key, value in sums.items()}
    if not parts:
        return spark.createDataFrame([], empty)
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return merge_topk(found, qid, cells.id_col, k)
