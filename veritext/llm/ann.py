"""Nearest neighbours through an inverted multi-index.

Vectors are cut into two halves; each half has a codebook of its own (k-means
on a bounded sample), and a cell is a pair of codes.  A query ranks the codes
of either half by distance and walks the pairs in order of their summed
distance with a heap, until the cells met hold the wanted share of all
vectors.  The vectors of those cells are ranked by exact distance.

Queries run in blocks of bounded size that are broadcast; every index
partition scores the rows whose cells a query of the block has met and hands
on its k best a query, so neither a full cell nor many copies of one vector
meet in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritext.llm.shared import stored

#: Vectors that the codebooks are fitted on (expected number), and their rounds of k-means.
SAMPLE_ROWS, ROUNDS = 20_000, 12
#: Codes of a half; cells are their pairs.
CODES = 64
#: Share of all vectors that a query's cells hold at least.
PROBED = 0.5
#: Queries of a block.
QUERY_BLOCK = 4096
#: Parts of the first of two merges of the partitions' best rows.
MERGE_PARTS = 16


def usable(column: str) -> F.Column:
    """Not null, no null or non-finite component, not zero."""
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0)


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """k centres of rows; fewer where there are fewer distinct rows."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(rounds):
        code = nearest(x, centres)
        counts = np.bincount(code, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, code, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None]


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return squared(x, centres).argmin(1)


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
    """Cells (first code * codes + second code) in order of summed distance,
    until they hold ``wanted`` vectors; empty cells are passed over."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, cells, held = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(b) + int(b[j])
        if sizes[cell]:
            cells.append(cell)
            held += int(sizes[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))
    return cells


def best(query: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k nearest, ties to the smaller id."""
    order = np.lexsort((ids, dist, query))
    start = np.flatnonzero(np.r_[True, query[order][1:] != query[order][:-1]])
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    return order[rank < k]


class MultiIndex:
    """The codebooks, the stored index (vec_id, cell, embedding), the cells' sizes."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", codes: int = CODES,
                 sample_rows: int = SAMPLE_ROWS):
        rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
        rows = rows.filter(F.col("vec_id").isNotNull() & usable("embedding"))
        dims = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").head()
        self.dims, total = (dims["d"], dims["count"]) if dims else (2, 0)
        self.total, half = total, max(1, self.dims // 2)
        self.half = half
        rows = rows.filter(F.size("embedding") == self.dims)
        if total:
            sample = rows.select("embedding").sample(min(1.0, sample_rows / total), seed=3).toPandas()["embedding"]
            x = np.array(sample.tolist() or [rows.head()["embedding"]])
            self.books = [kmeans(x[:, :half], codes), kmeans(x[:, half:], codes) if half < self.dims else np.zeros((1, 0))]
        else:
            self.books = [np.zeros((1, half)), np.zeros((1, self.dims - half))]
        books, width = self.books, len(self.books[1])

        @F.pandas_udf("int")
        def cell_of(batch: pd.Series) -> pd.Series:
            x = np.array(batch.tolist()).reshape(len(batch), -1)
            return pd.Series(nearest(x[:, :half], books[0]) * width + nearest(x[:, half:], books[1])) if len(batch) else pd.Series([], dtype="int32")

        self.rows = stored(rows.withColumn("cell", cell_of("embedding")).repartitionByRange("cell", "vec_id")
                           .sortWithinPartitions("cell"), "ann-index")
        self.sizes = np.zeros(len(books[0]) * width, "i8")
        for r in self.rows.groupBy("cell").count().collect():                 # one row a cell
            self.sizes[r["cell"]] = r["count"]

    def blocks(self, queries: DataFrame) -> Iterator[DataFrame]:
        """Queries (vec_id, cell, embedding) in blocks of neighbouring cells."""
        counts = sorted((r["cell"], r["count"]) for r in queries.groupBy("cell").count().collect())   # one row a cell
        cells, held = [], 0
        for cell, n in counts:
            parts = -(-n // QUERY_BLOCK)
            if parts > 1:
                for p in range(2 * parts):
                    yield queries.filter((F.col("cell") == cell) & (F.pmod(F.xxhash64("vec_id"), F.lit(2 * parts)) == p))
                continue
            if held + n > QUERY_BLOCK:
                yield queries.filter(F.col("cell").isin(cells))
                cells, held = [], 0
            cells.append(cell)
            held += n
        if cells:
            yield queries.filter(F.col("cell").isin(cells))

    def search(self, queries: DataFrame, k: int = 10, probed: float = PROBED) -> DataFrame:
        """query_id, rank (from 1), vec_id, score (Euclidean distance) of the k
        nearest found of every query (rows of ``self.rows``), its own vec_id
        apart; ties go to the smaller vec_id."""
        spark, sizes, books, half = self.rows.sparkSession, self.sizes, self.books, self.half
        wanted = max(k + 1, int(np.ceil(probed * self.total)))
        found = None
        def walks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                q = np.array(pdf["embedding"].tolist()).reshape(len(pdf), -1)
                first, second = squared(q[:, :half], books[0]), squared(q[:, half:], books[1])
                met = np.zeros((len(q), len(sizes)), bool)
                for i in range(len(q)):
                    met[i, walk(first[i], second[i], sizes, wanted)] = True
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "embedding": pdf["embedding"], "met": [m.tobytes() for m in np.packbits(met, axis=1)]})

        for block in self.blocks(queries):
            pdf = block.select("vec_id", "embedding").mapInPandas(walks, "vec_id long, embedding array<double>, met binary").toPandas()
            if pdf.empty:                                                     # QUERY_BLOCK rows at about most
                continue
            met = np.unpackbits(np.frombuffer(b"".join(pdf["met"]), "u1").reshape(len(pdf), -1), axis=1)
            by_cell = {int(c): np.flatnonzero(met[:, c]) for c in np.flatnonzero(met.any(axis=0))}
            sent = spark.sparkContext.broadcast((pdf["vec_id"].to_numpy(), np.array(pdf["embedding"].tolist()), by_cell))

            def score(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
                own, q, by_cell = sent.value
                held = (np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0))
                for pdf in batches:
                    for cell, rows in pdf.groupby("cell"):
                        if cell not in by_cell:
                            continue
                        asks, x, ids = by_cell[cell], np.array(rows["embedding"].tolist()), rows["vec_id"].to_numpy()
                        step = max(1, 1_000_000 // x[0].size)                 # pairs at a time
                        for at in range(0, len(x), max(1, step // len(asks))):
                            part, part_ids = x[at:at + max(1, step // len(asks))], ids[at:at + max(1, step // len(asks))]
                            dist = np.sqrt(((part[:, None, :] - q[asks][None]) ** 2).sum(-1))
                            a, b = np.broadcast_to(asks, dist.shape).ravel(), np.repeat(part_ids, len(asks))
                            other = b != own[a]
                            held = tuple(np.concatenate(h) for h in zip(held, (a[other], b[other], dist.ravel()[other]), strict=True))
                            if len(held[0]) > 2_000_000:
                                keep = best(*held, k)
                                held = tuple(h[keep] for h in held)
                if len(held[0]):
                    keep = best(*held, k)
                    yield pd.DataFrame({"query_id": own[held[0][keep]], "vec_id": held[1][keep], "score": held[2][keep]})

            part = self.rows.filter(F.col("cell").between(min(by_cell), max(by_cell))).mapInPandas(score, "query_id long, vec_id long, score double")
            found = part if found is None else found.unionByName(part)
        if found is None:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        order = ["score", "vec_id"]
        part = F.pmod(F.xxhash64("vec_id"), F.lit(MERGE_PARTS))
        found = found.withColumn("part", part)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order))).filter(F.col("rank") <= k)
        return (found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
                .filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def nearest_neighbours(vectors: DataFrame, is_query: F.Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10,
                       codes: int = CODES, probed: float = PROBED) -> DataFrame:
    """The k nearest found of the rows for which ``is_query`` (on ``vec_id``)
    holds, among all rows but those of the query's own id.

    Vectors that are null, zero, of another length than most, or hold a null
    or non-finite component take no part, nor do rows without id.  Rows that
    repeat an id are each a candidate and, as queries, give a result each.
    Fewer candidates than k: all.  An empty table gives no rows; further
    columns are left out.
    """
    index = MultiIndex(vectors, id_col, vector_col, codes)
    return index.search(index.rows.filter(is_query), k, probed)
