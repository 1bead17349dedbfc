"""Vector column expressions and the per-partition top-k helper.

Column helpers run in the JVM.  ``TopK`` is the small NumPy helper used inside
``mapInPandas`` tasks: it keeps, per query, the k best (score desc, id asc)
rows seen so far in a partition, so only k rows per query and partition
leave a task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE_DECIMALS = 6


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot(a, b) -> Column:
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_plus_one(a, b) -> Column:
    """Cosine similarity shifted to 0..2 (a zero vector gives null)."""
    return F.try_divide(dot(a, b), norm(a) * norm(b)) + F.lit(1.0)


def round_score(x: np.ndarray) -> np.ndarray:
    """Half-up rounding to SCORE_DECIMALS for non-negative scores."""
    m = 10.0 ** SCORE_DECIMALS
    return np.floor(x * m + 0.5) / m


class TopK:
    """Running top-k per query over (score desc, id asc); exact with ties.

    Candidates below a query's k-th best score so far are dropped as they
    come; the rest is gathered for all queries together and cut back to k a
    query by one sort whenever ``HELD`` candidates have come together.
    """

    HELD = 500_000

    def __init__(self, n_queries: int, k: int):
        self.k, self.n = k, n_queries
        self.floor = np.full(n_queries, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores``: rows x queries, already rounded; nan is no hit."""
        s = np.where(np.isnan(scores), -np.inf, scores)
        floor = self.floor
        if len(s) > self.k:                                   # a block's own k-th best is a floor as well
            floor = np.maximum(floor, np.partition(s, len(s) - self.k, axis=0)[len(s) - self.k])
        row, query = np.nonzero((s >= floor) & (s > -np.inf))
        if len(row):
            self.parts.append((query, ids[row], s[row, query]))
            self.held += len(row)
        if self.held > self.HELD:
            self._cut()

    def _cut(self) -> None:
        if not self.parts:
            return
        query, ids, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((np.unique(ids, return_inverse=True)[1], -score, query))
        query, ids, score = query[order], ids[order], score[order]
        start = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        rank = np.arange(len(query)) - np.repeat(start, np.diff(np.r_[start, len(query)]))
        keep = rank < self.k
        self.floor[query[rank == self.k - 1]] = score[rank == self.k - 1]
        self.parts, self.held = [(query[keep], ids[keep], score[keep])], int(keep.sum())

    def rows(self):
        self._cut()
        for query, ids, score in self.parts:
            for q, i, s in zip(query, ids, score):
                yield int(q), i, float(s)
