"""Fuzzy term expansion (R5) by Levenshtein automata walked over vocabulary tries.

The vocabulary is sorted and range-partitioned.  A task makes a trie of each
block of its terms, level by level, as arrays, and walks it with the automata
of a block of query terms at once.  An automaton's state is the band of the
edit table around the diagonal, as wide as the edits allowed; the walk holds
one row per (query term, trie node) that is still within them, so a branch
ends as soon as no term below it can match.

Edits are insertions, deletions, replacements and swaps of neighbours; a swap
with one letter put between the two, or taken out from between, is two edits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_EDITS = 2
WIDTH = 2 * MOST_EDITS + 1
FAR = 100                       # more edits than any allowed
QUERY_BLOCK = 50_000            # query terms that are broadcast at once
CELLS = 8_000_000               # characters of a vocabulary block, padded to its longest term
BLOCK_TERMS = 200_000
WALK = 400_000                  # (query term, node) rows that a step holds or makes at once


def _codes(terms: list[str]) -> np.ndarray:
    """terms x length matrix of code points, 0 beyond a term's end."""
    width = max(map(len, terms), default=0)
    return np.array(terms, f"<U{max(1, width)}").view("<u4").reshape(len(terms), -1) if terms else np.zeros((0, 1), "<u4")


class Trie:
    """A trie of sorted distinct terms; the nodes of a level are numbered in the order of the terms."""

    def __init__(self, terms: list[str]):
        codes = _codes(terms)
        length = np.array([len(t) for t in terms])
        self.labels, self.children, self.ends = [], [], []
        node = np.zeros(len(terms), "i8")                       # the node of each term on the level above
        count = 1
        for level in range(codes.shape[1] + 1):
            here = length == level
            end = np.full(count, -1)
            end[node[here]] = np.flatnonzero(here)
            self.ends.append(end)
            deeper = np.flatnonzero(length > level)
            if not len(deeper):
                break
            parent, label = node[deeper], codes[deeper, level]
            first = np.r_[True, (parent[1:] != parent[:-1]) | (label[1:] != label[:-1])]
            number = np.cumsum(first) - 1
            self.labels.append(label[first])
            self.children.append(np.searchsorted(parent[first], np.arange(count + 1)))
            node = np.zeros(len(terms), "i8")
            node[deeper] = number
            count = int(number[-1]) + 1


def _step(codes, length, query, level, rows, last, label):
    """The bands after one more character (``label``) of the vocabulary term.

    Cell d of a band is the edits between the first ``level`` characters there
    and the first ``level + d - MOST_EDITS`` of the query term.  ``rows`` are the
    bands of the three levels before (newest first), ``last`` the two labels before.
    """
    r0, r1, r2 = rows
    n = len(query)
    width = codes.shape[1]
    new = np.full((n, WIDTH), FAR, "i1")
    at = lambda j: np.where((j >= 1) & (j <= length[query]), codes[query, np.clip(j - 1, 0, width - 1)], 0)
    own = [at(np.full(n, level + d - MOST_EDITS)) for d in range(-2, WIDTH)]          # query characters j = level - 4 .. level + 2
    char = lambda d: own[d + 2]
    for d in range(WIDTH):
        j = level + d - MOST_EDITS
        if j < 0:
            continue
        cell = r0[:, d] + (char(d) != label) if j >= 1 else np.full(n, FAR)            # replaced or equal
        if d + 1 < WIDTH:
            cell = np.minimum(cell, r0[:, d + 1] + 1)                                  # one more there
        if d >= 1:
            cell = np.minimum(cell, new[:, d - 1] + 1)                                 # one more in the query term
        if level >= 2 and j >= 2:
            swap = (char(d) == last[0]) & (char(d - 1) == label)
            cell = np.minimum(cell, np.where(swap, r1[:, d] + 1, FAR))
        if level >= 3 and j >= 2 and d + 1 < WIDTH:                                    # one letter between, there
            wide = (char(d) == last[1]) & (char(d - 1) == label)
            cell = np.minimum(cell, np.where(wide, r2[:, d + 1] + 2, FAR))
        if level >= 2 and j >= 3 and d >= 1:                                           # one letter between, in the query term
            wide = (char(d) == last[0]) & (char(d - 2) == label)
            cell = np.minimum(cell, np.where(wide, r1[:, d - 1] + 2, FAR))
        new[:, d] = np.where(j <= length[query], np.minimum(cell, FAR), FAR)
    return new


def walk(trie: Trie, codes: np.ndarray, length: np.ndarray, edits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, term, edits) of all pairs within the edits allowed for the query terms."""
    n = len(length)
    first = np.full((n, WIDTH), FAR, "i1")
    for d in range(MOST_EDITS, WIDTH):
        first[:, d] = np.where(d - MOST_EDITS <= length, d - MOST_EDITS, FAR)
    far, none = np.full((n, WIDTH), FAR, "i1"), np.zeros(n, "<u4")
    todo = [(0, np.arange(n), np.zeros(n, "i8"), (first, far, far), (none, none))]
    while todo:
        level, query, node, rows, last = todo.pop()
        leaf = level == len(trie.labels)
        start, stop = (node, node) if leaf else (trie.children[level][node], trie.children[level][node + 1])
        number = stop - start
        if len(query) > 1 and max(len(query), number.sum()) > WALK:     # depth first, so that little waits
            half = len(query) // 2
            for part in (slice(half, None), slice(0, half)):
                todo.append((level, query[part], node[part], tuple(r[part] for r in rows), tuple(x[part] for x in last)))
            continue
        end = trie.ends[level][node]
        d = length[query] - level + MOST_EDITS
        cost = np.where((d >= 0) & (d < WIDTH), rows[0][np.arange(len(query)), np.clip(d, 0, WIDTH - 1)], FAR)
        hit = (end >= 0) & (cost <= edits[query])
        if hit.any():
            yield query[hit], end[hit], cost[hit]
        if not number.sum():
            continue
        of = np.repeat(np.arange(len(query)), number)
        child = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number) + start[of]
        label, q = trie.labels[level][child], query[of]
        new = _step(codes, length, q, level + 1, tuple(r[of] for r in rows), tuple(x[of] for x in last), label)
        alive = new.min(axis=1) <= edits[q]
        of = of[alive]
        if len(of):
            todo.append((level + 1, q[alive], child[alive], (new[alive], rows[0][of], rows[1][of]), (label[alive], last[0][of])))


def _blocks(terms: list[str]) -> Iterator[list[str]]:
    """Sorted terms in blocks of bounded size; terms much longer than others have blocks of their own."""
    for low, high in ((0, 32), (33, 256), (257, 1 << 31)):
        part = [t for t in terms if low <= len(t) <= high]
        size = max(1, min(BLOCK_TERMS, CELLS // max([1, *map(len, part)])))
        for a in range(0, len(part), size):
            yield part[a:a + size]


def expansions(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, vterm, edits): every vocabulary term (vterm) within the edits ``k`` (0 to 2) of a query term (term, k).

    A pass over the vocabulary serves ``QUERY_BLOCK`` query terms; the driver
    holds one block of them at a time.
    """
    out = T.StructType().add("term", "string").add("vterm", "string").add("edits", "integer")
    spark, found, block = queries.sparkSession, None, []

    def part(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(sorted(block, key=lambda x: (len(x[0]), x[0])))
        longest = max(len(t) for t, _ in block) + MOST_EDITS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            groups = []                                         # of similar length, so that their matrix is no larger than they
            for low, high in ((0, 32), (33, 256), (257, 1 << 31)):
                own = [x for x in asked if low <= len(x[0]) <= high]
                if own:
                    groups.append((own, _codes([t for t, _ in own]), np.array([len(t) for t, _ in own]), np.array([e for _, e in own], "i1")))
            for batch in batches:
                for terms in _blocks(sorted(set(batch.column("vterm").to_pylist()))):
                    trie = Trie(terms)
                    for own, codes, length, edits in groups:
                        for q, v, cost in walk(trie, codes, length, edits):
                            yield pa.RecordBatch.from_arrays([pa.array([own[i][0] for i in q], "string"), pa.array([terms[i] for i in v], "string"),
                                                              pa.array(cost.astype("i4"))], names=["term", "vterm", "edits"])

        return vocabulary.filter(F.length("vterm") <= longest).select("vterm").mapInArrow(run, out)

    for row in queries.select("term", "k").distinct().toLocalIterator():
        block.append((row["term"], row["k"]))
        if len(block) == QUERY_BLOCK:
            found = part(block) if found is None else found.unionByName(part(block))
            block = []
    if block:
        found = part(block) if found is None else found.unionByName(part(block))
    return spark.createDataFrame([], out) if found is None else found
