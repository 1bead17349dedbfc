"""Ranked lexical search by scanning the documents with an Aho-Corasick automaton.

1. The terms of a block of items go into one automaton, each between guard
   characters, so that a match is a whole term.  Blocks hold a bounded number
   of characters and items; a block is one scan of the documents.
2. Every task runs the automaton over its texts, cleaned the same way, with
   one guard between neighbouring terms.  What it finds are the counts of the
   items' terms in each document; no index of the documents is made.
3. The corpus statistics are aggregates over all documents.  The counts are
   scored in tasks that map a term to its items and keep the best k an item;
   the tasks' winners are merged on two levels.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritext.llm.shared import discard, stored, text_or_empty

#: A block of items has at most so many characters of distinct terms (one item may have more) and items.
BLOCK_CHARS, BLOCK_ITEMS = 2_000_000, 4096
#: Cells (documents x items) and pairs (term found, item) that are scored at once.
CELLS = 4_000_000
#: Candidates a task holds before it cuts back to the best k an item; parts of an item's first merge.
HELD, MERGE_PARTS = 500_000, 64

_GUARD = " "
#: Bytes of terms: letters and digits of ASCII, A-Z lower-cased, and all above ASCII; the rest is a guard.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def cleaned(text: bytes | None) -> bytes:
    """The UTF-8 text with its terms lower-cased and everything else blank."""
    return (text or b"").translate(_CLEAN)


def terms_of(text: bytes | None) -> list[str]:
    """The terms of a UTF-8 text in order, with repeats."""
    return [t.decode("utf-8", "replace") for t in cleaned(text).split()]


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, terms): the distinct terms of every item that has any; rows of one id are one item."""
    @F.pandas_udf("array<string>")
    def distinct_terms(texts: pd.Series) -> pd.Series:
        return texts.map(lambda b: sorted(set(terms_of(b))))

    rows = items.select(F.col(id_col).alias("item_id"), F.explode(distinct_terms(text_or_empty(text_col).cast("binary"))).alias("term"))
    return rows.distinct().groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))


def blocks_of(items: DataFrame, chars: int = BLOCK_CHARS, most: int = BLOCK_ITEMS) -> Iterator[list[tuple]]:
    """The items in lists of bounded size; the driver holds one at a time."""
    block, held = [], 0
    for row in items.toLocalIterator():
        size = sum(map(len, row["terms"])) + len(row["terms"])
        if block and (held + size > chars or len(block) >= most):
            yield block
            block, held = [], 0
        block.append((row["item_id"], row["terms"]))
        held += size
    if block:
        yield block


_AUTOMATA: dict[int, object] = {}


def _automaton(key: int, terms: list[str]):
    """The automaton of a block, built once a worker; the last one only is held."""
    if key not in _AUTOMATA:
        import ahocorasick

        made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, t in enumerate(terms):
            made.add_word(_GUARD + t + _GUARD, i)
        made.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[key] = made
    return _AUTOMATA[key]


def count_terms(docs: DataFrame, terms: list[str], id_col: str, text_col: str) -> DataFrame:
    """(id, n, found, counts): of every document its number of terms, the
    numbers of the listed terms that it holds, and how often it holds them."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)                       # at most a block's characters
    key = id(shared)
    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType)]).add("n", "long").add("found", T.ArrayType(T.IntegerType())).add("counts", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, shared.value)
        for batch in batches:
            sizes, ends, found, counts = [], [0], [], []
            for text in batch.column("text"):
                clean = cleaned(text.as_py())
                sizes.append(len(clean.split()))
                hits = Counter(map(itemgetter(1), automaton.iter(f"{_GUARD}{clean.decode('utf-8', 'replace')}{_GUARD}"))) if sizes[-1] else {}
                found.extend(hits.keys())
                counts.extend(hits.values())
                ends.append(len(found))
            lists = lambda values: pa.ListArray.from_arrays(pa.array(ends, "int32"), pa.array(values, "int32"))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, "int64"), lists(found), lists(counts)], names=["id", "n", "found", "counts"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, out)


class _Best:
    """The best k candidates of every item seen by a task, ties to the smaller id, null last."""

    def __init__(self, items: int, k: int):
        self.k, self.floor, self.parts, self.held = k, np.zeros(items, "i8"), [], 0

    def add(self, item: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        self.parts.append(pa.table({"item": pa.array(item, "int32"), "score": pa.array(score, "int64"), "id": ids}))
        self.held += len(item)
        if self.held > HELD:
            self.cut()

    def cut(self) -> pa.Table | None:
        if not self.parts:
            return None
        rows = pa.concat_tables(self.parts)
        rows = rows.take(pc.sort_indices(rows, [("item", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_end"))
        item = rows["item"].to_numpy()
        start = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        rank = np.arange(len(item)) - np.repeat(start, np.diff(np.r_[start, len(item)]))
        last = rank == self.k - 1
        self.floor[item[last]] = rows["score"].to_numpy()[last]
        self.parts = [rows.filter(pa.array(rank < self.k))]
        self.held = len(self.parts[0])
        return self.parts[0]


def _weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def score_counts(counted: DataFrame, block: list[tuple], terms: list[str], dfs: dict[int, int], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, id, score): the k best documents of each item of the block in each task's share of ``counted``."""
    place = {t: i for i, t in enumerate(terms)}
    pairs = sorted((place[t], i) for i, (_, own) in enumerate(block) for t in own)
    ptr = np.searchsorted([p for p, _ in pairs], np.arange(len(terms) + 1))
    shared = counted.sparkSession.sparkContext.broadcast((ptr, np.array([i for _, i in pairs], "i8"), np.array([_weight(n_docs, dfs.get(t, 0)) for t in range(len(terms))], "i8")))
    n_items, out = len(block), T.StructType().add("item", "integer").add("score", "long").add(T.StructField("id", counted.schema["id"].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ptr, items, weights = shared.value
        best = _Best(n_items, k)
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("found")
            ends = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
            term, tf = lists.flatten().to_numpy(), batch.column("counts").flatten().to_numpy().astype("i8")
            m = 50 + 50 * batch.column("n").to_numpy() * n_docs // n_terms
            gain = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, np.diff(ends))))
            wide = np.r_[0, np.cumsum(ptr[term + 1] - ptr[term])]                   # pairs up to each term found
            at = 0
            while at < batch.num_rows:
                to = min(batch.num_rows, at + max(1, CELLS // n_items))
                to = max(at + 1, min(to, int(np.searchsorted(wide[ends], wide[ends[at]] + CELLS, "right")) - 1))
                scores = np.zeros((to - at) * n_items, "i8")
                for a in range(ends[at], ends[to], CELLS):                          # one document can have more terms
                    b = min(a + CELLS, ends[to])
                    t = term[a:b]
                    reps = ptr[t + 1] - ptr[t]
                    chosen = items[np.repeat(ptr[t] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())]
                    doc = np.repeat(np.searchsorted(ends, np.arange(a, b), "right") - 1 - at, reps)
                    np.add.at(scores, doc * n_items + chosen, np.repeat(gain[a:b], reps))
                cells = np.flatnonzero(scores)
                cells = cells[scores[cells] >= best.floor[cells % n_items]]
                if len(cells):
                    best.add(cells % n_items, scores[cells], batch.column("id").take(pa.array(at + cells // n_items)))
                at = to
        rows = best.cut()
        if rows is not None:
            yield from rows.to_batches()

    return counted.filter(F.size("found") > 0).mapInArrow(run, out)


def merged(winners: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item, ranked; a task's window never holds more than ``MERGE_PARTS`` x k rows of an item."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    part = winners.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(MERGE_PARTS)))
    first = part.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k).select("item", "rank", "id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", block_chars: int = BLOCK_CHARS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The k best documents of every item: ``item_col``, rank (from 1), ``id_col``, score (above 0).

    Null and empty texts have no terms: such documents count nowhere and are
    never found, such items get no rows.  Rows that share an item id, null
    included, are one item with the terms of all.  Every document row counts
    on its own: rows that repeat an id, or have none, are ranked each; equal
    scores go by id, null last.  An empty table gives no rows.  Texts of any
    length are scanned whole.  Further columns are left out, so their names
    cannot clash.
    """
    spark, found = docs.sparkSession, []
    terms_table = stored(item_terms(items, item_col, item_text_col), "scan-items")
    out = T.StructType([T.StructField("item", T.IntegerType()), T.StructField(item_col, items.schema[item_col].dataType)])
    for block in blocks_of(terms_table, block_chars, block_items):
        terms = sorted({t for _, own in block for t in own})
        counted = stored(count_terms(docs, terms, id_col, text_col), "scan-counts")
        size = counted.agg(F.count_if(F.col("n") > 0).alias("n"), F.sum("n").alias("l")).head()
        if not size["n"]:
            break
        dfs = {r["t"]: r["n"] for r in counted.select(F.explode("found").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}  # a block's terms at most
        best = merged(score_counts(counted, block, terms, dfs, size["n"], size["l"], k), k)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], out)
        best = best.join(F.broadcast(names), "item").select(item_col, "rank", F.col("id").alias(id_col), "score")
        found.append(stored(best, "scan-best"))
        discard(counted)
    discard(terms_table)
    if not found:
        empty = T.StructType([out[1], T.StructField("rank", T.IntegerType()), T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.LongType())])
        return spark.createDataFrame([], empty)
    return reduce(DataFrame.unionByName, found)
