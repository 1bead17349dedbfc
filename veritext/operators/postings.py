"""BM25 over a postings table.

Layout
------
* A task of the build inverts the chunks that it reads, without a shuffle: so
  many in a row are a shard, numbered in the order of their ids (``chunks``:
  shard, ord, chunk id).  Shards lie in folders by groups of tasks (parts).
* ``postings`` has one row per (term, shard): the numbers of the chunks that
  hold the term, its counts there and the chunks' lengths, sorted by number,
  and for every block of ``BLOCK`` entries the largest tf part that the term
  reaches in it.  Rows of a part lie in folders by a bucket of the term, sorted
  by term, so a question reads the folders of its terms only.

Query
-----
The rows of the questions' terms are grouped by shard, in passes over the parts
whose shuffles go before the next; a shard's task scores all questions and
hands on the best k of each, which are merged on two levels.
In a shard, a question's terms go from the largest possible contribution to
the smallest.  As soon as what is left cannot lift a chunk that is not yet
among the best k into them, only chunks that still can get there are looked
up in the remaining (longest) lists, and the block bounds drop some of these
before.  The bounds are exact, so the result is that of scoring everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritext.functions.text import tokens
from veritext.functions.vectors import round_score
from veritext.operators.lexical import B, K1
from veritext.operators.retrieve import merge_topk
from veritext.session import side, stored

BUCKETS = 32                    # folders of terms in a part
IDS = -1                        # the folder of the chunks' ids
BLOCK = 128                     # entries under one bound
SHARD_CHUNKS = 125_000          # chunks of a shard at most
LEAST_SHARDS = 16
WEIGHT_ROWS = 500_000           # (question, term) weights that are broadcast at once
TASK_SHARDS = 1 << 12           # numbers for a task's shards
PART_TASKS = 8                  # tasks of the build whose shards are a part
MOST_PARTS = 64
ID_ROW = 10_000                 # ids in a row
PART_ENTRIES = 1_000_000        # entries that the build sorts at once, about
PASS_SHARDS = 2                 # shards a core, that a pass of a query scores, about
LISTS = "term string, shard int, ords array<int>, tfs array<int>, dls array<int>, bounds array<double>"
FLOOR_COST = 4                  # entries whose adding costs as much as the floor's pass over so many chunks
MARGIN = 1e-5                   # more than rounding to 6 decimals can lift a score


@dataclass
class Postings:
    """The stored tables, and what their bounds were made with."""

    postings: DataFrame
    chunks: DataFrame
    avgdl: float
    n_chunks: int
    id_col: str = "chunk_id"
    k1: float = K1
    b: float = B
    parts: int = 1              # folders of shards
    shards: int = 1


def bucket_of(term: str | Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class _Lists:
    """The chunks of a shard as they come, and then the postings of their terms."""

    def __init__(self):
        self.ids, self.lengths, self.words, self.codes, self.rows, self.tfs = [], [], [], [], [], []
        self.size = 0

    def add(self, ids: pa.Array, words: pa.ListArray) -> None:
        length = np.asarray(pc.fill_null(words.value_lengths(), 0)).astype("i4")
        coded, n = words.flatten().dictionary_encode(), len(ids)
        key = np.asarray(coded.indices).astype("i8") * n + np.repeat(np.arange(n), length)
        key, tf = np.unique(key, return_counts=True)
        self.ids.append(ids)
        self.lengths.append(length)
        self.words.append(coded.dictionary)
        self.codes.append((key // n).astype("i4"))
        self.rows.append((key % n + self.size).astype("i4"))
        self.tfs.append(tf.astype("i4"))
        self.size += n

    def rows_of(self, shard: int, schema: pa.Schema, avgdl: float, k1: float, b: float) -> Iterator[pa.RecordBatch]:
        """The chunks' ids in the order of their numbers, then a row a term, in the order of the terms."""
        ids = pa.concat_arrays(self.ids)
        order = np.asarray(pc.sort_indices(ids))
        number = np.empty(self.size, "i4")
        number[order] = np.arange(self.size)
        ids, dl = ids.take(pa.array(order)), np.concatenate(self.lengths)[order]
        for begin in range(0, self.size, ID_ROW):
            part = ids[begin:begin + ID_ROW]
            row = {"shard": pa.array([shard], "i4"), "ords": pa.array([[begin]], pa.list_(pa.int32())), "ids": pa.ListArray.from_arrays(pa.array([0, len(part)], "i4"), part)}
            yield pa.RecordBatch.from_arrays([row[f.name] if f.name in row else pa.nulls(1, f.type) for f in schema], schema=schema)
        words = pa.concat_arrays(self.words).dictionary_encode()
        order = np.asarray(pc.sort_indices(words.dictionary))
        rank = np.empty(len(order), "i4")
        rank[order] = np.arange(len(order))
        terms, rank = words.dictionary.take(pa.array(order)), rank[np.asarray(words.indices)]
        starts = np.r_[0, np.cumsum([len(w) for w in self.words])]
        codes = np.concatenate([rank[starts[i]:starts[i + 1]][own] for i, own in enumerate(self.codes)])
        self.codes = []
        rows = np.concatenate(self.rows)
        self.rows = []
        rows, tfs = number[rows], np.concatenate(self.tfs)
        self.__init__()
        counts = np.bincount(codes, minlength=len(terms))
        of_part = (np.cumsum(counts) - counts) // PART_ENTRIES           # terms are sorted and made by parts, so that little is held twice
        for part in np.unique(of_part):
            lo, hi = np.searchsorted(of_part, [part, part + 1])
            own = np.flatnonzero((codes >= lo) & (codes < hi))
            own = own[np.argsort(codes[own].astype("i8") * len(number) + rows[own])]
            ords, tf, size = rows[own], tfs[own], counts[lo:hi]
            ends = np.r_[0, np.cumsum(size)]
            blocks = -(-size // BLOCK)
            at = np.r_[0, np.cumsum(blocks)]
            cuts = np.repeat(ends[:-1], blocks) + BLOCK * (np.arange(at[-1]) - np.repeat(at[:-1], blocks))
            bounds = np.maximum.reduceat(tf / (tf + k1 * (1.0 - b + b * dl[ords] / (avgdl or 1.0))), cuts)
            lists = lambda values, ends: pa.ListArray.from_arrays(pa.array(ends.astype("i4")), pa.array(values))
            made = {"term": terms[lo:hi], "shard": pa.array(np.full(hi - lo, shard, "i4")), "ords": lists(ords, ends), "tfs": lists(tf, ends), "dls": lists(dl[ords], ends),
                    "bounds": lists(bounds, at)}
            yield pa.RecordBatch.from_arrays([made[f.name].cast(f.type) if f.name in made else pa.nulls(hi - lo, f.type) for f in schema], schema=schema)


def _inverter(most: int, avgdl: float, k1: float, b: float):
    """A task of the build: shards of at most ``most`` chunks, from batches of (id, tokens).

    Chunks without id cannot be found, but count in the frequencies of their
    terms: their shards have negative numbers.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() * TASK_SHARDS, 0
        held = {True: _Lists(), False: _Lists()}
        schema = None

        def ended(known: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made
            shard, made = first + made, made + 1
            yield from held[known].rows_of(shard if known else -1 - shard, schema, avgdl, k1, b)

        for batch in batches:
            ids, words = batch.columns
            if schema is None:
                numbers = pa.list_(pa.int32())
                schema = pa.schema([("term", words.type.value_type), ("shard", pa.int32()), ("ords", numbers), ("tfs", numbers), ("dls", numbers),
                                    ("bounds", pa.list_(pa.float64())), ("ids", pa.list_(ids.type))])
            for known, some in ((True, batch.filter(ids.is_valid())), (False, batch.filter(ids.is_null()))):
                while some.num_rows:
                    part = some.slice(0, most - held[known].size)
                    held[known].add(*part.columns)
                    some = some.slice(part.num_rows)
                    if held[known].size == most:
                        yield from ended(known)
        for known in (True, False):
            if held[known].size:
                yield from ended(known)

    return run


def build_postings(index: DataFrame, path: str, stats: DataFrame, id_col: str = "chunk_id", k1: float = K1, b: float = B, text: str = "text") -> None:
    """Write the postings of an index below ``path``.

    A task inverts the chunks that it reads, shard by shard, so nothing is
    shuffled; a list of postings never exceeds a shard, whatever the term.
    """
    spark = index.sparkSession
    row = stats.first()
    n, avgdl = int(row["n"]), float(row["avgdl"] or 0.0)
    most = max(1, min(SHARD_CHUNKS, -(-n // LEAST_SHARDS)))
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // SHARD_CHUNKS))
    parts = min(MOST_PARTS, -(-tasks // PART_TASKS))
    id_type = index.schema[id_col].dataType
    out = T.StructType([*T.StructType.fromDDL(LISTS).fields, T.StructField("ids", T.ArrayType(id_type))])
    rows = index.select(id_col, tokens(F.col(text)).alias("tokens")).coalesce(tasks).mapInArrow(_inverter(most, avgdl, k1, b), out)
    task = F.shiftright(F.when(F.col("shard") < 0, -1 - F.col("shard")).otherwise(F.col("shard")), TASK_SHARDS.bit_length() - 1)
    rows = rows.withColumn("part", F.floor(task * parts / tasks).cast("int")).withColumn("bucket", F.when(F.col("term").isNull(), IDS).otherwise(bucket_of("term")))
    order = ["part", "bucket", "term", "shard"]
    rows.sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd").partitionBy(*order[:2]).parquet(f"{path}/postings")
    meta = [(n, avgdl, id_col, float(k1), float(b), id_type.simpleString(), parts, -(-n // most))]
    schema = "n_chunks long, avgdl double, id_col string, k1 double, b double, id_type string, parts int, shards int"
    spark.createDataFrame(meta, schema).write.mode("overwrite").parquet(f"{path}/meta")


def open_postings(spark: SparkSession, path: str) -> Postings:
    m = spark.read.parquet(f"{path}/meta").first()
    rows = spark.read.schema(f"{LISTS}, ids array<{m['id_type']}>, part int, bucket int").parquet(f"{path}/postings").filter("shard >= 0")
    ids = rows.filter(F.col("bucket") == IDS).select("shard", F.element_at("ords", 1).alias("first"), F.posexplode("ids").alias("at", m["id_col"]))
    chunks = ids.select("shard", (F.col("first") + F.col("at")).alias("ord"), m["id_col"])
    return Postings(rows.filter(F.col("bucket") != IDS).drop("ids"), chunks, m["avgdl"], m["n_chunks"], m["id_col"], m["k1"], m["b"], m["parts"], m["shards"])


def document_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """``vterm, df`` of all terms of the postings below ``path``."""
    rows = spark.read.schema(f"{LISTS}, part int, bucket int").parquet(f"{path}/postings").filter(F.col("bucket") != IDS)
    return rows.groupBy(F.col("term").alias("vterm")).agg(F.sum(F.size("ords")).alias("df"))


def rows_of_terms(store: Postings, terms: DataFrame) -> DataFrame:
    """The postings rows of ``terms`` (term); only the folders of their buckets are read."""
    buckets = [r["bucket"] for r in terms.select(bucket_of("term").alias("bucket")).distinct().collect()]    # at most BUCKETS
    return store.postings.filter(F.col("bucket").isin(buckets)).join(side(terms.select("term").distinct()), "term", "left_semi")


class _Shard:
    """The postings of one shard: per term the sorted numbers, the tf parts and the block bounds."""

    def __init__(self, table: pa.Table, store_k1: float, store_b: float, k1: float, b: float, avgdl: float):
        lists = lambda name: table[name].combine_chunks()
        ends = np.r_[0, np.cumsum(np.asarray(lists("ords").value_lengths()))]
        flat = lambda name: np.asarray(lists(name).flatten())
        self.ords, tf, dl = flat("ords"), flat("tfs").astype("f8"), flat("dls").astype("f8")
        self.tf, self.norm = tf, tf + k1 * (1.0 - b + b * dl / (avgdl or 1.0))
        self.at = {t: (int(ends[i]), int(ends[i + 1])) for i, t in enumerate(table["term"].to_pylist())}
        bounds, sizes = flat("bounds"), np.asarray(lists("bounds").value_lengths())
        starts = np.r_[0, np.cumsum(sizes)]
        if (store_k1, store_b) != (k1, b) and len(self.ords):       # bounds were made for other parameters
            cuts = np.concatenate([np.arange(a, e, BLOCK) for a, e in zip(ends[:-1], ends[1:], strict=True)])
            bounds = np.maximum.reduceat(tf / self.norm, cuts)
        self.bounds = {t: bounds[starts[i]:starts[i + 1]] for i, t in enumerate(self.at)}
        self.most = {t: float(own.max()) for t, own in self.bounds.items()}
        self.size = int(self.ords.max()) + 1 if len(self.ords) else 0
        self.made: dict = {}                                         # a term's part of the score before its weight, for all questions
        self.looked_up = self.scanned = 0

    def _parts(self, term: str, idf: float) -> np.ndarray:
        if term not in self.made:
            a, e = self.at[term]
            self.made[term] = idf * self.tf[a:e] / self.norm[a:e]
        return self.made[term]

    def best(self, terms: list[tuple[str, float, float]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, scores) of the best k chunks for (term, weight, idf), scores rounded, ties to the smaller number."""
        here = [(w * i * self.most[t] * (1 + 1e-12), t, w, i) for t, w, i in terms if t in self.at]
        here.sort(key=lambda x: (-x[0], x[1]))
        left = np.cumsum([x[0] for x in here][::-1])[::-1]           # from each term on
        score, alive = np.zeros(self.size), None                     # alive: the chunks that can still get there
        floor, due = 0.0, 0                                          # a floor found once holds on; entries added since it was
        for j, (_, t, w, idf) in enumerate(here):
            a, e = self.at[t]
            if alive is None or e - a <= len(alive):                 # a short list is added whole
                score[self.ords[a:e]] += self._parts(t, idf) * w
                self.scanned += e - a
            else:
                block = np.searchsorted(self.ords[a:e:BLOCK], alive, "right") - 1
                most = np.where(block >= 0, self.bounds[t][np.maximum(block, 0)], 0.0) * (w * idf * (1 + 1e-12))
                alive = alive[score[alive] + most + (left[j + 1] if j + 1 < len(here) else 0.0) >= floor - MARGIN]
                at = np.minimum(np.searchsorted(self.ords[a:e], alive), e - a - 1)
                hit = self.ords[a:e][at] == alive
                score[alive[hit]] += self._parts(t, idf)[at[hit]] * w
                self.looked_up += len(alive)
            due += e - a
            if j + 1 == len(here) or self.size <= k:
                continue
            # a floor costs a pass over the chunks: it is sought where the lists added, or the next one, are as long
            after, following = left[j + 1], self.at[here[j + 1][1]]
            held = self.size if alive is None else len(alive)
            if FLOOR_COST * (due + following[1] - following[0]) < held:
                continue
            due = 0
            if alive is None:
                if after < score.max() - MARGIN:
                    floor = np.partition(score, self.size - k)[self.size - k]
                    if floor > 0 and after < floor - MARGIN:         # no chunk without a score yet can get there
                        alive = np.flatnonzero(score + after >= floor - MARGIN)
            elif len(alive) > k:
                floor = max(floor, np.partition(score[alive], len(alive) - k)[len(alive) - k])
                alive = alive[score[alive] + after >= floor - MARGIN]
        found = np.flatnonzero(score > 0) if alive is None else alive
        rounded = round_score(score[found])
        order = np.lexsort((found, -rounded))[:k]
        return found[order], rounded[order]


def _shard_scorer(store: Postings, shared, arrow: pa.DataType, qid: str, k: int, k1: float, b: float):
    """The task of a shard: the best k chunks of every question of the broadcast block."""
    stored_k1, stored_b, avgdl = store.k1, store.b, store.avgdl

    def score(table: pa.Table) -> pa.Table:
        shard = _Shard(table, stored_k1, stored_b, k1, b, avgdl)
        ids, ords, scores = [], [np.zeros(0, "i8")], [np.zeros(0)]
        for q, terms in shared.value.items():
            found, best = shard.best(terms, k)
            ids += [q] * len(found)
            ords.append(found)
            scores.append(best)
        number = [table["shard"][0].as_py()] * len(ids)
        return pa.table({qid: pa.array(ids, arrow), "shard": pa.array(number, "int32"), "ord": pa.array(np.concatenate(ords), "int32"), "score": np.concatenate(scores)})

    return score


def _blocks(weights: DataFrame, qid: str) -> Iterator[list]:
    """The weights in lists of whole questions and about ``WEIGHT_ROWS`` rows; the driver holds one at a time."""
    rows, last = [], None
    for r in weights.sort(qid).toLocalIterator():
        if len(rows) >= WEIGHT_ROWS and r[0] != last:
            yield rows
            rows = []
        rows.append(tuple(r))
        last = r[0]
    if rows:
        yield rows


def _passes(store: Postings, cores: int) -> list[tuple[int, int]]:
    """First and last parts of the passes of a query, each of which has shards for all cores."""
    n = max(1, min(store.parts, store.shards // (PASS_SHARDS * cores)))
    cuts = [i * store.parts // n for i in range(n + 1)]
    return [(a, e - 1) for a, e in zip(cuts[:-1], cuts[1:], strict=True)]


def postings_topk(store: Postings, df: DataFrame, weights: DataFrame, k: int = 50, qid: str = "question_id", k1: float = K1, b: float = B) -> DataFrame:
    """``question_id, rank, <id_col>, score`` (score rounded to 6), the rows that a scan of every chunk gives.

    ``df``: the stored document frequencies (vterm, df); ``weights``:
    (question_id, vterm, weight).  Terms that the index lacks count nothing;
    a question without a term of the index gets no rows.
    """
    spark, id_col = store.postings.sparkSession, store.id_col
    n = float(store.n_chunks)
    weights = stored(weights.select(qid, "vterm", "weight"), "postings-weights")
    needed = df.join(side(weights.select("vterm").distinct()), "vterm")
    idf = F.log(F.lit(1.0) + (F.lit(n) - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    weights = stored(weights.join(needed.select("vterm", idf.alias("idf")), "vterm").select(qid, "vterm", "weight", "idf"), "postings-weights")
    out = T.StructType([T.StructField(qid, weights.schema[qid].dataType), T.StructField("shard", T.IntegerType()), T.StructField("ord", T.IntegerType()),
                        T.StructField("score", T.DoubleType())])
    winners, arrow = [], weights.select(qid).limit(0).toArrow().schema.field(0).type
    for block in _blocks(weights, qid):
        questions: dict = {}
        for q, t, w, i in block:
            questions.setdefault(q, []).append((t, w, i))
        shared = spark.sparkContext.broadcast(questions)
        terms = spark.createDataFrame([(t,) for t in {r[1] for r in block}], "term string")
        rows = rows_of_terms(store, terms)
        for low, high in _passes(store, spark.sparkContext.defaultParallelism):
            some = rows.filter(F.col("part").between(low, high)).select("term", "shard", "ords", "tfs", "dls", "bounds")
            best = some.groupBy("shard").applyInArrow(_shard_scorer(store, shared, arrow, qid, k, k1, b), out)
            winners.append(stored(best, "postings-winners"))     # k a question and shard
    if not winners:
        return spark.createDataFrame([], T.StructType([out[0], T.StructField("rank", T.LongType()), store.chunks.schema[id_col], out[3]]))
    found = winners[0]
    for more in winners[1:]:
        found = found.unionByName(more)
    named = store.chunks.join(side(found, 40), ["shard", "ord"]).select(qid, id_col, "score")
    return merge_topk(named, qid, id_col, k)
