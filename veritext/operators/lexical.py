"""Lexical retrieval: BM25 top-k (R4) and fuzzy term expansion.

BM25 (k1 = 1.2, b = 0.75, idf = ln(1 + (N - df + .5) / (df + .5))) over the
tokens of ``veritext.functions.text.tokens``; a query term repeated in the
question counts once per repetition, any term may match (OR).

Scale
-----
* Corpus statistics are Spark aggregates: N and the mean length in one pass,
  document frequencies only for the (bounded) set of query terms, found by a
  broadcast hash join against each row's distinct tokens.
* Scoring does not emit (question, chunk) pairs: the per-term query weights
  are broadcast (row count checked) and each index partition scores its rows
  in Arrow batches, keeping the k best per question (as the vector path).
* An index with a postings table is not scanned: see ``operators.postings``.
* Fuzzy expansion walks tries of the sorted vocabulary with Levenshtein
  automata of the query terms (``operators.trie``); a swap of neighbours is
  one edit, and all terms within the edits are kept.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritext.functions.text import tokens
from veritext.functions.vectors import TopK, round_score
from veritext.operators.retrieve import MAX_QUERY_BLOCK, SCORE_CELLS, merge_topk, topk_frame
from veritext.operators.trie import expansions
from veritext.session import side, stored

K1 = 1.2
B = 0.75
MAX_WEIGHT_ROWS = 500_000       # (question, term, weight) rows per scoring block (driver + broadcast)
DENSE_CELLS = 16_000_000        # terms x questions kept dense per task


def auto_edits(term: Column) -> Column:
    """Edits allowed for a query term: <=2 chars 0, 3-5 chars 1, longer 2."""
    n = F.length(term)
    return F.when(n <= 2, 0).when(n <= 5, 1).otherwise(2)


def with_term_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``terms array<string>, term_ids array<bigint>, tfs array<int>, dl int``:
    the distinct tokens of the text (sorted), their xxhash64 ids, their counts
    and the token count, by sorting and run-length encoding inside the row.

    The sorted tokens are projected into a column first: lambdas then read a
    column instead of re-deriving the sort for every element.
    """
    srt = df.withColumn("_s", F.sort_array(tokens(F.col(text))))
    s_ = F.col("_s")
    n = F.size(s_)
    cut = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
                   lambda i: (i < n) & (F.element_at(s_, i) != F.element_at(s_, i + 1)))
    srt = srt.withColumn("_e", F.when(n == 0, F.array().cast("array<int>")).otherwise(F.concat(cut, F.array(n))))
    e_ = F.col("_e")
    prev = F.slice(F.concat(F.array(F.lit(0)), e_), 1, F.size(e_))      # of an empty text none
    out = (srt.withColumn("terms", F.transform(e_, lambda e: F.element_at(s_, e)))
           .withColumn("tfs", F.zip_with(e_, prev, lambda e, p: e - p))
           .withColumn("dl", n))
    return out.withColumn("term_ids", F.transform("terms", lambda t: F.xxhash64(t))).drop("_s", "_e")


def question_terms(questions: DataFrame, qid: str = "question_id", question: str = "question") -> DataFrame:
    """``question_id, term, n``: each distinct token with its repeat count."""
    return (questions.select(qid, F.explode(tokens(F.col(question))).alias("term"))
            .groupBy(qid, "term").agg(F.count(F.lit(1)).alias("n")))


def vocabulary(index: DataFrame, text: str = "text") -> DataFrame:
    """Distinct index terms (partial aggregation per partition first)."""
    return index.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("vterm")).distinct()


def fuzzy_terms(qterms: DataFrame, vocab: DataFrame, max_expansions: int | None = None) -> DataFrame:
    """``term, vterm, edits, boost`` for every query term (AUTO edits) and term of ``vocab`` (vterm).

    boost = 1 - edits / min(len(term), len(vterm)).  Every vocabulary term
    within the edits is kept; ``max_expansions`` (off by default) keeps only
    so many per query term, closest first, then alphabetical.
    """
    found = expansions(qterms.select("term").distinct().withColumn("k", auto_edits(F.col("term"))), vocab)
    if max_expansions is not None:
        w = Window.partitionBy("term").orderBy("edits", "vterm")
        found = found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max_expansions)
    boost = F.lit(1.0) - F.col("edits") / F.least(F.length("term"), F.length("vterm"))
    return found.select("term", "vterm", F.col("edits").cast("int").alias("edits"), boost.alias("boost"))


def query_weights(questions: DataFrame, qid: str = "question_id", question: str = "question",
                  fuzzy: DataFrame | None = None) -> DataFrame:
    """``question_id, vterm, weight``: plain BM25 weight = repeats; fuzzy adds
    every expansion of a term with weight repeats x boost."""
    qt = question_terms(questions, qid, question)
    if fuzzy is None:
        return qt.select(qid, F.col("term").alias("vterm"), F.col("n").cast("double").alias("weight"))
    j = qt.join(fuzzy, "term")
    return j.groupBy(qid, "vterm").agg(F.sum(F.col("n") * F.col("boost")).alias("weight"))


def corpus_stats(index: DataFrame, text: str = "text") -> DataFrame:
    """One row ``n, avgdl``: the number and the mean length of the texts."""
    return _stats(index, F.size(tokens(F.col(text))))


def _stats(index: DataFrame, dl: Column) -> DataFrame:
    return index.agg(F.count(F.lit(1)).alias("n"), F.avg(dl).alias("avgdl"))


def term_stats(index: DataFrame, text: str = "text"):
    """Index-wide statistics: one-row ``n, avgdl`` and ``vterm, df`` for all terms."""
    if {"terms", "dl"} <= set(index.columns):        # stored per-chunk term columns
        dl, distinct = F.col("dl"), F.col("terms")
    else:
        dl, distinct = F.size(tokens(F.col(text))), F.array_distinct(tokens(F.col(text)))
    stats = _stats(index, dl)
    df = index.select(F.explode(distinct).alias("vterm")).groupBy("vterm").agg(F.count(F.lit(1)).alias("df"))
    return stats, df


def bm25_topk(index: DataFrame, weights: DataFrame, k: int = 50, id_col: str = "chunk_id",
              text: str = "text", qid: str = "question_id", k1: float = K1, b: float = B,
              stored_stats=None) -> DataFrame:
    """``question_id, rank, <id_col>, score`` (score rounded to 6).

    ``stored_stats``: the (stats, df) pair written with the index; without it
    both are derived from the index.  An index without stored term columns
    gets them on the way, so there is one tokeniser and one scorer.
    """
    if not {"terms", "term_ids", "tfs", "dl"} <= set(index.columns):
        index = with_term_counts(index, text)
    stats, df = stored_stats if stored_stats is not None else term_stats(index, text)
    row = stats.first()
    n_docs, avgdl = int(row["n"]), float(row["avgdl"] or 0.0)
    weights = stored(weights.select(qid, "vterm", "weight"), "bm25-weights")
    needed = df.join(side(weights.select("vterm").distinct()), "vterm")
    idf = needed.select("vterm", F.log(F.lit(1.0) + (F.lit(float(n_docs)) - F.col("df") + F.lit(0.5))
                                       / (F.col("df") + F.lit(0.5))).alias("idf"))
    wq = stored(weights.join(idf, "vterm").select(qid, "vterm", "weight", "idf"), "bm25-weights")   # absent terms drop out
    schema = T.StructType([T.StructField(qid, weights.schema[qid].dataType), T.StructField(id_col, index.schema[id_col].dataType),
                           T.StructField("score", T.DoubleType())])
    # Ids stand for terms; ids of query terms that another vocabulary term
    # shares (as good as never) are compared as strings as well.
    q_ids = wq.select(F.col("vterm").alias("q"), F.xxhash64("vterm").alias("h")).distinct()
    clashes = (df.select("vterm", F.xxhash64("vterm").alias("h")).join(side(q_ids), "h")
               .filter(F.col("vterm") != F.col("q")).select("h").distinct())
    clashes = {r["h"] for r in clashes.collect()}                     # 64-bit collisions within the vocabulary
    size = wq.agg(F.count("*").alias("rows"), F.countDistinct(qid).alias("questions")).first()
    blocks = max(1, -(-size["rows"] // MAX_WEIGHT_ROWS), -(-size["questions"] // MAX_QUERY_BLOCK))
    parts = []
    for blk in range(blocks):
        part = wq if blocks == 1 else wq.filter(F.pmod(F.xxhash64(qid), F.lit(blocks)) == blk)
        rows = part.collect()       # about MAX_WEIGHT_ROWS rows and MAX_QUERY_BLOCK questions at most
        if rows:
            parts.append(_score_block(index, rows, k, id_col, qid, schema, avgdl, k1, b, clashes))
    if not parts:
        return index.sparkSession.createDataFrame([], T.StructType(
            [schema[0], T.StructField("rank", T.LongType()), schema[1], schema[2]]))
    return merge_topk(reduce(DataFrame.unionByName, parts), qid, id_col, k)


def _accumulate(r_a, t_a, contrib, n_rows, nq, qm, ptr, tq, tw):
    """rows x questions score sums of (row, term, contribution) entries."""
    if len(r_a) == 0:
        return np.zeros((n_rows, nq))
    if qm is not None:                           # dense term x question weights
        acc = np.zeros((n_rows, nq))
        starts = np.flatnonzero(np.r_[True, r_a[1:] != r_a[:-1]])
        acc[r_a[starts]] = np.add.reduceat(qm[t_a] * contrib[:, None], starts, axis=0)
        return acc
    reps = ptr[t_a + 1] - ptr[t_a]               # sparse: expand term -> questions
    total = int(reps.sum())
    offs = np.repeat(np.cumsum(reps) - reps, reps)
    sel = np.repeat(ptr[t_a], reps) + (np.arange(total) - offs)
    flat = np.repeat(r_a, reps) * nq + tq[sel]
    return np.bincount(flat, weights=np.repeat(contrib, reps) * tw[sel], minlength=n_rows * nq).reshape(n_rows, nq)


def _score_block(index, rows, k, id_col, qid, schema, avgdl, k1, b, clashes) -> DataFrame:
    """BM25 block scorer over stored term columns: no tokenising in Python.

    Chunk terms are matched to query terms by their 64-bit ids (vectorised);
    a match of an id in ``clashes`` counts only if the strings agree.
    """
    qids = sorted({r[0] for r in rows})
    qpos = {q: i for i, q in enumerate(qids)}
    # query terms in the order of their Spark xxhash64 ids (as stored in the index)
    names = sorted({r[1] for r in rows})
    hashed = index.sparkSession.createDataFrame([(t,) for t in names], "t string").select(
        "t", F.xxhash64("t").alias("h")).collect()
    hid = {r[0]: r[1] for r in hashed}
    terms = sorted(names, key=lambda t: (hid[t], t))
    tpos = {t: i for i, t in enumerate(terms)}
    sid = np.array([hid[t] for t in terms], dtype=np.int64)
    idf_arr = np.zeros(len(terms))
    by_term: list[list[tuple[int, float]]] = [[] for _ in terms]
    for q, t, w, i in rows:
        idf_arr[tpos[t]] = i
        by_term[tpos[t]].append((qpos[q], w))
    ptr = np.cumsum([0] + [len(x) for x in by_term])
    tq = np.array([q for x in by_term for q, _ in x], dtype=np.int64)
    tw = np.array([w for x in by_term for _, w in x], dtype=np.float64)
    dense = len(terms) * len(qids) <= DENSE_CELLS and len(tq) / max(1, len(terms)) * 4 >= len(qids)
    bc = index.sparkSession.sparkContext.broadcast(
        (qids, sid, terms if clashes else None, idf_arr, ptr, tq, tw, float(avgdl), dense, clashes))

    def run(batches):
        qids_, sid_, names_, idf_, ptr_, tq_, tw_, avg, dense_, clashes_ = bc.value
        nq = len(qids_)
        qm = None
        if dense_:
            qm = np.zeros((len(idf_), nq))
            np.add.at(qm, (np.repeat(np.arange(len(idf_)), ptr_[1:] - ptr_[:-1]), tq_), tw_)
        top = TopK(nq, k)
        for pdf in batches:
            step = max(1, SCORE_CELLS // max(1, nq))      # rows x questions scored at once
            for s0 in range(0, len(pdf), step):
                part = pdf.iloc[s0:s0 + step]
                lens = part["term_ids"].map(len).to_numpy()
                if lens.sum() == 0:
                    continue
                ids = np.concatenate(part["term_ids"].to_numpy()).astype(np.int64)
                pos = np.clip(np.searchsorted(sid_, ids), 0, len(sid_) - 1)
                hit = sid_[pos] == ids
                if clashes_:
                    words = np.concatenate(part["terms"].to_numpy())
                    for at in np.flatnonzero(hit & np.isin(ids, list(clashes_))):
                        same = [p for p in range(pos[at], len(sid_)) if sid_[p] == ids[at] and names_[p] == words[at]]
                        hit[at], pos[at] = bool(same), (same or [pos[at]])[0]
                if not hit.any():
                    continue
                r_a = np.repeat(np.arange(len(part)), lens)[hit]
                t_a = pos[hit]
                tf = np.concatenate(part["tfs"].to_numpy()).astype(np.float64)[hit]
                dl = part["dl"].to_numpy().astype(np.float64)[r_a]
                contrib = idf_[t_a] * tf / (tf + k1 * (1.0 - b + b * dl / avg))
                acc = _accumulate(r_a, t_a, contrib, len(part), nq, qm, ptr_, tq_, tw_)
                scores = np.where(acc > 0, round_score(acc), np.nan)
                top.add(part[id_col].to_numpy(), scores)
        yield topk_frame(list(top.rows()), qids_, qid, id_col)

    columns = ["term_ids", "tfs", "dl", *(["terms"] if clashes else [])]
    return index.select(id_col, *columns).mapInPandas(run, schema)
