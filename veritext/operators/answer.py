"""Answer assembly per question.

Input is the final chunk table (question_id, rank, content, source,
retrieval_score, rerank_score, reranking_used) plus the retrieval rows for
the counts.  Every step is keyed by question_id and works on at most the
final top-k rows of one question, so one shuffle by question serves the
windows and aggregates that follow.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritext import fixed as FX

MAX_CONTEXT_CHARS = FX.MAX_CONTEXT_CHARS
NO_DOCUMENTS = FX.NO_DOCUMENTS

# Prompt template of this package (not a fixed value): the context and the
# question are substituted; the rules are a parameter of ``prompt``.
PROMPT_INSTRUCTIONS = [
    "Base the answer on the numbered sources only.",
    "Refer to the sources you use by their numbers.",
    "When the sources do not settle the question, answer that they do not.",
]
PROMPT_HEAD = "Sources:\n"


def effective_score(rerank: str = "rerank_score", retrieval: str = "retrieval_score") -> Column:
    """G1: the rerank score unless it is null or exactly 0, else retrieval."""
    return F.coalesce(F.nullif(F.col(rerank), F.lit(0.0)), F.col(retrieval))


def score_text(score: Column) -> Column:
    """Three decimals via decimal rounding (half-up on 6-place value)."""
    return F.round(score.cast("decimal(18,6)"), 3).cast("string")


def format_columns(fmt: str, **cols: Column) -> Column:
    """``concat`` of the literal parts of ``fmt`` and the columns named in it."""
    parts = []
    for lit_part, name in re.findall(r"([^{]*)(?:\{(\w+)\})?", fmt):
        if lit_part:
            parts.append(F.lit(lit_part))
        if name:
            parts.append(cols[name])
    return F.concat(*parts)


def fragments(final: DataFrame, qid: str = "question_id") -> DataFrame:
    """Fragment text and running length per final chunk."""
    frag = format_columns(FX.FRAGMENT_FORMAT, i=F.col("rank").cast("string"), source=F.col("source"),
                          score=score_text(F.col("score")), content=F.col("content"))
    w = Window.partitionBy(qid).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (final.withColumn("score", effective_score()).withColumn("fragment", frag)
            .withColumn("run_length", F.sum(F.length("fragment")).over(w)))


def contexts(final: DataFrame, questions: DataFrame, max_chars: int = MAX_CONTEXT_CHARS,
             qid: str = "question_id") -> DataFrame:
    """``question_id, context, n_fragments``; stops at the first fragment
    that would pass ``max_chars`` (joiners not counted); ``''`` if none fit."""
    kept = fragments(final, qid).filter(F.col("run_length") <= max_chars)
    agg = kept.groupBy(qid).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "fragment"))),
                                 lambda s: s["fragment"]), FX.CONTEXT_JOINER).alias("context"),
        F.count(F.lit(1)).alias("n_fragments"))
    return (questions.select(qid).join(agg, qid, "left")
            .select(qid, F.coalesce("context", F.lit("")).alias("context"),
                    F.coalesce("n_fragments", F.lit(0)).cast("bigint").alias("n_fragments")))


def confidence(final: DataFrame, questions: DataFrame, qid: str = "question_id") -> DataFrame:
    """sum(s) / (n * max(s)) over all final chunks; 0 if none; null if max is 0."""
    s = effective_score()
    agg = final.groupBy(qid).agg(F.try_divide(F.sum(s), F.count(s) * F.max(s)).alias("confidence"),
                                 F.count(F.lit(1)).alias("_n"))
    return (questions.select(qid).join(agg, qid, "left")
            .select(qid, F.when(F.col("_n").isNull(), F.lit(0.0)).otherwise(F.col("confidence")).alias("confidence")))


def pipeline_stats(retrieved: DataFrame, final: DataFrame, questions: DataFrame,
                   qid: str = "question_id") -> DataFrame:
    """``retrieved, final, reranking_used`` per question (0/0/false if none)."""
    r = retrieved.groupBy(qid).agg(F.count(F.lit(1)).alias("retrieved"))
    f = final.groupBy(qid).agg(F.count(F.lit(1)).alias("final"), F.bool_or("reranking_used").alias("reranking_used"))
    return (questions.select(qid).join(r, qid, "left").join(f, qid, "left")
            .select(qid, F.coalesce("retrieved", F.lit(0)).cast("bigint").alias("retrieved"),
                    F.coalesce("final", F.lit(0)).cast("bigint").alias("final"),
                    F.coalesce("reranking_used", F.lit(False)).alias("reranking_used")))


def prompt(context: Column, question: Column, instructions: list[str] = PROMPT_INSTRUCTIONS) -> Column:
    """The generation prompt with context and question substituted."""
    steps = "\n".join(f"{i}. {t}" for i, t in enumerate(instructions, 1))
    return F.concat(F.lit(PROMPT_HEAD), context, F.lit("\n\nQuestion: "), question,
                    F.lit("\n\nRules:\n" + steps + "\n\nAnswer:"))


def source_listing(final: DataFrame) -> DataFrame:
    """Per final chunk, the score shown and its kind."""
    rr = F.nullif(F.col("rerank_score"), F.lit(0.0))
    return final.select("question_id", "rank", "source",
                        F.when(rr.isNotNull(), F.lit("Rerank")).otherwise(F.lit("Retrieval")).alias("score_kind"),
                        score_text(effective_score()).alias("score_text"))


def answer_records(questions: DataFrame, retrieved: DataFrame, final: DataFrame,
                   max_chars: int = MAX_CONTEXT_CHARS, qid: str = "question_id") -> DataFrame:
    """One row per question with chunks, context, prompt, confidence, stats."""
    chunk = F.struct("rank", "chunk_id", "content", "source", "retrieval_score", "rerank_score")
    rows = fragments(final, qid)
    fits = F.when(F.col("run_length") <= max_chars, F.struct("rank", "fragment"))
    agg = rows.groupBy(qid).agg(                    # a question's final chunks, once
        F.array_sort(F.collect_list(chunk)).alias("chunks"),
        F.array_join(F.transform(F.array_sort(F.collect_list(fits)), lambda s: s["fragment"]), FX.CONTEXT_JOINER).alias("context"),
        F.try_divide(F.sum("score"), F.count("score") * F.max("score")).alias("_confidence"),
        F.count(F.lit(1)).alias("final"), F.bool_or("reranking_used").alias("reranking_used"))
    counts = retrieved.groupBy(qid).agg(F.count(F.lit(1)).alias("retrieved"))
    out = questions.join(agg, qid, "left").join(counts, qid, "left")
    none = F.col("retrieved").isNull()
    context = F.coalesce("context", F.lit(""))
    return out.select(
        qid, "question",
        F.when(none, F.lit(NO_DOCUMENTS)).otherwise(F.lit(None).cast("string")).alias("answer"),
        F.coalesce("chunks", F.array().cast(agg.schema["chunks"].dataType)).alias("chunks"),
        context.alias("context"),
        F.when(none, F.lit(None).cast("string")).otherwise(prompt(context, F.col("question"))).alias("prompt"),
        F.when(F.col("final").isNull(), F.lit(0.0)).otherwise(F.col("_confidence")).alias("confidence"),
        F.struct(F.coalesce("retrieved", F.lit(0)).cast("bigint").alias("retrieved"),
                 F.coalesce("final", F.lit(0)).cast("bigint").alias("final"),
                 F.coalesce("reranking_used", F.lit(False)).alias("reranking_used")).alias("pipeline_stats"))


def record_digests(records: DataFrame, qid: str = "question_id") -> DataFrame:
    """Answer records as flat rows that other engines can recompute: digests
    of the ordered chunks, context and prompt, and the rounded numbers."""
    six = lambda x: F.coalesce(x.cast("decimal(18,6)").cast("string"), F.lit(""))
    one = lambda c: F.concat_ws("|", c["rank"].cast("string"), c["chunk_id"], F.md5(c["content"]), c["source"],
                                six(c["retrieval_score"]), six(F.round(c["rerank_score"], 6)))
    return records.select(
        qid, F.md5(F.array_join(F.transform("chunks", one), "\n")).alias("chunks_md5"), F.md5("context").alias("context_md5"),
        F.md5("prompt").alias("prompt_md5"), F.round("confidence", 6).alias("confidence"), "pipeline_stats.retrieved",
        "pipeline_stats.final", "pipeline_stats.reranking_used", (F.col("answer").isNotNull()).alias("no_documents"))
