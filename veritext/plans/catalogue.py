"""The query catalogue: one callable per implemented operator.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame over the driver
tables in ``sf_dir``; column names match ``veritext.plans.oracle``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.functions.text import py_strip
from veritext.operators import corpus as C
from veritext.operators import answer as A
from veritext.operators import embed as E
from veritext.operators import lexical as L
from veritext.operators import phrases as P
from veritext.operators import qlog as QL
from veritext.operators import retrieve as R
from veritext.operators.cells import cells_topk
from veritext.operators.phrase_index import phrase_counts_indexed
from veritext.operators.postings import postings_topk
from veritext.plans import qa
from veritext.plans.index import build_chunk_index, in_tasks, stored_cells, stored_chunk_index, stored_phrase_index, stored_term_tables
from veritext.plans.oracle import DIMS, DOC_DIMS, INDEX_DIMS, K
from veritext.session import scratch_path, side, stored
from veritext.sources import snapshots
from veritext.sources.json_arrays import read_json_array, write_json_array
from veritext.sources.tables import questions
from veritext.plans.oracle import PHRASE
from veritext.sources.tables import phrase_documents, table

Query = Callable[[SparkSession, str], DataFrame]


def q_phrase_counts(spark, d):
    return P.phrase_counts(phrase_documents(table(spark, d, "documents")), PHRASE)


def _benchmark_phrases(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("phrase_id"), F.col("text").alias("phrase"))


def q_phrase_counts_batch(spark, d):
    return P.phrase_counts_batch(phrase_documents(table(spark, d, "documents")), _benchmark_phrases(spark, d))


def q_phrase_counts_indexed(spark, d):
    """The batch over the stored positional index, which one build serves for every batch."""
    index = stored_phrase_index(spark, f"{d}/documents.parquet", phrase_documents(table(spark, d, "documents")))
    return phrase_counts_indexed(index, _benchmark_phrases(spark, d))


def q_phrase_doc_totals(spark, d):
    return P.phrase_doc_totals(q_phrase_counts_batch(spark, d))


def _pages(spark, d):
    return table(spark, d, "pages")


def q_page_titles(spark, d):
    return C.page_titles(_pages(spark, d))


def q_page_file_names(spark, d):
    return C.page_file_names(_pages(spark, d))


def q_page_file_names_from_url(spark, d):
    return C.page_file_names(_pages(spark, d), use_titles=False)


def q_unique_file_names(spark, d):
    return C.unique_file_names(C.page_file_names(_pages(spark, d)))


def q_page_text(spark, d):
    t = C.page_texts(_pages(spark, d))
    return t.select("page_id", F.length("text").cast("bigint").alias("text_length"), F.md5("text").alias("text_md5"))


def q_page_documents(spark, d):
    docs = C.build_documents(_pages(spark, d))
    return docs.select("page_id", "doc_id", "metadata.title", "metadata.source_file", "metadata.source_path",
                       F.col("metadata.text_length").cast("bigint").alias("text_length"), "metadata.doc_type",
                       F.md5("text").alias("text_md5"))


def q_document_report(spark, d):
    return C.document_report(C.build_documents(_pages(spark, d)))


def q_document_report_counts(spark, d):
    return C.report_counts(_pages(spark, d), C.build_documents(_pages(spark, d)))


def q_text_corpus_winners(spark, d):
    return C.text_corpus(_pages(spark, d)).select("file_name", "page_id", F.md5("text").alias("text_md5"))


def q_page_quarantine_counts(spark, d):
    return C.quarantine_counts(C.quarantine(_pages(spark, d)))


def _doc_chunks(spark, d):
    return C.split_chunks(table(spark, d, "documents"), regroup=True)


def _page_documents(spark, d):
    return C.build_documents(_pages(spark, d)).select("doc_id", "text", F.col("metadata.title").alias("title"))


def q_page_chunks(spark, d):
    """Pages to titled chunks, as the index holds them."""
    chunks = C.split_chunks(_page_documents(spark, d), title=F.col("title"), regroup=True)
    return chunks.select("doc_id", "pos", "chunk_id", "title", F.md5("text").alias("text_md5"))


def _page_index(spark, d):
    return stored_chunk_index(spark, f"{d}/pages.parquet", _page_documents(spark, d), DIMS, title="title")


def q_page_bm25_topk(spark, d):
    """Pages -> documents -> chunks -> index -> BM25."""
    terms = stored_term_tables(spark, f"{d}/pages.parquet", _page_documents(spark, d), DIMS, title="title")
    return postings_topk(terms.postings, terms.df, L.query_weights(questions(table(spark, d, "benchmark"))), K)


def q_page_source_labels(spark, d):
    """BM25 labels of the chunks found: their pages' titles."""
    hits = stored(q_page_bm25_topk(spark, d), "page-hits")
    rows = _page_index(spark, d).select("chunk_id", "title").join(side(hits), "chunk_id")
    return rows.select("question_id", "rank", "chunk_id", R.bm25_source_label("title").alias("source"))


def q_document_chunks(spark, d):
    return _doc_chunks(spark, d).select("doc_id", "pos", "chunk_id", "article", "paragraph",
                                        F.length("text").cast("bigint").alias("text_length"),
                                        F.md5("text").alias("text_md5"))


def q_chunks_array_round_trip(spark, d):
    """The chunks written as JSON arrays and read back in byte ranges."""
    chunks = _doc_chunks(spark, d).select("chunk_id", "article", "paragraph", "text")
    path = scratch_path(spark, f"chunk_arrays-{uuid.uuid4().hex[:12]}")
    write_json_array(chunks, path)
    return read_json_array(spark, path, chunks.schema).select("chunk_id", "article", "paragraph", F.length("text").cast("bigint").alias("text_length"),
                                                              F.md5("text").alias("text_md5"))


def q_chunk_length_profile(spark, d):
    return C.chunk_length_profile(_doc_chunks(spark, d))


def _hash_long(vecs):
    e = vecs.select("doc_id", F.posexplode("embedding").alias("bucket", "w")).filter(F.col("w") != 0)
    return e.select("doc_id", F.col("bucket").cast("int").alias("bucket"), F.round("w", 6).alias("weight"))


def q_hash_embeddings(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return _hash_long(E.embed_texts(docs, "text", (E.HashingEncoder, (DIMS,))))


def q_embed_distinct(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return _hash_long(E.embed_distinct(docs, "text", (E.HashingEncoder, (DIMS,))))


def _validated(spark, d):
    return E.validate_vectors(table(spark, d, "embeddings"), "embedding", INDEX_DIMS)


def q_vector_validation(spark, d):
    v = _validated(spark, d)
    return v.groupBy("valid", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def q_index_rebuild_counts(spark, d):
    return E.rebuild_index(_validated(spark, d), scratch_path(spark, "vector_index"))


def q_index_republish_counts(spark, d):
    """The index as versions: the second is published while a reader holds the first."""
    base = scratch_path(spark, f"vector_index_versions-{uuid.uuid4().hex[:12]}")
    first = E.republish_index(_validated(spark, d), base).first()
    with snapshots.pinned(spark, base) as old:
        counts = E.republish_index(_validated(spark, d), base)
        read, versions = old.count(), len(snapshots.remove_unread(spark, base))
    same = F.lit(read == first["success"] and versions == 0)      # the reader's version was whole, and stayed
    return counts.select(*counts.columns, same.alias("reader_undisturbed"), F.lit(len(snapshots.remove_unread(spark, base))).cast("bigint").alias("versions_removed"))


def q_embedding_cache_counts(spark, d):
    """Two batches through the stored cache: texts asked for, and texts encoded."""
    cache = scratch_path(spark, f"vector_cache-{uuid.uuid4().hex[:12]}")
    documents = table(spark, d, "documents").select("text")
    rows, held = [], 0
    for batch, texts in enumerate((documents, documents.union(table(spark, d, "benchmark").select("text"))), 1):
        found = E.embed_cached(texts, cache, spec=(E.HashingEncoder, (DIMS,)))
        n = found.agg(F.countDistinct(F.when(F.col("dimension").isNotNull(), py_strip(F.col("text"))))).first()[0]
        now = spark.read.parquet(f"{cache}/batch-*").count()
        rows.append((batch, n, now - held))
        held = now
    return spark.createDataFrame(rows, "batch bigint, texts bigint, encoded bigint")


def q_semantic_topk(spark, d):
    emb = table(spark, d, "embeddings")
    return R.semantic_topk(emb, R.centroids(emb, []), K, id_col="vec_id")


def q_semantic_topk_batch(spark, d):
    emb = table(spark, d, "embeddings")
    return R.semantic_topk_batch(emb, R.centroids(emb, ["label"]), K, id_col="vec_id", qid="label")


def q_semantic_topk_cells(spark, d):
    """The same rows from the cells that the bounds leave."""
    emb = table(spark, d, "embeddings")
    made = stored_cells(spark, f"{d}/embeddings.parquet", emb, "vec_id", INDEX_DIMS)
    return cells_topk(made, R.centroids(emb, ["label"]), K, qid="label")


def q_chunk_semantic_topk_cells(spark, d):
    made = stored_cells(spark, f"{d}/documents.parquet", _chunk_index(spark, d), "chunk_id", DIMS)
    return cells_topk(made, _question_vectors(spark, d), K, qid="question_id")


def _chunk_index(spark, d):
    return stored_chunk_index(spark, f"{d}/documents.parquet", table(spark, d, "documents"), DIMS)


def q_index_build_counts(spark, d):
    documents = in_tasks(spark, f"{d}/documents.parquet", table(spark, d, "documents"))
    return build_chunk_index(documents, scratch_path(spark, "chunk_index_build"), DIMS)


def _question_vectors(spark, d):
    qs = questions(table(spark, d, "benchmark"))
    return E.embed_texts(qs, "question", (E.HashingEncoder, (DIMS,)), out="query_vec")


def q_chunk_semantic_topk(spark, d):
    return R.semantic_topk_batch(_chunk_index(spark, d), _question_vectors(spark, d), K,
                                 id_col="chunk_id", qid="question_id")


def q_sparse_semantic_topk(spark, d):
    """Document-level retrieval: questions x documents, hashed into 1024 buckets."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    dv = E.validate_vectors(E.embed_texts(docs, "text", (E.HashingEncoder, (DOC_DIMS,))), "embedding", DOC_DIMS)
    qv = E.embed_texts(questions(table(spark, d, "benchmark")), "question", (E.HashingEncoder, (DOC_DIMS,)),
                       out="query_vec")
    return R.semantic_topk_batch(dv.filter("valid").select("doc_id", "embedding"), qv, K,
                                 id_col="doc_id", qid="question_id")


def q_source_labels(spark, d):
    return _doc_chunks(spark, d).select("chunk_id", R.source_label("article", "paragraph", "id").alias("source"))


def q_source_labels_bm25(spark, d):
    return _doc_chunks(spark, d).select("chunk_id", R.bm25_source_label("title").alias("source"))


def _qa(spark, d, use_reranking=True):
    qs = questions(table(spark, d, "benchmark"))
    cfg = qa.QAConfig(retrieval_top_k=K, rerank_top_k=3, use_reranking=use_reranking, dims=DIMS)
    return qa.answer(_chunk_index(spark, d), qs, cfg, lexical=lambda: _term_tables(spark, d))


def q_rerank_scores(spark, d):
    s = _qa(spark, d)["scored"]
    return s.select("question_id", "retrieval_rank", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"))


def q_rerank_topk(spark, d):
    f = _qa(spark, d)["final"]
    return f.select("question_id", "rank", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"))


def q_rerank_fallback(spark, d):
    f = _qa(spark, d, use_reranking=False)["final"]
    return f.select("question_id", "rank", "chunk_id", "retrieval_score")


def q_effective_scores(spark, d):
    f = _qa(spark, d)["final"]
    return f.select("question_id", "rank", "chunk_id", F.round(A.effective_score(), 6).alias("score"))


def q_context(spark, d):
    r = _qa(spark, d)
    return A.contexts(r["final"], questions(table(spark, d, "benchmark")))


def q_confidence(spark, d):
    r = _qa(spark, d)
    c = A.confidence(r["final"], questions(table(spark, d, "benchmark")))
    return c.select("question_id", F.round("confidence", 6).alias("confidence"))


def q_pipeline_stats(spark, d):
    r = _qa(spark, d)
    return A.pipeline_stats(r["retrieved"], r["final"], questions(table(spark, d, "benchmark")))


def q_prompts(spark, d):
    qs = questions(table(spark, d, "benchmark"))
    ctx = A.contexts(_qa(spark, d)["final"], qs).join(qs, "question_id")
    p = A.prompt(F.col("context"), F.col("question"))
    return ctx.select("question_id", F.md5(p).alias("prompt_md5"), F.length(p).cast("bigint").alias("prompt_length"))


def q_source_listing(spark, d):
    return A.source_listing(_qa(spark, d)["final"])


def q_answer_records(spark, d):
    return _qa(spark, d)["records"]


def q_answer_record_digests(spark, d):
    """The flagship's rows in a form that SQL can recompute."""
    return A.record_digests(_qa(spark, d)["records"])


def q_retrieval_route_fallback(spark, d):
    """A question encoder whose vectors do not fit the index: BM25 answers all."""
    qs = questions(table(spark, d, "benchmark"))
    cfg = qa.QAConfig(retrieval_top_k=K, dims=DIMS, encoder=(E.HashingEncoder, (INDEX_DIMS,)))
    return qa.route(_chunk_index(spark, d), qs, cfg, lexical=lambda: _term_tables(spark, d))


def q_retrieval_route(spark, d):
    r = _qa(spark, d)["retrieved"]
    return r.groupBy("question_id", "method").agg(F.count(F.lit(1)).alias("n_rows"))


def _term_tables(spark, d):
    return stored_term_tables(spark, f"{d}/documents.parquet", table(spark, d, "documents"), DIMS)


def q_bm25_topk(spark, d):
    terms = _term_tables(spark, d)
    return postings_topk(terms.postings, terms.df, L.query_weights(questions(table(spark, d, "benchmark"))), K)


def q_bm25_topk_scan(spark, d):
    """The same by a scan of every chunk's terms, as for an index without postings."""
    terms = _term_tables(spark, d)
    return L.bm25_topk(_chunk_index(spark, d), L.query_weights(questions(table(spark, d, "benchmark"))), K, id_col="chunk_id",
                       stored_stats=(terms.stats, terms.df))


def q_fuzzy_terms(spark, d):
    return L.fuzzy_terms(L.question_terms(questions(table(spark, d, "benchmark"))), _term_tables(spark, d).df)


def q_bm25_fuzzy_topk(spark, d):
    qs, terms = questions(table(spark, d, "benchmark")), _term_tables(spark, d)
    fz = stored(L.fuzzy_terms(L.question_terms(qs), terms.df), "fuzzy-terms")
    return postings_topk(terms.postings, terms.df, L.query_weights(qs, fuzzy=fz), K)


def q_log_pairs(spark, d):
    p = QL.conversation_pairs(table(spark, d, "conversations"))
    return p.select("conv_id", "turn", F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"))


def q_log_view(spark, d):
    p = QL.conversation_pairs(table(spark, d, "conversations"))
    return QL.log_view(p, [F.col("conv_id").desc(), F.col("turn").desc()]).select("conv_id", "turn", "header")


def q_log_metrics(spark, d):
    # a response time that follows from the question, so that SQL can tell it
    seconds = F.length("question") / 7
    return QL.log_metrics(QL.log_entries(_qa(spark, d)["records"], seconds))


def flagship(spark, d):
    return q_answer_records(spark, d)


def queries() -> dict[str, Query]:
    return {
        "index_build_counts": q_index_build_counts,
        "log_pairs": q_log_pairs,
        "log_view": q_log_view,
        "log_metrics": q_log_metrics,
        "rerank_scores": q_rerank_scores,
        "rerank_topk": q_rerank_topk,
        "rerank_fallback": q_rerank_fallback,
        "effective_scores": q_effective_scores,
        "context": q_context,
        "confidence": q_confidence,
        "pipeline_stats": q_pipeline_stats,
        "prompts": q_prompts,
        "source_listing": q_source_listing,
        "answer_records": q_answer_records,
        "answer_record_digests": q_answer_record_digests,
        "retrieval_route_fallback": q_retrieval_route_fallback,
        "page_chunks": q_page_chunks,
        "page_bm25_topk": q_page_bm25_topk,
        "page_source_labels": q_page_source_labels,
        "document_report_counts": q_document_report_counts,
        "retrieval_route": q_retrieval_route,
        "bm25_topk": q_bm25_topk,
        "bm25_topk_scan": q_bm25_topk_scan,
        "fuzzy_terms": q_fuzzy_terms,
        "bm25_fuzzy_topk": q_bm25_fuzzy_topk,
        "hash_embeddings": q_hash_embeddings,
        "embed_distinct": q_embed_distinct,
        "vector_validation": q_vector_validation,
        "index_rebuild_counts": q_index_rebuild_counts,
        "index_republish_counts": q_index_republish_counts,
        "embedding_cache_counts": q_embedding_cache_counts,
        "semantic_topk": q_semantic_topk,
        "semantic_topk_batch": q_semantic_topk_batch,
        "semantic_topk_cells": q_semantic_topk_cells,
        "chunk_semantic_topk": q_chunk_semantic_topk,
        "chunk_semantic_topk_cells": q_chunk_semantic_topk_cells,
        "sparse_semantic_topk": q_sparse_semantic_topk,
        "source_labels": q_source_labels,
        "source_labels_bm25": q_source_labels_bm25,
        "page_titles": q_page_titles,
        "page_file_names": q_page_file_names,
        "page_file_names_from_url": q_page_file_names_from_url,
        "unique_file_names": q_unique_file_names,
        "page_text": q_page_text,
        "page_documents": q_page_documents,
        "document_report": q_document_report,
        "text_corpus_winners": q_text_corpus_winners,
        "page_quarantine_counts": q_page_quarantine_counts,
        "document_chunks": q_document_chunks,
        "chunks_array_round_trip": q_chunks_array_round_trip,
        "chunk_length_profile": q_chunk_length_profile,
        "phrase_counts": q_phrase_counts,
        "phrase_counts_batch": q_phrase_counts_batch,
        "phrase_counts_indexed": q_phrase_counts_indexed,
        "phrase_doc_totals": q_phrase_doc_totals,
    }
