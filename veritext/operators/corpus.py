"""Corpus building: pages -> titles, names, documents, chunks, profiles.

S3 S6 S7 T1-T9.  All per-page work is column expressions over one row (narrow,
no shuffle).  Where rows must meet (same file name), the operators use
aggregates with map-side partial aggregation rather than windows, so that a
name shared by a large share of pages never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritext import fixed as FX
from veritext.functions import text as X
from veritext.session import side, stored

DOC_TYPE = FX.DOC_TYPE
ART_MARK = r"Art\.\s*(\d+[a-z]*)"  # article marker at the start of a line
PAR_MARK = r"§\s*(\d+[a-z]*)"      # paragraph marker at the start of a line


# --------------------------------------------------------------------- pages

def page_titles(pages: DataFrame) -> DataFrame:
    """``page_id, title``."""
    return pages.select("page_id", X.h1_title("html").alias("title"))


def page_texts(pages: DataFrame) -> DataFrame:
    """T2+T3: ``page_id, text``."""
    return pages.select("page_id", X.page_text("html").alias("text"))


def page_file_names(pages: DataFrame, use_titles: bool = True) -> DataFrame:
    """``page_id, file_name``; ``use_titles=False`` applies the URL rule."""
    name = X.page_file_name("html", "url") if use_titles else X.name_from_url("url")
    return pages.select("page_id", name.alias("file_name"))


def unique_file_names(named: DataFrame, key: str = "page_id", name: str = "file_name") -> DataFrame:
    """Make names unique; the first holder (lowest key) keeps the name.

    Later holders get ``_<key>`` appended; a generated name that equals an
    existing name gets another suffix, until all are free.  That ends: a name
    grows each round and the existing names are finite, and two generated
    names differ as their keys do.  Uses a grouped min (partial aggregation)
    and joins, never a window on the name.
    """
    return _unique_names(named, key, name).select(F.col("_k").alias(key), F.col("_name").alias(name))


def _unique_names(named: DataFrame, key: str, name: str) -> DataFrame:
    """``_k, _name, _gen`` (whether the name was generated)."""
    base = stored(named.select(F.col(key).alias("_k"), X.clean_given_name(F.col(name)).alias("_base")), "names")
    first = base.groupBy("_base").agg(F.min("_k").alias("_first"))
    later = F.col("_k") != F.col("_first")
    cur = stored(base.join(first, "_base")
                 .select("_k", F.when(later, F.concat_ws("_", F.col("_base"), F.col("_k").cast("string")))
                         .otherwise(F.col("_base")).alias("_name"), later.alias("_gen")), "names")
    taken = base.select(F.col("_base").alias("_name")).distinct()
    while True:
        clash = stored(cur.filter("_gen").join(taken, "_name", "left_semi").select("_k", F.lit(True).alias("_clash")), "names")
        if clash.isEmpty():
            return cur
        cur = stored(cur.join(clash, "_k", "left")
                     .select("_k", F.when(F.col("_clash"), F.concat_ws("_", F.col("_name"), F.col("_k").cast("string")))
                             .otherwise(F.col("_name")).alias("_name"), "_gen"), "names")


def build_documents(pages: DataFrame, folder: str = "html") -> DataFrame:
    """T5: document records; pages that T6 rejects are left out, the rest go on.

    ``doc_id string, text string, metadata struct<title, source_file,
    source_path, text_length, doc_type>, page_id bigint``.  Pages of a folder
    scan (S1) keep the file's own name and path; other pages count as saved
    as ``<unique name>.html`` below ``folder``.  Title, text and name come
    from one narrow pass; only the generated names, few where names seldom
    clash, are joined to it, as a broadcast if they are small.
    """
    good = quarantine(pages, "valid_utf8" if "valid_utf8" in pages.columns else None).filter(F.col("status") == "good")
    title, text = X.h1_title("html").alias("title"), X.page_text("html").alias("text")
    if {"path", "file_name"} <= set(pages.columns):
        p = good.select("page_id", "path", F.col("file_name").alias("source_file"), title, text)
        source_path = F.col("path")
    else:
        own = X.page_file_name("html", "url")
        names = _unique_names(good.select("page_id", own.alias("file_name")), "page_id", "file_name")
        renamed = side(names.filter("_gen").select("_k", "_name"))
        p = good.select("page_id", X.clean_given_name(own).alias("_own"), title, text)
        p = p.join(renamed, F.col("page_id") == F.col("_k"), "left")
        p = p.withColumn("source_file", F.concat(F.coalesce("_name", "_own"), F.lit(".html")))
        source_path = F.concat(F.lit(folder.rstrip("/") + "/"), F.col("source_file"))
    return p.select(
        F.regexp_replace("source_file", r"\.[^.]*$", "").alias("doc_id"),
        "text",
        F.struct("title", "source_file", source_path.alias("source_path"),
                 F.length("text").alias("text_length"), F.lit(DOC_TYPE).alias("doc_type")).alias("metadata"),
        "page_id")


def report_counts(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """How many pages were ``found`` and how many documents ``created``."""
    both = pages.select(F.lit(1).alias("_p"), F.lit(0).alias("_d")).unionAll(docs.select(F.lit(0), F.lit(1)))
    return both.agg(F.coalesce(F.sum("_p"), F.lit(0)).cast("bigint").alias("found"),
                    F.coalesce(F.sum("_d"), F.lit(0)).cast("bigint").alias("created"))


def quarantine(pages: DataFrame, valid_utf8: str | None = None) -> DataFrame:
    """Every page with ``status`` good/rejected and a ``reason``."""
    reason = (F.when(F.col("html").isNull(), F.lit("null_html"))
              .when(X.py_strip("html") == "", F.lit("blank_html")))
    if valid_utf8:
        reason = reason.when(~F.col(valid_utf8), F.lit("undecodable"))
    reason = reason.when(F.col("html").contains("\ufffd"), F.lit("undecodable"))
    return pages.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason").isNull(), F.lit("good")).otherwise(F.lit("rejected")))


def split_quarantine(pages: DataFrame, valid_utf8: str | None = None):
    """T6 as two outputs: ``(good, rejected)``."""
    flagged = quarantine(pages, valid_utf8)
    good = flagged.filter(F.col("status") == "good").drop("status", "reason")
    return good, flagged.filter(F.col("status") == "rejected")


def quarantine_counts(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("status", F.coalesce("reason", F.lit("")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"))


def text_corpus(pages: DataFrame) -> DataFrame:
    """S3+T4: one text per title-named file; the highest page_id wins a name.

    ``file_name, page_id, text``.  The winners are found on (name, page_id)
    rows alone; the html meets them in one join.
    """
    safe = X.safe_title(X.h1_title("html", missing=X.NO_TITLE_FILE))
    win = pages.select("page_id", safe.alias("safe")).groupBy("safe").agg(F.max("page_id").alias("winner"))
    win = side(stored(win, "text-corpus"))
    return (pages.join(win, F.col("page_id") == F.col("winner"))
            .select(F.concat(F.col("safe"), F.lit(".txt")).alias("file_name"), "page_id", X.page_text("html").alias("text")))


# ----------------------------------------------------------------- documents

def with_ordinal(df: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """Dense 1-based position in a total order, without a global window.

    The frame is range-sorted (distributed); each row gets its partition id
    and its index inside the partition (low bits of
    ``monotonically_increasing_id``); partition sizes (one row per
    partition) give the offsets.  Everything stays in the JVM.
    """
    srt = (df.orderBy(*order)
           .withColumn("_pid", F.spark_partition_id())
           .withColumn("_mid", F.monotonically_increasing_id()))
    srt = stored(srt, "ordinal")
    sizes = srt.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)   # one row per partition
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return (srt.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + local + 1).drop("_pid", "_mid", "_off"))


def document_report(docs: DataFrame, text_chars: int = FX.REPORT_TEXT_CHARS,
                    title_chars: int = FX.REPORT_TITLE_CHARS) -> DataFrame:
    """Ordinal, ids, file, length and previews per document."""
    rep = docs.select("doc_id", F.col("metadata.title").alias("title"),
                      F.col("metadata.source_file").alias("source_file"),
                      F.col("metadata.text_length").cast("bigint").alias("text_length"),
                      F.substring("text", 1, text_chars).alias("text_preview"),
                      F.substring(F.col("metadata.title"), 1, title_chars).alias("title_preview"))
    return with_ordinal(rep, [F.col("doc_id")])


def split_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 title: Column | None = None, regroup: bool = False) -> DataFrame:
    """One chunk per non-blank line, labelled with the article and paragraph
    markers in force at that line (a new article resets the paragraph).  With
    ``regroup`` the lines of one article or paragraph are one chunk, and only
    documents without any marker are cut into lines.

    The document is cut at article-marker lines, each part at paragraph-marker
    lines, each of those into lines; the labels come from the head of each
    part.  All of it is array work inside the row: no window, no shuffle.
    ``doc_id, pos, chunk_id, id, title, article, paragraph, text``.
    """
    by_art = F.split(F.col(text), r"\n(?=Art\.\s*\d)")

    def label(first_line, mark):
        return F.nullif(F.regexp_extract(first_line, "^" + mark, 1), F.lit(""))

    def head(seg):
        # labels are read from the first line of a part only (one pass per part)
        return F.substring_index(seg, "\n", 1)

    arts = F.transform(by_art, lambda seg: F.struct(label(head(seg), ART_MARK).alias("a"), seg.alias("s")))

    def lines_of_article(a):
        pars = F.transform(F.split(a["s"], r"\n(?=§\s*\d)"),
                           lambda ps: F.struct(label(head(ps), PAR_MARK).alias("p"), ps.alias("s")))
        return F.flatten(F.transform(pars, lambda p: F.transform(
            F.split(p["s"], "\n"), lambda ln: F.struct(a["a"].alias("article"), p["p"].alias("paragraph"),
                                                       ln.alias("text")))))

    def parts_of_article(a):
        pars = F.transform(F.split(a["s"], r"\n(?=§\s*\d)"),
                           lambda ps: F.struct(label(head(ps), PAR_MARK).alias("p"), ps.alias("s")))
        return F.transform(pars, lambda p: F.struct(a["a"].alias("article"), p["p"].alias("paragraph"), p["s"].alias("text")))

    lines = F.flatten(F.transform(arts, lines_of_article))
    if regroup:
        marked = F.col(text).rlike(r"(?m)^(?:Art\.\s*\d|§\s*\d)")
        lines = F.when(marked, F.flatten(F.transform(arts, parts_of_article))).otherwise(lines)
    cols = [F.col(doc_id).alias("doc_id")]
    if title is not None:
        cols.append(title.alias("title"))
    out = docs.select(*cols, F.posexplode(lines).alias("pos", "c"))
    out = out.filter(X.not_blank(F.col("c.text")))
    sid = F.col("doc_id").cast("string")
    return out.select("doc_id", F.col("pos").cast("bigint").alias("pos"),
                      F.concat(sid, F.lit(":"), F.col("pos").cast("string")).alias("chunk_id"),
                      sid.alias("id"),
                      (F.col("title") if title is not None else F.lit(None).cast("string")).alias("title"),
                      F.col("c.article").alias("article"), F.col("c.paragraph").alias("paragraph"),
                      F.col("c.text").alias("text"))


def chunk_length_profile(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Count, mean, sample std, min, quartiles (linear), max of lengths.

    ``percentile`` is exact and keeps one counter per distinct length, so its
    state is bounded by the longest chunk, not by the number of chunks.
    """
    n = F.length(F.col(text))
    q = F.percentile(n, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return chunks.agg(F.count(n).alias("count"), F.round(F.avg(n), 6).alias("mean"),
                      F.round(F.stddev_samp(n), 6).alias("std"), F.min(n).cast("bigint").alias("min"),
                      q.alias("_q"), F.max(n).cast("bigint").alias("max")).select(
        "count", "mean", "std", "min", F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"),
        F.col("_q")[2].alias("p75"), "max")
