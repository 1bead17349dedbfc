"""Token counts of whole texts by a map-side two-tier lookup.

Tier one is a compact table of the frequent pre-token chunks and their token
lengths, built from a bounded sample of documents and broadcast.  Tier two is
a cache in each Python worker that asks the tokenizer library for the rest.
Nothing is shuffled: a text is counted where it is read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritext.llm import pretokens
from veritext.llm.shared import text_or_empty

#: Documents (expected number) that the table of frequent chunks is taken from.
SAMPLE_DOCS = 1000
#: Entries of that table at most, and code points of an entry at most.
TABLE_ENTRIES = 50_000
TABLE_CHARS = 24

_COUNTERS: dict[tuple, pretokens.Counter] = {}


def frequent_lengths(docs: DataFrame, text_col: str, tokenizer_path: str,
                     alike: bool, sample_docs: int = SAMPLE_DOCS, entries: int = TABLE_ENTRIES) -> tuple[str, np.ndarray]:
    """The broadcast table: chunks joined by U+0000, and their token lengths.

    It only decides which lookups are fast, never a count.
    """
    total = docs.count()
    if not total:
        return "", np.zeros(0, "u1")

    def chunk_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                seen.update(c for c in pretokens.chunks_of(text)[1:] if 0 < len(c) <= TABLE_CHARS)
        top = seen.most_common(entries)
        yield pd.DataFrame({"chunk": [c for c, _ in top], "n": [n for _, n in top]})

    sample = docs.select(text_or_empty(text_col).alias("text")).sample(min(1.0, sample_docs / total), seed=7)
    counted: Counter = Counter()
    for chunk, n in sample.mapInPandas(chunk_counts, "chunk string, n long").toPandas().itertuples(index=False):
        counted[chunk] += n
    counter = pretokens.Counter(tokenizer_path, alike)
    names, lengths = [], []
    for chunk, _ in counted.most_common(entries):
        if chunk[0].isspace() or chunk[-1].isspace() or "\0" in chunk or (n := counter.chunk(chunk, " ")) > 255:
            continue
        names.append(chunk)
        lengths.append(n)
    return "\0".join(names), np.array(lengths, "u1")


def with_token_counts(docs: DataFrame, tokenizer_path: str, text_col: str = "text", out_col: str = "n_tokens",
                      sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``docs`` with ``out_col``: tokens of the whole text as the tokenizer
    library counts them, without added special tokens.

    A null or empty text has 0 tokens.  Special strings inside a text count
    as the library's default has them.  An empty table stays empty; repeated
    rows are counted each on its own; other columns pass through unchanged,
    and a column already called ``out_col`` is replaced.
    """
    spark = docs.sparkSession
    alike = pretokens.merges_alike(tokenizer_path)
    table = spark.sparkContext.broadcast(frequent_lengths(docs, text_col, tokenizer_path, alike, sample_docs))
    key = (tokenizer_path, alike, uuid.uuid4().hex)

    def counter() -> pretokens.Counter:
        if key not in _COUNTERS:
            _COUNTERS.clear()
            names, lengths = table.value
            frequent = dict(zip(names.split("\0"), lengths.tolist(), strict=True)) if names else {}
            _COUNTERS[key] = pretokens.Counter(tokenizer_path, alike, frequent)
        return _COUNTERS[key]

    @F.pandas_udf("long")
    def count_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter()
        for texts in batches:
            yield pd.Series([count(t) for t in texts], dtype="int64")

    return docs.withColumn(out_col, count_tokens(text_or_empty(text_col)))
