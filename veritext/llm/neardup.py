"""Near-duplicate documents by MinHash.

1. Every text gives its set of word shingles (64-bit hashes), a key of the
   whole set and a signature of many universal-hash minima.
2. Texts with equal sets form a class, which its smallest id stands for.
3. The signature is cut into bands; classes that agree on a band share a
   bucket.  Each member of a bucket is paired with the bucket's centre: of
   its members the one in the most and fullest buckets, which in a group of
   copies is the text that most others come from.  A large bucket has several.
4. Pairs whose signatures agree enough are confirmed on the full sets, and
   the links joined to components by alternating large-star and small-star.
5. What a centre cannot link is still compared: in small buckets all pairs
   that lie in different components; of large buckets, the members outside
   the component of the bucket's centre against all members, in blocks.

So no group is ever paired with itself as a whole, and no candidate is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritext.llm.candidates import centres_of, labels_of, members_of, outside, small_members, small_pairs, star_pairs, weights_of
from veritext.llm.components import star_components
from veritext.llm.shared import stored, text_or_empty

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 75
BANDS, ROWS = 32, 4
#: Signatures must agree to this share less this many standard deviations.
DEVIATIONS = 4.5
#: A block of the last step holds this many classes and shingles at most.
BLOCK_DOCS, BLOCK_SHINGLES = 4096, 4_000_000

_RNG = np.random.default_rng(20240229)
#: Multiply-shift universal hashing: the top 32 bits of a * x + b modulo 2^64, a odd.
_A = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype="u8") * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype="u8") * np.uint64(2)
_M = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles.

    A-Z are lower-cased; words are runs without ASCII white space.  Fewer
    words than a shingle are one shingle; no word gives the empty set.
    """
    found = text.encode().lower().split()
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), 1)] if found else [], "u8")
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, found), "u8", len(found))
    n = len(w) - words + 1
    h = w[:n].copy()
    for i in range(1, words):
        h *= _M
        h += w[i:i + n]
    h ^= h >> np.uint64(29)
    h *= _M
    h ^= h >> np.uint64(32)
    return np.unique(h)


def signature(shingles: np.ndarray, step: int = 1024) -> np.ndarray:
    """The minima of all hash functions over a set that is not empty."""
    best = np.full(len(_A), np.iinfo("u8").max, "u8")
    for at in range(0, len(shingles), step):
        x = shingles[at:at + step]
        np.minimum(best, (_A[:, None] * x + _B[:, None]).min(axis=1), out=best)
    return (best >> np.uint64(32)).astype("<u4")


def similar(a: np.ndarray, b: np.ndarray, percent: int = SIMILAR_PERCENT) -> bool:
    """100 * |a and b| >= percent * |a or b| for sorted sets that are not empty."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    both = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


def agreement_floor(percent: int = SIMILAR_PERCENT, n: int = BANDS * ROWS) -> float:
    p = percent / 100
    return p - DEVIATIONS * (p * (1 - p) / n) ** 0.5


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id, n_shingles, set_key, signature of every row."""
    out = (T.StructType().add("id", "string").add("n_shingles", "long").add("set_key", "binary")
           .add("signature", "binary"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingle_set(t, words) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "n_shingles": [len(s) for s in sets],
                                "set_key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                                "signature": [signature(s).tobytes() if len(s) else None for s in sets]})

    # the id travels as a string: beside a null, pandas would make numbers floats
    rows = docs.select(F.col(id_col).cast("string").alias("id"), text_or_empty(text_col).alias("text")).mapInPandas(run, out)
    return rows.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))


def confirmed(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose signatures agree and whose full sets are similar."""
    floor = agreement_floor(percent)

    @F.pandas_udf("double")
    def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        x, y = (np.frombuffer(b"".join(s), "<u4").reshape(len(s), -1) for s in (a, b))
        return pd.Series((x == y).mean(axis=1))

    side = lambda name, at, df, col: df.select(F.col("id").alias(name), F.col(col).alias(f"{col}_{at}"))
    near = (pairs.join(side("u", 1, sigs, "signature"), "u").join(side("v", 2, sigs, "signature"), "v")
            .filter(agreement("signature_1", "signature_2") >= floor).select("u", "v").distinct())
    near = stored(near, "dup-near")
    ids = near.select(F.col("u").alias("id")).union(near.select("v")).distinct()
    wanted = stored(texts.join(ids, "id", "left_semi"), "dup-texts")
    both = near.join(side("u", 1, wanted, "text"), "u").join(side("v", 2, wanted, "text"), "v")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = ("", None)                              # rows of one document often follow each other
        for pdf in batches:
            ok = []
            for a, b in zip(pdf["text_1"], pdf["text_2"], strict=True):
                if b != last[0]:
                    last = (b, shingle_set(b, words))
                ok.append(similar(shingle_set(a, words), last[1], percent))
            yield pdf.loc[ok, ["u", "v"]]

    kind = near.schema["u"].dataType
    return stored(both.mapInPandas(check, T.StructType().add("u", kind).add("v", kind)).distinct(), "dup-links")


def _outsiders(members: DataFrame, labels: DataFrame, centres: DataFrame, sigs: DataFrame, texts: DataFrame,
               words: int, percent: int) -> DataFrame | None:
    """Links of large buckets' members that their centre's component lacks,
    to all members of those buckets, found in blocks of bounded size."""
    large = outside(members, labels, centres)
    apart = F.col("component") != F.col("middle")
    outsiders = stored(large.filter(apart).select("id").distinct(), "dup-outside")
    if outsiders.isEmpty():
        return None
    # Only buckets that hold an outsider matter.
    inside = large.join(stored(large.filter(apart).select("key").distinct(), "dup-keys"), "key", "left_semi")
    everyone = stored(inside.select("id", "component").distinct().join(sigs, "id").join(texts, "id"), "dup-everyone")
    sought = everyone.join(outsiders, "id", "left_semi")
    size = sought.agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")).head()
    blocks = max(-(-size["n"] // BLOCK_DOCS), -(-size["s"] // BLOCK_SHINGLES))
    floor, kind = agreement_floor(percent), members.schema["id"].dataType
    schema = T.StructType().add("u", kind).add("v", kind)
    spark, found = members.sparkSession, None
    for block in range(blocks):
        rows = sought.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).select("id", "component", "signature", "text").toPandas()
        block_rows = spark.sparkContext.broadcast((rows["id"].tolist(), rows["component"].to_numpy(),
                                                   np.frombuffer(b"".join(rows["signature"]), "<u4").reshape(len(rows), -1),
                                                   [shingle_set(t, words) for t in rows["text"]]))

        def compare(batches: Iterator[pd.DataFrame], block_rows=block_rows) -> Iterator[pd.DataFrame]:
            ids, components, signatures, sets = block_rows.value
            for pdf in batches:
                links = {}                              # one link between an outsider and a component is enough
                for other, component, sig, text in zip(pdf["id"], pdf["component"], pdf["signature"], pdf["text"], strict=True):
                    agree = (signatures == np.frombuffer(sig, "<u4")).mean(axis=1) >= floor
                    own = None
                    for i in np.flatnonzero(agree & (components != component)):
                        if (ids[i], component) not in links:
                            own = shingle_set(text, words) if own is None else own
                            if similar(sets[i], own, percent):
                                links[ids[i], component] = other
                yield pd.DataFrame([(a, b) for (a, _), b in links.items()], columns=["u", "v"])

        part = everyone.select("id", "component", "signature", "text").mapInPandas(compare, schema)
        found = part if found is None else found.union(part)
    return None if found is None else stored(found.distinct(), "dup-links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
                    percent: int = SIMILAR_PERCENT) -> DataFrame:
    """One row a document: ``id_col``, n_shingles, component_id (the smallest
    id that links reach, its own included), kept (it is that id).

    Documents are linked if 100 * |intersection| >= percent * |union| of
    their shingle sets.  Null texts and texts without words have no shingles,
    are linked with nothing and kept.  Rows without id are linked with
    nothing: component_id null, kept.  Rows that repeat an id are one node
    of the graph and get a row each.  An empty table gives no rows; further
    columns of ``docs`` are left out.
    """
    rows = stored(sketches(docs, id_col, text_col, words), "dup-sketch")
    nodes = rows.filter(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
    classes = stored(nodes.groupBy("set_key").agg(F.min("id").alias("id"), F.first("signature").alias("signature"),
                                                  F.first("n_shingles").alias("n_shingles")), "dup-class")
    band = lambda b: F.xxhash64(F.lit(b), F.substring("signature", 4 * ROWS * b + 1, 4 * ROWS))
    keys = classes.select("id", F.explode(F.array(*[band(b) for b in range(BANDS)])).alias("key"))
    members = members_of(keys)
    weights = weights_of(members)
    centres = centres_of(members, weights)
    # The texts of all members move once; the hint keeps that alike at every size.
    texts = stored(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
                   .join(weights.select("id").hint("merge"), "id", "left_semi"), "dup-text")
    sigs = stored(classes.join(weights, "id", "left_semi").select("id", "signature", "n_shingles"), "dup-signature")
    links = confirmed(star_pairs(members, centres), sigs, texts, words, percent)
    found = stored(star_components(links), "dup-component")
    labels = labels_of(weights, found)
    more = confirmed(small_pairs(small_members(members, labels)), sigs, texts, words, percent)
    blocks = _outsiders(members, labels, centres, sigs, texts, words, percent)
    more = more if blocks is None else more.union(blocks)
    if not more.isEmpty():
        found = stored(star_components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more)), "dup-component")

    smallest = classes.select("set_key", F.col("id").alias("first"))
    rows = rows.drop("signature").join(smallest, "set_key", "left").join(found.withColumnRenamed("node", "first"), "first", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "first", "id"))
    return rows.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
                       F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
