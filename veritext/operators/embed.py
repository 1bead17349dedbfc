"""Embedding and index preparation.

The encoder is a plug point: any object with ``dims`` and
``encode(list[str]) -> ndarray[n, dims]`` can be used; it is built once per
Python worker and fed Arrow batches by ``mapInPandas``.  The built-in
``HashingEncoder`` needs no model: token counts hashed into ``dims`` buckets
(md5 of the token), L2-normalised.  Its tokens are the same as
``veritext.functions.text.tokens`` (lower-cased letter/digit runs).

Row keys travel with the rows, so a blank text yields a null vector on its
own key instead of shifting later vectors.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritext.functions.text import py_strip, stripped
from veritext.operators.batching import ModelBatches, call_batched
from veritext.session import scratch_path, stored
from veritext.sources import snapshots

DEFAULT_DIMS = 256
ENCODE_ROWS = 512               # texts of an encoder's call, unless ModelBatches says otherwise
CACHED_TOKENS = 100_000         # buckets that a worker keeps; the others are hashed again


class HashingEncoder:
    """Feature-hashing bag of words: bucket = int(md5(token)[:8], 16) % dims."""

    def __init__(self, dims: int = DEFAULT_DIMS):
        import regex

        self.dims = dims
        self._split = regex.compile(r"[^\p{L}\p{N}]+")
        self._bucket: dict[str, int] = {}

    def _b(self, tok: str) -> int:
        b = self._bucket.get(tok)
        if b is None:
            b = int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:8], 16) % self.dims
            if len(self._bucket) < CACHED_TOKENS:
                self._bucket[tok] = b
        return b

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), dtype=np.float64)
        known = self._bucket.get
        for r, t in enumerate(texts):
            toks = [x for x in self._split.split(t.lower()) if x]
            if toks:
                out[r] = np.bincount([self._b(x) if (b := known(x)) is None else b for x in toks], minlength=self.dims)
        n = np.linalg.norm(out, axis=1, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(n > 0, out / n, out)


_WORKER_ENCODERS: dict = {}


def _encoder_for(spec):
    enc = _WORKER_ENCODERS.get(spec)
    if enc is None:
        factory, args = spec
        enc = _WORKER_ENCODERS[spec] = factory(*args)
    return enc


def _encoded(enc, texts: pa.Array, batches: ModelBatches | None) -> pa.StructArray:
    """(vector, error) of an Arrow batch of texts, null where one is blank or fails.

    The vectors are written into one buffer as they come, so that a batch is
    held once, whatever the encoder's calls make.
    """
    filled = np.flatnonzero(np.asarray(pc.not_equal(texts, "").to_numpy(zero_copy_only=False), dtype=bool))
    flat, end, sizes, errors = np.zeros(0), 0, np.full(len(texts), -1), [None] * len(texts)
    step = max(1, len(filled)) if batches else ENCODE_ROWS
    for begin in range(0, len(filled), step):
        rows = filled[begin:begin + step]
        items = texts.take(pa.array(rows)).to_pylist()
        vecs, why = call_batched(enc.encode, items, [batches.length(t) for t in items] if batches else [], batches)
        for i, v, e in zip(rows, vecs, why, strict=True):
            errors[i] = e
            if v is not None:
                v = np.asarray(v, "f8").reshape(-1)
                if end + len(v) > len(flat):                    # as a rule once: all vectors have the size of the first
                    flat = np.concatenate([flat[:end], np.empty(max(end // 2, len(v) * (len(filled) if end == 0 else 1)))])
                flat[end:end + len(v)] = v
                end, sizes[i] = end + len(v), len(v)
    ends = np.r_[0, np.cumsum(np.maximum(sizes, 0))].astype("i4")
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[:end]), mask=pa.array(sizes < 0))
    return pa.StructArray.from_arrays([lists, pa.array(errors, "string")], ["vector", "error"])


def embed_texts(df: DataFrame, text: str = "text", spec=(HashingEncoder, (DEFAULT_DIMS,)),
                out: str = "embedding", error: str | None = None, batches: ModelBatches | None = None) -> DataFrame:
    """All input columns plus ``<out> array<double>, dimension int``.

    The text is stripped first; a blank text gets a null vector on its own
    row.  So does a text that the encoder fails on, alone (``call_each``);
    ``error`` names a column for the reason.  ``batches`` limits the encoder's
    calls to rows of similar length; without it a call takes ``ENCODE_ROWS`` texts.  Only the text goes to the Python
    workers, and the result is marked so that the planner never computes it
    twice for a filter above.
    """
    @F.arrow_udf("vector array<double>, error string")
    def vectors(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = _encoder_for(spec)
        for texts in arrays:
            yield _encoded(enc, texts, batches)

    made = vectors.asNondeterministic()(F.coalesce(stripped(text), F.lit("")))
    rows = df.withColumn("_made", made)
    rows = rows.withColumn(out, F.col("_made.vector"))
    rows = rows if error is None else rows.withColumn(error, F.col("_made.error"))
    return rows.drop("_made").withColumn("dimension", F.when(F.col(out).isNotNull(), F.size(out)))


def encoder_key(spec) -> str:
    """What tells one encoder's vectors from another's in a cache."""
    factory, args = spec
    return f"{factory.__module__}.{factory.__qualname__}{tuple(args)!r}"


def embed_cached(df: DataFrame, cache: str, text: str = "text", spec=(HashingEncoder, (DEFAULT_DIMS,)), out: str = "embedding") -> DataFrame:
    """E2 across batches and sessions: ``embed_distinct`` whose vectors are kept below ``cache``.

    Texts are looked up by encoder and SHA-256, and the text itself is
    compared.  Only misses are encoded, each once; they are written to a folder
    of their own, which one rename adds to the cache, so a lost executor or a
    failed job adds nothing, and two writers of one text add equal rows of
    which a lookup takes one.  Texts that the encoder fails on are not kept.
    """
    spark, kind = df.sparkSession, encoder_key(spec)
    known = _cached(spark, cache).filter(F.col("encoder") == kind)
    plain = F.coalesce(stripped(text), F.lit(""))
    keyed = df.withColumn("_h", F.sha2(plain, 256))
    asked = stored(keyed.filter(plain != "").groupBy("_h").agg(F.any_value(plain).alias("_text")), "cache-asked")
    there = known.select(F.col("h").alias("_h"), F.col("text").alias("_text"), "vector")
    there = there.join(asked, ["_h", "_text"], "left_semi").groupBy("_h").agg(F.any_value("vector").alias("vector"))
    there = stored(there, "cache-hits")
    misses = embed_texts(asked.join(there.select("_h"), "_h", "left_anti"), "_text", spec, "vector")
    draft = scratch_path(spark, f"cache-draft-{uuid.uuid4().hex[:12]}")
    misses.filter("vector IS NOT NULL").select(F.lit(kind).alias("encoder"), F.col("_h").alias("h"), F.col("_text").alias("text"), "vector").write.parquet(draft)
    made = spark.read.schema(CACHE_SCHEMA).parquet(draft)
    vectors = stored(there.unionByName(made.select(F.col("h").alias("_h"), "vector")), "cache-vectors")
    if not made.isEmpty():
        fs = spark._jvm.org.apache.hadoop.fs
        files = fs.Path(cache).getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(fs.Path(cache))
        if not files.rename(fs.Path(draft), fs.Path(f"{cache}/batch-{uuid.uuid4().hex}")):
            raise OSError(f"the new vectors could not be moved to {cache}")
    return keyed.join(vectors.withColumnRenamed("vector", out), "_h", "left").drop("_h").withColumn("dimension", F.when(F.col(out).isNotNull(), F.size(out)))


CACHE_SCHEMA = "encoder string, h string, text string, vector array<double>"


def _cached(spark, cache: str) -> DataFrame:
    """All rows of a cache: those of finished batches, each folder of which came by one rename."""
    fs = spark._jvm.org.apache.hadoop.fs
    files, path = fs.Path(cache).getFileSystem(spark._jsc.hadoopConfiguration()), fs.Path(cache)
    batches = [s.getPath().toString() for s in files.listStatus(path)] if files.exists(path) else []
    return spark.read.schema(CACHE_SCHEMA).parquet(*batches) if batches else spark.createDataFrame([], CACHE_SCHEMA)


def embed_distinct(df: DataFrame, text: str = "text", spec=(HashingEncoder, (DEFAULT_DIMS,)),
                   out: str = "embedding") -> DataFrame:
    """Encode each distinct (stripped) text once and share the vector.

    Texts are grouped by their SHA-256 (collision-free for practical
    purposes, unlike a 64-bit hash); the grouping pre-aggregates map-side so
    a text repeated in a third of all rows costs one row per partition.
    """
    keyed = df.withColumn("_h", F.sha2(py_strip(F.col(text)), 256))
    uniq = keyed.groupBy("_h").agg(F.any_value(text).alias(text))
    vecs = embed_texts(uniq, text, spec, out).drop(text)
    return keyed.join(vecs, "_h", "left").drop("_h")


def validate_vectors(df: DataFrame, col: str = "embedding", dims: int = DEFAULT_DIMS) -> DataFrame:
    """Adds ``valid boolean`` and ``reason``: fixed size, finite, non-zero."""
    v = F.col(col)
    reason = (F.when(v.isNull(), F.lit("missing"))
              .when(F.size(v) != dims, F.lit("wrong_dimension"))
              # contains is null, not false, of an array with nulls; no lambda runs for every element
              .when(F.coalesce(F.array_contains(v, F.lit(float("nan"))), F.lit(True)), F.lit("null_or_nan"))
              .when(F.coalesce((F.array_min(v) == 0) & (F.array_max(v) == 0), F.lit(True)), F.lit("zero_norm")))
    return df.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def rebuild_index(validated: DataFrame, path: str) -> DataFrame:
    """Replace the index at ``path`` with the valid rows; return counts.

    The success/failed counts are observed on the same pass that writes the
    index (``DataFrame.observe``), so the embedding is not computed twice.
    """
    return _counted(validated, lambda rows: rows.write.mode("overwrite").option("compression", "zstd").parquet(path))


def republish_index(validated: DataFrame, base: str) -> DataFrame:
    """S5 for an index that is read meanwhile: the valid rows become its next
    version (``sources.snapshots``), and versions that nobody reads go; return counts."""
    spark = validated.sparkSession
    counts = _counted(validated, lambda rows: snapshots.publish(spark, base, lambda path: rows.write.parquet(path)))
    snapshots.remove_unread(spark, base)
    return counts


def _counted(validated: DataFrame, write) -> DataFrame:
    from pyspark.sql import Observation

    obs = Observation("index_rebuild")
    observed = validated.observe(obs, F.count_if(F.col("valid")).alias("success"),
                                 F.count_if(~F.col("valid")).alias("failed"))
    write(observed.filter("valid").drop("valid", "reason"))
    m = obs.get
    return validated.sparkSession.createDataFrame([(int(m["success"]), int(m["failed"]))],
                                                  "success bigint, failed bigint")
