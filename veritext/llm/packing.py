"""Harmonic packing of documents into fixed-capacity sequences.

Capacity / 1, / 2, / 3 ... are the class sizes.  A document is cut into whole
sequences (class 1) and, from what is left, always the largest class size that
still fits, so a class's pieces all have one length and a bin of class j holds
exactly j of them.  Each worker (a task
of the first pass) fills bins of its own, one open bin a class at a time.
What it cannot fill it leaves over, fewer than j pieces a class.  The
leftovers of all workers are numbered on through the workers (a running count
over one row a worker and class) and fill bins by the same rule.  The fewer
than j pieces that then remain of each class are laid end to end and cut at
the capacity; their number depends on the capacity alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritext.llm import pretokens
from veritext.llm.shared import stored, text_or_empty

_ENCODERS: dict[tuple[str, bool], pretokens.Encoder] = {}


def class_sizes(capacity: int) -> list[int]:
    """Distinct whole parts of capacity / j, largest first."""
    return sorted({capacity // j for j in range(1, capacity + 1)}, reverse=True)


def cut(length: int, capacity: int, sizes: list[int]) -> list[tuple[int, int]]:
    """(start, size) of the pieces of a document of ``length`` ids, in order."""
    pieces = [(at, capacity) for at in range(0, length - capacity + 1, capacity)]
    at, i = len(pieces) * capacity, 0
    while at < length:
        while sizes[i] > length - at:
            i += 1
        pieces.append((at, sizes[i]))
        at += sizes[i]
    return pieces


def _encoder(path: str, alike: bool) -> pretokens.Encoder:
    if (path, alike) not in _ENCODERS:
        _ENCODERS[path, alike] = pretokens.Encoder(path, alike)
    return _ENCODERS[path, alike]


def cut_pieces(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, capacity: int,
               separator: int) -> DataFrame:
    """One row a piece: id, doc_tokens, start, size, ids (little-endian 32-bit),
    worker, bin (the worker's bin of that class; null: left over) and nth (the
    piece's place in its bin, or among the worker's leftovers of its class).

    A worker keeps one open bin a class, less than ``capacity`` ids each.
    """
    sizes, alike = class_sizes(capacity), pretokens.merges_alike(tokenizer_path)
    out = (T.StructType().add("id", "string").add("doc_tokens", "long").add("start", "long")
           .add("size", "long").add("ids", "binary").add("worker", "long").add("bin", "long").add("nth", "long"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, worker = _encoder(tokenizer_path, alike), TaskContext.get().partitionId()
        end, filled, open_bins, rows = separator.to_bytes(4, "little"), {}, {}, []
        frame = lambda rows: pd.DataFrame(rows, columns=out.names).astype({"bin": "Int64"})
        for pdf in batches:
            for key, text in zip(pdf["id"], pdf["text"], strict=True):
                ids = encoder.ids_of(text).astype("<u4").tobytes() + end
                n = len(ids) // 4
                for start, size in cut(n, capacity, sizes):
                    pieces = open_bins.setdefault(size, [])
                    pieces.append((key, n, start, size, ids[4 * start:4 * (start + size)]))
                    if len(pieces) == capacity // size:
                        number = filled.get(size, 0)
                        rows += [(*p, worker, number, i) for i, p in enumerate(pieces)]
                        filled[size] = number + 1
                        open_bins[size] = []
                if len(rows) >= 4096:
                    yield frame(rows)
                    rows = []
        rows += [(*p, worker, None, i) for pieces in open_bins.values() for i, p in enumerate(pieces)]
        yield frame(rows)

    # the id travels as a string: beside a null, pandas would make numbers floats
    rows = docs.select(F.col(id_col).cast("string").alias("id"), text_or_empty(text_col).alias("text")).mapInPandas(run, out)
    return rows.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))


#: Sequence ids: worker, class and bin share 63 bits; bins of leftovers have the top bit set.
BIN_BITS, CLASS_BITS = 35, 8
LEFT = 1 << 62


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = 1024, separator: int = 0) -> DataFrame:
    """Pack every document; one row a piece: ``id_col``, start, length, ids
    (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its token ids followed by ``separator``; a null or empty
    text is the separator alone.  Null or repeated ids are kept: each row is
    packed as a document of its own.  An empty table gives no rows; further
    columns of ``docs`` are left out, so their names cannot clash.
    """
    spark, sizes = docs.sparkSession, class_sizes(capacity)
    if len(sizes) >= 1 << CLASS_BITS:
        raise ValueError(f"capacity {capacity} has {len(sizes)} classes; at most {(1 << CLASS_BITS) - 1} fit an id")
    pieces = stored(cut_pieces(docs, tokenizer_path, id_col, text_col, capacity, separator), "packing")
    number = F.expr("array_position(array({}), size) - 1".format(", ".join(f"{s}L" for s in sizes)))
    columns = ["id", "start", "size", "ids", "doc_tokens", "sequence_id", "offset"]
    own = (pieces.filter(F.col("bin").isNotNull())
           .withColumn("sequence_id", F.shiftleft(F.col("worker"), BIN_BITS + CLASS_BITS)
                       + F.shiftleft(number.cast("long"), BIN_BITS) + F.col("bin"))
           .withColumn("offset", F.col("nth") * F.col("size")).select(columns))

    # Leftovers: fewer than capacity ids a class and worker.
    left = pieces.filter(F.col("bin").isNull())
    counts = left.groupBy("worker", "size").agg(F.count("*").alias("n"))
    totals = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # a row a class
    plan, at = [], 0
    for i, size in enumerate(sizes):
        fits, n = capacity // size, totals.get(size, 0)
        plan.append((size, fits, LEFT + (i << BIN_BITS), n - n % fits, at))
        at += n % fits * size
    plan = F.broadcast(spark.createDataFrame(plan, "size long, fits long, first long, binned long, rest_at long"))
    earlier = Window.partitionBy("size").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")   # a row a task and class
    left = left.join(before, ["worker", "size"]).join(plan, "size").withColumn("nth", F.col("nth") + F.col("before"))
    rest = F.col("rest_at") + (F.col("nth") - F.col("binned")) * F.col("size")   # place in the last few sequences
    in_bin = F.col("nth") < F.col("binned")
    last = LEFT + (len(sizes) << BIN_BITS)
    left = (left.withColumn("sequence_id", F.when(in_bin, F.col("first") + F.expr("nth div fits"))
                            .otherwise(F.lit(last) + F.floor(rest / capacity)))
            .withColumn("offset", F.when(in_bin, (F.col("nth") % F.col("fits")) * F.col("size"))
                        .otherwise(rest % capacity)).select(columns))
    # A piece of the last few sequences that runs across a capacity mark is cut there.
    room = F.lit(capacity) - F.col("offset")
    across = F.col("size") > F.col("room")
    left = left.withColumn("room", room).withColumn(
        "part", F.explode(F.when(across, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    second = F.col("part") == 1
    skip = F.when(second, F.col("room")).otherwise(0)
    length = F.when(second, F.col("size") - F.col("room")).otherwise(F.least("size", "room"))
    left = left.select("id", (F.col("start") + skip).alias("start"), length.alias("size"),
                       F.substring("ids", (skip * 4 + 1).cast("int"), (length * 4).cast("int")).alias("ids"),
                       "doc_tokens", (F.col("sequence_id") + F.col("part")).alias("sequence_id"),
                       F.when(second, 0).otherwise(F.col("offset")).alias("offset"))
    both = own.unionByName(left)
    return both.select(F.col("id").alias(id_col), F.col("start").cast("long"), F.col("size").cast("long").alias("length"),
                       "ids", "doc_tokens", F.col("sequence_id").cast("long"), F.col("offset").cast("long"))
