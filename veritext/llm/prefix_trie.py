"""Prefix trie of conversations, summed over subtrees by an Euler tour.

1. Turns become digests and lengths, so that no text is sorted or joined.
   They are numbered by one global sort: a conversation of any length is
   spread over tasks, whose counts are added up from a small table.
2. Conversations are rebuilt with the lead of another, and every prefix gets a
   digest: the exclusive or of its turns' digests, each bound to its place.
3. Equal prefixes are a node, an aggregate.  A node is named by its smallest
   member and its depth.
4. Every node has an enter and an exit arc, and each arc its successor in the
   tour.  The list is ranked in two steps: blocks of arcs are contracted in
   tasks (nodes lie in the order of conversations, so most successors are in
   the block), then the arcs at which a block is entered by pointer jumping.
5. The ranks are positions in the tour; prefix sums over them, taken chunk by
   chunk, give each subtree's leaves and savings as a difference.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritext.llm.shared import discard, stored, text_or_empty

#: A conversation c begins with the first crc32(c) % LEADS turns of conversation c - c % GROUP.
GROUP, LEADS = 100, 6
#: Turns of a conversation whose prefixes one task makes; arcs of a block (a power of two) and of a chunk.
PREFIX_CHUNK, BLOCK_BITS, TOUR_CHUNK = 4096, 19, 65536
#: Bits of the row number within a partition, in ids that Spark gives.
PART_BITS = 33

KEY = ["depth", "x1", "x2"]


def _part(col: str) -> Column:
    return F.shiftright(col, PART_BITS)


def _in_order(df: DataFrame, at: str, *order: Column, name: str) -> DataFrame:
    """``df`` with ``at``, a number that grows with the order; written, as a second run could deal rows otherwise."""
    return stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), name)


def turn_digests(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, d1, d2, size): 128 bits of each turn's role and text, and the text's code points."""
    both = (text_or_empty(role), text_or_empty(text))
    digest = lambda seed: F.xxhash64(F.lit(seed), *both)
    return rows.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), digest(1).alias("d1"), digest(2).alias("d2"),
        F.length(both[1]).cast("long").alias("size"))


def rebuilt_turns(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, i, n, d1, d2, size): turn i of n of the rebuilt conversations; and (conv, n) of all of them."""
    order = [F.col("conv").asc(), F.col("turn").asc_nulls_first(), F.col("d1").asc(), F.col("d2").asc()]
    ordered = _in_order(rows, "at", *order, name="trie-turns")
    spans = ordered.groupBy("conv", _part("at").alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)     # a row a task
    spans = stored(spans.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "trie-spans")
    convs = spans.groupBy("conv").agg(F.sum("n").alias("own"))
    convs = convs.select("conv", "own", (F.col("conv") - F.col("conv") % GROUP).alias("base"), (F.crc32(F.col("conv").cast("string")) % LEADS).alias("lead"))
    bases = convs.select(F.col("conv").alias("base"), F.col("own").alias("there"))
    taken = F.least("lead", F.coalesce("there", F.lit(0)))
    convs = stored(convs.join(bases, "base", "left").select("conv", "base", "lead", taken.alias("taken"),
                                                            (taken + F.greatest(F.col("own") - F.col("lead"), F.lit(0))).alias("n")), "trie-convs")
    placed = ordered.withColumn("part", _part("at")).join(spans.select("conv", "part", "first", "before"), ["conv", "part"])
    placed = stored(placed.select("conv", (F.col("before") + F.col("at") - F.col("first")).alias("place"), "d1", "d2", "size"), "trie-placed")
    own = placed.join(convs, "conv").filter(F.col("place") >= F.col("lead")).select(
        "conv", (F.col("place") - F.col("lead") + F.col("taken")).alias("i"), "n", "d1", "d2", "size")
    heads = placed.filter(F.col("place") < LEADS - 1).withColumnRenamed("conv", "base")
    lead = heads.join(convs, "base").filter(F.col("place") < F.col("taken")).select("conv", F.col("place").alias("i"), "n", "d1", "d2", "size")
    turns = stored(own.union(lead), "trie-rebuilt")
    discard(ordered, spans, placed)
    return turns, convs


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, x1, x2, p1, p2, size, ends): every prefix of every conversation, with its own and its parent's digest."""
    bound = lambda seed: F.xxhash64(F.lit(seed), "i", "d1", "d2")
    rows = turns.withColumns({"chunk": F.expr(f"i div {PREFIX_CHUNK}"), "f1": bound(3), "f2": bound(4)})
    upto = Window.partitionBy("conv", "chunk").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"r1": F.bit_xor("f1").over(upto), "r2": F.bit_xor("f2").over(upto)})
    chunks = rows.groupBy("conv", "chunk").agg(F.bit_xor("f1").alias("c1"), F.bit_xor("f2").alias("c2"))
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)     # a row a chunk
    before = chunks.select("conv", "chunk", *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(b) for c, b in (("c1", "b1"), ("c2", "b2"))])
    rows = rows.join(before.filter("chunk > 0"), ["conv", "chunk"], "left")
    whole = lambda r, b: F.col(r).bitwiseXOR(F.coalesce(b, F.lit(0)))
    rows = rows.withColumns({"x1": whole("r1", "b1"), "x2": whole("r2", "b2")})
    made = rows.select("conv", (F.col("i") + 1).alias("depth"), "x1", "x2", F.col("x1").bitwiseXOR(F.col("f1")).alias("p1"),
                       F.col("x2").bitwiseXOR(F.col("f2")).alias("p2"), "size", (F.col("i") + 1 == F.col("n")).alias("ends"))
    zero = F.lit(0).cast("long")
    return made.union(convs.select("conv", zero, zero, zero, zero, zero, zero, F.col("n") == 0))


def _ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256) of the conversations (depth, x1, x2, conv) that end at a node.

    A list is made of the pieces that the tasks of a sort by conversation
    give, and hashed as a stream: no list is ever held whole.
    """
    ordered = ends.repartitionByRange("conv").sortWithinPartitions("conv").withColumn("at", F.monotonically_increasing_id())
    kinds = T.StructType().add("depth", "long").add("x1", "long").add("x2", "long")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                by = pdf.groupby(KEY, sort=False)
                yield by.agg(at=("at", "min"), ids=("conv", lambda s: ",".join(map(str, s)))).reset_index()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for *now, ids in zip(*(batch.column(c).to_pylist() for c in [*KEY, "ids"]), strict=True):
                if now == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256(ids.encode())
            yield _digest_batch(done)
        if key is not None:
            yield _digest_batch([(*key, state.hexdigest())])

    made = ordered.mapInPandas(pieces, T.StructType(list(kinds)).add("at", "long").add("ids", "string"))
    return made.repartition(*KEY).sortWithinPartitions(*KEY, "at").mapInArrow(hashed, T.StructType(list(kinds)).add("ends_sha256", "string"))


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, "int64") for c in columns[:3]] + [pa.array(columns[3], "string")], names=[*KEY, "ends_sha256"])


def next_siblings(nodes: DataFrame) -> DataFrame:
    """(node, sibling): the next child of the same parent, in the order of their conversations."""
    ordered = _in_order(nodes.filter("parent IS NOT NULL").select("parent", "conv_id", "node"), "at", F.col("parent").asc(), F.col("conv_id").asc(), name="trie-siblings")
    rows = ordered.withColumn("part", _part("at"))
    within = Window.partitionBy("part").orderBy("at")
    here = rows.select("part", "parent", "node", F.lead("parent").over(within).alias("next_parent"), F.lead("node").over(within).alias("next"))
    firsts = rows.groupBy("part").agg(F.min_by(F.struct("parent", "node"), "at").alias("head"))
    after = firsts.select("part", F.lead("head").over(Window.orderBy("part")).alias("after"))           # a row a task
    found = here.join(F.broadcast(after), "part")
    parent, sibling = F.coalesce("next_parent", "after.parent"), F.coalesce("next", "after.node")
    return found.filter(parent == F.col("parent")).select("node", sibling.alias("sibling"))


def _contract(table: pa.Table) -> pa.Table:
    """The arcs of one block with their first successor outside it (null: the end of the list) and the steps to it."""
    arc, succ = table["arc"].to_numpy(), table["succ"].fill_null(-1).to_numpy()
    order = np.argsort(arc)
    arc, succ = arc[order], succ[order]
    at = np.clip(np.searchsorted(arc, succ), 0, len(arc) - 1)
    inside = arc[at] == succ
    jump, steps = np.where(inside, at, np.arange(len(arc))), np.where(inside, 1, 0)
    while True:                                                 # the arcs that leave the block are their own goal
        further = steps[jump]
        if not further.any():
            break
        steps, jump = steps + further, jump[jump]
    out = succ[jump]
    return pa.table({"arc": arc, "out": pa.array(out, "int64", mask=out < 0), "steps": pa.array(steps + (out >= 0), "int64")})


def rank_list(arcs: DataFrame, n_arcs: int) -> DataFrame:
    """(arc, rank): the steps from each arc to the end of the list that (arc, succ) is; succ is null at its end."""
    schema = T.StructType().add("arc", "long").add("out", "long").add("steps", "long")
    local = stored(arcs.groupBy(F.shiftright("arc", BLOCK_BITS + 1).alias("block")).applyInArrow(_contract, schema), "trie-local")
    entered = local.select(F.col("out").alias("arc")).filter("arc IS NOT NULL").distinct()
    jumps = stored(local.join(entered, "arc", "left_semi"), "trie-jumps")
    for _ in range(max(0, math.ceil(math.log2(max(1, jumps.count()))))):
        ahead = jumps.filter("out IS NOT NULL").select("out").join(jumps.select(F.col("arc").alias("out"), F.col("out").alias("far"), F.col("steps").alias("more")), "out")
        moved = jumps.join(ahead, "out").select("arc", F.col("far").alias("out"), (F.col("steps") + F.col("more")).alias("steps"))
        now = stored(moved.union(jumps.filter("out IS NULL").select("arc", "out", "steps")), "trie-jumps")
        discard(jumps)
        jumps = now
    to_end = jumps.select(F.col("arc").alias("out"), F.col("steps").alias("more"))
    ranked = stored(local.join(to_end, "out", "left").select("arc", (F.col("steps") + F.coalesce("more", F.lit(0))).alias("rank")), "trie-ranks")
    discard(local, jumps)
    return ranked


def subtree_sums(nodes: DataFrame, n_nodes: int) -> DataFrame:
    """(node, n_leaves, saved): sums over the subtrees of (node, parent, first_child, sibling, leaf, gain)."""
    node, enter, leave = F.col("node"), F.col("node") * 2, F.col("node") * 2 + 1
    into = nodes.select(enter.alias("arc"), F.coalesce(F.col("first_child") * 2, leave).alias("succ"))
    out_of = nodes.select(leave.alias("arc"), F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1).alias("succ"))
    ranked = rank_list(into.union(out_of), 2 * n_nodes)
    own = nodes.select(enter.alias("arc"), "leaf", "gain").union(nodes.select(leave, F.lit(0).cast("long"), F.lit(0).cast("long")))
    placed = ranked.join(own, "arc").withColumn("position", F.lit(2 * n_nodes - 1) - F.col("rank"))
    placed = stored(placed.withColumn("chunk", F.expr(f"position div {TOUR_CHUNK}L")), "trie-tour")
    upto = Window.partitionBy("chunk").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    chunks = placed.groupBy("chunk").agg(F.sum("leaf").alias("l"), F.sum("gain").alias("g"))
    earlier = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)                         # a row a chunk of the tour
    before = chunks.select("chunk", F.coalesce(F.sum("l").over(earlier), F.lit(0)).alias("l0"), F.coalesce(F.sum("g").over(earlier), F.lit(0)).alias("g0"))
    sums = placed.withColumns({"l": F.sum("leaf").over(upto), "g": F.sum("gain").over(upto)}).join(before, "chunk")
    sums = sums.select(F.expr("arc div 2").alias("node"), "leaf", "gain", (F.col("l") + F.col("l0")).alias("l"), (F.col("g") + F.col("g0")).alias("g"))
    # the sum up to the exit less that up to the enter arc, which holds the node's own
    made = stored(sums.groupBy("node").agg((F.max("l") - F.min("l") + F.max("leaf")).alias("n_leaves"), (F.max("g") - F.min("g") + F.max("gain")).alias("saved")), "trie-sums")
    discard(ranked, placed)
    return made


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a node: conv_id (its smallest member), depth, parent_conv_id
    (null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are integers.  Null roles and texts are empty ones; turns
    are ordered null first, turns of one number (or without) by a digest of
    role and text, and repeated rows are turns of their own.  Rows without
    conversation belong to none and are left out.  Conversations and lists of
    members of any length are spread over tasks or streamed.  An empty table
    has no node, not even a root.  Further columns are left out, so their
    names cannot clash.
    """
    turns, convs = rebuilt_turns(turn_digests(conversations, conv_col, turn_col, role_col, text_col))
    made = stored(prefixes(turns, convs), "trie-prefixes")
    groups = made.groupBy(*KEY).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("size").alias("size"))
    groups = _in_order(groups, "node", F.col("conv_id").asc(), F.col("depth").asc(), name="trie-groups")
    above = groups.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    linked = stored(groups.join(above, ["depth", "p1", "p2"], "left"), "trie-linked")
    children = linked.filter("parent IS NOT NULL").groupBy("parent").agg(F.min_by("node", "conv_id").alias("first_child"), F.count("*").alias("n_children"))
    nodes = linked.join(children.withColumnRenamed("parent", "node"), "node", "left").join(next_siblings(linked), "node", "left")
    nodes = nodes.withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("long")), "gain": (F.col("n_convs") - 1) * F.col("size")})
    nodes = stored(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")), "trie-nodes")
    sums = subtree_sums(nodes, nodes.count())
    ends = stored(_ends_digests(made.filter("ends").select(*KEY, "conv")), "trie-ends")
    discard(turns, convs, made, groups, linked)
    none = hashlib.sha256(b"").hexdigest()
    return nodes.join(sums, "node").join(ends, KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
