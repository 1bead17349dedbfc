"""Connected components of an edge table, as DataFrame operations.

Both ways hold one row an edge and aggregate before they shuffle, and each
round is written to the shared folder, which cuts the lineage.  Every join
has an exchange on both sides, so adaptive execution can split a node that
has a large share of the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritext.llm.shared import discard, stored


def _state(df: DataFrame) -> tuple:
    """Row count and an order-free checksum."""
    return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64(*df.columns)), F.bit_xor(F.xxhash64(F.lit(1), *df.columns))).head())


def star_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node of its component) for every node
    of ``edges`` (u, v), by alternating large-star and small-star.

    Large-star links every larger neighbour of a node to the smallest node
    around it, small-star does so with the smaller neighbours and the node.
    Rounds go on until the edges no longer change.  Self-links and repeated
    edges are of no effect; no edges give no rows.
    """
    u, v = F.col("u"), F.col("v")
    now = stored(edges.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "cc-edges")
    before, state = None, _state(now)
    while state != before and state[0]:
        both = now.select("u", "v").union(now.select(v.alias("u"), u.alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("w")).select(u.alias("n"), F.least("u", "w").alias("m")), "cc-min")
        large = stored(both.filter(v > u).join(least, u == F.col("n")).filter(v != F.col("m"))
                       .select(v.alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        lower = stored(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n"), "cc-min")
        small = (large.join(lower, u == F.col("n")).filter(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
                 .union(lower.select("n", "m")).distinct())
        last, now = now, stored(small, "cc-edges")
        discard(last, least, large, lower)
        before, state = state, _state(now)
    leaves = now.select(u.alias("node"), v.alias("component"))
    return leaves.union(now.select(v.alias("node"), v.alias("component")).distinct())


def union_find(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node of its component) for every node
    of ``edges`` (u, v), by distributed union-find.

    Every node hooks onto its smallest neighbour if that is smaller, pointers
    are halved until all point to a root, and the edges are carried over to
    the roots, until none joins two roots.  Self-links and repeated edges are
    of no effect; no edges give no rows.
    """
    u, v = F.col("u"), F.col("v")
    edges = stored(edges.filter(u != v).select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct(), "uf-edges")
    found, held = None, None                                    # held: the table that found reads
    while not edges.isEmpty():
        both = edges.select("u", "v").union(edges.select(v.alias("u"), u.alias("v")))
        table = stored(both.groupBy("u").agg(F.min("v").alias("v")).select(u.alias("node"), F.least("u", "v").alias("root")), "uf-roots")
        roots = table
        while True:
            upper = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
            halved = stored(roots.join(upper, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "uf-roots")
            discard(table)
            table, roots = halved, halved.select("node", "root")
            if halved.filter("moved").isEmpty():
                break
        of = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))  # noqa: E731, B023
        last, edges = edges, stored(edges.join(of("u"), "u").join(of("v"), "v").filter(F.col("u_root") != F.col("v_root"))
                                    .select(F.least("u_root", "v_root").alias("u"), F.greatest("u_root", "v_root").alias("v")).distinct(), "uf-edges")
        discard(last)
        if found is None:
            found, held = roots.withColumnRenamed("root", "component"), table
        else:
            over = roots.select(F.col("node").alias("component"), "root")
            made = stored(found.join(over, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "uf-found")
            discard(held, table)
            found = held = made
    return found if found is not None else edges.select(u.alias("node"), v.alias("component"))
