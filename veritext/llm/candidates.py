"""Candidate pairs from bucket keys, as DataFrame operations.

A row (id, key) says that a node is in a bucket.  Buckets with one member are
dropped by an aggregate; the others' members are paired with centres, never
with each other as a whole: a group that holds a third of all nodes costs a
few rows a member.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritext.llm.shared import discard, stored

#: Buckets of at most this many members are also compared pair by pair.
SMALL_BUCKET = 24
#: Centres of a larger bucket.
CENTRES = 4


def ordered(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b).alias("u"), F.greatest(a, b).alias("v")


def members_of(keys: DataFrame) -> DataFrame:
    """(key, id, n): the members of buckets of n > 1 members."""
    buckets = stored(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "bucket")
    members = stored(keys.join(buckets, "key"), "member")
    discard(buckets)
    return members


def weights_of(members: DataFrame) -> DataFrame:
    """(id, weight): the sizes of a node's buckets, summed."""
    return stored(members.groupBy("id").agg(F.sum("n").alias("weight")), "weight")


def centres_of(members: DataFrame, weights: DataFrame) -> DataFrame:
    """(key, n, weight, centre): of each bucket the member of most weight, of a
    large bucket that of each of ``CENTRES`` parts.

    In a group of copies the text that most others come from is in the most
    and fullest buckets.
    """
    salt = F.when(F.col("n") > SMALL_BUCKET, F.pmod(F.xxhash64("id"), F.lit(CENTRES))).otherwise(F.lit(0))
    best = (members.join(weights, "id").groupBy("key", salt.alias("salt"))
            .agg(F.max(F.struct("weight", "id")).alias("best"), F.max("n").alias("n")))
    return stored(best.select("key", "n", "best.weight", F.col("best.id").alias("centre")), "centre")


def star_pairs(members: DataFrame, centres: DataFrame) -> DataFrame:
    """(u, v): each member with the centres of its buckets."""
    return (members.select("key", "id").join(centres.select("key", "centre"), "key").filter(F.col("id") != F.col("centre"))
            .select(*ordered("id", "centre")).distinct())


def labels_of(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(id, component) of every node, its own id where it has no link."""
    return stored(nodes.select("id").join(found.withColumnRenamed("node", "id"), "id", "left")
                  .select("id", F.coalesce("component", "id").alias("component")), "label")


def small_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members (key, and the columns of ``labels``) of small buckets that lie in different components."""
    small = members.filter(F.col("n") <= SMALL_BUCKET).select("key", "id").join(labels, "id")
    mixed = stored(small.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"))
                   .filter("a != b").select("key"), "mixed")
    found = stored(small.join(mixed, "key"), "small")
    discard(mixed)
    return found


def small_pairs(small: DataFrame, test: Column | None = None) -> DataFrame:
    """(u, v): all pairs of small buckets' members that lie in different components, if ``test`` holds for
    them; the other's columns have _b after their names."""
    b = small.select("key", *[F.col(c).alias(f"{c}_b") for c in small.columns if c != "key"])
    apart = (F.col("id") < F.col("id_b")) & (F.col("component") != F.col("component_b"))
    met = small.join(b, "key").filter(apart if test is None else apart & test)
    return met.select(F.col("id").alias("u"), F.col("id_b").alias("v")).distinct()


def outside(members: DataFrame, labels: DataFrame, centres: DataFrame) -> DataFrame:
    """(key, id, n, component, middle) of large buckets; middle is the
    component of the heaviest centre, and who has another is an outsider."""
    large = members.filter(F.col("n") > SMALL_BUCKET).join(labels, "id")
    middle = (centres.filter(F.col("n") > SMALL_BUCKET).join(labels.withColumnRenamed("id", "centre"), "centre").groupBy("key")
              .agg(F.max_by("component", F.struct("weight", "centre")).alias("middle")))
    middle = stored(middle, "middle")
    found = stored(large.join(middle, "key"), "large")
    discard(middle)
    return found
