"""Connected components by alternating large-star and small-star, and splits that keep them whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tagweave.operators.selection import uniform
from tagweave.plans.runtime import Scratch

#: Edges of one node from which its smallest neighbour travels by broadcast instead of through the shuffle.
HOT_EDGES = 1_000_000
#: At most so many nodes are hot; the limit above rises with the number of edges until that holds.
MOST_HOT = 256
#: Hash ranges into which components fall before the ranges are dealt to splits.
RANGES = 4096


def _give_smallest(edges: DataFrame, total: int) -> DataFrame:
    """``edges(u, v)`` with ``m``, the smallest of ``u`` and its neighbours in ``edges``.

    The minimum is pre-aggregated before the shuffle. A node with more than a fixed share of the edges
    can't overload the join's task: at most MOST_HOT such nodes exist, and theirs is a broadcast join.
    """
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    smallest = smallest.select("u", F.least("u", "m").alias("m"), "n")
    limit = max(HOT_EDGES, 2 * total // MOST_HOT)
    if 2 * total <= limit:  # no node can have that many
        return edges.join(smallest.drop("n"), "u")
    hot = smallest.where(F.col("n") > limit).drop("n").collect()
    if not hot:
        return edges.join(smallest.drop("n"), "u")
    hot_rows = edges.sparkSession.createDataFrame([tuple(x) for x in hot], "u long, m long")
    keys = F.col("u").isin([x.u for x in hot])
    return (
        edges.where(~keys).join(smallest.drop("n").where(~keys), "u")
        .unionByName(edges.where(keys).join(F.broadcast(hot_rows), "u"))
    )


def _signature(edges: DataFrame) -> tuple:
    """Count and order-free checksums of an edge table."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())


def connected_components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """``(node long, component long)`` of every node in ``edges(u long, v long)``.

    Large-star links each node's larger neighbours to its smallest one, small-star its smaller
    neighbours; alternated until nothing changes, each component becomes a star around its smallest
    node. No neighbour list is ever held in memory. Self-loops give a component of one; rows with a
    null end are ignored; an empty table gives an empty result.
    """
    edges = edges.where("u is not null and v is not null")
    ends = scratch.keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    alone = ends.where("u = v").select(F.col("u").alias("node"))
    current, before, written = ends.where("u <> v"), _signature(ends), None
    for _ in range(most_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _give_smallest(both, 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = _give_smallest(large, 2 * before[0])
        small = (
            pairs.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct()
        )
        current = scratch.keep(small)
        after = _signature(current)
        if written is not None:
            scratch.drop(written)
        written = current
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    # what isn't a member of a star is its centre, or stands alone
    centres = current.select(F.col("v").alias("node")).unionByName(alone).distinct().join(members.select("node"), "node", "left_anti")
    return members.unionByName(centres.select("node", F.col("node").alias("component")))


def proportional_splits(groups: DataFrame, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """``groups(group_id, n_rows)`` with ``split``: whole groups, the rows in the given proportions.

    The group's hash decides its place among RANGES ranges; the ranges, in order, are dealt to the
    splits so that each gets its share of the rows. The same group, seed and table always give the same
    split. Shares that don't add up to 1 are scaled; a group larger than a share stays whole.
    """
    spark = groups.sparkSession
    placed = groups.withColumn("place", F.floor(uniform(seed, F.col("group_id")) * RANGES).cast("int"))
    weight = {r.place: r.n for r in placed.groupBy("place").agg(F.sum("n_rows").alias("n")).collect()}  # RANGES rows at most
    total, names = sum(weight.values()), list(shares)
    scale = total / sum(shares.values()) if total else 0
    ends, passed = [], 0.0
    for name in names:
        passed += shares[name] * scale
        ends.append(passed)
    dealt, running = [], 0
    for place in range(RANGES):
        middle = running + weight.get(place, 0) / 2
        running += weight.get(place, 0)
        dealt.append((place, names[next((i for i, end in enumerate(ends) if middle < end), len(names) - 1)]))
    of_place = spark.createDataFrame(dealt, "place int, split string")
    return placed.join(F.broadcast(of_place), "place").drop("place")
