"""Lineage: claims that hold only if all they are derived from hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.session import checkpoint


def held_claims(df: DataFrame, id: str, parent: str, holds: Column) -> DataFrame:
    """(id, state, hops, first_broken): the state of each node of a forest of parent links.

    `holds`: the node and all its ancestors hold; `broken`: one does not, the nearest of them (the node itself included)
    is first_broken; `missing`: the chain ends at a parent that is no node; `cycle`: it never ends. hops counts links to
    the end of the chain, null for a cycle. Rows without an id are left out; rows that repeat an id are one node, which
    holds if all of them do, with the smallest parent. A test that is null does not hold.

    Pointers double: each round a node takes over what its pointer's node knows, so a chain of d links takes about
    log2(d) rounds. If no node ends in a round, no later one would (an unended chain of d links has ended ancestors of
    every smaller length), so what is left leads into cycles. Nodes that have ended are joined no more; the lineage of
    the plan is cut by a checkpoint a round. A node with very many children is one row of the side that is looked up.
    """
    test = F.coalesce(holds, F.lit(False))
    base = df.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.min(parent).alias("p"), F.min(test).alias("ok"))
    known = base.select(F.col("id").alias("k"))
    first = base.join(known, F.col("p") == F.col("k"), "left").select(
        "id",
        F.col("k").alias("up"),
        F.when(F.col("k").isNotNull(), 1).otherwise(0).cast("long").alias("hops"),
        F.when(~F.col("ok"), F.col("id")).alias("bad"),
        (F.col("p").isNotNull() & F.col("k").isNull()).alias("lost"),
    )
    state = checkpoint(first)
    open_before = state.where("up is not null").count()
    while open_before:
        look = state.select(F.col("id").alias("k"), F.col("up").alias("u"), F.col("hops").alias("h"), F.col("bad").alias("b"), F.col("lost").alias("l"))
        moved = state.where("up is not null").join(look, F.col("up") == F.col("k")).select(
            "id", F.col("u").alias("up"), (F.col("hops") + F.col("h")).alias("hops"), F.coalesce("bad", "b").alias("bad"), F.col("l").alias("lost")
        )
        state = checkpoint(state.where("up is null").unionByName(moved))
        open_now = state.where("up is not null").count()
        if open_now == open_before:
            break
        open_before = open_now
    name = F.when(F.col("up").isNotNull(), "cycle").when(F.col("lost"), "missing").when(F.col("bad").isNotNull(), "broken").otherwise("holds")
    ended = F.col("up").isNull()
    return state.select(F.col("id").alias(id), name.alias("state"), F.when(ended, F.col("hops")).alias("hops"), F.when(name == "broken", F.col("bad")).alias("first_broken"))


def gate(claims: DataFrame, group: str) -> DataFrame:
    """(group, n, held, passes): a group of claims passes only if each of them holds; claims(group, state)."""
    return claims.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col("state") == "holds").alias("held")).withColumn("passes", F.col("n") == F.col("held"))
