"""Distributed connected components by alternating star operations.

Large-star links every larger neighbour of a node to the smallest node around
it, small-star does the same with the smaller neighbours; edges only ever move
towards the component's minimum, and the number of rounds grows with the
logarithm of the component's size. A hub is never gathered in one task: its
minimum is a combining aggregate written as a table of its own, and the join
that hands it back runs between two plain exchanges, which the session's skew
handling may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("hi", "lo")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v): u is the centre."""
    least = materialize(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")
    if large:
        least = least.withColumn("m", F.least("u", "m"))
    met = pairs.join(least, "u")
    if large:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        out = met.select(F.col("v").alias("hi"), F.col("m").alias("lo")).union(met.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
    done = materialize(out.where("hi != lo").distinct(), "star")
    discard(least)
    return done


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of the edge columns u and v.

    Null ends are dropped, loops make a node its own component, repeated edges count once.
    """
    given = edges.select("u", "v").where("u is not null and v is not null")
    loops = given.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    now = materialize(given.where("u != v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        larger = _star(both, large=True)
        after = _star(larger.select(F.col("hi").alias("u"), F.col("lo").alias("v")), large=False)
        discard(now)
        discard(larger)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    nodes = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    return nodes.union(roots).union(loops).groupBy("node").agg(F.min("component").alias("component"))
