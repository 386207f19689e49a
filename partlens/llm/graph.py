"""Connected components by alternating large and small stars, each round written to shared storage.

A hub with very many neighbours is never gathered: where one has more than HUB, each node's edges are dealt into as many
parts as that takes, minima are taken by part, then over the parts, and go back to (node, part). Rounds grow with the
logarithm of the longest chain; of the tables of the rounds only the last one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


#: Edges of a node that a task gets at most, about: a node with more has them dealt into parts.
HUB = 100_000


def _least(edges: DataFrame, parts: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """The edges, for each node (and part) its least neighbour, and the columns to join them by."""
    if parts == 1:
        return edges, edges.groupBy("a").agg(F.min("b").alias("m")), ["a"]
    dealt = edges.withColumn("part", F.expr(f"pmod(xxhash64(b), {parts})"))
    own = dealt.groupBy("a", "part").agg(F.min("b").alias("m"))
    return dealt, own.select("a", "part").join(own.groupBy("a").agg(F.min("m").alias("m")), "a"), ["a", "part"]


def _large(edges: DataFrame, parts: int) -> DataFrame:
    dealt, least, on = _least(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), parts)
    met = dealt.where("b > a").join(least, on)
    return met.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b")


def _small(edges: DataFrame, parts: int) -> DataFrame:
    dealt, least, on = _least(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), parts)
    met = dealt.join(least, on).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return met.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame):
    """What tells two rounds apart (number of edges and a sum over them), and the most edges that a node is the lesser end of."""
    own = edges.groupBy("b").agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"))
    return own.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("n").alias("hub")).first()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) pairs of long -> (node, root): the least node that each node with an edge is connected with.

    Loops (a = b) and null ends are ignored; an empty table gives no rows.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while before != (after := _state(now)):
        before, last, parts = after, now, 1 + int(after["hub"] or 0) // HUB
        now = written(_small(_large(now, parts), parts), name)
        dropped(last)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
