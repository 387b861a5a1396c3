"""Connected components over an edge table, by alternating star contraction.

Each round hooks every node to the smallest neighbour it knows (large star,
then small star), as joins and aggregated minima. Minima are taken over SALTS
parts of a node's neighbours before they meet, and the rows of nodes with many
neighbours are joined where they lie, so a node of any degree is never gathered
in one task. Nothing reaches the driver but one checksum per round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import written

SALTS = 32
#: Rows of a key from which on it is joined by broadcast, and most such keys: what is broadcast is bounded, since the counts add up to the total.
HOT, KEYS = 256, 100_000


def hot_join(big: DataFrame, small: DataFrame, on: list[str], n: Column, total: int, how: str = "inner") -> DataFrame:
    """big.join(small, on, how) without the shuffle of big's hot keys.

    small has one row per key; n is the key's number of rows in big, total
    their sum. Keys above max(HOT, total / KEYS) go out by broadcast. how:
    inner or left. small is written first, big is read up to three times.
    """
    small, least = written(small), max(HOT, total // KEYS)
    hot = small.where(n > least)
    if hot.isEmpty():
        return big.join(small, on, how)
    rest = big.join(F.broadcast(hot.select(*on)), on, "left_anti").join(small.where(n <= least), on, how)
    return big.join(F.broadcast(hot), on).unionByName(rest)


def _least(pairs: DataFrame) -> DataFrame:
    """(u, m, d): the smallest v of every u, and its rows."""
    salted = pairs.groupBy("u", F.pmod(F.hash("v"), F.lit(SALTS)).alias("s")).agg(F.min("v").alias("m"), F.count("*").alias("d"))
    return salted.groupBy("u").agg(F.min("m").alias("m"), F.sum("d").alias("d"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _least(both).select("u", F.least("u", "m").alias("m"), "d")
    return hot_join(both.where("v > u"), low, ["u"], F.col("d"), 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """edges: u > v."""
    low = _least(edges)
    hung = hot_join(edges, low, ["u"], F.col("d"), n)
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge other than itself.

    edges: pairs of long ids in any order; loops, repeats and nulls are
    ignored. Nodes that are the smallest of their component, and nodes without
    edges, have no row. An empty edge table gives an empty result.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = written(edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where(x.isNotNull() & y.isNotNull() & (x != y)).distinct())
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = mark
        now = written(_small_star(written(_large_star(now, mark[0])), mark[0]))
    raise RuntimeError(f"components: no fixed point within {max_rounds} rounds")
