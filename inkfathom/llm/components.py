"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: longs, any order, repeats and loops allowed) to (node, component): the smallest node reachable, for
    every node of an edge but those that are their component's smallest.

    Each step sends every larger end to the smallest node known next to the smaller end (large star), then every node's
    smaller neighbours to the smallest of them (small star). Minima are summed before the shuffle and only changed ones
    are joined, so a node with very many neighbours is neither collected nor a hot key of the smaller side.
    """
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    current = written(edges.filter("a != b").select(hi, lo).distinct(), "edges")
    while True:
        best = written(current.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n")), "best")
        moved = best.select(F.col("hi").alias("_u"), F.col("m").alias("_m"))
        large = current.join(moved, current.lo == F.col("_u"), "left")
        large = written(large.select("hi", F.coalesce("_m", "lo").alias("lo"), F.col("_m").isNotNull().alias("moved")), "large")
        dropped(current)
        neighbours = best.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        if neighbours <= 1 and large.filter("moved").isEmpty():
            dropped(large)
            return best.select(F.col("hi").alias("node"), F.col("m").alias("component"))
        pairs = large.select("hi", "lo").distinct()
        least = written(pairs.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n")), "least")
        many = least.filter("n > 1").select(F.col("hi").alias("_u"), F.col("m").alias("_m"))
        small = pairs.join(many, pairs.hi == F.col("_u")).filter("lo != _m").select(F.col("lo").alias("hi"), F.col("_m").alias("lo"))
        current = written(least.select("hi", F.col("m").alias("lo")).union(small).distinct(), "edges")
        dropped(best, large, least)


class Forest:
    """Union-find over a group's nodes, and the edges that joined two trees."""

    def __init__(self):
        self.parent: dict = {}
        self.edges: list[tuple] = []

    def find(self, x):
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while (up := self.parent.get(x, x)) != root:
            self.parent[x], x = root, up
        return root

    def join(self, a, b, edge: bool = True) -> bool:
        x, y = self.find(a), self.find(b)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        if edge:
            self.edges.append((a, b))
        return True
