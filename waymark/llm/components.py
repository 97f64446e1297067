"""Connected components of a graph of links, as aggregates and joins."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from waymark.llm.common import cut, drop

#: Links that a task holds at a time when it joins those of its own.
HELD = 500_000


def _own_stars(links: DataFrame) -> DataFrame:
    """u, v: stars that join the same nodes as the links (a, b) of each task do, HELD links at a time."""

    def stars(parent: dict[int, int]) -> pa.RecordBatch:
        u = [x for x in parent if parent[x] != x]
        for x in u:
            r = x
            while parent[r] != r:
                r = parent[r]
            while parent[x] != r:
                parent[x], x = r, parent[x]
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array([parent[x] for x in u], pa.int64())], names=["u", "v"])

    def run(batches):
        parent: dict[int, int] = {}
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = parent.setdefault(a, a), parent.setdefault(b, b)
                while parent[a] != a:
                    parent[a] = a = parent[parent[a]]
                while parent[b] != b:
                    parent[b] = b = parent[parent[b]]
                parent[max(a, b)] = min(a, b)
            if len(parent) > HELD:
                yield stars(parent)
                parent = {}
        yield stars(parent)

    return links.select("a", "b").mapInArrow(run, "u long, v long")


def _only_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("n"), F.lit(False).alias("centre")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("n"), F.lit(True).alias("centre")))
    per = ends.groupBy("x").agg(F.sum("n").alias("n"), F.max("centre").alias("centre"))
    return not per.agg(F.max((F.col("n") > 1) | ((F.col("n") > 0) & F.col("centre")))).head()[0]


def components(links: DataFrame) -> DataFrame:
    """node, component for every node of links (a, b): the smallest node that is reachable.

    Each task first makes stars of its own links. Then large stars and small stars by turns: every node sends its
    neighbours beyond it, and then those before it and itself, to its smallest neighbour, until only stars around the
    smallest nodes are left. Each turn is a minimum by key with partial sums and a join, of which a very large star is
    split at run time. The number of turns grows with the logarithm of the longest path. Each turn's links go to the
    shared folder, and go from there when the next one's are written.
    """
    edges = cut(_own_stars(links).distinct())
    while not _only_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        last, edges = edges, cut(small)
        drop(last)
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._folder = edges._folder
    return out
