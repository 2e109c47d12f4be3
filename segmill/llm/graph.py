"""Connected components of a graph that is spread over the cluster, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm.common import delete_folder, lookup, written


def _with_least(edges: DataFrame, by: str, other: str, total: int) -> DataFrame:
    """The edges with `least`, the smallest `other` of all edges with the same `by`."""
    return lookup(edges, edges.groupBy(by).agg(F.min(other).alias("least"), F.count("*").alias("n")), by, "n", total)


def _state(edges: DataFrame) -> tuple[int, int]:
    n, h = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("hi", "lo") % (1 << 40)), F.lit(0))).first()
    return n, h


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root, the smallest node of its component, for every node of the edges that isn't a root.

    Each round rewrites the edges (hi, lo), lo < hi, and writes them to the shared folder; the tables of the round before are
    deleted then. In a large star, every larger neighbour of a node is linked to the node's smallest one; in a small star,
    every smaller one is. The rounds end when a round changes nothing: each node is then linked to its root alone. A node
    with many edges is looked up by broadcast, so its edges stay where they are.
    """
    spark = edges.sparkSession
    hi, lo = F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    edges, path = written(edges.where(F.col(a) != F.col(b)).select(hi, lo).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        # large star: lo's smallest neighbour is the smallest of its smaller ones, if it has any
        below = edges.groupBy(F.col("hi").alias("lo")).agg(F.min("lo").alias("least"))
        count = edges.groupBy("lo").agg(F.count("*").alias("n"))
        large = lookup(edges, count.join(below, "lo"), "lo", "n", state[0])
        large, old = written(large.select("hi", F.coalesce("least", "lo").alias("lo")).distinct(), "edges")
        delete_folder(spark, path)
        # small star
        small = _with_least(large, "hi", "lo", state[0])
        small = small.select(F.explode(F.array(F.struct("hi", F.col("least").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("least").alias("lo")))).alias("e"))
        edges, path = written(small.select("e.*").where("hi <> lo").distinct(), "edges")
        delete_folder(spark, old)
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
