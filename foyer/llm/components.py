"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foyer.llm.common import store


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links(a, b) of comparable ids as node, component (the smallest id reachable); nodes without links are absent.

    Large-star and small-star rounds: each replaces links by links to the smallest
    neighbor, until nothing changes (a logarithmic number of rounds).  Smallest
    neighbors are aggregates with a partial step and come back by a join that Spark
    can split, so a node with very many links isn't gathered anywhere.  Every round
    is written to the shared folder.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:  # both directions; larger neighbors move to the smallest
            both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:  # a is the larger end
            both = edges.select("a", "b")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = both.join(least, "a")
        if large:
            out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.filter(F.col("a") != F.col("b")).distinct()

    edges = store(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    for _ in range(rounds):
        edges = store(star(star(edges, True), False), "links")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("x")).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
