"""Connected components of a table of links, and the pieces that pair operators need around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.sinks import scratch, stage

#: Rows of a table of ids that may be broadcast: some 20 MB. Larger tables are joined by a shuffle.
BROADCAST_ROWS = 1 << 20


def sized(df: DataFrame) -> DataFrame:
    """``df`` (a few numbers a row) with a broadcast hint if its counted rows are within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class Forest:
    """Disjoint sets of small numbers, for the links seen inside one task."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        """False if the two were in one set already."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of ``links`` (a, b).

    Large and small stars alternate until nothing moves; rounds grow with the logarithm of the longest
    chain. Every round is an aggregate with map-side combine and a join, written to the shared folder, so
    a lost executor costs one round at most. Nothing but two numbers a round reaches the driver.
    """
    with scratch(links.sparkSession):
        edges = stage(
            links.filter(F.col("a") != F.col("b"))
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .distinct(),
            "links",
        )
        before = None
        while True:
            now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if tuple(now) == before or now[0] == 0:
                break
            before = tuple(now)
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
            large = (
                both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
                .filter(F.col("a") != F.col("b")).distinct()
            )
            large = stage(large, "large-star")
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            small = (
                large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                .unionByName(least.select("a", F.col("m").alias("b")))
                .filter(F.col("a") != F.col("b")).distinct()
            )
            edges = stage(small, "small-star")
        found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        tops = edges.select(F.col("b").alias("node")).distinct()
        return stage(found.unionByName(tops.select("node", F.col("node").alias("component"))), "components", keep=True)
