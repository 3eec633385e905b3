"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import written


def _mark(links: DataFrame) -> tuple:
    """Number and hash of a set of links: one row, whatever the size."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link, root the smallest node of its component.

    ``links`` has columns a and b of one sortable type. Alternates two rounds until nothing
    changes: link a node's larger neighbours to its smallest one, then its smaller neighbours to
    their smallest. Each round keeps at most one link per node and link end, so the table never
    grows, and the number of rounds follows the logarithm of the number of nodes. Rounds are
    written to the shared folder and survive lost executors. The smallest neighbour comes from a
    partial aggregate, so a node with many links is no hot group.
    """
    now = written(links.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(now)
    while True:
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "links")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(down, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(down.select("a", F.col("m").alias("b")))
        new = written(small.where("a <> b").distinct(), "links")
        new_mark = _mark(new)
        if new_mark == mark:
            break
        now, mark = new, new_mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
