"""Connected components of a table of links, by repeated joins; nothing but counts comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._shared import discard, saved, spread_join


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of links (a, b): root is the smallest node that links reach.

    Large-star and small-star steps in turn: each links a node's neighbours to the smallest of them, until the links
    are stars.  A hot node only has a minimum taken over its links, which is formed before the shuffle.
    """
    now = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    digest = lambda df: tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())  # noqa: E731  of a set of links
    after = digest(now)
    while True:
        both = now.select(F.col("v").alias("node"), F.col("u").alias("other")).union(now.select(F.col("u").alias("node"), F.col("v").alias("other")))
        least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
        large = saved(
            spread_join(both.filter("other > node"), least, ["node"], ["other"]).select(F.col("other").alias("u"), F.col("least").alias("v")).distinct(),
            "links"
        )
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        met = spread_join(large, least, ["u"], ["v"])
        small = met.select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v").union(least.select("u", F.col("least").alias("v"))).distinct()
        small = saved(small, "links")
        discard(now, large)
        before, after, now = after, digest(small), small
        if before == after:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
