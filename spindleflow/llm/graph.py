"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindleflow.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """The smallest node that each linked node reaches: columns node, root.

    ``links`` has two columns of one orderable type. Alternating large-star and small-star steps move every node next to
    the smallest node it can see; stars of any size are handled by aggregates and joins, never gathered in a task. Each
    round is written to the shared folder, so a lost executor costs one round and the plan stays short. Rounds end when
    the links no longer change; their number grows with the logarithm of the longest chain.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = staged(edges, "links")
    seen = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("x"), F.least("v", "m").alias("y"))
        small = small.unionByName(low.select(F.col("u").alias("x"), F.col("m").alias("y")))
        edges = staged(small.where("x <> y").select(F.col("x").alias("u"), F.col("y").alias("v")).distinct(), "links")
        # A sum of hashes tells one set of links from another; it does not depend on their order.
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
