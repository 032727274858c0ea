"""Connected components over a table of links, in rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrawl.session import cut_lineage


def _smallest(pairs: DataFrame) -> DataFrame:
    """Written, so that a node with very many neighbours is joined to plain rows and can be split."""
    return cut_lineage(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "smallest")


def components(links: DataFrame) -> DataFrame:
    """node, root for every node with a smaller node in its component; the root is the smallest.

    Each round links every node's larger neighbours to its smallest neighbour, then its smaller ones. The links
    are written each round; the driver only sees their number and a sum of hashes, which stop changing at the end.
    """
    links = links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links, before = cut_lineage(links, "links"), None
    while True:
        count, mark = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if count == 0 or (count, mark) == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = (count, mark)
        both = links.union(links.select("v", "u"))
        large = (both.join(_smallest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        large = cut_lineage(large, "large-stars")
        least = _smallest(large)
        small = (large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        links = cut_lineage(small, "small-stars")
