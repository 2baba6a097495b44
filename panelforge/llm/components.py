"""Connected components of links by alternating large and small stars.

Each round lets every node point its larger neighbours, then its smaller ones, to the smallest
node it knows, and writes the new links to the shared folder. The rounds end when the links no
longer change; they then form one star per component. Nothing is collected but two counters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelforge.session import materialize


def _signature(links: DataFrame):
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node; ``links`` has two columns a and b of whole numbers.

    The root is the component's smallest node and has no row of its own.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    links = materialize(links.where("a != b").select(a.alias("a"), b.alias("b")).distinct())
    seen = _signature(links)
    while seen[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = materialize(moved.unionByName(small.select("a", F.col("m").alias("b"))).distinct())
        before, seen = seen, _signature(links)
        if seen == before:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
