"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import join_groups, materialize, release


def connected_components(links: DataFrame) -> DataFrame:
    """v, component for each vertex of links (columns a, b, longs): the smallest vertex that links reach.

    Alternates large-star and small-star steps (each vertex hands its larger, then its smaller neighbours the smallest
    vertex it knows) until nothing changes: a logarithmic number of rounds, each of joins and groupings whose size is that
    of the links. Each round is written to the shared folder, and what it was made of is deleted. Vertices with many links are joined apart. Links with a null
    end and loops are ignored; repeated links count once; no links give no rows.
    """
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    edges = materialize(links.filter("a <> b").select(hi, lo).distinct(), "components-links")
    before = None
    while (now := _checksum(edges)) != before and now[0]:
        before = now
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "components-least")
        large = join_groups(both, least, "u", "n", now[0] * 2).filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = materialize(large.distinct(), "components-large")
        last = materialize(large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n")), "components-least")
        small = join_groups(large, last, "hi", "n", now[0]).filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = materialize(small.unionByName(last.select("hi", F.col("m").alias("lo"))).distinct(), "components-links")
        release(edges, least, large, last)
        edges = after
    return edges.select(F.col("hi").alias("v"), F.col("lo").alias("component")).unionByName(
        edges.select(F.col("lo").alias("v"), F.col("lo").alias("component")).distinct()
    )


def _checksum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return row["n"], int(row["s"])
