"""Connected components of a graph of links, by alternating large-star and small-star steps on tables.

A hub's smallest neighbour is found with partial sums, and its rows in the joins are those that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import dropped, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node sends its (larger, or smaller) neighbours to its smallest one.  Edges have u > v."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame, a: str, b: str) -> tuple[DataFrame, str]:
    """(node, component), as a table, and its path: for each node of a link the smallest node that links lead to.

    Links whose ends are equal or null are left out; no links give an empty table.
    """
    spark = links.sparkSession
    edges, path = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(f"{a} <> {b}").distinct(), "links")
    before = None
    while True:
        after, new = written(_star(_star(edges, True), False), "links")
        n, total = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(spark, path)
        edges, path = after, new
        if (n, total) == before:
            break
        before = (n, total)
    out, found = written(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct(), "components")
    dropped(spark, path)
    return out, found
