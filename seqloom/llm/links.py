"""Connected components of a table of links, with joins and partial aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import stored


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (id, root): every id that has a link, with the smallest id that it reaches.

    Alternates the large-star and small-star steps, which need a number of rounds that grows with the logarithm of the
    longest path; each round is written to the shared folder. A star's centre may hold any number of links: its
    minimum is taken by a partial aggregate, and the join back has one row per id on its other side, which adaptive
    execution splits where it is skewed."""
    up = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        # large star: neighbours above u point to u's smallest neighbour
        both = up.unionByName(up.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below u, and u, point to the smallest of them
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        up = stored(up.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct())
        now = up.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    # all links now go to a root, the smallest id of its component
    return up.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(up.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
