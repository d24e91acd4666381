"""Connected components by alternating large and small stars, on tables alone.

Nulls: a link with a null end links nothing. Repeated links and links of a key with itself
change nothing; no links give no rows. The stars are repeated until they stand still,
however often that takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash


def large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the least of it and its neighbours."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def small_star(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of these."""
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def mark(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(links: DataFrame) -> DataFrame:
    """key, root of every node that has a link: the least key that it reaches. links: a, b."""
    e = stash(links.where("a <> b").select("a", "b").distinct(), "components")
    last, now = None, mark(e)
    while now != last:
        before, e = e, stash(small_star(large_star(e)), "components")
        discard(before)
        last, now = now, mark(e)
    roots = e.select(F.col("b").alias("key"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("key"), F.col("b").alias("root")).unionByName(roots)
