"""Connected components of a graph whose links lie in a table.

Large-star and small-star steps in turn (Kiveris et al., "Connected components in MapReduce
and beyond") until no link changes, which takes few rounds (at most the square of the logarithm
of a component's members).  Every step is a hash aggregation and a join over links;
the links stay in tables on shared storage, and the driver sees one count a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import discard, written


SALTS = 8


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (large: the greater ones; small: the lesser ones, and itself) are
    linked to the least node around it."""
    if large:
        both = links.union(links.select(F.col("b"), F.col("a"))).toDF("a", "b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        near = both.where("b > a")
    else:
        near = links  # a > b
        least = links.groupBy("a").agg(F.min("b").alias("m"))
    # A centre's neighbours are dealt to several tasks; each gets the centre's least node.
    near = near.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    least_of = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    linked = near.join(least_of, ["a", "salt"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        linked = linked.union(least.select("a", "m"))
    return linked.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, label: of each node of a link its component's least node.  links: columns a and b."""
    links = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        links, old = written(_star(_star(links, True), False)), links
        discard(old)
        # Equal sums of hashes of all links: nothing has changed.
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).union(links.select("b", "b").distinct())
