"""Connected components over links, by alternating large-star and small-star
steps (Kiveris et al., "Connected Components in MapReduce and Beyond").

Hubs are pre-aggregated before each shuffle (``min``).  The minima are joined
back right above their aggregate, so the links of one hub meet in one task;
writing the minima first would let adaptive execution split them, at the price
of three more jobs a round.  Every round is written to the shared folder; only
a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litgraph.llm.common import materialize


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.join(low, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, comp)`` for every node that occurs in a link with another one;
    ``comp`` is the smallest node reachable.  No links: no rows."""
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    last = None
    while True:
        e = materialize(_small_star(_large_star(e)), "components")
        sign = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == last or sign[0] == 0:
            break
        last = sign
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return stars.union(stars.select(F.col("comp").alias("node"), "comp").distinct())
