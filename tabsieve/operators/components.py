"""Connected components by alternating star contractions (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.session import materialise, spread_lookup


def connected_components(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest node id of each component: (keys, node) + (keys, u, v) -> (keys, node, comp).

    Each round costs two partial-aggregated minima; rounds grow with the logarithm
    of the component size, not its diameter. ``keys`` runs several graphs at once.
    """
    links = materialise(edges.where(F.col("u") != F.col("v"))
                        .select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or tuple(state) == seen:
            break
        seen = tuple(state)
        both = links.unionByName(links.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        # A component's smallest node gathers a large share of the links, hence the spread joins.
        low = both.groupBy(*keys, "u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("_rows"))
        large = (spread_lookup(both.where(F.col("v") > F.col("u")), low.drop("_rows"), [*keys, "u"], low.drop("m"), 2 * state[0])
                 .select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        parent = large.groupBy(*keys, "u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_rows"))
        small = (spread_lookup(large, parent.drop("_rows"), [*keys, "u"], parent.drop("m"), 2 * state[0])
                 .select(*keys, F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v"))
                 .where(F.col("u") != F.col("v")).distinct())
        links = materialise(small)
    best = links.groupBy(*keys, F.col("u").alias("node")).agg(F.min("v").alias("comp"))
    return (nodes.join(best, [*keys, "node"], "left")
            .withColumn("comp", F.coalesce("comp", "node")))
