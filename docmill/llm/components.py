"""Connected components of a table of links, by alternating large stars and small stars.

Each round is two joins and two groupings with map-side minima, so that no group of links comes together in one task;
rounds grow with the logarithm of the longest chain. Nodes are longs. Steps take as many tasks as the links need, so
that few links don't leave a file of each shuffle for each of many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.session import checkpointed


#: Links that one task takes.
TASK = 20_000


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each node of ``links`` that isn't the smallest of its component; root is the smallest."""
    big, small = F.greatest(a, b), F.least(a, b)
    links = links.filter(F.col(a) != F.col(b)).select(big.alias("u"), small.alias("v")).distinct()
    links = checkpointed(links)
    mark = _mark(links)
    few = 1 + mark[0] // TASK  # links never become more
    links = links.coalesce(few)
    while mark[0]:
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(few).distinct()
        large = checkpointed(large.coalesce(few))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
        links = checkpointed(pairs.select("col.u", "col.v").filter("u <> v").coalesce(few).distinct().coalesce(few))
        before, mark = mark, _mark(links)
        if before == mark:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
