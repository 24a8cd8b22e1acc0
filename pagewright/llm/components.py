"""Connected components of a table of links, by alternating large and small stars.

Each round points every node's larger neighbours, then its smaller ones, at the least
node in reach, until the links are stars around the least node of each component; that
takes a number of rounds in the order of the logarithm of the longest path.  Links never
leave the executors: a round is two aggregations (combined before the shuffle) and two
joins, and its result is a table in the shared folder, so lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import remove, written


ROWS = 100_000  # links that one task handles, at least where there are so many


def _dealt(df: DataFrame, rows: int) -> DataFrame:
    """df in no more partitions than its rows are worth."""
    return df.coalesce(-(-max(rows, 1) // ROWS))


def _kept(edges: DataFrame) -> tuple[DataFrame, str, tuple]:
    """edges as a written table, its path, and a state that tells whether it changed: number of links and sum of their hashes."""
    seen = Observation()
    counted = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h"))
    table, path = written(counted, "links")
    return table, path, (seen.get["n"], seen.get["h"])


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable, for every node in a link to another.

    Null ends and links of a node to itself are left out; repeated links do no harm.
    """
    spark = links.sparkSession
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null and u <> v")
    edges, path, state = _kept(pairs.distinct())
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every link is now (larger, smaller)
        small_least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        met = large.join(small_least, F.col("u") == F.col("k"))
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(small_least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
        after, after_path, now = _kept(_dealt(small, state[0]))
        remove(spark, path)
        edges, path = after, after_path
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
