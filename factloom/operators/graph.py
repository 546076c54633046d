"""Blocked joins between records that share informative keys, their edges, and connected components."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def informative_keys(keys: DataFrame, key: str, item: str, low: int, high: int) -> DataFrame:
    """Rows of keys whose key has between low and high distinct items."""
    size = keys.groupBy(key).agg(F.countDistinct(item).alias("size")).filter(F.col("size").between(low, high))
    return keys.join(size, key)


def blocked_pairs(keys: DataFrame, key: str, item: str, low: int = 2, high: int = 20) -> DataFrame:
    """a < b, shared: pairs of items that share informative keys, with the number of keys.

    The upper bound on a key's size bounds the pairs it makes, whatever the skew.
    """
    k = informative_keys(keys.select(key, item).distinct(), key, item, low, high).select(key, item)
    other = k.withColumnRenamed(item, "b")
    return k.withColumnRenamed(item, "a").join(other, key).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def sharing_pairs(keys: DataFrame, key: str, item: str, bound: int | None = None) -> DataFrame:
    """a < b, shared: all pairs of items that share two keys or more, exactly, with the number of keys.

    Keys with more than bound items (max(20, sqrt(rows)) by default) never make pairs alone: they are counted in pairs that share
    another key, and two of them make pairs only of items that have both, which all belong to the result.
    """
    k = keys.select(F.col(key).alias("k"), F.col(item).alias("i")).filter("k is not null and i is not null").distinct()
    if bound is None:
        bound = max(20, int(keys.count() ** 0.5))
    size = k.groupBy("k").agg(F.count("*").alias("size"))
    over = F.broadcast(size.filter(F.col("size") > bound).select("k"))  # at most rows / bound
    small = k.join(over, "k", "left_anti")
    hot = k.join(over, "k").groupBy("i").agg(F.sort_array(F.collect_set("k")).alias("hot"))

    def pairs(rows, by):
        return rows.withColumnRenamed("i", "a").join(rows.withColumnRenamed("i", "b"), by).filter("a < b")

    two = hot.withColumn("k1", F.explode("hot")).withColumn("k2", F.explode("hot")).filter("k1 < k2").select("i", "k1", "k2")
    found = pairs(small, "k").select("a", "b", F.lit(1).alias("n")).union(pairs(two, ["k1", "k2"]).select("a", "b", F.lit(0).alias("n")))
    found = found.groupBy("a", "b").agg(F.sum("n").alias("n"))
    side = lambda x: hot.select(F.col("i").alias(x), F.col("hot").alias(f"hot_{x}"))
    found = found.join(side("a"), "a", "left").join(side("b"), "b", "left")
    both = F.when(F.col("hot_a").isNull() | F.col("hot_b").isNull(), 0).otherwise(F.size(F.array_intersect("hot_a", "hot_b")))
    return found.select("a", "b", (F.col("n") + both).alias("shared")).filter("shared >= 2")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the least node reachable) of an undirected graph given by a, b; by large and small stars."""
    spark = edges.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is to name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(at or "file://" + tempfile.mkdtemp(prefix="factloom-", dir=os.environ.get("TMPDIR")))
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    before = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hub = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        now = both.filter("v > u").join(hub, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        hub = now.groupBy("u").agg(F.min("v").alias("m"))
        now = now.join(hub, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct().checkpoint()
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
    raise RuntimeError("components: no fixed point")
