"""Intervals by key: their union, and what it covers."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """key, low, high, n: the key's intervals [low, high) joined where they touch or overlap, with the number of each island's intervals.

    Intervals with a null or without length are left out; equal ones count each; a null key is a key. Intervals that are equal are
    counted before anything is sorted, so a third of all rows may repeat one interval.
    """
    some = df.filter(F.col(low) < F.col(high)).groupBy(key, low, high).agg(F.count("*").alias("n"))
    order = Window.partitionBy(key).orderBy(low, high)
    before = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = some.withColumn("new", F.when(before >= F.col(low), 0).otherwise(1))
    marked = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "island").agg(F.min(low).alias("low"), F.max(high).alias("high"), F.sum("n").alias("n")).drop("island")


def contained(points: DataFrame, spans: DataFrame, key: str, at: str) -> DataFrame:
    """points with the low and high of the span of their key that holds at ([low, high)), or nulls.

    spans do not overlap within a key, as those of islands: points and spans are sorted together, and a point takes the last span that starts
    by it. Points with a null key or place are in no span.
    """
    names = [c for c in points.columns if c != at]
    left = points.select(F.struct(*points.columns).alias("row"), F.col(key).alias("k"), F.col(at).alias("x"), F.lit(1).alias("kind"), F.lit(None).cast(spans.schema["high"].dataType).alias("stop"))
    right = spans.select(F.lit(None).cast(left.schema["row"].dataType).alias("row"), F.col(key).alias("k"), F.col("low").alias("x"), F.lit(0).alias("kind"), F.col("high").alias("stop"))
    last = Window.partitionBy("k").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("span", F.last(F.when(F.col("kind") == 0, F.struct(F.col("x").alias("low"), F.col("stop").alias("high"))), ignorenulls=True).over(last))
    inside = F.col("k").isNotNull() & (F.col("x") < F.col("span.high"))
    return both.filter("kind = 1").select(*(F.col(f"row.{c}") for c in (at, *names)), F.when(inside, F.col("span.low")).alias("low"), F.when(inside, F.col("span.high")).alias("high"))


def coverage(segments: DataFrame, sources: DataFrame, keys: list[str], width: int = 64) -> DataFrame:
    """id, n_sources, covered: each segment with the number of sources that overlap it in its artifact.

    Both have id, artifact, start, stop (last line; null: start) and the keys. Lines overlap at one line in common, and are not compared if
    a start is null; keys agree if equal or null on a side. If both have a line or key, one of those must be known on both sides.
    Rows with lines meet in blocks of `width` lines, where a pair is counted in the block of its later start, so a long artifact is
    spread over tasks and no pair is made twice; rows without a start meet by their artifact. Sources with equal fields are counted before
    they are joined. Null artifacts match nothing; a stop before its start overlaps nothing.
    """

    def side(df, tag):
        stop = F.coalesce("stop", "start")
        some = [F.col("artifact").alias("artifact"), F.col("start").alias(f"{tag}_start"), stop.alias(f"{tag}_stop"), *(F.col(k).alias(f"{tag}_{k}") for k in keys)]
        return df.filter("artifact is not null and (start is null or coalesce(stop, start) >= start)").select(*(["id"] if tag == "g" else []), *some)

    def blocks(df, tag):
        return df.filter(f"{tag}_start is not null").withColumn("block", F.explode(F.sequence(F.floor(F.col(f"{tag}_start") / width), F.floor(F.col(f"{tag}_stop") / width))))

    left, right = side(segments, "g"), side(sources, "s")
    right = right.groupBy(*right.columns).agg(F.count("*").alias("n"))
    agree, known, any_g, any_s = F.lit(True), F.lit(False), F.lit(False), F.lit(False)
    for k in keys:
        g, s = F.col(f"g_{k}"), F.col(f"s_{k}")
        agree = agree & (g.isNull() | s.isNull() | (g == s))
        known, any_g, any_s = known | (g.isNotNull() & s.isNotNull()), any_g | g.isNotNull(), any_s | s.isNotNull()
    lined = blocks(left, "g").join(blocks(right, "s"), ["artifact", "block"])
    lined = lined.filter((F.col("g_start") <= F.col("s_stop")) & (F.col("s_start") <= F.col("g_stop")) & (F.col("block") == F.floor(F.greatest("g_start", "s_start") / width)) & agree)
    apart = agree & (known | ~((any_g | F.col("g_start").isNotNull()) & (any_s | F.col("s_start").isNotNull())))
    free = left.filter("g_start is null").join(right, "artifact").filter(apart).select("id", "n")
    free = free.unionByName(left.filter("g_start is not null").join(right.filter("s_start is null"), "artifact").filter(apart).select("id", "n"))
    counts = lined.select("id", "n").unionByName(free).groupBy("id").agg(F.sum("n").alias("n_sources"))
    out = segments.select("id").join(counts, "id", "left").select("id", F.coalesce("n_sources", F.lit(0)).alias("n_sources"))
    return out.withColumn("covered", F.col("n_sources") > 0)
