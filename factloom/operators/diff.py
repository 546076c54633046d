"""Comparison of two versions of a table, what a change invalidates, and integrity checks."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, change: added, removed, changed or unchanged; one full outer join on the key."""
    pack = lambda df, name: df.select(key, F.struct(*fields).alias(name))
    both = pack(before, "b").join(pack(after, "a"), key, "full")
    return both.select(key, F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("changed").alias("change"))


def invalidated(members: DataFrame, changes: DataFrame, group: str, key: str) -> DataFrame:
    """group, n_changed: groups with a member that is not unchanged."""
    return members.join(changes.filter("change <> 'unchanged'"), key).groupBy(group).agg(F.count("*").alias("n_changed"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, name: str) -> DataFrame:
    """check, violations: rows of child whose key has no parent."""
    lost = child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")
    return lost.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations")
