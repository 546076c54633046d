"""Folding, exact and keyed de-duplication, and the ledger of rows that were set aside."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold_groups(df: DataFrame, key: str, value: str, least: int) -> DataFrame:
    """One row for each key with least rows or more: rows, low, high, total; smaller groups are left out.

    One aggregate with partial sums; money is summed as decimals, so the order of rows doesn't matter.
    """
    out = df.groupBy(key).agg(F.count("*").alias("n_rows"), F.min(value).alias("low"), F.max(value).alias("high"), F.sum(F.col(value).cast("decimal(18,2)")).cast("double").alias("total"))
    return out.filter(F.col("n_rows") >= least)


def fold_or_keep(df: DataFrame, key: str, value: str, least: int, ids: list[str]) -> DataFrame:
    """The folded groups, with null ids, and each row of the smaller groups as it is: n_rows 1, its value as low, high and total."""
    small = df.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n")).filter(F.col("__n") < least).select("__key")
    rest = df.join(small, F.col(key).eqNullSafe(F.col("__key")), "left_semi")
    money = F.col(value).cast("decimal(18,2)").cast("double")
    rest = rest.select(key, *ids, F.lit(1).cast("long").alias("n_rows"), F.col(value).alias("low"), F.col(value).alias("high"), money.alias("total"))
    return rest.unionByName(fold_groups(df, key, value, least), allowMissingColumns=True)


def first_of_each(df: DataFrame, keys: list[Column | str], order: list[Column], tag: str = "turn") -> DataFrame:
    """df with turn: 1 for the row that a key keeps, in the given order."""
    return df.withColumn(tag, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def exact_dedup(df: DataFrame, content: Column, id_column: str) -> DataFrame:
    """survivor (least id), copies: one row for each content, which is compared by its SHA-256 so that texts aren't shuffled."""
    return df.groupBy(F.sha2(content.cast("binary"), 256).alias("digest")).agg(F.min(id_column).alias("survivor"), F.count("*").alias("copies"))


def keyed_merge(df: DataFrame, keys: list[str], best: Column, id_column: str, fields: list[str]) -> DataFrame:
    """Each key's winner by best (then least id), with the number of rows and the distinct values of fields."""
    winner = F.max_by(id_column, F.struct(best.alias("b"), (-F.col(id_column)).alias("i")))
    return df.groupBy(*keys).agg(winner.alias("winner"), F.count("*").alias("merged"), *(F.array_sort(F.collect_set(f)).alias(f"all_{f}") for f in fields))


def quarantine(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with reason: the first rule that holds, else null. Nothing is dropped."""
    reason = F.lit(None).cast("string")
    for name, rule in reversed(rules.items()):
        reason = F.when(F.coalesce(rule, F.lit(False)), F.lit(name)).otherwise(reason)
    return df.withColumn("reason", reason)
