"""Ranking of competing claims: authority scores, the governing claim of a topic, risk, severity, corroboration."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks of authority classes.
RANKS = {"contractual": 100, "customer_current": 90, "roster": 80, "vendor": 65, "meeting": 55, "machine": 40, "quoted_old": 10, "deleted": 0}
#: A packet family's base risk.
BASE_RISK = {"exclusion": 0.85, "mismatch": 0.83, "conflict": 0.82, "override": 0.70, "access": 0.68, "missing": 0.64, "decision": 0.55, "action": 0.36, "claim": 0.35, "inclusion": 0.20}
OTHER_RISK = 0.50


def lookup(c: Column, values: dict, default) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def recency(df: DataFrame, ts: str, group: list[str]) -> DataFrame:
    """df with recency: 0 to 2 by place between the group's first and last time; 0 if they are one, null without a time.

    First and last times are partial aggregates that are joined back, so no group is sorted or held in one task.
    """
    at = F.unix_seconds(F.col(ts).cast("timestamp"))
    ends = df.groupBy(*(F.col(g).alias(f"of_{g}") for g in group)).agg(F.min(at).alias("of_first"), F.max(at).alias("of_last"))
    same = [df[g].eqNullSafe(ends[f"of_{g}"]) for g in group]
    span = F.col("of_last") - F.col("of_first")
    value = F.when(span == 0, 0.0).otherwise(F.round(2.0 * (at - F.col("of_first")) / span, 4))
    return df.join(ends, same).select(*(df[c] for c in df.columns), value.alias("recency"))


def governing(df: DataFrame, topic: list[str], score: Column, confidence: Column, ts: Column, id_column: str) -> DataFrame:
    """The first row of each topic by score, confidence, newer time, smaller id.

    An aggregate with partial maxima, so a hot topic isn't sorted in one task.
    """
    order = F.struct(score, confidence, F.unix_micros(ts), -F.col(id_column))
    return df.groupBy(*topic).agg(F.max_by(id_column, order).alias("governing"), F.count("*").alias("claims"))


def risk(family: Column, bonuses: list[tuple[Column, float]]) -> Column:
    """Base risk of the family plus the bonuses that hold, between 0 and 1, in four places."""
    out = lookup(family, BASE_RISK, OTHER_RISK)
    for holds, value in bonuses:
        out = out + F.when(holds, value).otherwise(0.0)
    return F.round(F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0)), 4)


def severity(c: Column) -> Column:
    return F.when(c >= 0.90, "critical").when(c >= 0.75, "high").when(c >= 0.45, "medium").otherwise("low")


def corroboration(c: Column) -> Column:
    return F.when(c >= 3, "well_corroborated").when(c == 2, "corroborated").otherwise("single_source")


#: Review tiers (lower comes first) by family and, where given, one of some flags; the first that fits holds.
TIERS = (
    ("quantity_conflict", (), 0),
    ("vendor_mismatch", ("vendor_scope_quantity_mismatch",), 1),
    ("scope_exclusion", ("power_vendor_scope_mismatch", "scope_pollution_vendor_vs_written_exclusion", "vendor_scope_pollution_candidate"), 2),
    ("missing_info", ("raceway_conduit_pathway_missing_info",), 3),
    ("missing_info", ("certification_testing_export_missing_info",), 4),
    ("missing_info", ("missing_info_access_gate", "site_access_gate_unknown"), 5),
    ("missing_info", (), 6),
    ("site_access", (), 7),
    ("scope_exclusion", (), 8),
    ("meeting_decision", (), 9),
    ("customer_override", (), 10),
    ("action_item", (), 11),
)
#: Tiers of packets without a known anchor, of settled inclusions, and of all others.
UNKNOWN_TIER, SETTLED_TIER, OTHER_TIER = 92, 85, 40


def queue_tier(family: Column, anchor: Column, flags: Column, status: Column) -> Column:
    """A packet's review tier. Null flags are none; a null anchor is a known one; a null family has OTHER_TIER."""
    name, marks = F.lower(F.coalesce(anchor, F.lit(""))), F.coalesce(flags, F.array().cast("array<string>"))
    out = F.when(F.contains(name, F.lit("device:unknown")) | name.isin("site:unknown", "entity:unknown"), UNKNOWN_TIER)
    out = out.when((family == "scope_inclusion") & (status == "active"), SETTLED_TIER)
    for of, any_of, tier in TIERS:
        holds = family == of
        out = out.when(holds & F.arrays_overlap(marks, F.array(*map(F.lit, any_of))) if any_of else holds, tier)
    return out.otherwise(OTHER_TIER)
