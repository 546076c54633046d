"""Scalar and array functions on text: plain Column expressions, so they stay in generated code."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what a slug replaces.
_NOT_SLUG = "[^a-z0-9]+"


def normalize_text(c: Column) -> Column:
    """Trimmed, ASCII lower-cased, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\s ]+", " "))


def slug(c: Column) -> Column:
    """Words of a-z and 0-9 of the lower-cased text, joined by underscores."""
    lowered = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.regexp_replace(lowered, _NOT_SLUG, "_"), "^_+|_+$", "")


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 16 hex digits of the SHA-256 of the parts joined by |."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 16))


def quantity(c: Column) -> Column:
    """struct(quantity double, unit string, uncertain boolean) of the first number of a text."""
    found = F.regexp_extract(c, r"(\d+(?:\.\d+)?)", 1)
    unit = F.regexp_extract(c, r"\d+(?:\.\d+)?\s*([A-Za-z]+)", 1)
    return F.struct(F.when(found != "", found.cast("double")).alias("quantity"), F.when(unit != "", F.lower(unit)).alias("unit"), ((found == "") | F.regexp_like(c, F.lit(r"[~?]|\bapprox"))).alias("uncertain"))


def emails(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"), F.lit(1)), lambda x: F.lower(x))))


def phones(c: Column) -> Column:
    """Digits of phone numbers (ten or more digits with separators)."""
    found = F.regexp_extract_all(c, F.lit(r"(\+?\d[\d ().-]{8,18}\d)"), F.lit(1))
    digits = F.transform(found, lambda x: F.regexp_replace(x, r"\D", ""))
    return F.array_sort(F.array_distinct(F.filter(digits, lambda d: (F.length(d) >= 10) & (F.length(d) <= 15))))


def dates(c: Column) -> Column:
    """date:yyyy-mm-dd of ISO dates with a month of 1-12 and a day of 1-31."""
    found = F.regexp_extract_all(c, F.lit(r"((?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01]))"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda d: F.concat(F.lit("date:"), d))))


def money(c: Column) -> Column:
    """Amounts after $ from 100 to 1e12, K/M/B as multipliers."""
    found = F.regexp_extract_all(c, F.lit(r"(\$\s?\d[\d,]*(?:\.\d+)?\s?[KMB]?)"), F.lit(1))
    number = lambda x: F.regexp_replace(x, r"[^\d.]", "").cast("double") * F.when(F.endswith(x, F.lit("K")), 1e3).when(F.endswith(x, F.lit("M")), 1e6).when(F.endswith(x, F.lit("B")), 1e9).otherwise(1.0)
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, number), lambda v: (v >= 100) & (v <= 1e12))))


def tokens(c: Column) -> Column:
    """Distinct lower-cased runs of a-z and 0-9 of three or more characters."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]{3,})"), F.lit(1))))


def hash_split(c: Column, share_train: int = 80, share_validate: int = 10) -> Column:
    """train, validate or test by the first four hex digits of the SHA-256."""
    bucket = F.conv(F.substring(F.sha2(c.cast("string").cast("binary"), 256), 1, 4), 16, 10).cast("int") % 100
    return F.when(bucket < share_train, "train").when(bucket < share_train + share_validate, "validate").otherwise("test")


def wilson_lower(hits: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of Wilson's interval of a share; 0 of none."""
    p = hits / n
    bound = (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    return F.when(n == 0, 0.0).otherwise(bound)
