"""Mail threads: conversations by reply headers and subjects, each message's place and parent, and quoted lines that repeat what a thread holds."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components


def threads(messages: DataFrame) -> DataFrame:
    """id, thread, place, size, parent, via for messages (id, message_id, refs, subject_key, ts); refs has the nearest ancestor first.

    Messages are in one thread if one refers to the other or they share a subject that is not empty, directly or by others; thread is the least
    id. They are placed by time, then id, those without a time last. A message's parent is the first of its refs that is known, via
    "reference", else the message before it, via "before". A message id that several have means the one of least id. ids are unique
    and not null; nulls elsewhere refer to nothing. A thread is sorted in one task, a few columns wide.
    """
    known = messages.filter("message_id <> ''").groupBy("message_id").agg(F.min("id").alias("other"))
    refs = messages.select("id", F.posexplode("refs").alias("n", "message_id")).join(known, "message_id").filter("id <> other").select("id", "n", "other")
    # Every message of a subject is tied to the subject's least id, so a common one makes no pairs.
    subjects = messages.filter("subject_key <> ''").select("id", "subject_key")
    first = subjects.groupBy("subject_key").agg(F.min("id").alias("other"))
    edges = refs.select(F.col("id").alias("a"), F.col("other").alias("b")).union(subjects.join(first, "subject_key").filter("id <> other").select("id", "other"))
    roots = components(edges).withColumnRenamed("node", "id")
    parents = refs.groupBy("id").agg(F.min_by("other", "n").alias("named"))
    whole = messages.select("id", "ts").join(roots, "id", "left").join(parents, "id", "left").withColumn("thread", F.coalesce("root", "id"))
    size = whole.groupBy("thread").agg(F.count("*").alias("size"))
    order = Window.partitionBy("thread").orderBy(F.col("ts").isNull(), "ts", "id")
    placed = whole.withColumn("place", F.row_number().over(order)).withColumn("before", F.lag("id").over(order))
    via = F.when(F.col("named").isNotNull(), "reference").when(F.col("before").isNotNull(), "before")
    return placed.join(size, "thread").select("id", "thread", "place", "size", F.coalesce("named", "before").alias("parent"), via.alias("via"))


def quoted_echoes(lines: DataFrame, least: int = 12) -> DataFrame:
    """id, reason of quoted lines (id, thread, text, quoted) that say nothing new: "authored" if the thread has the text as a line of its own, else "quoted" if an earlier id quotes it.

    Texts are compared lower-cased with single spaces, by their SHA-256; those shorter than `least` and null ones are never echoes. Both
    sides are aggregated before they are joined, so a text that a third of all lines repeat is one row.
    """
    flat = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    keyed = lines.filter("thread is not null").select("id", "thread", "quoted", flat.alias("k")).filter(F.length("k") >= least).withColumn("k", F.sha2(F.col("k").cast("binary"), 256))
    seen = keyed.groupBy("thread", "k").agg(F.bool_or(~F.col("quoted")).alias("authored"), F.min(F.when(F.col("quoted"), F.col("id"))).alias("first"))
    reason = F.when(F.col("authored"), "authored").when(F.col("id") > F.col("first"), "quoted")
    return keyed.filter("quoted").join(seen, ["thread", "k"]).select("id", reason.alias("reason")).filter("reason is not null")


def variants(keys: DataFrame) -> DataFrame:
    """key, full: short names (one word, or a first word of one letter) with the one full name of their surname; keys are names with _ between words.

    A surname that several full names have, or none, fuses nothing. Null and empty keys are no names; repeated keys count once.
    """
    words = F.split("key", "_")
    named = keys.select("key").filter("key <> ''").distinct().select("key", F.element_at(words, -1).alias("surname"), ((F.size(words) == 1) | (F.length(words[0]) == 1)).alias("short"))
    full = named.filter("not short").groupBy("surname").agg(F.count("*").alias("n"), F.min("key").alias("full")).filter("n = 1")
    return named.filter("short").join(full, "surname").select("key", "full")
