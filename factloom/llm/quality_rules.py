"""Quality rules: base counts, and the divergence of a document's histograms from its language's. DataFrame functions only.

Two histograms of a document, of character classes and of common words, are compared with those of all documents of its language that pass the base rules,
by Jensen-Shannon distance (base 2, 0 to 1). A document is rejected if a distance is above its limit; a text with fewer than
GUARD_WORDS words (or GUARD_CHARS characters) is too short to be compared and is not rejected by a distance. Most words are in no list, so
a text without any common word is at 0.27 to 0.29 only: the limit of words lies below that, with room for the chance of short texts.

The counts are made in one pass and checkpointed as numbers; the references are one row for each language, and their join is
broadcast only where Spark finds them small. No row is grouped with others but by partial sums.

Defined results: null text is empty and fails the base rules; a null lang is a language of its own; a null doc_id stays; repeated rows are returned
each; equal texts of a language have equal distances; a text of any length is counted whole; a distance of a text without characters (or words) is null; a language without any passing document rejects nothing; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _blocks as B

#: Common words whose frequencies make the second histogram, by language.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for"),
    "fr": ("de", "la", "le", "les", "et", "des", "un", "que"),
    "de": ("der", "die", "und", "das", "den", "von", "zu", "mit"),
    "es": ("el", "los", "en", "una", "por", "con", "las", "su"),
}
GUARD_WORDS, GUARD_CHARS = 50, 200
CHAR_LIMIT = 0.27
#: The limit of words is WORD_LIMIT + WORD_SPREAD / sqrt(words): of a grid fitted on half of the labelled documents of sf0.1 and check_h; see the README.
WORD_LIMIT, WORD_SPREAD = 0.13, 1.0
_GAP = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """body of value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, k: int = 5) -> Column:
    """Number of words in k-word windows found twice or more in the array, the first included."""
    #: Hashes of windows: without two equal ones no two windows are equal. Where two are, the words are compared.
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))

    def same(a, b):
        return (a["h"] == b["h"]) & (F.slice(words, a["i"] + 1, k) == F.slice(words, b["i"] + 1, k))

    def counted(h):
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = _let(ordered, lambda s: F.array_sort(F.transform(F.filter(
            s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1))), lambda x: x["i"])))
        return _let(again, lambda p: F.aggregate(
            F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.coalesce(F.least(b - a, F.lit(k)), F.lit(k))), F.lit(0), lambda s, x: s + x))

    covered = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), counted(h)).otherwise(0))
    return F.when(F.size(words) > k, covered).otherwise(0).cast("long")


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, chars array<long> and common array<long> of each row of docs (doc_id, lang, text)."""
    t = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("t"))
    t = t.withColumns({"words": F.filter(F.split("t", _GAP, -1), lambda w: w != ""), "close": F.regexp_replace("t", _GAP, "")})
    every = [w for ws in COMMON.values() for w in ws]
    t = t.withColumns({
        "n_words": F.size("words").cast("long"), "word_chars": F.length("close").cast("long"),
        "odd": F.regexp_replace("close", "[a-z]+", ""), "hits": F.filter("words", lambda w: w.isin(every)),
        "lines": F.filter(F.split("t", "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))),
    })
    t = t.withColumn("few", F.regexp_replace("odd", "[A-Z]+", "")).withColumn("marks", F.regexp_replace("few", "[0-9]+", "")).withColumn("wide", F.regexp_replace("marks", r"[\x21-\x7E]+", ""))
    size = lambda c: F.length(c).cast("long")
    symbols = F.length(F.regexp_replace("marks", "[^#*$%&|<>]+", "")).cast("long")
    chars = F.array(size("close") - size("odd"), size("odd") - size("few"), size("few") - size("marks"), symbols, size("marks") - size("wide") - symbols, size("wide"), size("t") - size("close"))
    equals = lambda w: lambda h: h == w
    common = F.array(*(F.size(F.filter("hits", equals(w))).cast("long") for w in every), (F.size("words") - F.size("hits")).cast("long"))
    return t.select(
        "doc_id", "lang", "n_words", "word_chars", symbols.alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"), chars.alias("chars"), common.alias("common"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts; null if one has none."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    pair = lambda a, b: _let((a + b) / 2, lambda m: (part(a, m) + part(b, m)) / 2)
    value = _let(F.struct(total(p).alias("p"), total(q).alias("q")), lambda n: F.when((n["p"] > 0) & (n["q"] > 0), F.aggregate(F.zip_with(p, q, lambda a, b: pair(a / n["p"], b / n["q"])), F.lit(0.0), lambda s, x: s + x)))
    return _let(value, lambda v: F.sqrt(F.when(v < 0, 0.0).otherwise(v)))


def judged(docs: DataFrame, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT, word_spread: float = WORD_SPREAD) -> DataFrame:
    """doc_id, base counts, base_failed, kept, char_distance, word_distance of each row of docs (doc_id, lang, text)."""
    rows = counts(B.own(docs, "doc_id", "lang", "text")).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    rows = B.checkpointed(rows)
    widths = {"chars": 7, "common": sum(map(len, COMMON.values())) + 1}
    sums = [F.sum(F.get(c, F.lit(i))).alias(f"{c}_{i}") for c, n in widths.items() for i in range(n)]
    known = rows.filter("not base_failed").groupBy("lang").agg(*sums)
    known = known.select(F.col("lang").alias("l"), *(F.array(*(F.col(f"{c}_{i}") for i in range(n))).alias(f"r_{c}") for c, n in widths.items()))
    out = rows.join(known, rows["lang"].eqNullSafe(known["l"]), "left")
    out = out.withColumns({"char_distance": distance(F.col("chars"), F.col("r_chars")), "word_distance": distance(F.col("common"), F.col("r_common"))})
    long = (F.col("n_words") >= GUARD_WORDS) & (F.col("word_chars") >= GUARD_CHARS)
    words_far = F.coalesce("word_distance", F.lit(0.0)) > word_limit + word_spread / F.sqrt(F.greatest("n_words", F.lit(1)))
    far = long & ((F.coalesce("char_distance", F.lit(0.0)) > char_limit) | words_far)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"),
        F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))


def op4_quality_divergence(spark, sf_dir: str) -> DataFrame:
    """Every text of documents with its base counts and verdict."""
    return judged(B.table(spark, sf_dir, "documents"))
