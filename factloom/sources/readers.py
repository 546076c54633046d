"""Readers that give records with provenance: files, JSON leaves, HTML blocks, transcripts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First bytes of formats.
MAGIC = {"pdf": "25504446", "zip": "504B0304", "rtf": "7B5C727466"}


def scan_files(spark: SparkSession, path: str, ignore: list[str] | None = None) -> DataFrame:
    """path, size, sha256, kind of the files under path, without those that match an ignored glob."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    for glob in ignore or []:
        pattern = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if not c.isalnum() else c) for c in glob)
        files = files.filter(~F.regexp_like("path", F.lit(f"(^|/){pattern}$")))
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), sniff(F.col("content")).alias("kind"))


def sniff(content: Column) -> Column:
    head, out = F.hex(F.substring(content, 1, 8)), F.lit("text")
    for kind, magic in MAGIC.items():
        out = F.when(F.startswith(head, F.lit(magic)), kind).otherwise(out)
    return out


def json_leaves(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """id, key, leaf of the top-level members of JSON objects."""
    return df.select(id_column, F.explode(F.from_json(column, "map<string,string>")).alias("key", "leaf"))


def html_blocks(html: Column) -> Column:
    """Texts of p, li, h1-h6, td and title elements, without scripts, styles and inner tags."""
    clean = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    found = F.regexp_extract_all(clean, F.lit(r"(?is)<(?:p|li|h[1-6]|td|title)(?:\s[^>]*)?>(.*?)</(?:p|li|h[1-6]|td|title)>"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " "))), lambda x: x != "")


def transcript(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """id, line, clock, speaker, said of lines such as '[00:01:02] Name: text'."""
    lines = df.select(id_column, F.posexplode(F.split(column, "\n", -1)).alias("line", "x"))
    get = lambda i: F.nullif(F.regexp_extract("x", r"^\s*(?:\[(\d{1,2}:\d\d(?::\d\d)?)\]\s*)?(?:([A-Z][\w .'-]{0,40}):\s+)?(.*)$", i), F.lit(""))
    return lines.select(id_column, "line", get(1).alias("clock"), get(2).alias("speaker"), get(3).alias("said")).filter("said is not null")
