"""Mixing sources to target weights: a low-discrepancy schedule of equal-token blocks.

Targets: each source's share of the mix by weight, at most REPEATS times its size, the excess reshared by weight until none is above.
The limit of that resharing is min(cap, level * weight) with one level for all, found in one pass over sources by cap / weight.

Schedule: slot n's point is frac(n * golden ratio); the cumulative targets map it to a source; a slot's rank within its source is the
block of that source that it takes, first epoch before second. The mix has round(all targets / block) slots, and a source has
the slots that the sequence gives it: at most deviation() more or fewer than its share, by the sequence's low discrepancy.
What would go beyond a source's target is cut there. Blocks are runs of
``block`` words of the source's documents in an order shuffled by MD5. Blocks are short beside the least source, but for there being at most
MOST_SLOTS slots, or one for each document in a larger corpus.

Skew. Nothing is grouped by source alone: documents are ordered within (source, part of the hash space), whose totals are summed
by source, so the hot source is spread over its parts; slots are ranked the same way over runs of the schedule; slots and blocks
are joined on (source, block). Only tables with one row for each source, or for each source and part, pass through a single task.

Defined results: null or empty text has size 0 and nothing is taken; null source is a source of its own, last; a null doc_id takes part;
equal rows may take different parts of the mix (their order among each other is by nothing else); a text of any length lies in as many blocks as it fills; an empty table gives an empty result; without any word all targets are 0; other columns are not read, and mixture keeps them whatever their names.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _blocks as B

WEIGHTS = (5, 2, 1)
SHARE, REPEATS = 1.5, 2
#: Words of a block, at most, and blocks that the least source has where the number of slots allows it.
BLOCK, LEAST_BLOCKS = 1024, 256
MOST_SLOTS = 1 << 20
GOLDEN = 0.6180339887498949
#: Documents of a source and part on average; slots of a run.
PART_ROWS, RUN = 20_000, 65_536
#: Cells in which points and sources meet.
CELLS = 1024


def deviation(slots: int) -> float:
    """Slots by which a source's number of slots differs from its share of all, at most."""
    return 2 + 0.5 * math.log2(slots + 1)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, s_null, s, size, tag, place of each row of docs (doc_id, source, text); place orders a source's documents, tag is a hash of the text."""
    return docs.select(
        F.col("doc_id"), F.col("source").isNull().alias("s_null"), F.coalesce("source", F.lit("")).alias("s"),
        F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(B.WORD))).cast("long").alias("size"),
        F.xxhash64("text").alias("tag"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("place"))


def targets(sized: DataFrame) -> DataFrame:
    """s_null, s, source_size, weight, target of each source."""
    rows = sized.groupBy("s_null", "s").agg(F.sum("size").alias("source_size"))
    names = Window.partitionBy(F.lit(0)).orderBy("s_null", "s")
    every = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("weight", F.get(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.row_number().over(names) - 1, F.lit(len(WEIGHTS)))).cast("double"))
    rows = rows.withColumn("cap", F.lit(float(REPEATS)) * F.col("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "s_null", "s")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    left = F.lit(SHARE) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / rest)
    #: The first source whose cap is not reached sets the level of all that follow.
    free = F.min(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)
    rows = rows.withColumn("target", F.least(F.col("cap"), F.coalesce(free["level"] * F.col("weight"), F.col("cap"))))
    return rows.select("s_null", "s", "source_size", "weight", "target")


_KEY = ["s_null", "s"]


def _laid_out(sized: DataFrame, count: int) -> DataFrame:
    """sized with low: words of the source's documents before this one in shuffled order."""
    parts = 1
    while parts * PART_ROWS < count and parts < 1 << 20:
        parts *= 16
    digits = {1: 0}.get(parts, len(f"{parts:x}") - 1)
    rows = sized.withColumn("part", F.substring("place", 1, digits))
    totals = rows.groupBy(*_KEY, "part").agg(F.sum("size").alias("n"))
    offset = Window.partitionBy(*_KEY).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("base", F.coalesce(F.sum("n").over(offset), F.lit(0))).drop("n")
    within = Window.partitionBy(*_KEY, "part").orderBy("place", "doc_id", "tag").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return rows.join(totals, [*_KEY, "part"]).select("doc_id", *_KEY, "size", "tag", (F.col("base") + F.col("inside")).alias("low"))


def golden(n: Column) -> Column:
    """Point n of the golden-ratio sequence in [0, 1)."""
    at = n.cast("double") * F.lit(GOLDEN)
    return at - F.floor(at)


def schedule(goals: DataFrame, slots: int, point=golden) -> DataFrame:
    """slot, s_null, s, rank: the source of each slot, and how many earlier ones that source has.

    goals: s_null, s, goal (words, long). point: a sequence of points in [0, 1), as a function of the slot's number.
    """
    one = Window.partitionBy(F.lit(0)).orderBy(*_KEY)
    goals = goals.filter("goal > 0").select(*_KEY, "goal", F.sum("goal").over(one).alias("high"), F.sum("goal").over(Window.partitionBy(F.lit(0))).alias("total"))
    goals = goals.withColumn("low", F.col("high") - F.col("goal"))
    #: Sources and points meet in cells of the total: an equi-join, in which each source has as many cells as its share.
    width = F.greatest(F.ceil(F.col("total") / CELLS), F.lit(1))
    cell = goals.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width)))).drop("goal", "total")
    total = goals.select(F.col("total").alias("t"), F.greatest(F.ceil(F.col("total") / CELLS), F.lit(1)).alias("w")).limit(1)
    points = goals.sparkSession.range(slots).select(F.col("id").alias("slot"), point(F.col("id")).alias("u")).join(F.broadcast(total))
    points = points.withColumn("at", F.floor(F.col("u") * F.col("t"))).withColumn("cell", F.floor(F.col("at") / F.col("w")))
    hit = points.join(cell, "cell").filter("at >= low and at < high").select("slot", *_KEY, F.floor(F.col("slot") / RUN).alias("run"))
    totals = hit.groupBy(*_KEY, "run").agg(F.count("*").alias("n"))
    totals = totals.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy(*_KEY).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy(*_KEY, "run").orderBy("slot")) - 1
    ranked = hit.withColumn("inside", inside).join(totals, [*_KEY, "run"])
    return ranked.select("slot", *_KEY, (F.col("base") + F.col("inside")).alias("rank"))


def pieces(docs: DataFrame, point=golden) -> tuple[DataFrame, DataFrame]:
    """(sized rows with source_size, target and low; taken pieces: doc_id, s_null, s, low, slot, epoch, first, words).

    A piece is a run of a document's words, from word first on, that a slot of the schedule takes.
    """
    sized = B.checkpointed(sizes(B.own(docs, "doc_id", "source", "text")))
    goals = B.checkpointed(targets(sized).withColumn("goal", F.round("target").cast("long")))
    facts = goals.filter("source_size > 0").agg(F.sum("goal").alias("t"), F.min("source_size").alias("m")).first()
    total, rows = facts["t"] or 0, sized.count()
    block = max(1, min(BLOCK, (facts["m"] or 1) // LEAST_BLOCKS), -(-total // max(MOST_SLOTS, rows)))
    laid = B.checkpointed(_laid_out(sized, rows))
    plan = schedule(goals, (2 * total + block) // (2 * block), point)
    size = goals.filter("source_size > 0").select(*_KEY, "source_size", "goal")
    last = F.floor((F.col("source_size") - 1) / block) + 1
    plan = plan.join(size, _KEY).withColumn("epoch", F.floor(F.col("rank") / last)).withColumn("block", F.pmod(F.col("rank"), last))
    plan = plan.withColumn("stop", F.least((F.col("block") + 1) * block, "source_size", F.col("goal") - F.col("epoch") * F.col("source_size"))).select("slot", *_KEY, "epoch", "block", "stop")
    cut = laid.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / block), F.floor((F.col("low") + F.col("size") - 1) / block))))
    cut = cut.withColumn("from", F.greatest("low", F.col("block") * block)).withColumn("to", F.least(F.col("low") + F.col("size"), (F.col("block") + 1) * block))
    got = cut.join(plan, [*_KEY, "block"]).withColumn("words", F.least("to", "stop") - F.col("from")).filter("words > 0")
    got = got.select("doc_id", *_KEY, "low", "size", "tag", "slot", "epoch", (F.col("from") - F.col("low")).alias("first"), "words")
    return laid.join(goals.select(*_KEY, "source_size", "target"), _KEY), got


def mixed(docs: DataFrame, point=golden) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot of each row of docs (doc_id, source, text).

    first_slot is the slot of the schedule that takes the row's first word; null if none does.
    """
    rows, got = pieces(docs, point)
    taken = got.groupBy("doc_id", *_KEY, "low", "size").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    same = [rows["doc_id"].eqNullSafe(taken["doc_id"]), *(rows[k] == taken[k] for k in (*_KEY, "low", "size"))]
    return rows.join(taken, same, "left").select(rows["doc_id"], rows["size"], "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def mixture(docs: DataFrame, slot: str | None = None) -> DataFrame:
    """The mix as rows of docs: a document once for each epoch that takes it, cut to the words taken where the target ends within it.

    Columns stay (n_chars follows a cut text); documents of which nothing is taken go. With slot, a column of that name holds the
    first slot that takes the row in its epoch: the schedule's order of the mix.
    """
    _, got = pieces(docs)
    names = ("d", "sn", "s", "size", "tag", "low", "words", "turn", "slot")
    d, sn, s, size, tag, low, words, turn, first = own_names = B.unused(docs, *names)
    taken = got.groupBy("doc_id", *_KEY, "low", "size", "tag", "epoch").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
    taken = taken.select(*(F.col(c).alias(n) for c, n in zip(("doc_id", *_KEY, "size", "tag", "low", "words", "slot"), (d, sn, s, size, tag, low, words, first), strict=True)))
    #: Equal rows are told apart by their turn: those before others are taken first.
    key = [d, sn, s, size, tag]
    taken = taken.withColumn(turn, F.dense_rank().over(Window.partitionBy(*key).orderBy(low))).drop(low)
    own = docs.withColumns({d: F.col("doc_id"), sn: F.col("source").isNull(), s: F.coalesce("source", F.lit("")), size: F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(B.WORD))).cast("long"), tag: F.xxhash64("text")})
    own = own.withColumn(turn, F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))).alias("own")
    taken = taken.alias("taken")
    same = [F.col(f"own.{d}").eqNullSafe(F.col(f"taken.{d}")), *(F.col(f"own.{k}") == F.col(f"taken.{k}") for k in (*key[1:], turn))]
    got = own.join(taken, same).select(*(F.col(f"own.`{c}`") for c in docs.columns), F.col(f"own.{size}"), F.col(f"taken.{words}"), F.col(f"taken.{first}"))
    cut = F.slice(F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != ""), F.lit(1), F.col(words).cast("int"))
    whole = F.col(words) >= F.col(size)
    out = got.withColumn("text", F.when(whole, F.col("text")).otherwise(F.array_join(cut, " ")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), *([F.col(first).alias(slot)] if slot else []))


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents: what it takes of each."""
    return mixed(B.table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, source IS NULL AS sn, coalesce(source, '') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), src AS MATERIALIZED (
  SELECT sn, s, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY sn, s) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY sn, s
), lev AS (
  SELECT *, 2.0 * source_size / w AS r,
    (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / w, sn, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 2.0 * source_size / w, sn, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM src
), goal AS (
  SELECT sn, s, source_size, least(2.0 * source_size, coalesce((SELECT arg_min(level, r) FROM lev WHERE r > level) * w, 2.0 * source_size))::DOUBLE AS target FROM lev
), facts AS (
  SELECT t, block, (2 * t + block) // (2 * block) AS slots FROM (
    SELECT sum(round(target))::BIGINT AS t,
      greatest(1, least(1024, min(source_size) // 256), ceil(sum(round(target)) / greatest(1048576, (SELECT count(*) FROM d)))::BIGINT)::BIGINT AS block
    FROM goal WHERE source_size > 0)
), spans AS (
  SELECT sn, s, round(target)::BIGINT AS goal, sum(round(target)::BIGINT) OVER (ORDER BY sn, s) AS high FROM goal WHERE round(target) > 0
), points AS MATERIALIZED (
  SELECT n AS slot, floor((n::DOUBLE * 0.6180339887498949::DOUBLE - floor(n::DOUBLE * 0.6180339887498949::DOUBLE)) * t::DOUBLE)::BIGINT AS place
  FROM (SELECT unnest(range(slots)) AS n, t FROM facts)
), plan AS MATERIALIZED (
  SELECT sn, s, slot, row_number() OVER (PARTITION BY sn, s ORDER BY slot) - 1 AS rank
  FROM points ASOF JOIN (SELECT sn, s, high - goal AS low FROM spans) x ON points.place >= x.low
), reach AS (
  SELECT goal.sn, goal.s, source_size, target, block, n, (source_size - 1) // block + 1 AS last, round(target)::BIGINT AS quota
  FROM goal, facts LEFT JOIN (SELECT sn, s, count(*) AS n FROM plan GROUP BY ALL) c ON c.sn = goal.sn AND c.s = goal.s
), laid AS (
  SELECT *, (sum(size) OVER (PARTITION BY sn, s ORDER BY md5(doc_id::VARCHAR), doc_id) - size)::BIGINT AS low FROM d
), ends AS (
  SELECT laid.*, source_size, target, block,
    greatest(0, least(quota, source_size, least(coalesce(n, 0), last) * block)) AS once,
    greatest(0, least(quota - source_size, source_size, (coalesce(n, 0) - last) * block)) AS twice
  FROM laid JOIN reach USING (sn, s)
)
SELECT doc_id, size, source_size, target,
  (least(greatest(once - low, 0), size) + least(greatest(twice - low, 0), size))::BIGINT AS taken, slot AS first_slot
FROM ends LEFT JOIN plan ON plan.sn = ends.sn AND plan.s = ends.s AND size > 0 AND low < once AND rank = low // block
"""
