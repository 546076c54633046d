"""One query for each operator, on the driver's tables, with the SQL that gives the same rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import authority as A
from ..operators import dedup as D
from ..operators import diff as X
from ..operators import graph as G
from ..operators import retrieval as R
from ..sources import readers as S
from ..streaming import events as E

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("SELECT l_partkey, count(*) AS n_rows, min(l_extendedprice) AS low, max(l_extendedprice) AS high, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS total FROM lineitem GROUP BY 1 HAVING count(*) >= 30")
def rollup_fold(s, d):
    return D.fold_groups(t(s, d, "lineitem"), "l_partkey", "l_extendedprice", 30)


@query("WITH g AS (SELECT l_partkey, count(*) AS n_rows, min(l_extendedprice) AS low, max(l_extendedprice) AS high, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS total FROM lineitem GROUP BY 1) SELECT l_partkey, NULL::BIGINT AS l_orderkey, NULL::BIGINT AS l_linenumber, n_rows, low, high, total FROM g WHERE n_rows >= 30 UNION ALL SELECT l.l_partkey, l_orderkey, l_linenumber, 1, l_extendedprice, l_extendedprice, l_extendedprice::DECIMAL(18,2)::DOUBLE FROM lineitem l JOIN g ON g.l_partkey IS NOT DISTINCT FROM l.l_partkey WHERE n_rows < 30")
def rollup_fold_all(s, d):
    """The folds of rollup_fold and the line items that are not folded."""
    return D.fold_or_keep(t(s, d, "lineitem"), "l_partkey", "l_extendedprice", 30, ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderpriority AS band, o_orderstatus, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY ALL")
def rollup_money_keys(s, d):
    return t(s, d, "orders").groupBy(F.col("o_orderpriority").alias("band"), "o_orderstatus").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query(f"SELECT p_partkey, trim(regexp_replace({_LOWER.format('p_name')}, '[\\s ]+', ' ', 'g')) AS normal, regexp_replace(regexp_replace({_LOWER.format('p_name')}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def normalize_and_slug(s, d):
    return t(s, d, "part").select("p_partkey", T.normalize_text(F.col("p_name")).alias("normal"), T.slug(F.col("p_name")).alias("slug"))


@query("SELECT c_custkey, 'cus_' || substr(sha256(concat_ws('|', c_custkey::VARCHAR, c_name, c_mktsegment)), 1, 16) AS stable_id FROM customer")
def stable_ids(s, d):
    return t(s, d, "customer").select("c_custkey", T.stable_id("cus", F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_mktsegment")).alias("stable_id"))


@query(r"""SELECT p_partkey, CASE WHEN q <> '' THEN q::DOUBLE END AS quantity, nullif(lower(regexp_extract(x, '\d+(?:\.\d+)?\s*([A-Za-z]+)', 1)), '') AS unit FROM (SELECT *, regexp_extract(x, '(\d+(?:\.\d+)?)', 1) AS q FROM (SELECT p_partkey, p_size::VARCHAR || ' pcs ' || p_type AS x FROM part))""")
def parse_quantity(s, d):
    q = T.quantity(F.concat(F.col("p_size").cast("string"), F.lit(" pcs "), F.col("p_type")))
    return t(s, d, "part").select("p_partkey", q.alias("q")).select("p_partkey", "q.quantity", "q.unit")


@query(r"""SELECT doc_id, unnest(list_sort(list_distinct(list_transform(regexp_extract_all(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})', 1), lambda x: lower(x))))) AS email FROM documents""")
def extract_email(s, d):
    return t(s, d, "documents").select("doc_id", F.explode(T.emails(F.col("text"))).alias("email"))


@query(r"""SELECT doc_id, unnest(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '(\+?\d[\d ().-]{8,18}\d)', 1), lambda x: regexp_replace(x, '\D', '', 'g')), lambda x: len(x) >= 10 AND len(x) <= 15)))) AS phone FROM documents""")
def extract_phone(s, d):
    return t(s, d, "documents").select("doc_id", F.explode(T.phones(F.col("text"))).alias("phone"))


@query(r"""SELECT doc_id, unnest(list_sort(list_distinct(list_transform(regexp_extract_all(text, '((?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01]))', 1), lambda x: 'date:' || x)))) AS date_key FROM documents""")
def extract_date(s, d):
    return t(s, d, "documents").select("doc_id", F.explode(T.dates(F.col("text"))).alias("date_key"))


@query(r"""SELECT doc_id, unnest(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '(\$\s?\d[\d,]*(?:\.\d+)?\s?[KMB]?)', 1), lambda x: regexp_replace(x, '[^\d.]', '', 'g')::DOUBLE * CASE right(x, 1) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 ELSE 1.0 END), lambda v: v >= 100 AND v <= 1e12)))) AS amount FROM documents""")
def extract_money(s, d):
    return t(s, d, "documents").select("doc_id", F.explode(T.money(F.col("text"))).alias("amount"))


_FLAT = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"


@query(f"WITH i AS (SELECT item_id, {_FLAT} AS x FROM benchmark), d AS (SELECT doc_id, {_FLAT} AS y FROM documents) SELECT item_id, count(doc_id) AS n_docs, count(doc_id) FILTER (contains(y, x)) AS n_whole, count(doc_id) > 0 AS covered FROM i LEFT JOIN d ON x <> '' AND contains(y, left(x, 40)) GROUP BY 1")
def reference_containment(s, d):
    """Each benchmark passage with the number of documents that hold its first 40 characters, and all of it, by normalised text."""
    flat = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    items = t(s, d, "benchmark").select("item_id", flat.alias("x"))
    docs = t(s, d, "documents").select(flat.alias("y"))
    # The passages are the small side; counts come back by item, so that passages that no document holds stay.
    found = docs.join(F.broadcast(items.filter("x <> ''")), F.expr("contains(y, left(x, 40))")).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.sum(F.expr("contains(y, x)").cast("long")).alias("n_whole"))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return items.select("item_id").join(found, "item_id", "left").select("item_id", n("n_docs"), n("n_whole"), F.col("n_docs").isNotNull().alias("covered"))


@query("SELECT sha256(text) AS digest, min(doc_id) AS survivor, count(*) AS copies FROM documents GROUP BY 1")
def exact_dedup(s, d):
    return D.exact_dedup(t(s, d, "documents"), F.col("text"), "doc_id")


@query("SELECT c_nationkey, c_mktsegment, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS winner, count(*) AS merged FROM customer GROUP BY 1, 2")
def keyed_merge_dedup(s, d):
    return D.keyed_merge(t(s, d, "customer"), ["c_nationkey", "c_mktsegment"], F.col("c_acctbal"), "c_custkey", []).select("c_nationkey", "c_mktsegment", "winner", "merged")


@query("SELECT coalesce(CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN n_chars < 200 THEN 'short' WHEN n_chars > 20000 THEN 'long' END, 'kept') AS reason, count(*) AS n FROM documents GROUP BY 1")
def suppression_ledger(s, d):
    rules = {"empty": F.col("text").isNull() | (F.trim("text") == ""), "short": F.col("n_chars") < 200, "long": F.col("n_chars") > 20000}
    return D.quarantine(t(s, d, "documents"), rules).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations")
def thread_context(s, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t(s, d, "conversations").select("conv_id", "turn", F.lag("text").over(w).alias("previous"), F.row_number().over(w).alias("place"))


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, sha256(text) ORDER BY turn) AS r FROM conversations WHERE len(text) >= 12) WHERE r > 1")
def line_dedup_within_thread(s, d):
    rows = t(s, d, "conversations").filter(F.length("text") >= 12).withColumn("k", F.sha2(F.col("text").cast("binary"), 256))
    return D.first_of_each(rows, ["conv_id", "k"], [F.col("turn")], "r").filter("r > 1").select("conv_id", "turn")


@query("SELECT DISTINCT q.conv_id, q.turn FROM conversations q WHERE q.role = 'user' AND EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = q.conv_id AND a.turn > q.turn AND a.role = 'assistant')")
def answered_questions(s, d):
    c = t(s, d, "conversations")
    last = c.filter("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("last"))
    return c.filter("role = 'user'").join(last, "conv_id").filter("turn < last").select("conv_id", "turn").distinct()


@query("WITH k AS (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem), i AS (SELECT l_partkey FROM k GROUP BY 1 HAVING count(*) BETWEEN 2 AND 40) SELECT x.l_orderkey AS a, y.l_orderkey AS b, count(*) AS shared FROM k x JOIN k y USING (l_partkey) JOIN i USING (l_partkey) WHERE x.l_orderkey < y.l_orderkey GROUP BY 1, 2 HAVING count(*) >= 2")
def blocked_pairs(s, d):
    return G.blocked_pairs(t(s, d, "lineitem"), "l_partkey", "l_orderkey", 2, 40).filter("shared >= 2")


@query("WITH k AS (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) SELECT x.l_orderkey AS a, y.l_orderkey AS b, count(*) AS shared FROM k x JOIN k y USING (l_partkey) WHERE x.l_orderkey < y.l_orderkey GROUP BY 1, 2 HAVING count(*) >= 2")
def blocked_pairs_all(s, d):
    """Orders that share two parts or more, whatever the number of a part's orders."""
    return G.sharing_pairs(t(s, d, "lineitem"), "l_partkey", "l_orderkey")


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS size, count(DISTINCT l_partkey) BETWEEN 2 AND 500 AS informative FROM lineitem GROUP BY 1")
def hot_key_filter(s, d):
    return t(s, d, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("size")).withColumn("informative", F.col("size").between(2, 500))


def _claims(s, d):
    return t(s, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("q"))


_CLAIMS = "WITH c AS (SELECT l_partkey, l_suppkey, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS q FROM lineitem GROUP BY 1, 2) "
_PAIRED = "SELECT x.l_partkey, x.l_suppkey AS a, y.l_suppkey AS b FROM c x JOIN c y ON x.l_partkey = y.l_partkey AND x.l_suppkey < y.l_suppkey "


def _paired(s, d):
    c = _claims(s, d)
    return c.select("l_partkey", F.col("l_suppkey").alias("a"), F.col("q").alias("qa")).join(c.select("l_partkey", F.col("l_suppkey").alias("b"), F.col("q").alias("qb")), "l_partkey").filter("a < b")


@query(_CLAIMS + _PAIRED + "WHERE x.q = y.q")
def supports_edges(s, d):
    return _paired(s, d).filter("qa = qb").select("l_partkey", "a", "b")


@query(_CLAIMS + _PAIRED + "WHERE abs(x.q - y.q) >= 80")
def contradicts_edges(s, d):
    return _paired(s, d).filter("abs(qa - qb) >= 80").select("l_partkey", "a", "b")


@query(_CLAIMS + _PAIRED + "WHERE x.q <> y.q")
def contradicts_edges_all(s, d):
    """Every pair of differing claims on one part; contradicts_edges has those that differ by 80 or more only."""
    return _paired(s, d).filter("qa <> qb").select("l_partkey", "a", "b")


@query("SELECT o_orderkey, round(o_totalprice - coalesce(t, 0), 2) AS gap FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS t FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE abs(o_totalprice - coalesce(t, 0)) > 1")
def aggregate_mismatch(s, d):
    sums = t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("t"))
    gap = F.col("o_totalprice") - F.coalesce("t", F.lit(0.0))
    return t(s, d, "orders").join(sums, "o_orderkey", "left").filter(F.abs(gap) > 1).select("o_orderkey", F.round(gap, 2).alias("gap"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(l_extendedprice * (1 - l_discount) * (1 + l_tax) - l_extendedprice) > 0.1 * l_extendedprice")
def arithmetic_check(s, d):
    return t(s, d, "lineitem").filter("abs(l_extendedprice * (1 - l_discount) * (1 + l_tax) - l_extendedprice) > 0.1 * l_extendedprice").select("l_orderkey", "l_linenumber")


@query("SELECT sha256(text) AS digest, count(DISTINCT source) AS n_sources, count(DISTINCT lang) AS n_langs FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def cross_source_conflicts(s, d):
    return t(s, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.countDistinct("source").alias("n_sources"), F.countDistinct("lang").alias("n_langs")).filter("n_sources > 1")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, r::INT AS r FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 8")
def topk_reinforcement(s, d):
    return D.first_of_each(t(s, d, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], "r").filter("r <= 8").select("l_suppkey", "l_orderkey", "l_linenumber", "r")


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS sources, CASE WHEN count(DISTINCT l_suppkey) >= 3 THEN 'well_corroborated' WHEN count(DISTINCT l_suppkey) = 2 THEN 'corroborated' ELSE 'single_source' END AS tier FROM lineitem GROUP BY 1")
def corroboration(s, d):
    return t(s, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("sources")).withColumn("tier", A.corroboration(F.col("sources")))


@query(_CLAIMS + "SELECT l_partkey, count(*) AS claims, count(DISTINCT q) AS stances, max(q) AS high, min(q) AS low FROM c GROUP BY 1")
def scope_truth(s, d):
    return _claims(s, d).groupBy("l_partkey").agg(F.count("*").alias("claims"), F.countDistinct("q").alias("stances"), F.max("q").alias("high"), F.min("q").alias("low"))


@query("SELECT o_orderkey, CASE WHEN b = a THEN 0.0 ELSE round(2.0 * (epoch(o_orderdate)::BIGINT - a) / (b - a), 4) END AS recency FROM (SELECT *, min(epoch(o_orderdate)::BIGINT) OVER (PARTITION BY o_orderpriority) AS a, max(epoch(o_orderdate)::BIGINT) OVER (PARTITION BY o_orderpriority) AS b FROM orders)")
def recency_authority(s, d):
    return A.recency(t(s, d, "orders"), "o_orderdate", ["o_orderpriority"]).select("o_orderkey", "recency")


@query("SELECT o_custkey, o_orderkey AS governing, n AS claims FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'O' THEN 65 ELSE 40 END DESC, o_totalprice DESC, o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def governing_choice(s, d):
    score = A.lookup(F.col("o_orderstatus"), {"F": A.RANKS["contractual"], "O": A.RANKS["vendor"]}, A.RANKS["machine"])
    return A.governing(t(s, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")), ["o_custkey"], score, F.col("o_totalprice"), F.col("o_orderdate"), "o_orderkey")


@query("SELECT o_orderkey, count(l_linenumber) AS members, count(DISTINCT l_returnflag) AS flags, list_sort(list(DISTINCT l_linestatus))[1] AS first_status FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def packet_groups(s, d):
    return t(s, d, "lineitem").join(t(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("l_linenumber").alias("members"), F.countDistinct("l_returnflag").alias("flags"), F.min("l_linestatus").alias("first_status"))


_RISK = "round(least(greatest(CASE o_orderstatus WHEN 'F' THEN 0.85 WHEN 'O' THEN 0.68 ELSE 0.5 END + CASE WHEN o_totalprice > 200000 THEN 0.1 ELSE 0 END + CASE WHEN o_orderpriority LIKE '1%' THEN 0.1 ELSE 0 END, 0), 1), 4)"


def _risk():
    family = F.when(F.col("o_orderstatus") == "F", "exclusion").when(F.col("o_orderstatus") == "O", "access").otherwise("other")
    return A.risk(family, [(F.col("o_totalprice") > 200000, 0.10), (F.startswith("o_orderpriority", F.lit("1")), 0.10)])


@query(f"SELECT o_orderkey, risk, CASE WHEN risk >= 0.9 THEN 'critical' WHEN risk >= 0.75 THEN 'high' WHEN risk >= 0.45 THEN 'medium' ELSE 'low' END AS severity FROM (SELECT o_orderkey, ({_RISK})::DOUBLE AS risk FROM orders)")
def packet_risk(s, d):
    return t(s, d, "orders").select("o_orderkey", _risk().alias("risk")).withColumn("severity", A.severity(F.col("risk")))


@query(f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY ({_RISK})::DOUBLE DESC, o_totalprice DESC, o_orderkey) AS place FROM orders")
def queue_order(s, d):
    return D.first_of_each(t(s, d, "orders").withColumn("risk", _risk()), ["o_custkey"], [F.desc("risk"), F.desc("o_totalprice"), F.col("o_orderkey")], "place").select("o_orderkey", "place")


@query("SELECT l_suppkey, count(*) AS lines, count(DISTINCT l_orderkey) AS orders, sum((l_returnflag = 'R')::INT)::BIGINT AS returned FROM lineitem GROUP BY 1")
def stakeholder_load(s, d):
    return t(s, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("lines"), F.countDistinct("l_orderkey").alias("orders"), F.sum((F.col("l_returnflag") == "R").cast("int")).alias("returned"))


@query("SELECT l_returnflag, coalesce(sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice::DECIMAL(18,2) END), 0)::DOUBLE AS f, coalesce(sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice::DECIMAL(18,2) END), 0)::DOUBLE AS o FROM lineitem GROUP BY 1")
def deal_financials(s, d):
    rows = t(s, d, "lineitem").select("l_returnflag", F.lower("l_linestatus").alias("k"), F.col("l_extendedprice").cast("decimal(18,2)").alias("x"))
    return rows.groupBy("l_returnflag").pivot("k", ["f", "o"]).agg(F.sum("x").cast("double")).fillna(0.0)


@query("SELECT doc_id, round(0.5 + CASE WHEN quality IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN n_chars >= 80 THEN 0.05 WHEN n_chars < 20 THEN -0.1 ELSE 0 END + CASE WHEN toxic = 1 THEN -0.05 ELSE 0 END, 3)::DOUBLE AS confidence FROM documents LEFT JOIN labels USING (doc_id)")
def completeness_score(s, d):
    score = F.lit(0.5) + F.when(F.col("quality").isNotNull(), 0.15).otherwise(0.0) + F.when(F.col("n_chars") >= 80, 0.05).when(F.col("n_chars") < 20, -0.1).otherwise(0.0) + F.when(F.col("toxic") == 1, -0.05).otherwise(0.0)
    return t(s, d, "documents").select("doc_id", "n_chars").join(t(s, d, "labels"), "doc_id", "left").select("doc_id", F.round(score, 3).alias("confidence"))


@query("SELECT source, CASE WHEN regexp_matches(source, '[05]$') THEN 'contractual_final' WHEN regexp_matches(source, '[1-3]$') THEN 'approved_scope' ELSE 'supporting_evidence' END AS tier, count(*) AS n FROM documents GROUP BY ALL")
def source_tier(s, d):
    tier = F.when(F.regexp_like("source", F.lit("[05]$")), "contractual_final").when(F.regexp_like("source", F.lit("[1-3]$")), "approved_scope").otherwise("supporting_evidence")
    return t(s, d, "documents").groupBy("source", tier.alias("tier")).agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS n, sum((quality = 1)::INT)::BIGINT AS good, round(sum((quality = 1)::INT) / count(*), 6) AS share FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def recall_metrics(s, d):
    j = t(s, d, "documents").select("doc_id", "lang").join(t(s, d, "labels"), "doc_id")
    return j.groupBy("lang").agg(F.count("*").alias("n"), F.sum((F.col("quality") == 1).cast("int")).alias("good")).withColumn("share", F.round(F.col("good") / F.col("n"), 6))


@query("SELECT source, count(*) AS support, sum(toxic)::BIGINT AS hits FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING count(*) >= 3")
def rule_mining_support(s, d):
    return t(s, d, "documents").select("doc_id", "source").join(t(s, d, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("support"), F.sum("toxic").alias("hits")).filter("support >= 3")


@query("SELECT doc_id, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'validate' ELSE 'test' END AS split FROM (SELECT doc_id, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 4))::INT % 100 AS b FROM documents)")
def hash_split(s, d):
    return t(s, d, "documents").select("doc_id", T.hash_split(F.col("doc_id")).alias("split"))


@query("SELECT source, n, round(((h / n) + 3.8416 / (2 * n) - 1.96 * sqrt(((h / n) * (1 - (h / n)) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 6) AS bound FROM (SELECT source, count(*) AS n, sum(quality) AS h FROM documents JOIN labels USING (doc_id) GROUP BY 1)")
def wilson_bound(s, d):
    g = t(s, d, "documents").select("doc_id", "source").join(t(s, d, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("h"))
    return g.select("source", "n", F.round(T.wilson_lower(F.col("h"), F.col("n")), 6).alias("bound"))


@query("SELECT event_id, k AS key, (props::JSON ->> ('$.' || k)) AS leaf FROM (SELECT event_id, props, unnest(json_keys(props::JSON)) AS k FROM events)")
def json_leaves(s, d):
    return S.json_leaves(t(s, d, "events"), "event_id", "props")


@query(r"SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, len(html) AS n_chars FROM pages")
def html_title(s, d):
    return t(s, d, "pages").select("page_id", F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")).alias("title"), F.length("html").cast("long").alias("n_chars"))


@query()
def html_blocks(s, d):
    return t(s, d, "pages").select("page_id", F.posexplode(S.html_blocks(F.col("html"))).alias("place", "block"))


def _vectors(s, d):
    return t(s, d, "embeddings").select("vec_id", "label", R.unit(F.col("embedding")).alias("v"))


def _neighbours(s, d):
    v = _vectors(s, d)
    return R.top_k(v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), v.select("vec_id", "v"), 10)


_SIMS = "WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, i.vec_id, i.label, round(list_sum(list_transform(list_zip(q.v, i.v), lambda z: z[1] * z[2])), 6) AS sim FROM u q, u i WHERE q.vec_id % 100 = 0 AND q.vec_id <> i.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS place FROM s) "


@query(_SIMS + "SELECT query_id, vec_id, sim, place FROM r WHERE place <= 10")
def vector_topk(s, d):
    return _neighbours(s, d)


@query(_SIMS + "SELECT query_id, CASE WHEN top >= 0.2 AND weight - second >= 0.05 THEN label ELSE -1 END AS label, weight FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, label) AS t, coalesce(lead(weight) OVER (PARTITION BY query_id ORDER BY weight DESC, label), 0) AS second, max(best) OVER (PARTITION BY query_id) AS top FROM (SELECT query_id, label, round(sum(greatest(sim, 0)::DECIMAL(20,6))::DOUBLE, 6) AS weight, max(sim) AS best FROM r WHERE place <= 10 GROUP BY 1, 2)) WHERE t = 1")
def knn_vote(s, d):
    return R.vote(_neighbours(s, d).join(t(s, d, "embeddings").select("vec_id", "label"), "vec_id"), 0.2, 0.05).withColumn("label", F.coalesce("label", F.lit(-1)))  # -1: abstains


@query("SELECT label, dimension, count(*) AS n, round(sum(x::DECIMAL(20,8))::DOUBLE / count(*), 6) AS mean FROM (SELECT label, unnest(range(0, len(embedding)))::INT AS dimension, unnest(embedding) AS x FROM embeddings) GROUP BY 1, 2")
def prototypes(s, d):
    return R.prototypes(t(s, d, "embeddings").select("label", F.col("embedding").alias("v")), 64).select("label", "dimension", "n", "mean")


@query("WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents), b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS place FROM documents) SELECT doc_id, round(sum((1.0::DOUBLE / (60 + place))::DECIMAL(20,10))::DOUBLE, 8) AS score FROM (SELECT * FROM a WHERE place <= 400 UNION ALL SELECT * FROM b WHERE place <= 400) GROUP BY 1")
def rrf_fusion(s, d):
    docs = t(s, d, "documents").select("doc_id", "n_chars")
    best = lambda *o: docs.orderBy(*o).limit(400).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*o)))  # noqa: E731  the two lists' top 400
    return R.fuse(best(F.desc("n_chars"), "doc_id").union(best("n_chars", "doc_id")), "doc_id")


@query()
def mmr(s, d):
    n = _neighbours(s, d).join(_vectors(s, d).select("vec_id", "v"), "vec_id")
    return R.diverse(n.select("query_id", "vec_id", "sim", "v"), 5)


@query("SELECT conv_id, turn, string_agg(text, ' | ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS around FROM conversations")
def neighbour_frame(s, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-1, 1)
    return t(s, d, "conversations").select("conv_id", "turn", F.array_join(F.collect_list("text").over(w), " | ").alias("around"))


@query("WITH k AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS together FROM k x JOIN k y USING (l_orderkey) WHERE x.l_suppkey < y.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 3")
def cooccurrence(s, d):
    return G.blocked_pairs(t(s, d, "lineitem"), "l_orderkey", "l_suppkey", 2, 20).withColumnRenamed("shared", "together").filter("together >= 3")


def _halves(s, d):
    o = t(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return o.filter("o_orderkey % 7 <> 0"), o.filter("o_orderkey % 5 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("o_orderstatus")))


_DIFF = "WITH b AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0), a AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0), c AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN a.o_orderkey IS NULL THEN 'removed' WHEN a.o_orderstatus = b.o_orderstatus AND a.o_totalprice = b.o_totalprice THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey) "


@query(_DIFF + "SELECT * FROM c")
def snapshot_diff(s, d):
    before, after = _halves(s, d)
    return X.snapshot_diff(before, after, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query(_DIFF + "SELECT o_custkey, count(*) AS n_changed FROM c JOIN orders USING (o_orderkey) WHERE change <> 'unchanged' GROUP BY 1")
def invalidation(s, d):
    before, after = _halves(s, d)
    changes = X.snapshot_diff(before, after, "o_orderkey", ["o_orderstatus", "o_totalprice"])
    return X.invalidated(t(s, d, "orders").select("o_orderkey", "o_custkey"), changes, "o_custkey", "o_orderkey")


@query("SELECT 'order_customer' AS check_name, count(*) AS violations FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'line_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def integrity_checks(s, d):
    o, c, li = t(s, d, "orders"), t(s, d, "customer"), t(s, d, "lineitem")
    return X.orphans(o, c, "o_custkey", "c_custkey", "order_customer").union(X.orphans(li, o, "l_orderkey", "o_orderkey", "line_order"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 50")
def page_api(s, d):
    """A page of results, as the REST surface gives it: the limit is the feature."""
    return t(s, d, "orders").filter("o_orderstatus = 'O' and o_totalprice >= 100000").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice").offset(50).limit(50)


@query("WITH RECURSIVE e AS (SELECT o_custkey AS a, -o_orderkey AS b FROM orders), n AS (SELECT c_custkey, (SELECT min(c2.c_custkey) FROM customer c2 WHERE c2.c_nationkey = c1.c_nationkey AND c2.c_mktsegment = c1.c_mktsegment) AS root FROM customer c1) SELECT c_custkey AS node, root FROM n WHERE root IN (SELECT root FROM n GROUP BY 1 HAVING count(*) > 1)")
def components(s, d):
    c = t(s, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    w = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    return G.components(c.select(F.col("c_custkey").alias("a"), F.lag("c_custkey").over(w).alias("b")).filter("b is not null"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value::DECIMAL(18,4))::DOUBLE, 4) AS total FROM events GROUP BY 1, 2")
def event_windows(s, d):
    return E.windowed(t(s, d, "events"))


@query("SELECT b.item_id, count(*) AS n_tokens FROM (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '([a-z0-9]{3,})', 1)) AS w FROM benchmark) b GROUP BY 1")
def entity_key_index(s, d):
    return t(s, d, "benchmark").select("item_id", F.explode(T.tokens(F.col("text"))).alias("w")).groupBy("item_id").agg(F.count("*").alias("n_tokens"))


@query(r"SELECT page_id, lower(regexp_extract(url, '^https?://(?:www\.|m\.)?([^/?#]+)', 1)) || rtrim(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/') AS normal FROM pages")
def url_normalize(s, d):
    host = F.lower(F.regexp_extract("url", r"^https?://(?:www\.|m\.)?([^/?#]+)", 1))
    return t(s, d, "pages").select("page_id", F.concat(host, F.rtrim(F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1), F.lit("/"))).alias("normal"))


@query("SELECT conv_id, segment, min(role) AS speaker, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n_turns FROM (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM (SELECT *, (role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) OR row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1)::INT AS new FROM conversations)) GROUP BY 1, 2")
def speaker_segments(s, d):
    """Runs of turns of one speaker."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    new = ~F.col("role").eqNullSafe(F.lag("role").over(w)) | (F.row_number().over(w) == 1)
    rows = t(s, d, "conversations").select("conv_id", "turn", "role", new.cast("int").alias("new"))
    rows = rows.withColumn("segment", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("conv_id", "segment").agg(F.min("role").alias("speaker"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n_turns"))


@query("WITH k AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), e AS (SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS together FROM k x JOIN k y USING (l_orderkey) WHERE x.l_suppkey < y.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 3), n AS (SELECT a AS node, b AS neighbour, together FROM e UNION ALL SELECT b, a, together FROM e) SELECT node, neighbour, together FROM n JOIN supplier ON s_suppkey = node WHERE s_acctbal < 0")
def expand_1hop(s, d):
    """Neighbours, by shared orders, of the suppliers in question (a negative balance)."""
    e = G.blocked_pairs(t(s, d, "lineitem"), "l_orderkey", "l_suppkey", 2, 20).withColumnRenamed("shared", "together").filter("together >= 3")
    both = e.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("neighbour")), F.struct(F.col("b").alias("node"), F.col("a").alias("neighbour")))).alias("x"), "together").select("x.*", "together")
    return both.join(t(s, d, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("node")), "node").select("node", "neighbour", "together")


@query("SELECT o_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE abs(l_quantity * p_retailprice - l_extendedprice) > greatest(0.02, 0.0001 * greatest(abs(l_quantity * p_retailprice), abs(l_extendedprice)))")
def price_math_mismatch(s, d):
    """Lines whose quantity times unit price is not their extended price."""
    x = t(s, d, "lineitem").join(t(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey")
    x = x.filter("abs(l_quantity * p_retailprice - l_extendedprice) > greatest(0.02, 0.0001 * greatest(abs(l_quantity * p_retailprice), abs(l_extendedprice)))")
    return x.join(t(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
