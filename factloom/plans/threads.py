"""Queries of threads, quoted lines and name variants, with the SQL that gives the same rows."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import threads as H
from .queries import query, t

_MAIL = {
    "id": "conv_id * 10000 + turn",
    "ref": "CASE WHEN turn % 3 <> 0 THEN 'm' || cast(conv_id * 10000 + turn - 1 as varchar(20)) END",
    "subject_key": "CASE WHEN turn % 4 = 0 AND conv_id % 3 <> 0 THEN 's' || cast(conv_id % 40 as varchar(20)) ELSE '' END",
    "ts": "CASE WHEN turn % 5 <> 4 THEN turn * 7 % 11 END",
}


@query("WITH RECURSIVE m AS MATERIALIZED (SELECT DISTINCT " + ", ".join(f"{v} AS {k}" for k, v in _MAIL.items()) + " FROM conversations), e AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM m x JOIN m y ON x.ref = 'm' || y.id::VARCHAR UNION SELECT x.id, min(y.id) FROM m x JOIN m y USING (subject_key) WHERE subject_key <> '' GROUP BY 1), u AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT id, id FROM m), r AS (SELECT id, id AS near FROM m UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.near), g AS (SELECT id, min(near) AS thread FROM r GROUP BY 1), p AS (SELECT m.*, thread, row_number() OVER w AS place, lag(id) OVER w AS before FROM m JOIN g USING (id) WINDOW w AS (PARTITION BY thread ORDER BY ts IS NULL, ts, id)) SELECT p.id, thread, place, count(*) OVER (PARTITION BY thread) AS size, coalesce(q.id, before) AS parent, CASE WHEN q.id IS NOT NULL THEN 'reference' WHEN before IS NOT NULL THEN 'before' END AS via FROM p LEFT JOIN m q ON p.ref = 'm' || q.id::VARCHAR")
def mail_threads(s, d):
    """Threads of messages made of conversation turns: most refer to the turn before, some share a subject with other conversations."""
    m = t(s, d, "conversations").select(*(F.expr(v).alias(k) for k, v in _MAIL.items())).distinct()
    return H.threads(m.select("id", F.concat(F.lit("m"), F.col("id").cast("string")).alias("message_id"), F.array("ref").alias("refs"), "subject_key", "ts"))


@query("WITH l AS (SELECT doc_id AS id, lang AS thread, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS k, doc_id % 2 = 0 AS quoted FROM documents) SELECT id, CASE WHEN EXISTS (SELECT 1 FROM l o WHERE o.thread = l.thread AND o.k = l.k AND NOT o.quoted) THEN 'authored' ELSE 'quoted' END AS reason FROM l WHERE quoted AND len(k) >= 12 AND EXISTS (SELECT 1 FROM l o WHERE o.thread = l.thread AND o.k = l.k AND (NOT o.quoted OR o.id < l.id))")
def quoted_echoes(s, d):
    """Every other document as a quoted line of its language's thread: those whose text the language has otherwise."""
    return H.quoted_echoes(t(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("thread"), "text", (F.col("doc_id") % 2 == 0).alias("quoted")))


_PERSON = "CASE c_custkey % 3 WHEN 0 THEN 's' || cast(c_custkey % 700 as varchar(20)) WHEN 1 THEN 'j_s' || cast(c_custkey % 500 as varchar(20)) ELSE 'ann' || cast(c_custkey % 2 as varchar(20)) || '_s' || cast(c_custkey % 900 as varchar(20)) END"


@query(f"WITH n AS (SELECT DISTINCT {_PERSON} AS key FROM customer), w AS (SELECT key, regexp_extract(key, '[^_]+$') AS surname, key NOT LIKE 'ann%' AS short FROM n), f AS (SELECT surname, min(key) AS \"full\" FROM w WHERE NOT short GROUP BY 1 HAVING count(*) = 1) SELECT key, \"full\" FROM w JOIN f USING (surname) WHERE short")
def name_variants(s, d):
    """Short forms of names made of customers' numbers, and the full name that each can only mean."""
    return H.variants(t(s, d, "customer").select(F.expr(_PERSON).alias("key")))
