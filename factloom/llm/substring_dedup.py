"""Substring dedup: repeated word windows across a corpus, by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words. Each window has a minimiser, the least hash among its
word 3-grams, and consecutive windows that share it travel as one packed string (a super-k-mer) to the
minimiser's bucket. Sorting a bucket's windows brings equal ones together; equality of hashes is then
confirmed word by word, so counts are exact. The first start (smallest document, then position) stays.

Skew. (1) Equal super-k-mers of one block of rows travel once: the later ones are repeats already, and go as merged spans by
a bucket that has nothing to do with the passage. So a passage that a third of all documents share reaches its bucket once per block. (2) Grams that hold over
``HOT_SHARE`` of sampled positions lose their place in the order (they are minimisers of nothing), and a window of
nothing but such grams goes by its own hash. There are at most 2 / HOT_SHARE of them, which bounds what is
sent to tasks. (3) The number of buckets follows the number of words.

Defined results: null, empty and short texts have no window and lose nothing; a text of any length is read whole; a null doc_id sorts last;
rows with the same doc_id and text are the same place, so neither repeats the other; an empty table gives an
empty result; other columns are not read.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _blocks as B

WINDOW = 20
GRAM = 3
HOT_SHARE = 1 / 2048
#: Words whose windows one bucket holds on average.
BUCKET_WORDS = 400_000
_NONE = 2**63 - 1


def _hot(window: int):
    def run(batches):
        for _, texts in B.blocks(batches):
            whole = b" ".join([x for t in texts if t and (x := B.spaced(t))])
            words = B.words_of(whole)[2] if whole else np.empty(0, np.uint64)
            g = B.grams(words, GRAM)
            span = window - GRAM + 1
            least = g[: len(g) // span * span].reshape(-1, span).min(axis=1) if len(g) >= span else g[:0]
            keys, counts = B.heavy(least, HOT_SHARE)
            yield pa.RecordBatch.from_pydict({"k": pa.array([None, *keys.view(np.int64).tolist()], pa.int64()), "n": pa.array([len(words), *counts.tolist()], pa.int64()), "of": pa.array([len(least)] + [0] * len(keys), pa.int64())})

    return run


def _window_hash(h: np.ndarray, w: int) -> np.ndarray:
    """Hash of each w consecutive values, by doubling: w as a sum of powers of two."""
    n = len(h) - w + 1
    if n <= 0:
        return h[:0]
    part, size, out, done, power = h, 1, None, 0, np.array([B.M1], np.uint64)
    while size <= w:
        if w & size:
            piece = part[done : done + n]
            out = piece.copy() if out is None else out * power + piece
            done += size
        part = part[:-size] * power + part[size:] if len(part) > size else part[:0]
        power = power * power
        size *= 2
    return B.mix(out)


def _spread(window: int, buckets: int, hot: np.ndarray):
    def run(batches):
        for columns, texts in B.blocks(batches):
            yield from _block(columns["doc"].to_numpy(zero_copy_only=False), columns["tag"].to_numpy(zero_copy_only=False), texts, window, buckets, hot)

    return run


def _block(docs, tags, texts, window, buckets, hot):
    order = np.lexsort((tags, docs))
    parts, which, sizes = [], [], []
    for i in order.tolist():
        if texts[i] and (n := (t := B.spaced(texts[i])).count(b" ") + 1) >= window:
            which.append(i)
            sizes.append(n)
            parts.append(t)
    if not parts:
        return
    whole = b" ".join(parts)
    del parts
    sizes = np.array(sizes, np.int64)
    first = np.cumsum(sizes) - sizes
    begin, end, h = B.words_of(whole)
    g = B.grams(h, GRAM)
    g[B.is_in(g, hot)] = B.TOP
    key = B.sliding_min(g, window - GRAM + 1)
    if (none := key == B.TOP).any():
        key = np.where(none, _window_hash(h, window), key)
    doc_of = np.repeat(np.arange(len(which)), sizes)
    valid = doc_of[: len(key)] == doc_of[window - 1 :]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | ~valid[:-1]
    starts = np.flatnonzero(valid & fresh)
    stop = np.flatnonzero(valid & np.append(fresh[1:] | ~valid[1:], True))
    count = stop - starts + 1
    low, high = begin[starts].tolist(), end[starts + count + window - 2].tolist()
    _, at, of = np.unique(B.runs_hash(h, starts, count + window - 1), return_index=True, return_inverse=True)
    lead = at[of]
    for j in np.flatnonzero(lead != np.arange(len(lead))).tolist():
        if whole[low[j] : high[j]] != whole[low[lead[j]] : high[lead[j]]]:
            lead[j] = j  # two hashes coincide: it travels by itself
    owner = doc_of[starts]
    doc, tag = docs[which][owner], tags[which][owner]
    start = (starts - first[owner]).astype(np.int32)
    bucket = (B.mix(key[starts] + B.M1) % np.uint64(buckets)).astype(np.int32)
    own = lead == np.arange(len(lead))
    #: Equal rows are one place: what starts at the leader's own place is no repeat of it.
    again = np.flatnonzero(~own & ((doc != doc[lead]) | (tag != tag[lead]) | (start != start[lead])))
    out_b, out, none = [], [], [np.empty(0, k) for k in (np.int64, np.int64, np.int32, np.int32)]
    if len(again):  # repeats of this block are spans already: they go by any bucket, in one blob
        a, z = start[again], start[again] + count[again] + window - 1
        new = np.ones(len(again), bool)
        new[1:] = (owner[again[1:]] != owner[again[:-1]]) | (a[1:] > z[:-1])
        last = np.append(np.flatnonzero(new)[1:], len(again)) - 1
        a, z, rep = a[new].astype(np.int32), z[last].astype(np.int32), again[new]
        out_b.append(int((int(tag[rep[0]]) ^ int(doc[rep[0]])) % buckets))
        out.append(B.pack(*none[:4], b"", doc[rep], tag[rep], a, z))
    sent = np.flatnonzero(own)
    sent = sent[np.argsort(bucket[sent], kind="stable")]
    cuts = np.searchsorted(bucket[sent], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        send = sent[cuts[b] : cuts[b + 1]]
        text = b"\n".join([whole[low[j] : high[j]] for j in send.tolist()])
        out_b.append(b)
        out.append(B.pack(doc[send], tag[send], start[send], count[send].astype(np.int32), text, *none))
        if len(out) >= 64:
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(out_b, pa.int32()), "blob": pa.array(out, pa.binary())})
            out_b, out = [], []
    if out:
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(out_b, pa.int32()), "blob": pa.array(out, pa.binary())})


def _solve(blobs: list[bytes], window: int):
    """Word spans (doc, tag, low, high) of a bucket that repeat an earlier start."""
    parts = [B.unpack(b) for b in blobs]
    column = lambda i, kind: np.concatenate([np.frombuffer(p[i], kind) for p in parts])
    doc, tag, start, count = column(0, np.int64), column(1, np.int64), column(2, np.int32), column(3, np.int32)
    found = [(column(5, np.int64), column(6, np.int64), column(7, np.int32), column(8, np.int32))]
    if len(doc):
        whole = b"\n".join([p[4] for p in parts if len(p[4])])
        begin, end, h = B.words_of(whole)
        length = count + window - 1
        base = np.cumsum(length, dtype=np.int64) - length
        order = np.lexsort((start, tag, doc))
        n = count[order]
        run = np.repeat(order, n)
        inside = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        place = base[run] + inside
        late, early = _equal(_window_hash(h, window)[place])
        late, early = _confirmed(whole, begin[place], end[place + window - 1], run, late, early)
        at = start[run] + inside
        there = (doc[run[late]] != doc[run[early]]) | (tag[run[late]] != tag[run[early]]) | (at[late] != at[early])
        flag = np.zeros(len(run), bool)
        flag[late[there]] = True
        hit = np.flatnonzero(flag)
        if len(hit):
            new = np.ones(len(hit), bool)
            new[1:] = (hit[1:] != hit[:-1] + 1) | (run[hit[1:]] != run[hit[:-1]])
            a, z = hit[new], hit[np.append(np.flatnonzero(new)[1:], len(hit)) - 1]
            found.append((doc[run[a]], tag[run[a]], at[a].astype(np.int32), (at[z] + window).astype(np.int32)))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _equal(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(late, early): places whose hash stands at an earlier place too, ascending, and the first such place."""
    by = np.argsort(hashes)
    sorted_ = hashes[by]
    new = np.ones(len(by), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    cuts = np.flatnonzero(new)
    size = np.diff(np.append(cuts, len(by)))
    many = np.repeat(size > 1, size)
    if not many.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    by, size = by[many], size[size > 1]
    first = np.repeat(np.minimum.reduceat(by, np.cumsum(size) - size), size)
    late = by != first
    order = np.argsort(by[late])
    return by[late][order], first[late][order]


def _confirmed(whole: bytes, low, high, run, late, early):
    """The pairs of windows that are equal word by word. Runs of windows whose first places run along too are compared as one text."""
    if not len(late):
        return late, early
    new = np.ones(len(late), bool)
    new[1:] = (late[1:] != late[:-1] + 1) | (early[1:] != early[:-1] + 1) | (run[late[1:]] != run[late[:-1]]) | (run[early[1:]] != run[early[:-1]])
    cuts = np.flatnonzero(new)
    last = np.append(cuts[1:], len(late)) - 1
    ends = (low[late[cuts]].tolist(), high[late[last]].tolist(), low[early[cuts]].tolist(), high[early[last]].tolist())
    if all(whole[a:z] == whole[b:y] for a, z, b, y in zip(*ends, strict=True)):
        return late, early
    #: Two hashes coincide: all windows by their own words.
    first: dict[bytes, int] = {}
    same = [(j, k) for j, (a, z) in enumerate(zip(low.tolist(), high.tolist(), strict=True)) if (k := first.setdefault(whole[a:z], j)) != j]
    return np.array([j for j, _ in same], np.int64), np.array([k for _, k in same], np.int64)


def _buckets(window: int):
    def run(batches):
        for _, blobs in B.by_key(batches):
            doc, tag, low, high = _solve(blobs, window)
            for a in range(0, len(doc), 50_000):
                z = slice(a, a + 50_000)
                yield pa.RecordBatch.from_pydict({"doc": pa.array(doc[z], pa.int64()), "tag": pa.array(tag[z], pa.int64()), "low": pa.array(low[z], pa.int32()), "high": pa.array(high[z], pa.int32())})

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("doc"), F.xxhash64("text").alias("tag"), F.col("text"))


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Word spans [low, high) of documents that are covered by repeated windows.

    docs: doc_id, text. Result: doc (doc_id; null as the largest long), tag (xxhash64 of the text), low, high.
    Spans of a document may touch or overlap.
    """
    rows = _keyed(docs)
    share = rows.select("text").mapInArrow(_hot(window), "k long, n long, of long")
    sums = B.checkpointed(share.groupBy("k").agg(F.sum("n").alias("n"), F.sum("of").alias("of")))  # the pass over all texts runs once
    total = sums.filter("k is null").first()
    words, sampled = (total["n"], total["of"]) if total else (0, 0)
    limit = max(2, sampled * HOT_SHARE / 2)
    hot = np.array(sorted(r["k"] for r in sums.filter(F.col("k").isNotNull() & (F.col("n") >= limit)).collect()) if sampled else [], np.int64).view(np.uint64)
    hot.sort()
    buckets = max(16, words // BUCKET_WORDS)
    parts = rows.mapInArrow(_spread(window, buckets, hot), "bucket int, blob binary")
    return parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_buckets(window), "doc long, tag long, low int, high int")


def _zip(batches):
    """Texts compressed one by one, which halves what the join with their spans moves."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        texts = [None if t is None else squeeze(t) for t in (x.as_py() for x in B.binary(b.column("text")))]
        yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").cast(pa.int64()), "doc": b.column("doc"), "tag": b.column("tag"), "zipped": pa.array(texts, pa.binary())})


def removed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Each row of docs (doc_id, text) with its repeated spans: doc_id, zipped (zstd of the text), spans array<struct<low,high>> or null."""
    spans = repeated_spans(docs, window).groupBy("doc", "tag").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("doc"), F.xxhash64("text").alias("tag"), "text")
    return rows.mapInArrow(_zip, "doc_id long, doc long, tag long, zipped binary").join(spans, ["doc", "tag"], "left").select("doc_id", "zipped", "spans")


def _kept_words(text: bytes | None, spans) -> tuple[int, int, bytes]:
    """Words, removed words, and the kept ones joined by one space."""
    words = text.split() if text else []
    if spans is None:
        return len(words), 0, b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        gone[s["low"]] += 1
        gone[s["high"]] -= 1
    out = np.cumsum(gone[:-1]) > 0
    return len(words), int(out.sum()), b" ".join([w for w, o in zip(words, out.tolist(), strict=True) if not o])


def _digest(batches):
    plain = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        found = [_kept_words(plain(t) if t else None, s) for t, s in zip(batch.column("zipped").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": pa.array([x[0] for x in found], pa.int64()), "n_removed": pa.array([x[1] for x in found], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x[2]).hexdigest() for x in found], pa.string())})


def dedup_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (SHA-256 of the kept words joined by one space)."""
    return removed(B.own(docs, "doc_id", "text"), window).mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup_texts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the repeated words taken out of text; n_chars follows where the column is there.

    A text without repeats keeps its own spacing; in a changed one the kept words are joined by one space.
    Rows whose words are all repeats keep an empty text. Columns and rows stay.
    """
    doc, tag, held = B.unused(docs, "doc", "tag", "spans")
    spans = repeated_spans(B.own(docs, "doc_id", "text"), window).groupBy("doc", "tag").agg(F.collect_list(F.struct("low", "high")).alias(held))
    rows = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE))).withColumn(tag, F.xxhash64("text"))
    spans = spans.withColumnsRenamed({"doc": doc, "tag": tag})
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    joined = rows.join(spans, [doc, tag], "left")
    #: Spans in order of position; a word stays where no span holds it.
    kept = F.array_join(F.flatten(_gaps(F.col(held), words)), " ")
    new = F.when(F.col(held).isNull(), F.col("text")).otherwise(kept)
    out = joined.withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(held).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return B.own(out, *docs.columns)


def _gaps(spans, words):
    """The words between spans, as an array of arrays."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,z:int>>").alias("out"))
    step = lambda acc, s: F.struct(F.greatest(acc["at"], s["high"]).alias("at"), F.when(s["low"] > acc["at"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("a"), s["low"].alias("z"))))).otherwise(acc["out"]).alias("out"))
    return F.flatten(F.transform(F.array(words), lambda w: F.transform(
        F.aggregate(F.concat(F.array_sort(spans), F.array(F.struct(F.size(w).alias("low"), F.size(w).alias("high")))), start, step, lambda acc: acc["out"]),
        lambda g: F.slice(w, g["a"] + 1, g["z"] - g["a"]))))


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every text of documents without the windows that start earlier too."""
    return dedup_digest(B.table(spark, sf_dir, "documents"))


#: For the SQL check: the same windows, by a plain self-comparison of positions.
OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, s, array_to_string(ws[s:s+19], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20)
), late AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM win) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, s + o AS p FROM late, (SELECT unnest(range(0, 20)) AS o)
), word AS (
  SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w
), kept AS (
  SELECT word.doc_id, string_agg(x, ' ' ORDER BY p) FILTER (WHERE gone.p IS NULL) AS t, count(gone.p) AS n_removed, count(*) AS n_words
  FROM word LEFT JOIN gone USING (doc_id, p) GROUP BY ALL
)
SELECT w.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
