"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(bias + sum of term weights + sum over pairs of terms of the dot product of their factors), so that terms
that are harmless alone and toxic together can be learnt. Terms are a text's distinct words (ASCII lower-cased, ASCII
punctuation cut off), hashed to 2**BITS weights; labels, lang, source and doc_id are never terms.

Which terms have weights: those whose share among toxic and clean texts differs clearly, and those of some pair whose share does, though
neither term's own does. So a rare word is not learnt by heart, and terms that matter only together are kept. Pairs are counted
among the PAIR_TERMS most frequent other terms.

The model is fitted by AdaGrad on a bounded sample of labelled rows: at most TOXIC_ROWS toxic and CLEAN_ROWS clean ones, the least by a hash of
doc_id, of those whose crc32(doc_id as text) mod 5 is not 0, as far as they hold at most SAMPLE_TERMS terms in all (which bounds what the driver
receives). Its size is fixed by BITS and FACTORS. Scoring reads every whole text.

Defined results: null or empty text has no term and scores the bias; a null doc_id counts as an empty text in the
remainder; a document with several labels takes the largest, and of rows with one labelled doc_id the least by terms is learnt from; repeated rows are scored each;
a text of any length is scored whole; without labelled rows of both kinds every score is the share of toxic ones (0.001 to 0.999; 0.001 without labels), and without_toxic keeps
every row, as no text tells more than another; other columns are not read; an empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _blocks as B

BITS = 18
FACTORS = 4
TOXIC_ROWS, CLEAN_ROWS = 4_000, 8_000
SAMPLE_TERMS = 16_000_000
EPOCHS = 12
#: Sampled texts that a term stands in at least, and standard errors by which its share among toxic and clean ones differs.
LEAST_DOCUMENTS, LEAST_Z = 4, 4.0
#: The same for pairs of terms; there are two million pairs, so that chance goes further.
PAIR_TERMS, PAIR_DOCUMENTS, PAIR_Z = 2048, 16, 8.0
_CUT = bytes(32 if (c < 128 and not chr(c).isalnum()) else (c + 32 if 65 <= c <= 90 else c) for c in range(256))


class Terms(dict):
    def __missing__(self, word: bytes) -> int:
        at = self[word] = xxhash.xxh3_64_intdigest(word) & ((1 << BITS) - 1)
        return at

    def of(self, text: bytes | None) -> np.ndarray:
        if len(self) > 300_000:
            self.clear()
        words = set(text.translate(_CUT).split()) if text else ()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def remainder(doc_id):
    """crc32 of doc_id as text, mod 5."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic, terms binary (int64 indexes) of the bounded sample that the model is fitted on."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(remainder("doc_id") != 0)
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    part = lambda y, n: known.filter(F.col("toxic") == y).orderBy(*order).limit(n)
    chosen = part(1, TOXIC_ROWS).union(part(0, CLEAN_ROWS))
    rows = B.own(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")

    def run(batches):
        terms = Terms()
        for columns, texts in B.blocks(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": columns["doc_id"].cast(pa.int64()), "toxic": columns["toxic"].cast(pa.int32()), "terms": pa.array([np.unique(terms.of(t)).astype(np.int32).tobytes() for t in texts], pa.binary())})

    found = rows.mapInArrow(run, "doc_id long, toxic int, terms binary").groupBy("doc_id", "toxic").agg(F.min("terms").alias("terms"))
    held = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # at most TOXIC_ROWS + CLEAN_ROWS rows
    return found.withColumn("held", F.sum(F.length("terms") / 4).over(held)).filter(F.col("held") <= SAMPLE_TERMS).drop("held")


def _apart(count, many):
    """Standard errors by which the shares of two classes differ; count and many: of clean and of toxic texts."""
    part = (count[0] + count[1]) / sum(many)
    spread = np.sqrt(np.maximum(part * (1 - part), 1e-12) * (1 / many[0] + 1 / many[1]))
    return np.abs(count[1] / many[1] - count[0] / many[0]) / spread


def chosen_terms(rows: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Which of the 2**BITS terms have weights, by their own shares or by those of a pair."""
    size = 1 << BITS
    different = {(a, x.tobytes()): x for a, x in rows}  # copies say nothing new about a term
    texts = [[x for (a, _), x in different.items() if a == k] for k in (0, 1)]
    many = [max(1, len(t)) for t in texts]
    count = [np.bincount(np.concatenate(t) if t else np.empty(0, np.int64), minlength=size) for t in texts]
    both = count[0] + count[1]
    own = (both >= LEAST_DOCUMENTS) & (_apart(count, many) >= LEAST_Z)
    others = np.flatnonzero((both >= PAIR_DOCUMENTS) & ~own)
    others = np.sort(others[np.argsort(-both[others], kind="stable")][:PAIR_TERMS])
    at = np.full(size, -1)
    at[others] = np.arange(len(others))
    pairs = [np.zeros((len(others), len(others)), np.float32) for _ in (0, 1)]
    for of, found in zip(texts, pairs, strict=True):
        for a in range(0, len(of), 1024):
            block = np.zeros((len(of[a : a + 1024]), len(others)), np.float32)
            for j, x in enumerate(of[a : a + 1024]):
                block[j, at[x][at[x] >= 0]] = 1
            found += block.T @ block
    for a in range(0, len(others), 256):
        part = [p[a : a + 256] for p in pairs]
        hit = (part[0] + part[1] >= PAIR_DOCUMENTS) & (_apart(part, many) >= PAIR_Z)
        own[others[a : a + 256][hit.any(axis=1)]] = True  # a term with itself is below LEAST_Z
    return own


def fit(rows: list[tuple[int, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
    """bias, weights, factors; rows: (label, term indexes)."""
    size, rng = 1 << BITS, np.random.default_rng(8)
    w, v = np.zeros(size, np.float64), np.zeros((size, FACTORS), np.float64)
    y = np.array([r[0] for r in rows], float)
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.0, 1e-3), 1 - 1e-3)
        return float(np.log(p / (1 - p))), w, v
    often = chosen_terms(rows)
    terms = [r[1][often[r[1]]] for r in rows]
    v[often] = rng.normal(0, 0.05, (int(often.sum()), FACTORS))
    gw, gv = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2)
    bias, gb, rate, decay = float(np.log(y.mean() / (1 - y.mean()))), 1e-2, 0.25, 1e-4
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)).tolist():
            x = terms[i]
            f = v[x]
            total = f.sum(0)
            z = bias + w[x].sum() + 0.5 * ((total**2).sum() - (f**2).sum())
            g = 1 / (1 + np.exp(-max(-30.0, min(30.0, z)))) - y[i]
            gb += g * g
            bias -= rate * g / gb**0.5
            d = g + decay * w[x]
            gw[x] += d * d
            w[x] -= rate * d / np.sqrt(gw[x])
            d = g * (total - f) + decay * f
            gv[x] += d * d
            v[x] = f - 0.5 * rate * d / np.sqrt(gv[x])
    return float(bias), w.astype(np.float32), v.astype(np.float32)


def model_of(docs: DataFrame, labels: DataFrame):
    found = labelled_sample(docs, labels).toArrow().to_pydict()
    rows = sorted(zip(found["doc_id"], found["toxic"], found["terms"], strict=True))
    model = fit([(y, np.frombuffer(t, np.int32).astype(np.int64)) for _, y, t in rows])
    del found, rows
    B.released()
    return model


def _scores(model):
    bias, w, v = model

    def run(batches):
        terms = Terms()
        for columns, texts in B.blocks(batches):
            out = []
            for t in texts:
                x = np.unique(terms.of(t))  # in order, so that equal texts have equal sums
                f = v[x].astype(np.float64)
                z = bias + w[x].sum(dtype=np.float64) + 0.5 * ((f.sum(0) ** 2).sum() - (f**2).sum())
                out.append(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_pydict({**{n: c for n, c in columns.items()}, "score": pa.array(out, pa.float64())})

    return run


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text), learnt from labels (doc_id, toxic)."""
    model = model_of(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id") == 0).alias("held_out"), F.col("text"))
    return rows.mapInArrow(_scores(model), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that are predicted toxic; columns stay. Without labels of both kinds every row stays."""
    bias, w, v = model_of(docs, labels)
    B.small_batches(docs)
    if not w.any() and not v.any():
        return docs

    def run(batches):
        terms = Terms()
        for batch in batches:
            keep = []
            for t in (x.as_py() for x in B.binary(batch.column("text"))):
                x = np.unique(terms.of(t))
                f = v[x].astype(np.float64)
                keep.append(bool(bias + w[x].sum(dtype=np.float64) + 0.5 * ((f.sum(0) ** 2).sum() - (f**2).sum()) < 0))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity_fm(spark, sf_dir: str) -> DataFrame:
    """Every text of documents, scored by a model learnt from labels."""
    return scored(B.table(spark, sf_dir, "documents"), B.table(spark, sf_dir, "labels"))
