"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import bpe, jaccard_join, license_scans, media_avi, mixing, packing, quality_rules, substring_dedup, toxicity, url_filters

LONG = " ".join(f"t{i % 977}x{i % 13}" for i in range(60_000))
ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "a b c d e f g h"), (5, "a b c d e f g h"), (6, "a b c d e f g h"), (None, None), (None, "x y z"), (None, "x y z"), (7, "same " * 200), (8, "same " * 200), (9, "\u00e9t\u00e9 \U0001f642 z")]
OWN = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for themselves, or that clash with a result's.
NAMES = ["doc", "tag", "bucket", "blob", "spans", "key", "_key", "_doc", "__key", "__gone", "__spans", "__d", "_d", "_size", "_turn", "_slot", "words", "score", "at", "low", "n", "cls", "root", "slot", "a.b", "text2", "Word", "url", "title"]
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def frame(spark, rows=ROWS, names=()):
    data = [(i, t, "en", ["s", None][k % 2], None if t is None else len(t), *(f"{k}{n}" for n in names)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, ", ".join([OWN, *(f"`{n}` string" for n in names)])).repartition(3)


def labels(spark):
    return spark.createDataFrame([(5, 1), (7, 0), (8, 0), (None, 1), (4, 0), (4, 1)], "doc_id long, toxic int")


def ids(docs):
    return bpe.encode_documents(docs, public_tokenizers.PATTERN, PATH)


OPERATORS = {
    "op1 texts": lambda s, d: packing.unpack_documents(packing.pack_texts(d, 512)).filter("chunk = 0"), "op1 ids": lambda s, d: packing.unpack_documents(packing.pack_ids(ids(d), 512)).filter("chunk = 0"),
    "op2": lambda s, d: substring_dedup.dedup_digest(d), "op3": lambda s, d: url_filters.judged(d.drop("url").withColumns({"page_id": F.col("doc_id"), "url": F.col("text")})).withColumnRenamed("page_id", "doc_id"),
    "op4": lambda s, d: quality_rules.judged(d), "op5": lambda s, d: mixing.mixed(d), "op6": lambda s, d: jaccard_join.linked_documents(d),
    "op7": lambda s, d: bpe.digest(d, public_tokenizers.PATTERN, PATH), "op8": lambda s, d: toxicity.scored(d, labels(s)), "op9": lambda s, d: media_avi.digest(d), "op10": lambda s, d: license_scans.scanned(d),
}


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, name):
    run = OPERATORS[name]
    plain = run(spark, frame(spark))
    got = rows_of(plain)
    assert sorted(str(r["doc_id"]) for r in plain.collect()) == sorted(str(i) for i, _ in ROWS)  # a result for each row, nulls included
    assert rows_of(run(spark, frame(spark, names=NAMES)).select(*plain.columns)) == got  # other columns make no difference
    assert run(spark, frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, tmp_path, name):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    plain = stage(spark, frame(spark), str(tmp_path))
    wide = stage(spark, frame(spark, names=NAMES), str(tmp_path))
    assert rows_of(wide.select(*plain.columns)) == rows_of(plain)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert plain.columns == frame(spark).columns and wide.columns == frame(spark, names=NAMES).columns
        assert all(r["Word"] for r in wide.collect())
    assert stage(spark, frame(spark, []), str(tmp_path)).count() == 0


def test_what_stages_do_with_odd_rows(spark, tmp_path):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    docs, stages = frame(spark), dict(corpus_pipeline.STAGES)
    key = lambda df: sorted(map(str, ((r["doc_id"], r["text"]) for r in df.collect())))
    whole = sorted(map(str, ROWS))
    kept = key(stages["ngram_jaccard_join"](spark, docs, ""))
    assert kept == sorted(str(x) for x in [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "a b c d e f g h"), (None, None), (None, "x y z"), (7, "same " * 200), (9, ROWS[-1][1])])
    assert sorted(str(r["doc_id"]) for r in stages["substring_dedup"](spark, docs, "").collect()) == sorted(str(i) for i, _ in ROWS)
    assert len(key(stages["toxicity"](spark, docs, str(tmp_path)))) <= len(whole)
    #: Documents without a word, of which nothing can be taken, go; the others come once or twice.
    assert {r["doc_id"] for r in stages["source_mixing"](spark, docs, "").collect()} <= {i for i, t in ROWS if t and t.strip()}
