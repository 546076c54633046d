"""Every query against its SQL in DuckDB on the smallest tables, and small cases of the operators."""
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import authority as A
from factloom.operators import dedup as D
from factloom.operators import diff as X
from factloom.operators import graph as G
from factloom.plans import registry
from factloom.sources import readers as S

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(str([v[i] for i in order]) for v in values)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    ours = registry.queries()[name](spark, DATA)
    theirs = duck.execute(registry.oracle_sql()[name])
    assert rows(ours.columns, map(tuple, ours.collect())) == rows([c[0] for c in theirs.description], theirs.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_claims_that_differ_a_little_contradict(spark, duck):
    got = {tuple(r) for r in registry.queries()["contradicts_edges_all"](spark, DATA).collect()}
    q = {(p, s): x for p, s, x in duck.execute("SELECT l_partkey, l_suppkey, sum(l_quantity::DECIMAL(18,2)) FROM lineitem GROUP BY 1, 2").fetchall()}
    of = {}
    for p, s in q:
        of.setdefault(p, []).append(s)
    assert got == {(p, a, b) for p, ss in of.items() for a in ss for b in ss if a < b and q[p, a] != q[p, b]}
    assert any(abs(q[p, a] - q[p, b]) < 80 for p, a, b in got)


def test_rows_that_are_not_folded_stay(spark):
    rows = spark.createDataFrame([(1, 1, 2.0), (1, 2, 5.0), (1, 3, 3.0), (2, 4, 7.0), (2, 5, 7.0), (None, 6, 1.0), (3, 7, None)], "k int, i int, v double")
    got = {tuple(r) for r in D.fold_or_keep(rows, "k", "v", 3, ["i"]).collect()}
    assert got == {(1, None, 3, 2.0, 5.0, 10.0), (2, 4, 1, 7.0, 7.0, 7.0), (2, 5, 1, 7.0, 7.0, 7.0), (None, 6, 1, 1.0, 1.0, 1.0), (3, 7, 1, None, None, None)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_the_fold_covers_every_line_item(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).agg(F.sum("n_rows")).first()[0] == spark.read.parquet(f"{DATA}/lineitem.parquet").count()


@pytest.mark.parametrize("bound", [None, 3, 8])
def test_pairs_of_hot_keys_stay(spark, bound):
    own = random.Random(4)
    rows = [(0, i) for i in range(40)] + [(1, i) for i in range(0, 40, 3)] + [(own.randrange(2, 30), own.randrange(60)) for _ in range(200)] + [(None, 1), (None, 2), (5, None)]
    has = {}
    for k, i in rows:
        if k is not None and i is not None:
            has.setdefault(i, set()).add(k)
    want = {(a, b, len(has[a] & has[b])) for a in has for b in has if a < b and len(has[a] & has[b]) >= 2}
    got = G.sharing_pairs(spark.createDataFrame(rows, "k int, i int"), "k", "i", bound).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_passages_and_amounts_in_documents(spark, tmp_path):
    passage = "Alpha  beta gamma delta epsilon zeta eta theta iota kappa"
    spark.createDataFrame([(1, passage), (2, "not held anywhere"), (3, " "), (4, None), (5, "Iota")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = ["x ALPHA beta\ngamma delta epsilon zeta eta theta iota kappa y", "alpha beta gamma delta epsilon zeta eta other", None, "", "$2.5K or $1,200 and $3"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in registry.queries()["reference_containment"](spark, str(tmp_path)).collect()}
    assert got == {(1, 2, 1, True), (2, 0, 0, False), (3, 0, 0, False), (4, 0, 0, False), (5, 1, 1, True)}
    assert {tuple(r) for r in registry.queries()["extract_money"](spark, str(tmp_path)).collect()} == {(4, 2500.0), (4, 1200.0)}


def test_text_functions(spark):
    df = spark.createDataFrame([("  Ab\t c  ", "Call +1 (555) 010-9999 or A@x.org, $1.5K on 2024-02-30 and $5")], "a string, b string")
    r = df.select(T.normalize_text(F.col("a")), T.slug(F.col("a")), T.emails(F.col("b")), T.phones(F.col("b")), T.money(F.col("b")), T.dates(F.col("b"))).first()
    assert list(r) == ["ab c", "ab_c", ["a@x.org"], ["15550109999"], [1500.0], ["date:2024-02-30"]]


def test_severity_is_bounded(spark):
    df = spark.createDataFrame([("exclusion",), ("nothing",)], "f string")
    got = df.select(A.risk(F.col("f"), [(F.lit(True), 0.3)]).alias("r")).select("r", A.severity(F.col("r"))).collect()
    assert [tuple(x) for x in got] == [(1.0, "critical"), (0.8, "high")]


def test_components_of_a_chain_and_a_pair(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(1, 20)] + [(50, 40)], "a long, b long")
    assert {r["node"]: r["root"] for r in G.components(edges).collect()} == {**{i: 1 for i in range(1, 21)}, 40: 40, 50: 40}


def test_diff_sees_nulls(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, "z"), (4, "w")], "k int, v string")
    assert dict(X.snapshot_diff(a, b, "k", ["v"]).collect()) == {1: "unchanged", 2: "changed", 3: "removed", 4: "added"}


def test_readers(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.tmp").write_bytes(b"x")
    assert [r["kind"] for r in S.scan_files(spark, str(tmp_path), ["*.tmp"]).collect()] == ["pdf"]
    df = spark.createDataFrame([(1, "[00:01:02] Ann Lee: hello\nplain")], "id int, t string")
    assert [tuple(r) for r in S.transcript(df, "id", "t").orderBy("line").collect()] == [(1, 0, "00:01:02", "Ann Lee", "hello"), (1, 1, None, None, "plain")]


def test_entry_imports_without_the_llm_folder():
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
