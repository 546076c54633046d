"""Record fields and intervals on odd inputs, against plain Python."""
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.functions import records as R
from factloom.operators import authority, intervals
from factloom.plans import registry


def one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("c"))).collect()]


def test_subject_keys(spark):
    assert one(spark, R.subject_key, None, "", "RE: Fwd: 010065  AP Swap", "010065 ap swap", " aw [3] : x", "Regarding: x", "re:") == ["", "", "010065 ap swap", "010065 ap swap", "x", "regarding: x", ""]


def test_us_phones(spark):
    got = one(spark, R.us_phones, None, "", "1-800-256-8224 or 800-256-8224", "(212) 555.0199", "0123456789 1234567890 2121234567", "12125550199 2125550199,2125550198")
    assert got == [None, [], ["phone:8002568224"], ["phone:2125550199"], [], ["phone:2125550198", "phone:2125550199"]]


@pytest.mark.parametrize("name", ["extract_us_phone", "extract_us_phone_all"])
def test_phones_that_share_a_separator_are_those_of_the_sql(spark, tmp_path, name):
    own = random.Random(5)
    shared = ["d9566113270c2345678901e", "2125550199,2125550198,2125550197", "2125550199 12125550198", "212\x0b555\x0b0199", "2125550199\r\n2125550198", None, ""]
    part = lambda: own.choice(["", "1", "+1 (", "("]) + own.choice(["212", "345", "012"]) + own.choice(["", ")", "-", " ", "\x0b"]) + own.choice(["555", "199"]) + own.choice(["", ".", "\n"]) + f"{own.randrange(10000):04d}" + own.choice([" ", ",", "\x0b", "é", "\r\n", "+", "1", "\0", "٢", "😀", ""])
    texts = shared + ["".join(part() for _ in range(own.randrange(1, 6))) for _ in range(2000)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(registry.oracle_sql()[name]).fetchall())
    every = {(0, "9566113270"), (0, "2345678901"), (1, "2125550199"), (1, "2125550198"), (1, "2125550197"), (2, "2125550199"), (2, "2125550198"), (3, "2125550199"), (4, "2125550199"), (4, "2125550198")}
    missed = {(0, "2345678901"), (1, "2125550198"), (2, "2125550198"), (3, "2125550199")} if name == "extract_us_phone" else set()
    assert {(i, p.removeprefix("phone:")) for i, p in got if i < len(shared)} == every - missed


def test_sections_and_inclusion(spark):
    assert one(spark, R.spec_sections, None, "27 10 00 and 27 10 00.13, 271000") == [None, ["spec_section:27_10_00", "spec_section:27_10_00_13"]]
    assert one(spark, R.inclusion, None, "", "Yes", "N.I.C.", "not included", "Alternate 1", "Allowance", "TBD", "No", "x") == ["unknown", "unknown", "included", "excluded", "excluded", "optional", "allowance", "tbd", "excluded", "unknown"]


def test_intervals(spark):
    own = random.Random(1)
    spans = [(own.choice([1, 2, None]), a, a + own.randrange(0, 9)) for a in own.choices(range(100), k=80)] * 2 + [(1, None, 5), (1, 5, None)]
    points = [(i, own.choice([1, 2, None, 3]), own.choice([None, *range(110)])) for i in range(200)]
    found = intervals.islands(spark.createDataFrame(spans, "k int, a int, z int").repartition(3), "k", "a", "z")
    held = {(r["k"], r["low"], r["high"], r["n"]) for r in found.collect()}
    covered = {(k, x) for k, a, z in spans if a is not None and z is not None for x in range(a, z)}
    assert covered == {(k, x) for k, a, z, _ in held for x in range(a, z)}
    assert sum(n for *_, n in held) == sum(a is not None and z is not None and a < z for _, a, z in spans)
    assert not any(k == j and a <= b <= z and (a, z) != (b, y) for k, a, z, _ in held for j, b, y, _ in held)
    rows = intervals.contained(spark.createDataFrame(points, "i int, k int, x int"), found.drop("n"), "k", "x").collect()
    assert len(rows) == len(points)
    for r in rows:
        want = next(((a, z) for k, a, z, _ in held if r["k"] is not None and r["x"] is not None and k == r["k"] and a <= r["x"] < z), (None, None))
        assert (r["low"], r["high"]) == want
    assert intervals.islands(spark.createDataFrame([], "k int, a int, z int"), "k", "a", "z").count() == 0


def test_queue_tiers(spark):
    rows = [("quantity_conflict", "site:x", [], "active", 0), ("missing_info", "x", ["site_access_gate_unknown"], "active", 5), ("missing_info", None, None, None, 6), ("scope_inclusion", "x", [], "active", 85), ("quantity_conflict", "Site:Unknown", [], "active", 92), (None, "x", [], "active", 40), ("scope_exclusion", "x", ["power_vendor_scope_mismatch", "y"], "active", 2)]
    got = spark.createDataFrame(rows, "f string, a string, m array<string>, s string, want int").select(authority.queue_tier(F.col("f"), F.col("a"), F.col("m"), F.col("s")), "want").collect()
    assert all(r[0] == r[1] for r in got)


def test_recency_of_groups(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 10), ("a", 5), ("b", 7), (None, 1), (None, 3), ("c", None)], "g string, x long").withColumn("ts", F.timestamp_seconds("x"))
    got = {(r["g"], r["x"]): r["recency"] for r in authority.recency(rows, "ts", ["g"]).collect()}
    assert got == {("a", 0): 0.0, ("a", 10): 2.0, ("a", 5): 1.0, ("b", 7): 0.0, (None, 1): 0.0, (None, 3): 2.0, ("c", None): None}
