"""Authority, certificates and confidence on odd and hand-made claims."""
from pyspark.sql import functions as F

from factloom.operators import lattice as L

CLAIM = "struct<id:long,authority:string,kind:string,status:string,artifact:string,role:string,sender:string,keys:array<string>,confidence:double,ts:timestamp,topic:string>"


def claim(i, authority=None, kind=None, status=None, topic="t", confidence=0.8, ts=None, **more):
    return (i, authority, kind, status, more.get("artifact"), more.get("role"), more.get("sender"), more.get("keys"), confidence, ts, topic)


def test_rules_and_ties_decide(spark):
    import datetime

    old, new = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 2)
    cases = [
        (claim(1, "quoted_old"), claim(2, "customer_current"), None, (2, "current_over_quoted")),
        (claim(1, "customer_current", "exclusion"), claim(2, "roster", "quantity"), None, (1, "exclusion_over_roster")),
        (claim(1, "vendor", "scope_item"), claim(2, "vendor", "exclusion"), None, (2, "vendor_scope")),
        (claim(1, "vendor", "quantity", topic="a"), claim(2, "roster", "quantity", topic="b"), "quantity_conflict", (2, "roster_over_vendor")),
        (claim(1, "meeting", "note"), claim(2, "contractual"), None, (2, "written_over_meeting")),
        (claim(1, "meeting", "quantity"), claim(2, "vendor", "note"), None, (2, "vendor_quantity_over_meeting")),
        (claim(1, "machine"), claim(2, "contractual"), None, (2, "score")),
        (claim(1, "machine", confidence=0.5), claim(2, "machine"), None, (2, "confidence")),
        (claim(2, "machine", ts=new), claim(1, "vendor", ts=old), "vendor_mismatch", (1, "score")),
        (claim(2, "machine"), claim(1, "machine"), None, (1, "id")),
        (claim(1, "deleted"), claim(2, None, None, None, None, None), None, (2, "score")),
        (claim(1, "contractual", status="rejected"), claim(2, "machine"), None, (2, "score")),
        (claim(1, "quoted_old", topic=None), claim(2, "customer_current", topic=None), None, (2, "score")),
    ]
    rows = spark.createDataFrame([(a, b, f, w[0], w[1]) for a, b, f, w in cases], f"a {CLAIM}, b {CLAIM}, f string, who long, why string")
    for r in rows.select(L.decide(F.col("a"), F.col("b"), F.col("f")).alias("d"), "who", "why").collect():
        assert (r["d"]["governing"], r["d"]["reason"]) == (r["who"], r["why"])


def test_scores_in_context(spark):
    rows = [("p", claim(1, "quoted_old")), ("p", claim(2, "customer_current", sender="x@Own.example", role="customer")), (None, claim(3, "quoted_old")), ("p", claim(4, None, topic=None)), ("p", claim(2, "customer_current", topic="u"))]
    df = L.context(spark.createDataFrame(rows, f"packet string, x {CLAIM}"), "packet")
    got = sorted((r["id"], r["s"]) for r in df.select("x.id", L.score(F.col("x"), F.col("recency"), F.col("current_customer"), F.lit(None)).alias("s")).collect())
    assert got == [(1, 10 - 40.0), (2, 92.0), (2, 93.0), (3, 10.0), (4, 0.0)]
    assert L.context(df.select("packet", "x").filter("false"), "packet").count() == 0


def test_tiers_and_scopes(spark):
    names = spark.createDataFrame([("Signed-RFP.pdf", "contractual_final"), ("change_order", "contractual_final"), ("Spec.doc", "approved_scope"), ("", "supporting_evidence"), (None, "supporting_evidence")], "n string, want string")
    assert all(a == b for a, b in names.select(L.artifact_tier(F.col("n")), "want").collect())
    texts = spark.createDataFrame([("  Phase  2", "base bid", "phase 2"), (None, "Add Alt 3", "alternate"), ("", "the BASE bid", "base"), (None, "database", "unspecified"), (None, None, "unspecified")], "h string, x string, want string")
    assert all(a == b for a, b in texts.select(L.scope_dimension(F.col("h"), F.col("x")), "want").collect())
    pairs = spark.createDataFrame([("base", "base", True), ("base", "alternate", False), ("unspecified", "base", True)], "a string, b string, want boolean")
    assert all(a == b for a, b in pairs.select(L.scopes_agree(F.col("a"), F.col("b")), "want").collect())


def test_routing_and_conflicts(spark):
    rows = spark.createDataFrame([(1, "a", 5.0), (1, "b", 4.5), (2, "a", 9.0), (3, "a", 1.5), (4, "b", 3.0), (4, "a", 2.0), (5, None, None)], "o int, p string, s double")
    assert {tuple(r) for r in L.route(rows, "o", "p", "s").collect()} == {(1, None, None), (2, "a", 0.85), (3, None, None), (4, "b", 0.7)}
    rows = spark.createDataFrame([(None, 1, "contractual_final"), (None, 2, "x"), (1, 1, "approved_scope"), (1, 1, "x"), (2, 1, "x"), (2, 2, None), (3, 1, "approved_scope"), (3, 2, "x")], "k int, v int, t string")
    assert {tuple(r) for r in L.source_conflicts(rows, "k", "v", "t").collect()} == {(None, 2, "high"), (3, 2, "medium")}


def test_confidence_is_bounded(spark):
    df = spark.createDataFrame([(True, 1.0, "contractual_final", 100), (None, None, None, None)], "b boolean, c double, t string, n int")
    b = F.col("b")
    got = df.select(L.confidence(b, F.col("c"), b, ~b, F.col("t"), b, F.col("n"), b).alias("x"), L.packet_confidence(F.col("c"), b).alias("y")).collect()
    assert [tuple(r) for r in got] == [(0.99, 0.85), (0.35, 0.0)]


def test_coverage_of_segments(spark):
    import itertools

    segments = [(i, a, x, y, k) for i, (a, x, y, k) in enumerate(itertools.product(("p", None), (None, 0, 63, 130), (None, 64, 200), (None, 1)))]
    sources = [(0, a, x, y, k) for a, x, y, k in itertools.product(("p", "q", None), (None, 5, 64), (None, 3, 64, 140), (None, 1, 2))] * 2

    def matches(g, s):
        if g[1] is None or g[1] != s[1] or any(r[2] is not None and r[3] is not None and r[3] < r[2] for r in (g, s)):
            return False
        if g[4] is not None and s[4] is not None and g[4] != s[4]:
            return False
        if g[2] is not None and s[2] is not None:
            return s[2] <= (g[2] if g[3] is None else g[3]) and g[2] <= (s[2] if s[3] is None else s[3])
        of = [{"line": r[2], "sheet": r[4]} for r in (g, s)]
        has = [{k for k, v in f.items() if v is not None} for f in of]
        return not (has[0] and has[1]) or bool(has[0] & has[1])

    from factloom.operators import intervals

    names = "id int, artifact string, start int, stop int, sheet int"
    got = {r["id"]: r["n_sources"] for r in intervals.coverage(spark.createDataFrame(segments, names), spark.createDataFrame(sources, names), ["sheet"], 64).collect()}
    assert got == {g[0]: sum(matches(g, s) for s in sources) for g in segments} and any(got.values())


def test_votes_of_neighbours(spark):
    from factloom.operators import retrieval as R

    rows = [(1, 0, 0.9), (1, 0, 0.8), (1, 1, 0.9), (2, 0, 0.1), (3, 2, 0.5), (3, 1, 0.5), (4, 1, -0.2), (4, 0, 0.9)]
    sizes = spark.createDataFrame([(0, 100), (1, 1), (2, 1)], "label int, n long")
    got = {r["query_id"]: (r["label"], r["confidence"]) for r in R.confident_vote(spark.createDataFrame(rows, "query_id int, label int, sim double"), sizes, 0.2, 0.15).collect()}
    assert got == {1: (1, round((0.9 - 0.17) / (1.07 + 1e-9), 6)), 2: (None, 0.0), 3: (None, 0.0), 4: (0, 1.0)}
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id int, v array<double>")
    exemplars = spark.createDataFrame([([1.0, 0.0], True), ([0.0, 1.0], False)], "e array<double>, positive boolean")
    assert {tuple(r) for r in R.margin(items, exemplars).collect()} == {(1, 1.0), (2, -0.35)}
    assert {tuple(r) for r in R.margin(items, exemplars.filter("false")).collect()} == {(1, 0.0), (2, 0.0)}
