"""Threads, quoted lines and name variants on odd inputs."""
from factloom.operators import threads as H


def test_threads_by_headers_and_subjects(spark):
    rows = [
        (1, "a", None, "x", 50), (2, "b", ["nobody", "a"], "", 10), (3, "c", ["b", "a"], None, None), (4, None, None, "x", 60), (5, "d", ["d"], "", 1), (6, "a", [None], None, 2),
        (7, "", ["", "c"], "z", None), (8, None, [], "z", 5),
    ]
    got = {r["id"]: tuple(r)[1:] for r in H.threads(spark.createDataFrame(rows, "id long, message_id string, refs array<string>, subject_key string, ts long")).collect()}
    assert got == {
        8: (1, 1, 6, None, None), 2: (1, 2, 6, 1, "reference"), 1: (1, 3, 6, 2, "before"), 4: (1, 4, 6, 1, "before"), 3: (1, 5, 6, 2, "reference"), 7: (1, 6, 6, 3, "reference"),
        5: (5, 1, 1, None, None), 6: (6, 1, 1, None, None),
    }


def test_empty_tables(spark):
    assert H.threads(spark.createDataFrame([], "id long, message_id string, refs array<string>, subject_key string, ts long")).count() == 0
    assert H.quoted_echoes(spark.createDataFrame([], "id long, thread string, text string, quoted boolean")).count() == 0


def test_quoted_echoes(spark):
    long = "Please confirm the total"
    rows = [(1, "t", long, False), (2, "t", " please  CONFIRM the total", True), (3, "u", long, True), (4, "u", long, True), (5, "t", "short", False), (6, "t", "short", True), (7, "t", None, True), (8, None, long, True), (9, "v", long, True), (10, "v", long, False)]
    got = {tuple(r) for r in H.quoted_echoes(spark.createDataFrame(rows, "id long, thread string, text string, quoted boolean")).collect()}
    assert got == {(2, "authored"), (4, "quoted"), (9, "authored")}


def test_name_variants(spark):
    keys = ["ann_lee", "lee", "j_lee", "bo_ray", "cy_ray", "ray", "x_doe", "", None, "lee"]
    got = {tuple(r) for r in H.variants(spark.createDataFrame([(k,) for k in keys], "key string")).collect()}
    assert got == {("lee", "ann_lee"), ("j_lee", "ann_lee")}
