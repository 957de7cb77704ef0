import pytest
from pyspark.sql import functions as F

from cohortile.operators import cohort as C
from cohortile.operators import matching as MT
from cohortile.operators import sampling as A
from cohortile.operators import splits as P


def test_last_row_and_master(spark):
    m = spark.createDataFrame([(" A-B-C ", "x", "5", "", 1), ("A-B-C", "x", "7", "", 2), (None, "x", "1", "", 3), ("D-E-F", "", "0", "abc", 4)],
                              "patient_id string, vital_status string, days_to_last_followup string, death_days_to string, row_ord int")
    assert C.last_row_wins(m).filter("patient_id = 'A-B-C'").first().days_to_last_followup == "7"
    s = spark.createDataFrame([("A-B-C-1", "c1"), ("D-E-F-2", "c2"), ("Q-Q-Q-3", "c3"), ("zz", "c4"), (None, "c5")], "slide_id string, case_id string")
    rows, bad = C.survival_labels(s, m)
    assert [(r.slide_id, r.time, r.event) for r in rows.collect()] == [("A-B-C-1", 7.0, 0)]
    assert {(r.slide_id, r.reason) for r in bad.collect()} == {
        ("D-E-F-2", "invalid survival data"), ("Q-Q-Q-3", "not found in master file"), ("zz", "could not extract patient id"), (None, "missing slide_id")}
    v = C.split_validation(s.withColumn("split", F.lit("train")), m).first()
    assert (v.total, v.matched, v.valid) == (5, 2, 1)


def test_case_label(spark):
    num = spark.createDataFrame([("A", x) for x in ("3", "3", "4", "4", "zz")], "case_id string, value string")
    assert C.case_label(num, "numeric").first().label == 4
    st = spark.createDataFrame([("B", x) for x in ("T2", "t3a", "T3", "T9")] + [("C", None)], "case_id string, value string")
    assert [(r.case_id, r.label) for r in C.case_label(st, "stage").collect()] == [("B", 3)]


def test_key_sets(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], "model string, slide_id int")
    assert [r.slide_id for r in C.common_keys(df).collect()] == [1]
    with pytest.raises(Exception, match="models without data: c"):
        C.common_keys(df, expected=["a", "b", "c"]).collect()
    want = spark.createDataFrame([(1,), (9,)], "slide_id int")
    assert [r.slide_id for r in C.missing_keys(want, df).collect()] == [9]
    assert [r.slide_id for r in C.keys_in_any(want, df).collect()] == [1]


def test_splits_are_patient_safe(spark):
    lab = spark.range(400).select(F.col("id").cast("string").alias("slide_id"), (F.col("id") % 120).cast("string").alias("case_id"),
                                  (F.col("id") % 120 % 3).cast("int").alias("label"), F.col("id").alias("row_ord"))
    sp = P.stratified_patient_splits(lab)
    n = {(r.fold, r.split): r["count"] for r in sp.groupBy("fold", "split").count().collect()}
    assert all(n[(f, "test")] == 12 and n[(f, "val")] == 12 and n[(f, "train")] == 96 for f in range(5))
    assert sp.groupBy("fold", "case_id").count().filter("count > 1").count() == 0
    test_sets = sp.filter("split = 'test'").groupBy("case_id").agg(F.count_distinct("fold").alias("k")).select("k").distinct().collect()
    assert [r.k for r in test_sets] == [5]
    per = P.expand_to_slides(sp, lab).groupBy("fold", "case_id").agg(F.count_distinct("split").alias("k")).agg(F.max("k")).first()[0]
    assert per == 1
    seq = P.sequential_splits(lab, 2, label_frac=0.5)
    d = P.split_descriptor(seq).first()
    assert (d.val, d.test, d.train) == (4, 4, 16)
    wide = P.split_wide(seq, "case_id")
    assert wide.filter("fold = 0").count() == 48 and wide.filter("val = ''").count() > 0
    assert set(P.split_boolean(seq).columns) == {"fold", "case_id", "train", "val", "test"}


def test_quota_and_padding(spark):
    c = spark.createDataFrame([("s", "a", 5), ("s", "b", 3), ("s", "c", 2)], "scope string, k string, n int")
    assert [r.quota for r in A.largest_remainder_quota(c, 6, "scope", "k").orderBy("k").collect()] == [3, 2, 1]
    assert [r.quota for r in A.largest_remainder_quota(c, 99, "scope", "k").orderBy("k").collect()] == [5, 3, 2]
    t = spark.createDataFrame([("s", 1, 0.5, [1.0, 1.0]), ("s", 2, 0.1, [2.0, 2.0])], "slide_id string, tile_idx int, score double, f array<double>")
    rows = A.bottom_k_padded(t, "slide_id", "score", 3, "f", 2).orderBy("rank").collect()
    assert [r.f for r in rows] == [[2, 2], [1, 1], [0, 0]] and [r.padded for r in rows] == [False, False, True]
    assert A.top_k(t, ["slide_id"], "score", 1).first().tile_idx == 1


def test_large_top_k(spark):
    df = spark.range(5000).select(F.lit("hot").alias("k"), F.col("id").alias("tile_idx"), (F.col("id") * 7919 % 5003).alias("score"))
    got = [(r["rank"], r.score) for r in A.top_k(df, ["k"], "score", 1500).orderBy("rank").collect()]
    want = sorted((i * 7919 % 5003 for i in range(5000)), reverse=True)[:1500]
    assert got == list(enumerate(want, 1))


def test_grid_direct(spark):
    pts = [("m", 1, .1, .1), ("m", 2, .6, .1), ("m", 3, .7, .2), ("m", 4, .6, .6), ("m", 5, .75, .74), ("m", 6, .99, .99)]
    df = spark.createDataFrame(pts, "model string, id int, x01 double, y01 double")
    got = {(r.r, r.c): (r.n_points, r.id) for r in A.grid_direct(df, ["model"], ["id"], 2, 2).collect()}
    assert got[(0, 0)] == (1, 1) and got[(1, 1)] == (3, 5) and got[(0, 1)][0] == 2
    top = A.top_k_classes(spark.createDataFrame([(1, [.2, .5, .5])], "i int, p array<double>"), ["i"], "p", 2).first()
    assert (top.Pred_0, top.p_0, top.Pred_1) == (1, .5, 2)


def test_location_sample(spark):
    df = spark.range(500).select(F.when(F.col("id") < 20, "small").otherwise("big").alias("slide_id"), "id", (F.col("id") % 23).alias("x"), (F.col("id") % 29).alias("y"))
    got = A.location_sample(df, "slide_id", ["id"], 50, (8, 8))
    n = {r.slide_id: r["count"] for r in got.groupBy("slide_id").count().collect()}
    assert n["small"] == 20 and n["big"] == 50


def test_file_matching(spark):
    t = spark.createDataFrame([("abc",), ("xdefy",)], "stem string")
    a = spark.createDataFrame([("abc",), ("def",)], "stem string")
    assert {(r.tile_stem, r.attention_stem) for r in MT.pair_files(t, a).collect()} == {("abc", "abc"), ("xdefy", "def")}
    with pytest.raises(Exception, match="more than one attention file"):
        MT.pair_files(t, a.unionByName(spark.createDataFrame([("xd",)], "stem string"))).collect()
    with pytest.raises(Exception, match="no attention file"):
        MT.pair_files(spark.createDataFrame([("q",)], "stem string"), a).collect()
    n = spark.createDataFrame([("p",), ("q",), ("r_1",), ("none",)], "stem string")
    f = spark.createDataFrame([("p",), ("p_L-1",), ("q_A",), ("q_L-1",), ("r_1_z",), ("r_1_b_c",)], "file_stem string")
    assert {r.stem: r.file_stem for r in MT.match_with_fallback(n, f).collect()} == {"p": "p", "q": "q_L-1", "r_1": "r_1_b_c"}
    x = spark.createDataFrame([("s", 0, 1, 1), ("s", 1, 2, 2)], "slide_id string, tile_idx int, x int, y int")
    MT.assert_aligned(x, x)
    with pytest.raises(ValueError):
        MT.assert_aligned(x, x.withColumn("x", F.col("x") + F.col("tile_idx")))


def test_location_sample_of_a_hot_key(spark, monkeypatch):
    """A key with more rows than a task is dealt is dealt by bin, with the same rows."""
    df = spark.range(3000).selectExpr("cast(if(id % 10 = 0, id % 3, 7) as string) as slide_id", "id", "id * 37 % 1000 as x", "id * 91 % 777 as y")
    take = lambda: sorted(tuple(r) for r in A.location_sample(df, "slide_id", ["id"], 120, (8, 8)).collect())
    want = take()
    monkeypatch.setattr(A, "TASK_ROWS", 500)
    assert take() == want and len({r[0] for r in want}) == 4


def test_location_sample_of_no_rows(spark):
    df = spark.createDataFrame([], "slide_id string, id long, x long, y long")
    assert A.location_sample(df, "slide_id", ["id"], 5).count() == 0
