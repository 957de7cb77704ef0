import pytest
from pyspark.sql import functions as F

from cohortile.functions import scalars as X
from cohortile.functions import scaling

IDS = ["TCGA-BP-5006-01Z-00-DX1.98cb", "tcga-AB-1234-x", "HCM-1-2-3", "TCGA-X-TS-9", "A-B", "  ", None]


def test_identifiers(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(IDS)], "i int, s string")
    rows = df.select("i", X.patient_id("s", "prefix").alias("p"), X.patient_id("s", "strict").alias("t"),
                     X.patient_id("s", "segments").alias("g"), X.institution_code("s").alias("inst"),
                     X.exclude_cohort("s").alias("ex")).orderBy("i").collect()
    assert [r.p for r in rows] == ["TCGA-BP-5006", None, None, "TCGA-X-TS", None, None, None]
    assert [r.t for r in rows] == ["TCGA-BP-5006", None, None, None, None, None, None]
    assert [r.g for r in rows] == ["TCGA-BP-5006", "tcga-AB-1234", "HCM-1-2", "TCGA-X-TS", None, None, None]
    assert [r.inst for r in rows] == ["BP", "AB", None, "X", None, None, None]
    assert [r.ex for r in rows] == [False, False, True, True, False, False, None]


def test_clinical_values(spark):
    vals = [None, "0", " 0.0 ", "abc", "", "-5", "12", "nan"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    rows = df.select("i", X.is_valid_value("v").alias("ok"), X.survival_time_event("v", F.lit("3")).alias("s")).orderBy("i").collect()
    assert [r.ok for r in rows] == [False, False, False, True, False, True, True, True]
    assert [(r.s.time, r.s.event) for r in rows] == [(3.0, 0)] * 6 + [(12.0, 1), (3.0, 0)]
    none = df.select(X.survival_time_event(F.lit("abc"), F.lit("-5")).alias("s")).first()
    assert none.s is None


def test_labels_and_marks(spark):
    df = spark.createDataFrame([("T1", "G1", 0.0005, 0.1), ("t3a", "G4", 0.02, -0.6), ("T9", "GX", 0.5, 0.9), (None, None, None, None)],
                               "stage string, grade string, p double, d double")
    r = df.select(X.parse_stage("stage").alias("s"), X.map_grade("grade").alias("g"), X.significance_stars("p").alias("st"),
                  X.effect_magnitude("d").alias("e")).collect()
    assert [x.s for x in r] == [1, 3, None, None]
    assert [x.g for x in r] == [0, 3, None, None]
    assert [x.st for x in r] == ["***", "*", "", ""]
    assert [x.e for x in r] == ["negligible", "medium", "large", None]
    lab = spark.createDataFrame([(0,), (2,), (7,), (8,), (99,)], "l int")
    got = lab.select(X.remap_task_label("l", "kidney").alias("k"), X.remap_task_label("l", "prostate").alias("p"),
                     X.remap_task_label("l", "none").alias("n"), X.class_sign(X.remap_task_label("l", "prostate")).alias("s")).collect()
    assert [x.k for x in got] == [0, 1, None, None, None]
    assert [x.p for x in got] == [0, 0, 0, 1, None]
    assert [x.n for x in got] == [0, 2, 7, 8, 99]
    assert [x.s for x in got] == [-1, -1, -1, 1, None]
    with pytest.raises(Exception, match="outside the task mapping"):
        lab.select(X.remap_task_label("l", "rectal", "error")).collect()


def test_names_colors_geometry(spark):
    df = spark.createDataFrame([("65280", "run_MIL_uninet_s1", "x_combpruned06", [1.0, 4.0, 16.0]), ("zz", "plain_name", "06", [2.0, 2.0])],
                               "c string, d string, t string, levels array<double>")
    a, b = df.select(X.colorref_to_hex("c").alias("h"), X.colorref_to_bgr("c").alias("bgr"), X.model_from_dir("d", "_MIL_").alias("m"),
                     X.parse_threshold("t", True).alias("t"), X.pick_level("levels", F.lit(40), F.lit(10)).alias("lv"),
                     X.level0_top_left(F.lit(10.0), F.lit(4), F.lit(8.0)).alias("tl"), X.argmax("levels").alias("am"),
                     X.threshold_label(F.lit(0.6)).alias("tl2")).collect()
    assert (a.h, a.bgr, a.m, a.t, a.lv, a.tl, a.am, a.tl2) == ("#00FF00", [0, 255, 0], "uninet", 0.6, 1, 0, 2, "thr_0p6")
    assert (b.h, b.bgr, b.m, b.t, b.lv, b.am) == (None, [0, 0, 255], "plain name", 0.6, 0, 0)
    px = spark.createDataFrame([(250, 250, 250), (200, 20, 20)], "r int, g int, b int")
    got = px.select(X.tissue_pixel("r", "g", "b", 15, 240).alias("t"), X.proxy_nontumor("r", "g", "b", F.lit(False)).alias("n")).collect()
    assert [(x.t, x.n) for x in got] == [(False, True), (True, False)]
    names = X.number_duplicates(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "n string, o int"), "n", "o", "u")
    assert [r.u for r in names.orderBy("o").collect()] == ["a", "a_1", "b"]
    dims = X.lookup_embed_dim(spark.createDataFrame([("u",), ("v",)], "model string"), spark.createDataFrame([("u", 1536)], "model string, dim int"))
    assert {r.model: r.dim for r in dims.collect()} == {"u": 1536, "v": 1024}


def test_scaling(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("c", 2.0), ("c", 2.0)], "k string, v double")
    out = {}
    for mode in ("heat", "zero", "raw", "span"):
        out[mode] = [r.s for r in scaling.minmax(df, ["k"], "v", "s", mode, 1.0).orderBy("k", "v").collect()]
    assert out["heat"][1] == pytest.approx(2 / (2 + 1e-6)) and out["heat"][2] == 0
    assert out["zero"] == [0, 1, 0, 0] and out["raw"] == [0, 1, 2, 2] and out["span"] == [0, 1, 0, 0]
    z = [r.z for r in scaling.zscore01(df, ["k"], "v", "z").orderBy("k", "v").collect()]
    assert z == pytest.approx([(3 - 1) / 6, (3 + 1) / 6, 0, 0])
    p = [r.p for r in scaling.percentile_score(df, ["k"], "v", "p").orderBy("k", "v").collect()]
    assert p == [0, 1, 0, 0]
