import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortile.operators import bootstrap as B
from cohortile.operators import metrics as M
from cohortile.operators import significance as S
from cohortile.operators import survival as V


def preds(spark, rows):
    return spark.createDataFrame([("m", *r) for r in rows], "model string, label int, pred int, score double")


def test_binary(spark):
    df = preds(spark, [(0, 0, 0.1), (0, 0, 0.4), (1, 0, 0.35), (1, 1, 0.8)])
    r = M.binary_metrics(df, ["model"]).first()
    assert (r.n, r.accuracy, r.auc, r.sensitivity, r.specificity) == (4, 0.75, 0.75, 0.5, 1.0)
    assert r.f1 == pytest.approx((0.8 + 2 / 3) / 2)
    assert M.confusion_metrics(df, ["model"], f1="binary").first().f1 == pytest.approx(2 / 3)
    tied = preds(spark, [(0, 0, 0.4), (1, 0, 0.4)])
    assert M.auc(tied, ["model"]).first().auc == 0.5
    one = preds(spark, [(1, 0, 0.4), (1, 1, 0.6)])
    r = M.binary_metrics(one, ["model"]).first()
    assert r.auc is None and r.specificity == 0.0 and r.sensitivity == 0.5
    flip = M.auc(df.withColumn("score", -F.col("score")), ["model"]).first().auc
    assert flip == pytest.approx(0.25)


def test_weights_equal_copies(spark):
    rows = [(0, 0, 0.1), (1, 1, 0.6), (0, 1, 0.6), (1, 0, 0.2)]
    w = [3, 1, 2, 2]
    copies = preds(spark, [r for r, k in zip(rows, w) for _ in range(k)])
    weighted = spark.createDataFrame([("m", *r, k) for r, k in zip(rows, w)], "model string, label int, pred int, score double, w int")
    assert M.binary_metrics(copies, ["model"]).first() == M.binary_metrics(weighted, ["model"], weight="w").first()


def test_multi_class(spark):
    df = spark.createDataFrame([(0, 0, [0.5, 0.3, 0.2]), (1, 0, [0.6, 0.3, 0.1]), (1, 1, [0.1, 0.8, 0.1])], "label int, pred int, prob array<double>").withColumn("k", F.lit(1))
    r = M.auc_ovr(df, ["k"]).first()
    assert r.n_classes == 2 and r.auc_ovr == pytest.approx((0.5 + 0.75) / 2)
    assert M.auc_ovr(df, ["k"], present_only=False).first().auc_ovr is None
    assert M.macro_specificity(df, ["k"], 3).first().macro_specificity == pytest.approx((0.5 + 1 + 1) / 3)
    acc = {x.label: (x["count"], x.correct, x.error) for x in M.per_class_accuracy(df, ["k"]).collect()}
    assert acc == {0: (1, 1, 0.0), 1: (2, 1, 0.5)}


def test_votes_and_best_fold(spark):
    v = spark.createDataFrame([("s", x) for x in (0, 1, 1, 0)] + [("t", x) for x in (1, 1, 0, 1, 0)], "slide_id string, pred int")
    assert {r.slide_id: r.pred for r in M.majority_vote(v).collect()} == {"s": 0, "t": 1}
    f = spark.createDataFrame([("a", 1, "test", .5, .7, .8), ("a", 2, "test", .9, .9, .7), ("a", 3, "test", .5, .8, .8), ("b", 1, "test", .6, None, None)],
                              "model string, fold int, split string, accuracy double, auc double, f1 double")
    best = lambda rule: {r.model: r.fold for r in M.best_fold(f, rule).collect()}
    assert best("f1_auc") == {"a": 3} and best("f1") == {"a": 1} and best("auc_accuracy") == {"a": 2, "b": 1}


def test_merge_and_combinations(spark):
    p = spark.createDataFrame([("x", "s", 1), ("y", "s", 1), ("z", "s", 1), ("x", "t", 1)], "model string, slide_id string, label int")
    assert {r.slide_id for r in M.merge_predictions(p).collect()} == {"s"}
    combos = M.model_combinations(p.select("model"), (2, 0)).collect()
    assert sorted({r.combo for r in combos}) == ["x+y", "x+y+z", "x+z", "y+z"]
    with pytest.raises(Exception, match="more than once"):
        M.merge_predictions(p.unionByName(p)).collect()


def test_bootstrap_draws(spark):
    items = spark.range(50).select(F.col("id").cast("string").alias("s"))
    w = B.draw_weights(items, "s", 7, 0.8).select("s", F.explode("draws").alias("d")).select("s", "d.*")
    per = {r.iter: r.n for r in w.groupBy("iter").agg(F.sum("weight").alias("n")).collect()}
    assert per == {i: 40 for i in range(7)}


def test_bootstrap_pipeline(spark):
    rng = np.random.default_rng(0)
    rows = [(m, f"s{i}", i % 2, 0.0) for i in range(40) for m in ("a", "b")]
    p = spark.createDataFrame([(m, s, y, float(rng.random() * 0.6 + 0.4 * y)) for m, s, y, _ in rows],
                              "model string, slide_id string, label int, score double").withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    boot = B.bootstrap_metrics(p, 5, 0.8)
    assert boot.count() == 5 * 3 * 5 and boot.filter("value is null").count() == 0
    assert B.percentile_ci(boot.filter("iter = 0")).filter("ci_low is not null").count() == 0


def values(spark):
    rng = np.random.default_rng(3)
    ref, other = rng.normal(0, 1, 12).round(3), rng.normal(0.5, 1, 12).round(3)
    rows = [("acc", "ref", i, float(v)) for i, v in enumerate(ref)] + [("acc", "b", i, float(v)) for i, v in enumerate(other)]
    return ref, other, spark.createDataFrame(rows, "metric string, model string, iter int, value double")


def test_tests_against_brute_force(spark):
    ref, other, df = values(spark)
    r = S.paired_tests(df, "ref").first()
    d = ref - other
    assert r.ttest_stat == pytest.approx(d.mean() / (d.std(ddof=1) / np.sqrt(12)))
    order = np.abs(d).argsort().argsort() + 1
    assert r.wilcoxon_stat == min(order[d > 0].sum(), order[d < 0].sum())
    u = sum((a > b) + 0.5 * (a == b) for a in ref for b in other)
    assert r.mannwhitney_stat == u and 0 < r.mannwhitney_p <= 1 and 0 < r.wilcoxon_p <= 1
    pair = S.pairwise_rank_sum(df).first()
    assert (pair.model1, pair.model2, pair.u) == ("b", "ref", 144 - u)
    pooled = np.sqrt((ref.var(ddof=1) + other.var(ddof=1)) / 2)
    assert B.cohens_d(df, "ref").first().cohens_d == pytest.approx((ref.mean() - other.mean()) / pooled)
    s = S.model_summary_with_reference(df, S.pairwise_rank_sum(df), "ref").orderBy("group_order").collect()
    assert [x.model for x in s] == ["ref", "b"] and s[1].p_value == pytest.approx(pair.p_value)
    few = S.paired_tests(df.filter("iter < 2"), "ref").first()
    assert few.ttest_stat is None and few.mannwhitney_stat is None


def test_survival(spark):
    rows = [("g", t, e) for t, e in zip([1, 2, 2, 3, 4], [1, 1, 0, 1, 0])] + [("h", 5, 0), ("h", 6, 1), ("h", 9, 0)]
    df = spark.createDataFrame(rows, "g string, time int, event int")
    c = V.km_curve(df, ["g"])
    assert [round(r.survival, 6) for r in c.filter("g = 'g'").orderBy("time").collect()] == [0.8, 0.6, 0.3, 0.3]
    assert {r.g: r["median"] for r in V.median_survival(c, ["g"]).collect()} == {"g": 3.0, "h": 6.0}
    never = V.median_survival(V.km_curve(df.filter("time in (1, 5) and g = 'h'"), ["g"]), ["g"]).first()
    assert never["median"] == float("inf")
    rng = np.random.default_rng(5)
    t, e, g = rng.integers(1, 20, 60), rng.integers(0, 2, 60), rng.integers(0, 2, 60)
    oe = v = 0.0
    for x in np.unique(t[e == 1]):
        n, n1 = (t >= x).sum(), ((t >= x) & (g == 1)).sum()
        d, d1 = ((t == x) & (e == 1)).sum(), ((t == x) & (e == 1) & (g == 1)).sum()
        oe += d1 - d * n1 / n
        v += n1 * (n - n1) * d * (n - d) / (n * n * (n - 1)) if n > 1 else 0
    lr = spark.createDataFrame([(1, int(a), int(b), int(c)) for a, b, c in zip(t, e, g)], "k int, time int, event int, group int")
    r = V.logrank(lr, ["k"]).first()
    assert r.statistic == pytest.approx(oe * oe / v) and 0 < r.p_value < 1
    assert V.logrank(lr.filter("group = 1"), ["k"]).first().statistic is None


def test_survival_by_split(spark):
    ids = [f"TCGA-AA-{i:04d}-01" for i in range(8)]
    preds_ = spark.createDataFrame([(s, i % 2) for i, s in enumerate(ids)], "slide_id string, pred int")
    splits = spark.createDataFrame([(s, "train" if i < 6 else "val") for i, s in enumerate(ids)], "slide_id string, split string")
    master = spark.createDataFrame([(s[:12], "x", str(100 + 50 * i), "" if i % 3 else str(200 + i), i) for i, s in enumerate(ids)],
                                   "patient_id string, vital_status string, days_to_last_followup string, death_days_to string, row_ord int")
    r = {x.split: x for x in V.survival_by_split_test(preds_, splits, master).collect()}
    assert (r["train"].n_low, r["train"].n_high, r["test"].n_low, r["test"].statistic) == (3, 3, 0, None)
    assert r["train"].p_value is not None
