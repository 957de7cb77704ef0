"""Fold metrics, ensembles, bootstrap, tests and survival on the given tables."""

from pyspark.sql import functions as F

from ..operators import bootstrap as B
from ..operators import metrics as M
from ..operators import significance as S
from ..operators import survival as V
from ..plans.ordered import exact_percentiles
from ..session import r6
from . import standins as D
from .registry import query

METRIC_COLS = ["accuracy", "auc", "sensitivity", "specificity", "f1"]
FOLD_SQL = (f"{D.SQL_PREDS}, {D.SQL_SPLITS}, fm as (select p.*, s.fold, s.split from preds p join splits s using (slide_id)), "
            + D.sql_metrics("fm", "model, fold, split"))


def _fold_metrics(spark, sf):
    p = D.preds(spark, sf).drop("label")
    return M.fold_metrics(p, D.labels(spark, sf), D.splits(spark, sf))


@query("fold_metrics", f"""with {FOLD_SQL}
select model, fold, split, n, round(accuracy, 6) as accuracy, round(auc, 6) as auc, round(sensitivity, 6) as sensitivity,
       round(specificity, 6) as specificity, round(f1, 6) as f1 from metrics""")
def fold_metrics(spark, sf):
    return _fold_metrics(spark, sf).select("model", "fold", "split", "n", *[r6(c).alias(c) for c in METRIC_COLS])


@query("best_fold", f"""with {FOLD_SQL}
select model, fold, round(accuracy, 6) as accuracy, round(auc, 6) as auc, round(f1, 6) as f1 from metrics where split = 'test'
qualify row_number() over (partition by model order by round(f1, 6) desc nulls last, round(auc, 6) desc nulls last, fold) = 1""")
def best_fold(spark, sf):
    m = fold_metrics(spark, sf)
    return M.best_fold(m, "f1_auc")


@query("fold_summary", f"""with {FOLD_SQL},
long as (select model, split, 'auc' as metric, auc as value from metrics where split in ('test', 'val')
         union all select model, split, 'accuracy', accuracy from metrics where split in ('test', 'val'))
select model, split, metric, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, count(value) as folds
from long group by model, split, metric""")
def fold_summary(spark, sf):
    return M.fold_summary(_fold_metrics(spark, sf)).select(
        "model", "split", "metric", r6("mean").alias("mean"), r6("std").alias("std"), "folds")


@query("auc_ovr", f"""with {D.SQL_MULTI},
x as (select class, p as score, case when label = class then 1 else 0 end as pos from multi),
g as (select class, score, sum(pos)::double as pos, sum(1 - pos)::double as neg from x group by class, score),
c as (select *, coalesce(sum(neg) over (partition by class order by score rows between unbounded preceding and 1 preceding), 0) as below from g),
a as (select class, case when sum(pos) * sum(neg) > 0 then sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) end as auc from c group by class)
select 'all' as cohort, round(avg(auc), 6) as auc_ovr, count(auc) as n_classes from a""")
def auc_ovr(spark, sf):
    m = D.multi(spark, sf).withColumn("cohort", F.lit("all"))
    return M.auc_ovr(m, ["cohort"]).select("cohort", r6("auc_ovr").alias("auc_ovr"), "n_classes")


def _multi_pred(spark, sf):
    from ..functions.scalars import argmax
    return D.multi(spark, sf).withColumn("pred", argmax("prob")).withColumn("cohort", F.lit("all"))


@query("per_class_accuracy", f"""with {D.SQL_MULTI}
select 'all' as cohort, label, count(*) as count, cast(sum(case when pred = label then 1 else 0 end) as bigint) as correct,
       round(avg(case when pred = label then 1.0::double else 0 end), 6) as accuracy,
       round(1 - avg(case when pred = label then 1.0::double else 0 end), 6) as error
from multi_pred group by label""")
def per_class_accuracy(spark, sf):
    return M.per_class_accuracy(_multi_pred(spark, sf), ["cohort"]).select(
        "cohort", "label", "count", "correct", r6("accuracy").alias("accuracy"), r6("error").alias("error"))


@query("macro_specificity", f"""with {D.SQL_MULTI},
c as (select unnest(range(0, 10)) as class),
s as (select class, sum(case when label <> class and pred <> class then 1.0::double else 0 end) as tn,
             sum(case when label <> class and pred = class then 1.0::double else 0 end) as fp from multi_pred, c group by class)
select 'all' as cohort, round(avg(case when tn + fp > 0 then tn / (tn + fp) else 0 end), 6) as macro_specificity from s""")
def macro_specificity(spark, sf):
    return M.macro_specificity(_multi_pred(spark, sf), ["cohort"], 10).select(
        "cohort", r6("macro_specificity").alias("macro_specificity"))


VOTE_SQL = """
votes as (select slide_id, label, pred, count(*) as v from preds group by slide_id, label, pred),
vote as (select slide_id, label, arg_max(pred, (v, -pred)) as pred from votes group by slide_id, label)"""


@query("vote_ensemble", f"with {D.SQL_PREDS}, {VOTE_SQL} select slide_id, label, pred from vote")
def vote_ensemble(spark, sf):
    return M.majority_vote(D.preds(spark, sf), ["slide_id", "label"])


def _combo_sql():
    combos = ["m1+m2", "m1+m3", "m2+m3", "m1+m2+m3"]
    rows = ", ".join(f"('{c}', '{m}')" for c in combos for m in c.split("+"))
    return f"combos(combo, model) as (values {rows})"


@query("prob_ensemble", f"""with {D.SQL_PREDS}, {D.SQL_SPLITS}, {_combo_sql()},
ens as (select combo, slide_id, label, round(avg(score), 9) as score from preds join combos using (model) group by combo, slide_id, label),
ep as (select *, case when score >= 0.5 then 1 else 0 end as pred from ens),
src as (select ep.*, s.fold, s.split from ep join splits s using (slide_id)),
{D.sql_metrics("src", "combo, fold, split")}
select combo, fold, split, n, round(accuracy, 6) as accuracy, round(auc, 6) as auc, round(f1, 6) as f1 from metrics""")
def prob_ensemble(spark, sf):
    p = D.preds(spark, sf)
    combos = M.model_combinations(p.select("model"), (2, 3))
    ens = M.mean_prob_ensemble(p, combos).withColumn("score", F.round("score", 9)).withColumn(
        "pred", (F.col("score") >= 0.5).cast("int"))
    rows = M.attach_split(ens, D.splits(spark, sf))
    return M.binary_metrics(rows, ["combo", "fold", "split"]).select(
        "combo", "fold", "split", "n", *[r6(c).alias(c) for c in ["accuracy", "auc", "f1"]])


@query("ensemble_wide", f"""with {D.SQL_PREDS}
select slide_id, label, round(max(case when model = 'm1' then 1 - score end), 6) as m1_prob_0,
       round(max(case when model = 'm1' then score end), 6) as m1_prob_1, max(case when model = 'm1' then pred end) as m1_pred,
       round(max(case when model = 'm2' then 1 - score end), 6) as m2_prob_0,
       round(max(case when model = 'm2' then score end), 6) as m2_prob_1, max(case when model = 'm2' then pred end) as m2_pred,
       round(max(case when model = 'm3' then 1 - score end), 6) as m3_prob_0,
       round(max(case when model = 'm3' then score end), 6) as m3_prob_1, max(case when model = 'm3' then pred end) as m3_pred
from preds group by slide_id, label""")
def ensemble_wide(spark, sf):
    merged = M.merge_predictions(D.preds(spark, sf))
    wide = M.wide_predictions(merged, ["m1", "m2", "m3"])
    return wide.select(*[r6(c).alias(c) if "_prob_" in c else F.col(c) for c in wide.columns])


@query("model_pairs", f"""with {D.SQL_BOOT}, m as (select distinct model from boot)
select a.model as model1, b.model as model2 from m a join m b on a.model < b.model""")
def model_pairs(spark, sf):
    return M.model_pairs(D.boot_values(spark, sf))


# --- bootstrap -----------------------------------------------------------------
BOOT_SQL = f"""{D.SQL_PREDS}, {VOTE_SQL},
mean_score as (select slide_id, label, round(avg(score), 9) as score from preds group by slide_id, label),
allp as (select model, slide_id, label, pred, score from preds
         union all select 'ensemble', v.slide_id, v.label, v.pred, m.score from vote v join mean_score m using (slide_id, label)),
ids as (select slide_id, row_number() over (order by md5(concat_ws('|', slide_id, '42')), slide_id) - 1 as pos
        from (select distinct slide_id from preds)),
nn as (select count(*) as n from ids),
it as (select unnest(range(0, 50)) as iter),
draws as (select iter, {D.sql_hash("cast(iter as varchar)", "cast(pos as varchar)", "'42'")} % n as pos
          from ids, nn, it where pos < floor(n * 0.8)),
w as (select iter, pos, count(*) as weight from draws group by iter, pos),
src as (select w.iter, a.model, a.label, a.pred, a.score, w.weight from w join ids using (pos) join allp a using (slide_id)),
{D.sql_metrics("src", "iter, model", "weight")},
boot as (unpivot metrics on accuracy, auc, sensitivity, specificity, f1 into name metric value value)"""


def _boot(spark, sf):
    return B.bootstrap_metrics(D.preds(spark, sf), digits=9)


@query("bootstrap_metrics", f"with {BOOT_SQL} select cast(iter as integer) as iter, model, metric, round(value, 6) as value from boot")
def bootstrap_metrics(spark, sf):
    return _boot(spark, sf).select("iter", "model", "metric", r6("value").alias("value"))


@query("bootstrap_summary", f"""with {BOOT_SQL}
select model, metric, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, round(quantile_cont(value, 0.5), 6) as median,
       round(quantile_cont(value, 0.25), 6) as q25, round(quantile_cont(value, 0.75), 6) as q75, round(min(value), 6) as min,
       round(max(value), 6) as max, count(value) as n from boot group by model, metric""")
def bootstrap_summary(spark, sf):
    s = B.distribution_summary(_boot(spark, sf))
    return s.select("model", "metric", *[r6(c).alias(c) for c in ["mean", "std", "median", "q25", "q75", "min", "max"]], "n")


@query("bootstrap_ci", f"""with {BOOT_SQL},
q as (select model, metric, quantile_cont(value, 0.025) as lo, quantile_cont(value, 0.975) as hi from boot group by model, metric)
select model, metric, round(lo, 6) as ci_low, round(hi, 6) as ci_high, round(hi - lo, 6) as ci_width from q""")
def bootstrap_ci(spark, sf):
    s = B.percentile_ci(_boot(spark, sf))
    return s.select("model", "metric", *[r6(c).alias(c) for c in ["ci_low", "ci_high", "ci_width"]])


@query("cohens_d", f"""with {D.SQL_BOOT},
s as (select metric, model, count(value) as n, avg(value) as m, var_samp(value) as v from boot group by metric, model)
select s.metric, s.model,
       round((r.m - s.m) / sqrt(((s.n - 1) * s.v + (r.n - 1) * r.v) / (s.n + r.n - 2)), 6) as cohens_d
from s join s r on r.metric = s.metric and r.model = 'click' where s.model <> 'click'""")
def cohens_d(spark, sf):
    return B.cohens_d(D.boot_values(spark, sf), "click").select("metric", "model", r6("cohens_d").alias("cohens_d"))


@query("paired_tests", f"""with {D.SQL_BOOT},
ref as (select metric, iter, value as ref from boot where model = 'click'),
pairs as (select b.metric, b.model, r.ref - b.value as d from boot b join ref r using (metric, iter) where b.model <> 'click'),
t as (select metric, model, avg(d) / (stddev_samp(d) / sqrt(count(d))) as t_stat, count(d) as n_pairs from pairs group by metric, model),
rk as (select metric, model, d, rank() over w + (count(*) over (partition by metric, model, abs(d)) - 1) / 2.0::double as r
       from pairs where d <> 0 window w as (partition by metric, model order by abs(d))),
wx as (select metric, model, sum(case when d > 0 then r else 0 end) as w_plus, sum(case when d < 0 then r else 0 end) as w_minus,
              count(*) as n_nonzero from rk group by metric, model),
pool as (select b.metric, b.model, b.value, 0 as a from boot b where b.model <> 'click'
         union all select r.metric, o.model, r.value, 1 from boot r, (select distinct model from boot where model <> 'click') o where r.model = 'click'),
pr as (select *, rank() over (partition by metric, model order by value) + (count(*) over (partition by metric, model, value) - 1) / 2.0::double as r from pool),
u as (select metric, model, sum(case when a = 1 then r else 0 end) - sum(a) * (sum(a) + 1) / 2.0::double as u, cast(sum(a) as bigint) as n1,
             cast(sum(1 - a) as bigint) as n2 from pr group by metric, model)
select metric, model, round(t_stat, 6) as t_stat, n_pairs, round(w_plus, 6) as w_plus, round(w_minus, 6) as w_minus, n_nonzero,
       round(u, 6) as u, n1, n2 from t join wx using (metric, model) join u using (metric, model)""")
def paired_tests(spark, sf):
    s = S.test_statistics(D.boot_values(spark, sf), "click")
    return s.select("metric", "model", r6("t_stat").alias("t_stat"), "n_pairs", r6("w_plus").alias("w_plus"),
                    r6("w_minus").alias("w_minus"), "n_nonzero", r6("u").alias("u"), "n1", "n2")


@query("paired_test_pvalues")
def paired_test_pvalues(spark, sf):
    return S.paired_tests(D.boot_values(spark, sf), "click")


PAIR_SQL = f"""{D.SQL_BOOT},
s as (select metric, model, avg(value) as mean, stddev_samp(value) as std from boot group by metric, model),
pool as (select x.metric, p.model1, p.model2, x.value, case when x.model = p.model1 then 1 else 0 end as a
         from boot x join (select a.metric, a.model as model1, b.model as model2 from s a join s b on a.metric = b.metric and a.model < b.model) p
         on x.metric = p.metric and x.model in (p.model1, p.model2)),
pr as (select *, rank() over (partition by metric, model1, model2 order by value)
              + (count(*) over (partition by metric, model1, model2, value) - 1) / 2.0::double as r from pool),
u as (select metric, model1, model2, sum(case when a = 1 then r else 0 end) - sum(a) * (sum(a) + 1) / 2.0::double as u,
             cast(sum(a) as bigint) as n1, cast(sum(1 - a) as bigint) as n2 from pr group by metric, model1, model2)"""


@query("pairwise_rank_sum", f"""with {PAIR_SQL}
select u.metric, u.model1, u.model2, round(s1.mean, 6) as mean1, round(s1.std, 6) as std1, round(s2.mean, 6) as mean2,
       round(s2.std, 6) as std2, round(u, 6) as u, n1, n2
from u join s s1 on s1.metric = u.metric and s1.model = model1 join s s2 on s2.metric = u.metric and s2.model = model2""")
def pairwise_rank_sum(spark, sf):
    s = S.pairwise_statistics(D.boot_values(spark, sf))
    return s.select("metric", "model1", "model2", *[r6(c).alias(c) for c in ["mean1", "std1", "mean2", "std2", "u"]], "n1", "n2")


@query("model_summary", f"""with {D.SQL_BOOT}
select metric, model, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std,
       case when model = 'click' then 0 else 2 end as group_order from boot group by metric, model""")
def model_summary(spark, sf):
    b = D.boot_values(spark, sf)
    s = S.model_summary_with_reference(b, S.pairwise_rank_sum(b), "click")
    return s.select("metric", "model", r6("mean").alias("mean"), r6("std").alias("std"), "group_order")


# --- survival ---------------------------------------------------------------------
def _survival(spark, sf):
    s = D.survival(spark, sf).withColumn("_k", F.lit("all"))
    med = exact_percentiles(s, ["_k"], "o_totalprice", [0.5]).select("_k", F.col("pct")[0].alias("_m"))
    return s.join(F.broadcast(med), "_k").select("time", "event", (F.col("o_totalprice") >= F.col("_m")).cast("int").alias("group"))


KM_SQL = f"""{D.SQL_SURVIVAL},
g as (select grp, time, sum(event) as d, count(*) as m from surv group by grp, time),
r as (select *, sum(m) over (partition by grp order by time desc) as n from g),
km as (select grp, time, cast(d as bigint) as deaths, cast(m - d as bigint) as censored, cast(n as bigint) as at_risk,
              product(1 - d::double / n) over (partition by grp order by time) as survival from r)"""


@query("km_curve", f"""with {KM_SQL}
select grp as "group", round(time / 365.25, 6) as years, deaths, censored, at_risk, round(survival, 6) as survival from km""")
def km_curve(spark, sf):
    c = V.km_curve(_survival(spark, sf), ["group"])
    return c.select("group", r6(F.col("time") / V.DAYS_PER_YEAR).alias("years"), "deaths", "censored", "at_risk",
                    r6("survival").alias("survival"))


@query("median_survival", f"""with {KM_SQL}
select grp as "group", round(coalesce(min(case when survival <= 0.5 + 1e-12 then time end), 'infinity'::double), 6) as median from km group by grp""")
def median_survival(spark, sf):
    return V.median_survival(V.km_curve(_survival(spark, sf), ["group"]), ["group"])


@query("logrank", f"""with {D.SQL_SURVIVAL},
g as (select time, sum(case when grp = 0 then event else 0 end)::double as d0, sum(case when grp = 1 then event else 0 end)::double as d1,
             sum(case when grp = 0 then 1 else 0 end)::double as m0, sum(grp)::double as m1 from surv group by time),
r as (select *, sum(m0) over (order by time desc) as r0, sum(m1) over (order by time desc) as r1 from g),
e as (select d0 + d1 as d, r0 + r1 as n, * from r)
select 'all' as cohort, cast(sum(m0) as bigint) as n0, cast(sum(m1) as bigint) as n1,
       round(pow(sum(d1 - d * r1 / n), 2) / sum(case when n > 1 then r0 * r1 * d * (n - d) / (n * n * (n - 1)) else 0 end), 6) as statistic from e""")
def logrank(spark, sf):
    s = V.logrank_statistic(_survival(spark, sf).withColumn("cohort", F.lit("all")), ["cohort"])
    return s.select("cohort", "n0", "n1", r6("statistic").alias("statistic"))


@query("logrank_pvalue")
def logrank_pvalue(spark, sf):
    return V.logrank(_survival(spark, sf).withColumn("cohort", F.lit("all")), ["cohort"])


def _simpson(f, end, n=4000):
    """SQL of the integral from 0 to ``end`` of f (in terms of x)."""
    return f"(({end}) / {n} / 3 * list_sum(list_transform(range(0, {n + 1}), lambda i: (case when i = 0 or i = {n} then 1 when i % 2 = 1 then 4 else 2 end) * {f.replace('{x}', f'(({end}) * i / {n})')})))"


LOGRANK_SQL = f"""{D.SQL_SURVIVAL},
g as (select time, sum(case when grp = 0 then event else 0 end)::double as d0, sum(case when grp = 1 then event else 0 end)::double as d1,
             sum(case when grp = 0 then 1 else 0 end)::double as m0, sum(grp)::double as m1 from surv group by time),
r as (select *, sum(m0) over (order by time desc) as r0, sum(m1) over (order by time desc) as r1 from g),
e as (select d0 + d1 as d, r0 + r1 as n, * from r),
st as (select pow(sum(d1 - d * r1 / n), 2) / sum(case when n > 1 then r0 * r1 * d * (n - d) / (n * n * (n - 1)) else 0 end) as s from e)"""


@query("logrank_test", f"""with {LOGRANK_SQL} select 'all' as cohort, round(s, 6) as statistic,
 round(greatest(0, 1 - 2 / sqrt(pi()) * {_simpson('exp(-pow({x}, 2))', 'sqrt(s / 2)')}), 6) as p_value from st""")
def logrank_test(spark, sf):
    return logrank_pvalue(spark, sf).select("cohort", r6("statistic").alias("statistic"), r6("p_value").alias("p_value"))


@query("paired_t_test", f"""with {D.SQL_BOOT},
ref as (select metric, iter, value as ref from boot where model = 'click'),
pairs as (select b.metric, b.model, r.ref - b.value as d from boot b join ref r using (metric, iter) where b.model <> 'click'),
t as (select metric, model, avg(d) / (stddev_samp(d) / sqrt(count(d))) as t, count(d) - 1.0::double as v from pairs group by metric, model)
select metric, model, round(t, 6) as ttest_stat,
 round(greatest(0, 1 - 2 * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * {_simpson('pow(1 + pow({x}, 2) / v, -(v + 1) / 2)', 'abs(t)')}), 6) as ttest_p from t""")
def paired_t_test(spark, sf):
    return paired_test_pvalues(spark, sf).select("metric", "model", r6("ttest_stat").alias("ttest_stat"), r6("ttest_p").alias("ttest_p"))


# --- wide reports --------------------------------------------------------------------
@query("fold_table", f"""with {FOLD_SQL}
select model, fold as folds, round(max(auc) filter (split = 'test'), 6) as test_auc, round(max(auc) filter (split = 'val'), 6) as val_auc,
       round(max(accuracy) filter (split = 'test'), 6) as test_acc, round(max(accuracy) filter (split = 'val'), 6) as val_acc from metrics group by model, fold""")
def fold_table(spark, sf):
    t = M.fold_table(_fold_metrics(spark, sf))
    return t.select("model", "folds", *[r6(c).alias(c) for c in ["test_auc", "val_auc", "test_acc", "val_acc"]])


@query("survival_by_split", """with s as (select case o_orderkey % 10 when 0 then 'test' when 1 then 'val' else 'train' end as split,
 case when o_totalprice >= 200000 then 1 else 0 end as grp, round(cast(date_diff('day', o_orderdate::date, date '2001-09-01') as double), 0) / 365.25::double as time,
 case when o_orderstatus = 'F' then 1 else 0 end as event from orders),
g as (select split, grp, time, sum(event)::double as d, count(*)::double as m from s group by 1, 2, 3),
r as (select *, sum(m) over (partition by split, grp order by time desc) as n from g),
km as (select split, grp, time, product(1 - d / n) over (partition by split, grp order by time) as surv from r),
med as (select split, grp, coalesce(min(time) filter (surv <= 0.5 + 1e-12), 'infinity'::double) as med from km group by 1, 2),
p as (select split, time, sum(case when grp = 0 then event else 0 end)::double as d0, sum(case when grp = 1 then event else 0 end)::double as d1,
      sum(case when grp = 0 then 1 else 0 end)::double as m0, sum(grp)::double as m1 from s group by 1, 2),
q as (select *, d0 + d1 as d, sum(m0) over (partition by split order by time desc) as r0, sum(m1) over (partition by split order by time desc) as r1 from p),
t as (select split, cast(sum(m0) as bigint) as n_low, cast(sum(m1) as bigint) as n_high, pow(sum(d1 - d * r1 / (r0 + r1)), 2)
      / sum(case when r0 + r1 > 1 then r0 * r1 * d * (r0 + r1 - d) / ((r0 + r1) * (r0 + r1) * (r0 + r1 - 1)) else 0 end) as statistic from q group by 1)
select split, n_low, n_high, round(statistic, 6) as statistic, round((select med from med where med.split = t.split and grp = 0), 6) as median_low,
       round((select med from med where med.split = t.split and grp = 1), 6) as median_high from t""")
def survival_by_split(spark, sf):
    o = D.table(spark, sf, "orders").withColumn("slide_id", F.concat(F.lit("TCGA-XX-"), F.col("o_orderkey").cast("string"), F.lit("-01")))
    k = F.col("o_orderkey") % 10
    days = F.datediff(F.lit("2001-09-01").cast("date"), F.col("o_orderdate").cast("date")).cast("string")
    dead = F.col("o_orderstatus") == "F"
    master = o.select(F.substring_index("slide_id", "-", 3).alias("patient_id"), F.lit("x").alias("vital_status"), days.alias("days_to_last_followup"),
                      F.when(dead, days).otherwise("").alias("death_days_to"), F.col("o_orderkey").alias("row_ord"))
    splits = o.select("slide_id", F.when(k == 0, "test").when(k == 1, "val").otherwise("train").alias("split"))
    preds = o.select("slide_id", (F.col("o_totalprice") >= 200000).cast("int").alias("pred"))
    s = V.survival_by_split(preds, splits, master)
    return s.select("split", "n_low", "n_high", r6("statistic").alias("statistic"), r6("median_low").alias("median_low"), r6("median_high").alias("median_high"))
