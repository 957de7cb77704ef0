"""Product-limit curves, medians and the log-rank test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pvalues import chi2_1df_pvalue
from ..functions.scalars import survival_time_event
from ..plans.ordered import running_sums
from .cohort import slides_to_master

DAYS_PER_YEAR = 365.25
HALF = 0.5 + 1e-12  # a product kept as a sum of logs may end a hair above one half


def km_curve(df: DataFrame, keys, time="time", event="event") -> DataFrame:
    """Per (keys, time): deaths, censored, at_risk, survival. Rows are first
    reduced to one per distinct time."""
    keys = list(keys)
    per = df.groupBy(*keys, time).agg(
        F.sum((F.col(event) == 1).cast("long")).alias("deaths"),
        F.sum((F.col(event) != 1).cast("long")).alias("censored"))
    per = per.withColumn("_gone", F.col("deaths") + F.col("censored"))
    risk = running_sums(per, keys, time, {"_gone": "_before"}, {"_gone": "_n"}).withColumn(
        "at_risk", F.col("_n") - F.col("_before"))
    alive = 1 - F.col("deaths") / F.col("at_risk")
    step = risk.withColumn("_ln", F.when(alive > 0, F.ln(alive)).otherwise(F.lit(0.0))).withColumn(
        "_zero", (alive <= 0).cast("long"))
    acc = running_sums(step, keys, time, {"_ln": "_lnp", "_zero": "_zp"})
    s = F.when(F.col("_zp") + F.col("_zero") > 0, F.lit(0.0)).otherwise(F.exp(F.col("_lnp") + F.col("_ln")))
    return acc.select(*keys, time, "deaths", "censored", "at_risk", s.alias("survival"))


def median_survival(curve: DataFrame, keys, time="time") -> DataFrame:
    """First time with survival <= 0.5, else +infinity."""
    hit = F.min(F.when(F.col("survival") <= HALF, F.col(time).cast("double")))
    return curve.groupBy(*keys).agg(F.coalesce(hit, F.lit(float("inf"))).alias("median"))


def logrank_statistic(df: DataFrame, keys, time="time", event="event", group="group") -> DataFrame:
    """Chi-square (1 df) of group 0 against group 1; null if either is empty."""
    keys = list(keys)
    dead, one = F.col(event) == 1, F.col(group) == 1
    per = df.groupBy(*keys, time).agg(
        F.sum((dead & ~one).cast("long")).alias("_d0"), F.sum((dead & one).cast("long")).alias("_d1"),
        F.sum((~one).cast("long")).alias("_m0"), F.sum(one.cast("long")).alias("_m1"))
    at = running_sums(per, keys, time, {"_m0": "_b0", "_m1": "_b1"}, {"_m0": "n0", "_m1": "n1"})
    r0, r1 = F.col("n0") - F.col("_b0"), F.col("n1") - F.col("_b1")
    n, d = (r0 + r1).cast("double"), (F.col("_d0") + F.col("_d1")).cast("double")
    expected = d * r1 / n
    var = F.when(n > 1, r0 * r1 * d * (n - d) / (n * n * (n - 1))).otherwise(F.lit(0.0))
    s = at.groupBy(*keys).agg(
        F.max("n0").alias("n0"), F.max("n1").alias("n1"), F.sum(F.col("_d1") - expected).alias("_oe"),
        F.sum(var).alias("_v"))
    ok = (F.col("n0") > 0) & (F.col("n1") > 0) & (F.col("_v") > 0)
    return s.select(*keys, "n0", "n1", F.when(ok, F.col("_oe") * F.col("_oe") / F.col("_v")).alias("statistic"))


def logrank(df: DataFrame, keys, time="time", event="event", group="group") -> DataFrame:
    return logrank_statistic(df, keys, time, event, group).withColumn("p_value", chi2_1df_pvalue("statistic"))


def survival_by_split(preds: DataFrame, splits: DataFrame, master: DataFrame, split_names=("train", "val", "test"),
                      mode="segments") -> DataFrame:
    """Per split: group sizes by predicted class, log-rank statistic and median
    years. Slides without prediction, master row or valid time are dropped; a
    split without any gives a row of zeros."""
    matched, _ = slides_to_master(splits.select("slide_id", "split"), master, mode)
    te = survival_time_event("death_days_to", "days_to_last_followup")
    rows = (
        matched.withColumn("_s", te).filter(F.col("_s").isNotNull())
        .join(preds.select("slide_id", F.col("pred").alias("group")), "slide_id")
        .select("split", "group", (F.col("_s.time") / DAYS_PER_YEAR).alias("time"), F.col("_s.event").alias("event"))
        .filter(F.col("group").isin(0, 1))
    )
    med = median_survival(km_curve(rows, ["split", "group"]), ["split", "group"]).groupBy("split").agg(
        F.max(F.when(F.col("group") == 0, F.col("median"))).alias("median_low"),
        F.max(F.when(F.col("group") == 1, F.col("median"))).alias("median_high"))
    test = logrank_statistic(rows, ["split"])
    # the wanted split names are a fixed short list
    names = splits.sparkSession.createDataFrame([(s,) for s in split_names], "split string")
    return names.join(test, "split", "left").join(med, "split", "left").select(
        "split", F.coalesce("n0", F.lit(0)).alias("n_low"), F.coalesce("n1", F.lit(0)).alias("n_high"),
        "statistic", "median_low", "median_high")


def survival_by_split_test(*args, **kwargs) -> DataFrame:
    return survival_by_split(*args, **kwargs).withColumn("p_value", chi2_1df_pvalue("statistic"))
