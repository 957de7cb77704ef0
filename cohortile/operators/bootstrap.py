"""Paired bootstrap of model metrics and summaries of its distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.draws import hash_number, hash_rank, order_hash
from ..session import durable, join_same_key
from .metrics import binary_metrics, majority_vote

METRICS = ("accuracy", "auc", "sensitivity", "specificity", "f1")


def draw_weights(items: DataFrame, id_col: str, n_iter=50, frac=0.8, seed=42, within=()) -> DataFrame:
    """(within, id, draws array<struct(iter, weight)>): how often each item is drawn.

    Every iteration draws int(n * frac) positions with replacement, n being the
    items of a ``within`` group (all items by default). Position k of iteration
    i is ``md5(i|k|seed) mod n``; the item at dense position k stands for draw
    k, so the draws are spread over the cluster with the items. One row per
    item leaves here, whatever the number of iterations.
    """
    by = ["_all", *within]
    base = durable(items.select(*within, id_col).distinct().withColumn("_all", F.lit(1)))
    dense = durable(hash_rank(base.withColumn("_h", order_hash(id_col, seed)), by, "_h", [id_col], "_pos").select(
        *by, id_col, "_pos"))
    total = base.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    drawn = (
        join_same_key(dense, total, by)
        .filter(F.col("_pos") < F.floor(F.col("_n") * frac))
        .select(*by, "_n", "_pos", F.explode(F.sequence(F.lit(0), F.lit(n_iter - 1))).alias("iter"))
        .select(*by, "iter", (hash_number("iter", "_pos", seed) % F.col("_n")).alias("_pos"))
    )
    per_pos = drawn.groupBy(*by, "_pos", "iter").agg(F.count(F.lit(1)).alias("weight")).groupBy(*by, "_pos").agg(
        F.collect_list(F.struct("iter", "weight")).alias("draws"))
    # both the confusion and the ranking metrics read the draws: keep them
    return durable(join_same_key(dense, per_pos, [*by, "_pos"]).select(*within, id_col, "draws"))


def with_ensemble(preds: DataFrame, members=None) -> DataFrame:
    """Add model ``ensemble``: majority vote, mean score. It is row-wise, so
    adding it before resampling equals recomputing it in every iteration."""
    pool = preds if members is None else preds.filter(F.col("model").isin(*members))
    vote = majority_vote(pool, ["slide_id", "label"])
    mean = pool.groupBy("slide_id", "label").agg(F.avg("score").alias("score"))
    ens = vote.join(mean, ["slide_id", "label"]).withColumn("model", F.lit("ensemble"))
    cols = ["model", "slide_id", "label", "pred", "score"]
    return preds.select(*cols).unionByName(ens.select(*cols))


def bootstrap_metrics(preds: DataFrame, n_iter=50, frac=0.8, seed=42, members=None, digits=None) -> DataFrame:
    """Long rows (iter, model, metric, value). One pass over the predictions:
    weights per item are joined once, all iterations are keys of one groupBy.
    ``digits`` rounds the ensemble's mean scores, so that equal means tie."""
    rows = with_ensemble(preds, members)
    if digits is not None:
        rows = rows.withColumn("score", F.when(F.col("model") == "ensemble", F.round("score", digits)).otherwise(F.col("score")))
    w = draw_weights(preds.select("slide_id"), "slide_id", n_iter, frac, seed)
    drawn = rows.join(w, "slide_id").select(
        "model", "label", "pred", "score", F.explode("draws").alias("_d")).select(
        "model", "label", "pred", "score", "_d.iter", "_d.weight")
    wide = binary_metrics(drawn, ["iter", "model"], weight="weight")
    return wide.unpivot(["iter", "model"], list(METRICS), "metric", "value")


def distribution_summary(boot: DataFrame, keys=("model", "metric")) -> DataFrame:
    """Population std; nulls left out. A group holds one value per iteration."""
    q = F.percentile("value", F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75)))
    return boot.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), q.alias("_q"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n"),
    ).select(*keys, "mean", "std", F.get("_q", F.lit(0)).alias("median"), F.get("_q", F.lit(1)).alias("q25"),
             F.get("_q", F.lit(2)).alias("q75"), "min", "max", "n")


def percentile_ci(boot: DataFrame, keys=("model", "metric"), confidence=0.95) -> DataFrame:
    """Linear percentiles of the bootstrap values; fewer than two values give null."""
    tail = (1 - confidence) / 2
    q = F.percentile("value", F.array(F.lit(tail), F.lit(1 - tail)))
    out = boot.groupBy(*keys).agg(F.when(F.count("value") >= 2, q).alias("_q"))
    lo, hi = F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    return out.select(*keys, lo.alias("ci_low"), hi.alias("ci_high"), (hi - lo).alias("ci_width"))


def cohens_d(boot: DataFrame, reference: str, by=("metric",)) -> DataFrame:
    """(reference - model) / pooled sample std; null below two values or when
    the pooled std is zero."""
    by = list(by)
    s = boot.groupBy(*by, "model").agg(
        F.count("value").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    ref = s.filter(F.col("model") == reference).select(
        *by, F.col("n").alias("rn"), F.col("m").alias("rm"), F.col("v").alias("rv"))
    pooled = F.sqrt(((F.col("n") - 1) * F.col("v") + (F.col("rn") - 1) * F.col("rv")) / (F.col("n") + F.col("rn") - 2))
    ok = (F.col("n") >= 2) & (F.col("rn") >= 2) & (pooled > 0)
    return s.filter(F.col("model") != reference).join(ref, by).select(
        *by, "model", F.when(ok, (F.col("rm") - F.col("m")) / pooled).alias("cohens_d"))
