"""Classifier metrics and ensembles on long prediction tables.

Predictions are compressed to counts first -- per (keys, label, pred) for the
confusion metrics, per (keys, score) for the ranking metrics -- with a
map-side combine, so cost after the first shuffle follows the number of
distinct cells, not of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import running_sums


def _weight(weight):
    return F.lit(1) if weight is None else F.col(weight)


def class_counts(preds: DataFrame, keys, label="label", pred="pred", weight=None) -> DataFrame:
    """Per (keys, class): tp, fp, fn for every class seen as label or pred."""
    cells = preds.groupBy(*keys, label, pred).agg(F.sum(_weight(weight)).alias("_w"))
    same, w, zero = F.col(label) == F.col(pred), F.col("_w"), F.lit(0)

    def part(cls, tp, fp, fn):
        return F.struct(F.col(cls).alias("class"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))

    hit, miss = F.when(same, w).otherwise(zero), F.when(same, zero).otherwise(w)
    parts = F.array(part(label, hit, zero.cast("long"), miss), part(pred, zero.cast("long"), miss, zero.cast("long")))
    return (
        cells.select(*keys, F.explode(parts).alias("_p")).select(*keys, "_p.*")
        .groupBy(*keys, "class").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    )


def confusion_metrics(preds: DataFrame, keys, label="label", pred="pred", weight=None,
                      n_classes=2, f1="macro") -> DataFrame:
    """n, accuracy, sensitivity, specificity and F1 per key.

    0/0 is 0.0. Sensitivity and specificity need two classes, else null.
    ``f1="macro"`` averages over labels seen in truth or prediction,
    ``"binary"`` takes class 1.
    """
    tp, fp, fn, cls = F.col("tp"), F.col("fp"), F.col("fn"), F.col("class")
    score = F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0))
    recall = tp / F.nullif(tp + fn, F.lit(0))

    def of(c):
        if n_classes != 2:
            return F.lit(None).cast("double")
        return F.coalesce(F.max(F.when(cls == c, recall)), F.lit(0.0))

    f1_agg = F.avg(score) if f1 == "macro" else F.coalesce(F.max(F.when(cls == 1, score)), F.lit(0.0))
    return class_counts(preds, keys, label, pred, weight).groupBy(*keys).agg(
        F.sum(tp + fn).alias("n"),
        (F.sum(tp) / F.sum(tp + fn)).alias("accuracy"),
        of(1).alias("sensitivity"), of(0).alias("specificity"), f1_agg.alias("f1"),
    )


def auc(preds: DataFrame, keys, label="label", score="score", weight=None) -> DataFrame:
    """Area under the ROC curve; a tied pair counts one half; null when only
    one class occurs."""
    w = _weight(weight)
    counts = preds.groupBy(*keys, score).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("_pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(w)).alias("_neg"),
    )
    placed = running_sums(counts, keys, score, {"_neg": "_below"})
    wins = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0))
    return placed.groupBy(*keys).agg(
        (wins / F.nullif((F.sum("_pos") * F.sum("_neg")).cast("double"), F.lit(0.0))).alias("auc"))


def binary_metrics(preds: DataFrame, keys, label="label", pred="pred", score="score", weight=None,
                   f1="macro") -> DataFrame:
    """Confusion metrics and AUC of one count table: one row per (keys, label,
    prediction, score), summed before the shuffle and read by both."""
    keys = list(keys)
    counts = preds.groupBy(*keys, label, pred, score).agg(F.sum(_weight(weight)).alias("_times"))
    return confusion_metrics(counts, keys, label, pred, "_times", 2, f1).join(
        auc(counts, keys, label, score, "_times"), keys, "left")


def one_vs_rest(preds: DataFrame, keep, probs="prob", label="label") -> DataFrame:
    return preds.select(*keep, F.col(label).alias("_y"), F.posexplode(probs).alias("class", "score")).withColumn(
        "_is", (F.col("_y") == F.col("class")).cast("int"))


def auc_ovr(preds: DataFrame, keys, probs="prob", label="label", present_only=True) -> DataFrame:
    """Macro one-vs-rest AUC. ``present_only`` averages the classes that occur;
    otherwise a class without cases makes the result null."""
    keys = list(keys)
    per = auc(one_vs_rest(preds, keys, probs, label), keys + ["class"], "_is", "score")
    mean = F.avg("auc")
    if not present_only:
        mean = F.when(F.count("auc") == F.count(F.lit(1)), mean)
    return per.groupBy(*keys).agg(mean.alias("auc_ovr"), F.count("auc").alias("n_classes"))


def macro_specificity(preds: DataFrame, keys, n_classes: int, label="label", pred="pred") -> DataFrame:
    """Mean over all ``n_classes`` classes of tn/(tn+fp), 0 where undefined."""
    keys = list(keys)
    counts = class_counts(preds, keys, label, pred)
    total = counts.groupBy(*keys).agg(F.sum(F.col("tp") + F.col("fn")).alias("_n"), F.count(F.lit(1)).alias("_seen"))
    tn = F.col("_n") - F.col("tp") - F.col("fp") - F.col("fn")
    spec = F.coalesce(tn / F.nullif(tn + F.col("fp"), F.lit(0)), F.lit(0.0))
    # classes never seen have tn = n, fp = 0: specificity 1
    return counts.join(total, keys).groupBy(*keys).agg(
        ((F.sum(spec) + (F.lit(n_classes) - F.first("_seen"))) / n_classes).alias("macro_specificity"))


def per_class_accuracy(preds: DataFrame, keys, label="label", pred="pred") -> DataFrame:
    hit = (F.col(label) == F.col(pred)).cast("long")
    return preds.groupBy(*keys, label).agg(
        F.count(F.lit(1)).alias("count"), F.sum(hit).alias("correct"), F.avg(hit).alias("accuracy"),
        (1 - F.avg(hit)).alias("error"))


def attach_split(preds: DataFrame, splits: DataFrame, on=("slide_id",)) -> DataFrame:
    return preds.join(splits, list(on), "left")


def fold_metrics(preds: DataFrame, labels: DataFrame, splits: DataFrame, f1="macro") -> DataFrame:
    """Metric rows per (model, fold, split). ``preds`` may or may not carry a
    fold of its own; slides without label or split are left out."""
    on = ["fold", "slide_id"] if "fold" in preds.columns else ["slide_id"]
    rows = preds.join(labels.select("slide_id", "label"), "slide_id").join(splits, on)
    return binary_metrics(rows, ["model", "fold", "split"], f1=f1)


def fold_summary(metrics: DataFrame, metric_cols=("auc", "accuracy"), splits=("test", "val")) -> DataFrame:
    """Mean and population std across folds, one row per (model, split, metric)."""
    long = metrics.filter(F.col("split").isin(*splits)).unpivot(
        ["model", "split"], list(metric_cols), "metric", "value")
    return long.groupBy("model", "split", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("folds"))


BEST_FOLD_ORDER = {
    "f1": ["f1"],
    "f1_auc": ["f1", "auc"],
    "auc": ["auc"],
    "auc_accuracy": [("auc", "accuracy")],
}


def best_fold(metrics: DataFrame, rule="f1_auc", split="test", by=("model",)) -> DataFrame:
    """The winning fold per model; nulls rank last, the lower fold wins ties.
    ``auc_accuracy`` ranks by AUC, or by accuracy where AUC is missing."""
    cols = BEST_FOLD_ORDER[rule]
    rows = metrics.filter(F.col("split") == split)
    usable = F.lit(False)
    order = []
    for c in cols:
        v = F.coalesce(*c) if isinstance(c, tuple) else F.col(c)
        if isinstance(c, tuple):
            rows = rows.withColumn("_any_auc", F.max(c[0]).over(Window.partitionBy(*by)))
            v = F.when(F.col("_any_auc").isNotNull(), F.col(c[0])).otherwise(F.col(c[1]))
        usable = usable | v.isNotNull()
        order.append(F.coalesce(v, F.lit(float("-inf"))))
    best = rows.filter(usable).groupBy(*by).agg(
        F.max_by(F.struct("fold", "accuracy", "auc", "f1"), F.struct(*order, -F.col("fold"))).alias("_b"))
    return best.select(*by, F.col("_b.fold").alias("fold"), F.col("_b.accuracy").alias("accuracy"),
                       F.col("_b.auc").alias("auc"), F.col("_b.f1").alias("f1"))


def majority_vote(preds: DataFrame, keys=("slide_id",), pred="pred") -> DataFrame:
    """Most frequent class; the smallest class wins ties."""
    votes = preds.groupBy(*keys, pred).agg(F.count(F.lit(1)).alias("_v"))
    return votes.groupBy(*keys).agg(F.max_by(pred, F.struct("_v", -F.col(pred))).alias(pred))


def combinations_of(members, size: int):
    """All unordered ``size``-element subsets of an array column, as an array
    of sorted arrays. No join: the list of models is one short array."""
    ordered = F.array_sort(members)
    combos = F.transform(ordered, lambda m: F.array(m))
    for _ in range(size - 1):
        combos = F.flatten(F.transform(combos, lambda c: F.transform(
            F.filter(ordered, lambda m: m > F.element_at(c, -1)), lambda m: F.concat(c, F.array(m)))))
    return combos


def model_combinations(models: DataFrame, sizes=(2, 3)) -> DataFrame:
    """(combo, model) rows for every unordered combination of the given sizes;
    size 0 stands for all models together."""
    listed = models.groupBy().agg(F.collect_set("model").alias("_m"))
    sets = F.flatten(F.array(*[
        F.array(F.array_sort("_m")) if r == 0 else combinations_of(F.col("_m"), r) for r in sizes]))
    members = listed.select(F.explode(F.array_distinct(sets)).alias("members"))
    return members.select(F.concat_ws("+", "members").alias("combo"), F.explode("members").alias("model"))


def model_pairs(models: DataFrame, keys=()) -> DataFrame:
    """(keys, model1, model2) for every unordered pair present under a key."""
    listed = models.groupBy(*keys).agg(F.collect_set("model").alias("_m"))
    return listed.select(*keys, F.explode(combinations_of(F.col("_m"), 2)).alias("_p")).select(
        *keys, F.element_at("_p", 1).alias("model1"), F.element_at("_p", 2).alias("model2"))


def mean_prob_ensemble(preds: DataFrame, combos: DataFrame, keys=("slide_id", "label"), probs="prob",
                       decide="mean") -> DataFrame:
    """Mean class probabilities per combo. ``decide="mean"`` thresholds the mean
    (argmax for more than two classes), ``"vote"`` takes the majority vote.
    ``score`` is the class-1 mean for two classes, else the largest mean."""
    keys = list(keys)
    member = preds.join(combos, "model")
    means = (
        member.select("combo", *keys, F.posexplode(probs).alias("_c", "_p"))
        .groupBy("combo", *keys, "_c").agg(F.avg("_p").alias("_p"))
        .groupBy("combo", *keys).agg(F.array_sort(F.collect_list(F.struct("_c", "_p"))).alias("_a"))
        .withColumn("prob", F.transform("_a", lambda s: s["_p"])).drop("_a")
    )
    two = F.size("prob") == 2
    out = means.withColumn("score", F.when(two, F.element_at("prob", 2)).otherwise(F.array_max("prob")))
    if decide == "vote":
        return out.join(majority_vote(member, ["combo", *keys]), ["combo", *keys])
    first_max = (F.array_position("prob", F.array_max("prob")) - 1).cast("int")
    return out.withColumn("pred", F.when(two, (F.element_at("prob", 2) >= 0.5).cast("int")).otherwise(first_max))


def merge_predictions(preds: DataFrame, keys=("slide_id", "label")) -> DataFrame:
    """Slides every model predicted, one-to-one: a key a model predicted twice
    stops the job with an error."""
    keys = list(keys)
    n_models = preds.select("model").distinct().groupBy().agg(F.count(F.lit(1)).alias("_m"))
    per_model = preds.groupBy(*keys, "model").agg(F.count(F.lit(1)).alias("_rows"))
    ok = F.when(F.max("_rows") == 1, F.count(F.lit(1))).otherwise(
        F.raise_error(F.lit("a model predicts the same slide more than once")).cast("long"))
    full = per_model.groupBy(*keys).agg(ok.alias("_k"))
    # one-row scalar, not a product of two tables
    keep = full.join(F.broadcast(n_models), F.col("_k") == F.col("_m")).select(*keys)
    return preds.join(keep, keys, "left_semi")


def wide_predictions(merged: DataFrame, models, n_classes=2, keys=("slide_id", "label")) -> DataFrame:
    """``{model}_prob_c`` and ``{model}_pred`` columns; ``models`` is the list of
    names, so the pivot needs no extra pass."""
    aggs = [F.first("pred").alias("pred")] + [
        F.first(F.element_at("prob", c + 1)).alias(f"prob_{c}") for c in range(n_classes)]
    return merged.groupBy(*keys).pivot("model", list(models)).agg(*aggs)


def wide_metrics(metrics: DataFrame, keys, phases=("train", "val", "test"),
                 cols=("accuracy", "auc", "sensitivity", "specificity", "f1")) -> DataFrame:
    """``{phase}_{metric}`` columns, one row per key."""
    of = lambda p, c: F.max(F.when(F.col("split") == p, F.col(c))).alias(f"{p}_{c}")
    return metrics.groupBy(*keys).agg(*[of(p, c) for p in phases for c in cols])


def fold_table(metrics: DataFrame, keys=("model",)) -> DataFrame:
    """One row per fold: test_auc, val_auc, test_acc, val_acc."""
    w = wide_metrics(metrics, [*keys, "fold"], ("test", "val"), ("auc", "accuracy"))
    return w.select(*keys, F.col("fold").alias("folds"), "test_auc", "val_auc", F.col("test_accuracy").alias("test_acc"),
                    F.col("val_accuracy").alias("val_acc"))


def fold_table_name(start: int, end: int, k: int) -> str:
    """Name of the table for folds start..end-1 of k."""
    return "summary" if end - start == k else f"summary_partial_{start}_{end}"
