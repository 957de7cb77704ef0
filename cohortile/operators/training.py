"""Fold driver: fit on train, score every split, hand on prediction rows."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import fold_metrics


def fold_train_score(vecs: DataFrame, labels: DataFrame, splits: DataFrame, folds, model="model", max_iter=50,
                     reg=0.01, estimator=None) -> DataFrame:
    """(model, fold, slide_id, prob, pred, score): for each fold the estimator is
    fitted on its train slides and applied to all of its slides. Fitting is
    distributed; the folds are a short list."""
    rows = vecs.join(labels.select("slide_id", "label"), "slide_id").select(
        "slide_id", F.col("label").cast("double").alias("label"), array_to_vector(F.col("features").cast("array<double>")).alias("features"))
    out = None
    for f in folds:
        here = rows.join(splits.filter(F.col("fold") == f), "slide_id")
        est = estimator or LogisticRegression(maxIter=max_iter, regParam=reg)
        fitted = est.fit(here.filter("split = 'train'"))
        prob = vector_to_array(F.col("probability"))
        part = fitted.transform(here).select(
            F.lit(model).alias("model"), F.lit(f).alias("fold"), "slide_id", prob.alias("prob"),
            F.col("prediction").cast("int").alias("pred"), F.element_at(prob, 2).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def fold_train_metrics(vecs: DataFrame, labels: DataFrame, splits: DataFrame, folds, **kw) -> DataFrame:
    preds = fold_train_score(vecs, labels, splits, folds, **kw)
    return fold_metrics(preds, labels, splits.filter(F.col("fold").isin(*folds)))
