"""Rankings and reshaping of summary tables (one row per model and cutoff)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .significance import display_order


def rank_models(summary: DataFrame, metric: str, by=("percentile",)) -> DataFrame:
    """1-based rank per cutoff (and tissue), highest first, ties by model name."""
    w = Window.partitionBy(*by).orderBy(F.col(metric).desc_nulls_last(), "model")
    return summary.filter(F.col(metric).isNotNull()).withColumn("rank", F.row_number().over(w))


def aggregated_rank(summary: DataFrame, target: str, other: str, by=("percentile",)) -> DataFrame:
    """Rank the target coverage from the top and the other from the bottom, add
    both, rank the sums from the smallest."""
    w = Window.partitionBy(*by)
    r = summary.withColumns({
        "target_rank": F.row_number().over(w.orderBy(F.col(target).desc_nulls_last(), "model")),
        "_or": F.row_number().over(w.orderBy(F.col(other).desc_nulls_last(), "model")), "_n": F.count(F.lit(1)).over(w)})
    r = r.withColumn("other_rank", (F.col("_n") + 1 - F.col("_or")).cast("int")).withColumn("rank_sum", F.col("target_rank") + F.col("other_rank"))
    return r.withColumn("rank", F.row_number().over(w.orderBy("rank_sum", "model"))).drop("_or", "_n")


def detect_other(columns, prefix="mean_", suffix="_cov"):
    """``normal`` or ``benign``, whichever the summary has."""
    for name in ("normal", "benign"):
        if f"{prefix}{name}{suffix}" in columns:
            return f"{prefix}{name}{suffix}"
    raise ValueError("summary has neither a normal nor a benign coverage column")


def combine_models(summaries: dict) -> DataFrame:
    """One table from {model: summary}; columns a summary lacks are null."""
    parts = [df.withColumn("model", F.lit(m)) for m, df in summaries.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def metric_pivot(combined: DataFrame, metric: str, percents, keys=("model",)) -> DataFrame:
    """Model x cutoff, first value per cell."""
    return combined.groupBy(*keys).pivot("percentile", list(percents)).agg(F.first(metric, ignorenulls=True))


def metrics_with_data(combined: DataFrame, metrics) -> DataFrame:
    """(metric) names that have any value."""
    return combined.select(*metrics).agg(*[F.count(m).alias(m) for m in metrics]).unpivot([], list(metrics), "metric", "n").filter("n > 0").select("metric")


def reshape_coverage(wide: DataFrame, tissues, prefixes=(("mean", "mean_{}_cov"), ("std", "std_{}_cov"), ("n", "n_valid_{}_cov"))) -> DataFrame:
    """Wide summary -> (model, percentile, tissue, mean, std, n, model_order).
    Columns the summary lacks are null."""
    def col(pattern, t):
        name = pattern.format(t)
        return F.col(name).cast("double") if name in wide.columns else F.lit(None).cast("double")

    parts = F.array(*[F.struct(F.lit(t).alias("tissue"), *[col(p, t).alias(n) for n, p in prefixes]) for t in tissues])
    rows = wide.select("model", "percentile", F.explode(parts).alias("_p")).select("model", "percentile", "_p.*")
    return rows.withColumn("model_order", display_order(F.col("model")))
