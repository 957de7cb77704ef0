"""Per-group rescaling of a value column: group statistics joined back.

Statistics are aggregates with a map-side combine, so a group holding most
of the rows is reduced before the shuffle and never sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import average_ranks
from ..session import join_same_key


def minmax(df: DataFrame, keys, value: str, out: str, mode="heat", floor=1e-12) -> DataFrame:
    """``heat``: +1e-6 in the denominator; ``zero``: 0 if constant; ``raw``:
    unchanged if constant; ``span``: span at least ``floor``."""
    s = df.groupBy(*keys).agg(F.min(value).alias("_mn"), F.max(value).alias("_mx"))
    v, mn, mx = F.col(value), F.col("_mn"), F.col("_mx")
    scaled = (v - mn) / F.nullif(mx - mn, F.lit(0.0))
    expr = {
        "heat": (v - mn) / (mx - mn + 1e-6),
        "zero": F.coalesce(scaled, F.when(v.isNotNull(), F.lit(0.0))),
        "raw": F.coalesce(scaled, v),
        "span": (v - mn) / F.greatest(mx - mn, F.lit(floor)),
    }[mode]
    return join_same_key(df, s, keys).withColumn(out, expr).drop("_mn", "_mx")


def zscore01(df: DataFrame, keys, value: str, out: str, lo=-3.0, hi=3.0) -> DataFrame:
    """Not-a-number and infinite values count as 0; population std; below 1e-8
    the result is 0; otherwise clip to [lo, hi] and map to [0, 1]."""
    raw = F.col(value)
    bad = raw.isNull() | F.isnan(raw) | (F.abs(raw) == float("inf"))
    clean = df.withColumn("_v", F.when(bad, F.lit(0.0)).otherwise(raw))
    s = clean.groupBy(*keys).agg(F.avg("_v").alias("_m"), F.stddev_pop("_v").alias("_sd"))
    z = F.greatest(F.lit(lo), F.least(F.lit(hi), (F.col("_v") - F.col("_m")) / F.col("_sd")))
    expr = F.when(F.col("_sd") < 1e-8, F.lit(0.0)).otherwise((z - lo) / (hi - lo))
    return join_same_key(clean, s, keys).withColumn(out, expr).drop("_v", "_m", "_sd")


def percentile_score(df: DataFrame, keys, value: str, out: str) -> DataFrame:
    """Share of the group's other rows that lie below (ties share a score), as
    ``percent_rank`` gives it."""
    keys = list(keys)
    ranks = average_ranks(df, keys, value, "_r", size="_n")
    low = ranks.withColumn("_low", F.col("_r") - (F.col("ties") - 1) / 2)
    pos = low.select(
        *keys, value, F.when(F.col("_n") > 1, (F.col("_low") - 1) / (F.col("_n") - 1)).otherwise(F.lit(0.0)).alias(out))
    return join_same_key(df, pos, keys + [value])
