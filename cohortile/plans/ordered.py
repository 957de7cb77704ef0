"""Ranks, running sums and percentiles of groups of any size.

A window over one group sorts that whole group in one task. Here all rows are
cut into ranges of (keys, order) instead, as even as Spark's range sampling
makes them: a small group lies inside one range, a large one is cut wherever
the ranges end. Each range sums its part of every group it holds, the parts
before a range give its offsets, and a window only ever sorts one range. The
plan is the same for every size; ranges follow ``spark.sql.shuffle.partitions``
and are merged by adaptive execution where they are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable


def scan(df: DataFrame, keys, order, sums: dict | None = None, totals: dict | None = None, ends: dict | None = None) -> DataFrame:
    """Prefix sums over the rows of every group, in the order of ``order``.

    ``sums`` maps a column to the name of its sum over all earlier rows of the
    group, ``totals`` a column to the name of its group total; ``ends`` maps a
    column to the name of its sum up to and with the row. ``order`` must name
    each row of a group once, or rows that tie must be interchangeable. A null
    key is a group, a null in ``order`` comes first. The rows are written out
    by range, so ``df`` is read once more for its sample of ranges only.
    """
    keys, sums, totals, ends = list(keys), sums or {}, totals or {}, ends or {}
    order = [order] if isinstance(order, str) else list(order)
    rows = durable(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
                   .withColumn("_group", F.xxhash64(*keys) if keys else F.lit(0).cast("long")))
    wanted = list(dict.fromkeys([*sums, *totals, *ends]))
    inside = Window.partitionBy("_range", "_group", *keys)
    before, here = (inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, e) for e in (-1, 0))
    if len(rows.inputFiles()) < 2:  # all ranges were merged into one file: every part is a whole group
        return rows.select(
            *df.columns, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for c, n in sums.items()],
            *[F.sum(c).over(here).alias(n) for c, n in ends.items()], *[F.sum(c).over(inside).alias(n) for c, n in totals.items()])
    per = rows.groupBy("_range", "_group", *keys).agg(*[F.sum(c).alias(f"_s_{c}") for c in wanted])
    group = Window.partitionBy(*keys)  # at most one row per range
    prior = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(
        F.col("_range").alias("_r"), F.col("_group").alias("_g"), *[F.col(k).alias(f"_key_{k}") for k in keys],
        *[F.coalesce(F.sum(f"_s_{c}").over(prior), F.lit(0)).alias(f"_o_{c}") for c in dict.fromkeys([*sums, *ends])],
        *[F.sum(f"_s_{c}").over(group).alias(n) for c, n in totals.items()])
    # the exchange of the join serves the window too
    same = (F.col("_range") == F.col("_r")) & (F.col("_group") == F.col("_g"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return rows.join(offsets, same).select(
        *df.columns,
        *[(F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(before), F.lit(0))).alias(n) for c, n in sums.items()],
        *[(F.col(f"_o_{c}") + F.sum(c).over(here)).alias(n) for c, n in ends.items()],
        *totals.values())


def running_sums(df: DataFrame, keys, value: str, sums: dict, totals: dict | None = None) -> DataFrame:
    """For every (keys, value) row add the sums over all smaller values.

    ``sums`` maps a column to the name of its exclusive prefix sum, ``totals``
    a column to the name of its group total. ``df`` holds each (keys, value)
    once and is computed once.
    """
    return scan(df, keys, value, sums, totals)


def average_ranks(df: DataFrame, keys, value: str, name="rank", size=None) -> DataFrame:
    """One row per (keys, value): ``ties`` rows share the average 1-based rank;
    ``size`` names an extra column with the group's row count."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("ties"))
    below = running_sums(counts, keys, value, {"ties": "_below"}, {"ties": size} if size else None)
    return below.withColumn(name, F.col("_below") + (F.col("ties") + 1) / 2).drop("_below")


def exact_percentiles(df: DataFrame, keys, value: str, fractions, name="pct", weight=None) -> DataFrame:
    """Linear-interpolated percentiles, one array per group, for groups of any
    size. Nulls are ignored; ``weight`` counts a row several times."""
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_c")).filter("_c > 0")
    placed = running_sums(counts, keys, value, {"_c": "_below"}, {"_c": "_n"})

    def at(pos):
        hit = (F.col("_below") <= pos) & (pos < F.col("_below") + F.col("_c"))
        return F.max(F.when(hit, F.col(value)))

    aggs, cols = [], []
    for i, p in enumerate(fractions):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        aggs += [at(F.floor(pos)).alias(f"_lo{i}"), at(F.ceil(pos)).alias(f"_hi{i}"),
                 F.max(pos - F.floor(pos)).alias(f"_f{i}")]
        cols.append(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}"))
    return placed.groupBy(*keys).agg(*aggs).select(*keys, F.array(*cols).alias(name))
