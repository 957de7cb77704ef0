"""Repeatable random choices.

A choice is an order by ``md5(part|part|...)``: it is the same for every
partitioning, every re-run of a lost task and every SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import join_same_key


def order_hash(*parts) -> Column:
    cols = [F.col(p) if isinstance(p, str) else (p if isinstance(p, Column) else F.lit(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def hash_number(*parts) -> Column:
    """First 60 bits of the md5 as a long."""
    return F.conv(F.substring(order_hash(*parts), 1, 15), 16, 10).cast("long")


def hash_unit(*parts) -> Column:
    """The same bits scaled to [0, 1)."""
    return hash_number(*parts) / F.lit(float(1 << 60))


RUN_ROWS = 1_000_000


def hash_rank(df: DataFrame, keys, hash_col: str, ties, name="rank", size=None, run_rows=RUN_ROWS) -> DataFrame:
    """0-based position of each row in the order (hash, ties) inside ``keys``;
    ``size`` names an extra column with the group's row count.

    A group of up to ``run_rows`` rows is one window. md5 spreads evenly, so the
    first hex digits cut a larger one into 256 or 65536 even runs; their sizes
    are counted with a map-side combine and added up, and only a run is ever
    sorted by one task.
    """
    keys = list(keys)
    n = F.col("_n")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    digits = F.when(n <= run_rows, 0).when(n <= 256 * run_rows, 2).otherwise(4)
    rows = join_same_key(df, sizes, keys).withColumn("_run", F.substr(F.col(hash_col), F.lit(1), digits))
    before = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.filter(n > run_rows).groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    )
    inside = Window.partitionBy(*keys, "_run").orderBy(hash_col, *ties)
    out = join_same_key(rows, offsets, keys + ["_run"], "left").withColumn(
        name, F.coalesce("_off", F.lit(0)) + F.row_number().over(inside) - 1).drop("_run", "_off")
    return out.withColumnRenamed("_n", size) if size else out.drop("_n")


#: up to this many rows per key Spark limits each partition before the shuffle
GROUP_LIMIT = 1000
#: hex digits of the hash by which rows are counted to find a bound
DIGITS = 3


def first_by_hash(df: DataFrame, keys, hash_col: str, ties, n: int) -> DataFrame:
    """The n rows of smallest (hash, ties) of every key, without ranking the rest.

    A small n is a window that keeps n rows per key and task before the
    shuffle. For a larger one the rows are counted by the first digits of their
    hash (16^DIGITS sums per key at most); the digits under which n rows lie are
    the bound, and only rows within it are ranked.
    """
    keys = list(keys)
    if n <= GROUP_LIMIT:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(hash_col, *ties))
        return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")
    digits = F.substring(F.col(hash_col), 1, DIGITS)
    upto = Window.partitionBy(*keys).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, digits.alias("_d")).agg(F.count(F.lit(1)).alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(upto), F.lit(0)))
    bound = sums.filter(F.col("_before") < n).groupBy(*keys).agg(F.max("_d").alias("_bound"))
    near = join_same_key(df, bound, keys).filter(digits <= F.col("_bound")).drop("_bound")
    return hash_rank(near, keys, hash_col, ties, "_place").filter(F.col("_place") < n).drop("_place")


def hash_take(df: DataFrame, keys, parts, ties, quota) -> DataFrame:
    """Exactly ``quota`` rows per key without replacement, in hash order.

    ``quota`` is a column, a number, or a function of the group size
    (given as a column).
    """
    keys = list(keys)
    src = df if keys else df.withColumn("_all", F.lit(1))
    use = keys or ["_all"]
    if isinstance(quota, int) and not keys and quota <= GROUP_LIMIT:  # the best n of each task, then of those
        return df.withColumn("_h", order_hash(*parts)).orderBy("_h", *ties).limit(quota).select(*df.columns)
    if isinstance(quota, int):
        return first_by_hash(src.withColumn("_h", order_hash(*parts)), use, "_h", ties, quota).select(*df.columns)
    ranked = hash_rank(src.withColumn("_h", order_hash(*parts)), use, "_h", ties, "_pos", "_size")
    if callable(quota):
        quota = quota(F.col("_size"))
    elif not isinstance(quota, Column):
        quota = F.lit(quota)
    kept = ranked.filter(F.col("_pos") < quota)
    return kept.select(*df.columns)
