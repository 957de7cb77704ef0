"""Work that needs more than one row at a time, on bounded pieces.

``beside`` runs the rows of a group next to a small table of that group (its
components, its centroids, its pivots). ``pair_blocks`` runs every pair of rows
of a group, block against block: a pair of blocks meets once, for both of its
sides, and no pair of rows is written out. A block holds at most ``NUMBERS``
vector components and ``MOST_ROWS`` rows; below that the groups are cut into
just enough blocks to keep all tasks busy, since each row is sent once per
block of its group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable, join_same_key

#: vector components in a block or part
NUMBERS = 4_000_000
#: rows that a task works on after ``spread``
TASK_ROWS = 1_000_000
#: rows in a block whose pairs are worked out
MOST_ROWS = 32_768


def beside(rows: DataFrame, table: DataFrame, keys, features: str | Column, work, schema, numbers=NUMBERS) -> DataFrame:
    """``work(part, its table)`` (Arrow in, Arrow out) for parts of every group.
    ``part`` has the columns of ``rows`` in their order, and some more; a part
    whose group has no table rows gets an empty one. ``features`` is the vector
    or a column that says what a row weighs in components."""
    by = ["_all", *keys]
    rows, table = rows.withColumn("_all", F.lit(1)), table.withColumn("_all", F.lit(1))
    parts = rows.groupBy(*by).agg(F.greatest(F.lit(1), F.ceil(F.sum(F.size(features) if isinstance(features, str) else features) / numbers)).cast("int").alias("_parts"))
    left = join_same_key(rows, parts, by).withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.col("_parts")).cast("int"))
    right = join_same_key(table, parts, by).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    names = [c for c in rows.columns if c != "_all"]
    left = left.select(*names, *[c for c in [*by, "_part"] if c not in names])
    return left.groupBy(*by, "_part").cogroup(right.groupBy(*by, "_part")).applyInArrow(work, schema)


def spread(rows: DataFrame, weight, by, each=TASK_ROWS, total=None) -> DataFrame:
    """``rows`` dealt by ``by`` into enough tasks that what they grow into
    (``weight`` a row, or ``total``) is about ``each`` rows a task. The size of a shuffle in
    bytes says little about it: short rows compress well and are then merged
    into few tasks."""
    total = (rows.agg(F.sum(weight)).first()[0] or 0) if total is None else total
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(tasks, math.ceil(total / each)), *by)


def cut_blocks(df: DataFrame, keys, ids: str, features: str | Column, numbers=NUMBERS, rows=1024, most=MOST_ROWS) -> DataFrame:
    """Add ``_block`` and ``_blocks`` (how many the group has), by hash of the id.

    A row is sent once per block of its group, so blocks are as large as a task
    may hold (``numbers``, ``most`` rows). Below that all groups together are cut
    into about two pairs of blocks a task, each in proportion to its rows, and
    none into blocks of less than ``rows``. ``features`` is the vector or a column
    that says what a row weighs in components."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, size = F.count(F.lit(1)), F.sum(F.size(features) if isinstance(features, str) else features)
    sizes = df.withColumn("_all", F.lit(1)).groupBy("_all", *keys).agg(n.alias("_n"), size.alias("_size"))
    whole = sizes.groupBy("_all").agg(F.sqrt(F.sum(F.col("_n").cast("double") * F.col("_n"))).alias("_norm"))
    side = F.ceil(math.sqrt(4 * tasks) * F.col("_n") / F.col("_norm"))
    wanted = F.greatest(F.lit(1), F.ceil(F.col("_size") / numbers), F.ceil(F.col("_n") / most), F.least(F.ceil(F.col("_n") / rows), side)).cast("int")
    counts = sizes.join(F.broadcast(whole), "_all").select("_all", *[c for c in keys if c != "_all"], wanted.alias("_blocks"))  # ``whole`` is one row
    counts = counts if "_all" in keys else counts.drop("_all")
    return join_same_key(df, counts, keys).withColumn("_block", F.pmod(F.xxhash64(ids), F.col("_blocks")).cast("int"))


def pair_blocks(rows: DataFrame, keys, work, schema, chosen: DataFrame | None = None) -> DataFrame:
    """``work(left, right)`` for every unordered pair of blocks of a group;
    ``right`` is None where a block meets itself. ``rows`` come from
    ``cut_blocks``. With ``chosen`` (keys, _bi, _bj) only those pairs of
    different blocks meet."""
    keys = list(keys)
    by = [*keys, "_bi", "_bj"]
    if chosen is None:
        rows = durable(rows)  # both sides read it
        left = rows.withColumn("_bi", F.col("_block")).withColumn("_bj", F.explode(F.sequence(F.col("_block"), F.col("_blocks") - 1)))
        right = rows.filter("_block > 0").withColumn("_bj", F.col("_block")).withColumn("_bi", F.explode(F.sequence(F.lit(0), F.col("_block") - 1)))
    else:
        left = join_same_key(rows.withColumn("_bi", F.col("_block")), chosen.select(*by), [*keys, "_bi"])
        right = join_same_key(rows.withColumn("_bj", F.col("_block")), chosen.select(*by), [*keys, "_bj"])

    def run(a, b):
        if a.num_rows and a.column("_bi")[0] == a.column("_bj")[0]:
            return work(a, None)
        return work(a, b) if a.num_rows and b.num_rows else work(a.slice(0, 0), None)

    names = [c for c in rows.columns if c not in by]
    right = right.select(*[F.col(c).alias(c) for c in [*by, *names]])  # columns of its own: both sides are one table
    return left.select(*by, *names).groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, schema)
