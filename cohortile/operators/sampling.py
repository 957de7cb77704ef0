"""Top-k, quotas, repeatable samples and grid placement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scaling import percentile_score
from ..plans.blocks import TASK_ROWS, spread
from ..plans.draws import hash_take, order_hash
from ..session import durable


GROUP_LIMIT = 1000  # up to this k Spark limits each partition before the shuffle
SALTS = 64


def top_k(df: DataFrame, keys, score: str, k: int, ties=("tile_idx",), lowest=False) -> DataFrame:
    """The k best rows per key. Spark limits each partition to k rows per key
    before the shuffle, so a hot key sends k rows per task, not all of them.
    For a larger k the same is done by hand: k rows per salted part of the key,
    then k of those."""
    order = F.col(score).asc() if lowest else F.col(score).desc()

    def best(rows, by):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(order, *ties))
        return rows.withColumn("rank", rank).filter(F.col("rank") <= k)

    if k > GROUP_LIMIT:
        salt = F.pmod(F.xxhash64(F.col(score), *[F.col(t) for t in ties]), F.lit(SALTS))
        df = best(df.withColumn("_salt", salt), [*keys, "_salt"]).drop("rank", "_salt")
    return best(df, keys)


def bottom_k_padded(df: DataFrame, key: str, score: str, k: int, features: str, dim: int, ties=("tile_idx",)) -> DataFrame:
    """The k lowest-scored rows per key as ranks 1..k; missing ranks hold zero vectors."""
    low = top_k(df, [key], score, k, ties, lowest=True).select(key, "rank", features)
    slots = df.select(key).distinct().select(key, F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    zeros = F.array_repeat(F.lit(0.0), dim)
    return slots.join(low, [key, "rank"], "left").select(
        key, "rank", F.col(features).isNull().alias("padded"),
        F.coalesce(F.col(features).cast("array<double>"), zeros).alias(features))


def fraction_per_group(df: DataFrame, keys, ids, frac=0.1, seed=42) -> DataFrame:
    """max(1, int(n * frac)) rows per group without replacement."""
    return hash_take(df, keys, [*ids, seed], list(ids), lambda n: F.greatest(F.lit(1), F.floor(n * frac)))


def sample_total(df: DataFrame, ids, n: int, seed=42, keys=()) -> DataFrame:
    """Up to n rows per key (or in all), without replacement."""
    return hash_take(df, keys, [*ids, seed], list(ids), n)


def sample_names(df: DataFrame, name: str, n: int, seed=42) -> DataFrame:
    """n distinct names, sorted; n <= 0 keeps all."""
    names = df.select(name).distinct()
    return (names if n <= 0 else hash_take(names, [], [name, seed], [name], n)).orderBy(name)


def location_sample(df: DataFrame, key: str, ids, limit: int, bins=(32, 32), seed=42) -> DataFrame:
    """At most one row per spatial bin and at most ``limit`` per key; keys with
    no more than ``limit`` rows stay whole.

    Rows are dealt to tasks by key; if one key has more than a task is dealt,
    they are dealt by key and bin."""
    size = durable(df.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.min("x").alias("_x0"), F.max("x").alias("_x1"),
        F.min("y").alias("_y0"), F.max("y").alias("_y1")))
    total, most = size.agg(F.sum("_n"), F.max("_n")).first()
    hot = (most or 0) > TASK_ROWS
    j = (df if hot else spread(df, None, [key], total=total or 0)).join(size, key)

    def bin_of(v, lo, hi, b):
        unit = (F.col(v) - F.col(lo)) / F.greatest((F.col(hi) - F.col(lo)).cast("double"), F.lit(1.0))
        return F.least(F.lit(b - 1), F.floor(unit * b))

    binned = j.select(
        *df.columns, "_n", bin_of("x", "_x0", "_x1", bins[0]).alias("_bx"), bin_of("y", "_y0", "_y1", bins[1]).alias("_by"),
        order_hash(*ids, seed).alias("_h"))
    if hot:
        binned = spread(binned, None, [key, "_bx", "_by"], total=total)
    whole = binned.filter(F.col("_n") <= limit).select(*df.columns)
    row = F.struct(*df.columns).alias("_row")
    one = (
        binned.filter(F.col("_n") > limit).select(key, "_bx", "_by", "_h", *[F.col(i).alias(f"_t{k}") for k, i in enumerate(ids)], row)
        .groupBy(key, "_bx", "_by").agg(F.min_by(F.struct("_h", "_row"), F.struct("_h", *[f"_t{k}" for k in range(len(ids))])).alias("_b"))
    )
    # at most bins_x * bins_y rows per key are left
    pos = F.row_number().over(Window.partitionBy(key).orderBy("_b._h"))
    return whole.unionByName(one.withColumn("_i", pos).filter(F.col("_i") <= limit).select("_b._row.*"))


def largest_remainder_quota(counts: DataFrame, target: int, scope: str, key: str, n="n") -> DataFrame:
    """Split ``target`` over the groups of a scope in proportion to their counts:
    floors, then the largest fractions, clip to what is there, then top up from
    the groups with most left. ``counts`` is one row per group."""
    w = Window.partitionBy(scope)
    c, tot = F.col(n), F.col("_tot")
    a = counts.withColumn("_tot", F.sum(n).over(w)).withColumn("_raw", (c / tot) * F.lit(target))
    a = a.withColumn("_base", F.floor("_raw")).withColumn("_frac", F.col("_raw") - F.col("_base"))
    rest = F.lit(target) - F.sum("_base").over(w)
    extra = F.row_number().over(w.orderBy(F.col("_frac").desc(), key)) <= rest
    a = a.withColumn("_q", F.least(F.col("_base") + extra.cast("long"), c))
    a = a.withColumn("_short", F.lit(target) - F.sum("_q").over(w)).withColumn("_left", c - F.col("_q"))
    before = w.orderBy(F.col("_left").desc(), key).rowsBetween(Window.unboundedPreceding, -1)
    given = F.least(F.col("_left"), F.greatest(F.lit(0), F.col("_short") - F.coalesce(F.sum("_left").over(before), F.lit(0))))
    a = a.withColumn("_more", given)
    quota = F.when(tot <= target, c).otherwise(F.col("_q") + F.col("_more"))
    return a.select(scope, key, n, quota.cast("long").alias("quota"))


def quota_sample(df: DataFrame, quotas: DataFrame, key: str, ids, seed=42) -> DataFrame:
    """The quota of each group, drawn without replacement."""
    j = df.join(quotas.select(key, "quota"), key)
    return hash_take(j, [key], [*ids, seed], list(ids), F.col("quota")).drop("quota")


def sample_by_score(df: DataFrame, key: str, score: str, k: int, mode="top", start=0.0, end=1.0,
                    ties=("tile_idx",), seed=42) -> DataFrame:
    """k rows per key whose percentile lies in [start, end]: highest, lowest or
    drawn by hash (``range``)."""
    inside = percentile_score(df, [key], score, "percentile").filter(F.col("percentile").between(start, end))
    if mode == "range":
        return hash_take(inside, [key], [*ties, seed], list(ties), k)
    return top_k(inside, [key], score, k, ties, lowest=mode == "bottom").drop("rank")


def random_centers(pixels: DataFrame, key: str, n: int, scale_x: float, scale_y: float, seed=42) -> DataFrame:
    """n distinct mask pixels per key as level-0 centres."""
    got = hash_take(pixels.select(key, "px", "py").distinct(), [key], [key, "px", "py", seed], ["px", "py"], n)
    return got.select(key, ((F.col("px") + 0.5) * scale_x).alias("cx"), ((F.col("py") + 0.5) * scale_y).alias("cy"))


def unit_cell(x, y, rows: int, cols: int):
    """(row, column) of a point of the unit square."""
    r = F.least(F.lit(rows - 1), F.greatest(F.lit(0), F.floor(F.col(y) * rows)))
    c = F.least(F.lit(cols - 1), F.greatest(F.lit(0), F.floor(F.col(x) * cols)))
    return r.cast("int").alias("r"), c.cast("int").alias("c")


def grid_direct(df: DataFrame, keys, ids, rows: int, cols: int, x="x01", y="y01", seed=42) -> DataFrame:
    """One row per occupied cell: the only one; one of two by hash; else the one
    nearest the cell centre. A single aggregate, whatever the cell sizes."""
    keys = list(keys)
    r, c = unit_cell(x, y, rows, cols)
    p = df.withColumns({"r": r, "c": c})
    dx, dy = F.col(x) - (F.col("c") + 0.5) / cols, F.col(y) - (F.col("r") + 0.5) / rows
    row = F.struct(*[i for i in df.columns if i not in keys])
    agg = p.withColumns({"_d": dx * dx + dy * dy, "_h": order_hash(*ids, seed)}).groupBy(*keys, "r", "c").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.min_by(row, F.struct("_h", *ids)).alias("_by_hash"), F.min_by(row, F.struct("_d", *ids)).alias("_by_dist"))
    pick = F.when(F.col("n_points") == 2, F.col("_by_hash")).otherwise(F.col("_by_dist"))
    out = agg.withColumn("_p", pick)
    return out.select(*keys, "r", "c", "n_points", *[F.col(f"_p.{i}").alias(i) for i in df.columns if i not in keys])


def occupancy(df: DataFrame, keys, rows: int, cols: int, label="class", x="x01", y="y01") -> DataFrame:
    """Per cell: points of class 1 and 0 and which has the majority."""
    r, c = unit_cell(x, y, rows, cols)
    n1, n0 = F.sum((F.col(label) == 1).cast("long")), F.sum((F.col(label) == 0).cast("long"))
    return df.groupBy(*keys, r, c).agg(n1.alias("n_pos"), n0.alias("n_neg")).withColumn(
        "majority", F.when(F.col("n_pos") > F.col("n_neg"), "pos").when(F.col("n_pos") < F.col("n_neg"), "neg").otherwise("mixed"))


def top_k_classes(df: DataFrame, keep, probs: str, k: int) -> DataFrame:
    """``Pred_i`` and ``p_i`` columns by falling probability; no shuffle."""
    ranked = F.array_sort(F.transform(probs, lambda p, i: F.struct((-p).alias("n"), i.alias("i"))))
    cols = []
    for j in range(k):
        cols += [F.get("_r", F.lit(j))["i"].alias(f"Pred_{j}"), (-F.get("_r", F.lit(j))["n"]).alias(f"p_{j}")]
    return df.select(*keep, ranked.alias("_r")).select(*keep, *cols)
