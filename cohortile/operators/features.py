"""Feature selection, provenance and importance roll-ups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pvalues import t_pvalue, z_pvalue
from ..plans.gram import keyed_gram
from ..plans.ordered import running_sums
from ..session import durable, join_same_key

METHODS = ("spearman", "pearson")


def feature_values(df: DataFrame, keys, features: str, extra=()) -> DataFrame:
    """Long (keys, extra, feature, value)."""
    return df.select(*keys, *extra, F.posexplode(features).alias("feature", "value"))


def value_counts(df: DataFrame, keys, features: str, cls: str) -> DataFrame:
    """Per (keys, feature, value): rows of class 1 (``pos``) and of the rest.
    Distinct counts, ranks and rank sums all follow from this table, so the
    exploded values are shuffled once."""
    v = F.col("value").cast("double")
    clean = F.when(~F.isnan(v), v)
    return feature_values(df, keys, features, [cls]).withColumn("value", clean).groupBy(*keys, "feature", "value").agg(
        F.sum((F.col(cls) == 1).cast("long")).alias("pos"), F.sum((F.col(cls) != 1).cast("long")).alias("neg"))


def column_filter(counts: DataFrame, keys) -> DataFrame:
    """Features without a missing value and with more than floor(0.1 n)
    distinct values."""
    n = F.sum(F.col("pos") + F.col("neg"))
    gaps = F.sum(F.when(F.col("value").isNull(), F.col("pos") + F.col("neg")).otherwise(0))
    s = counts.groupBy(*keys, "feature").agg(n.alias("n"), gaps.alias("missing"), F.count("value").alias("distinct_values"))
    return s.filter((F.col("missing") == 0) & (F.col("distinct_values") > F.floor(F.col("n") * F.lit(0.1)))).select(
        *keys, "feature", "n", "distinct_values")


def t_statistics(df: DataFrame, keys, features: str, cls: str, welch=False) -> DataFrame:
    """Two-sample t per feature, class 1 against the other, from one vector
    aggregate per class."""
    keys = list(keys)
    rows = df.select(*keys, (F.col(cls) == 1).alias("_one"), array_to_vector(F.col(features).cast("array<double>")).alias("_v"))
    per = rows.groupBy(*keys, "_one").agg(Summarizer.metrics("count", "mean", "variance").summary(F.col("_v")).alias("_s"))
    long = per.select(*keys, "_one", F.col("_s.count").cast("double").alias("n"), F.posexplode(F.arrays_zip(
        vector_to_array(F.col("_s.mean")).alias("m"), vector_to_array(F.col("_s.variance")).alias("v"))).alias("feature", "z"))

    def of(flag, c):
        return F.max(F.when(F.col("_one") == flag, F.col(c)))

    s = long.select(*keys, "_one", "n", "feature", F.col("z.m").alias("m"), F.col("z.v").alias("v")).groupBy(*keys, "feature").agg(
        of(True, "n").alias("n1"), of(False, "n").alias("n0"), of(True, "m").alias("m1"), of(False, "m").alias("m0"),
        of(True, "v").alias("v1"), of(False, "v").alias("v0"))
    n1, n0, v1, v0 = (F.col(c) for c in ["n1", "n0", "v1", "v0"])
    if welch:
        a, b = v1 / n1, v0 / n0
        se2, dof = a + b, (a + b) * (a + b) / F.nullif(a * a / F.nullif(n1 - 1, F.lit(0.0)) + b * b / F.nullif(n0 - 1, F.lit(0.0)), F.lit(0.0))
    else:
        dof = n1 + n0 - 2
        se2 = ((n1 - 1) * v1 + (n0 - 1) * v0) / F.nullif(dof, F.lit(0.0)) * (1 / n1 + 1 / n0)
    return s.select(*keys, "feature", ((F.col("m1") - F.col("m0")) / F.nullif(F.sqrt(se2), F.lit(0.0))).alias("statistic"), dof.alias("dof"))


def rank_sum_statistics(counts: DataFrame, keys) -> DataFrame:
    """z of the rank sum of class 1 per feature, without corrections."""
    keys = [*keys, "feature"]
    rows = counts.filter(F.col("value").isNotNull()).withColumn("_t", F.col("pos") + F.col("neg"))
    placed = running_sums(rows, keys, "value", {"_t": "_below"}, {"pos": "n1", "neg": "n0"})
    rank = F.col("_below") + (F.col("_t") + 1) / 2.0
    s = placed.groupBy(*keys).agg(F.sum(F.col("pos") * rank).alias("w"), F.max("n1").cast("double").alias("n1"), F.max("n0").cast("double").alias("n0"))
    n1, n0 = F.col("n1"), F.col("n0")
    z = (F.col("w") - n1 * (n1 + n0 + 1) / 2) / F.nullif(F.sqrt(n1 * n0 * (n1 + n0 + 1) / 12), F.lit(0.0))
    return s.select(*keys, z.alias("statistic"))


def feature_pvalues(df: DataFrame, keys, features: str, cls: str, test="ranksum", counts=None) -> DataFrame:
    """(keys, feature, statistic, p_value); undefined p-values are dropped.
    ``test``: ranksum, t (equal variances) or welch."""
    if test == "ranksum":
        counts = value_counts(df, keys, features, cls) if counts is None else counts
        s = rank_sum_statistics(counts, keys).withColumn("p_value", z_pvalue("statistic"))
    else:
        s = t_statistics(df, keys, features, cls, test == "welch").withColumn("p_value", t_pvalue("statistic", "dof")).drop("dof")
    return s.filter(F.col("p_value").isNotNull() & ~F.isnan("p_value"))


def rank_vectors(df: DataFrame, keys, ids: str, features: str) -> DataFrame:
    """Replace every feature by its average rank inside the key."""
    keys = list(keys)
    long = feature_values(df, keys, features, [ids]).withColumn("value", F.col("value").cast("double"))
    counts = long.groupBy(*keys, "feature", "value").agg(F.count(F.lit(1)).alias("_t"))
    placed = running_sums(counts, [*keys, "feature"], "value", {"_t": "_below"})
    rank = placed.select(*keys, "feature", "value", (F.col("_below") + (F.col("_t") + 1) / 2.0).alias("_rank"))
    back = long.join(rank, keys + ["feature", "value"]).groupBy(*keys, ids).agg(
        F.array_sort(F.collect_list(F.struct("feature", "_rank"))).alias("_r"))
    return back.select(*keys, ids, F.transform("_r", lambda r: r["_rank"]).alias(features))


def abs_correlation(df: DataFrame, keys, ids: str, features: str, method="spearman") -> DataFrame:
    """Rows (keys, feature, corr array) of the absolute correlation matrix; a
    constant feature has null correlations."""
    keys = list(keys)
    src = rank_vectors(df, keys, ids, features) if method == "spearman" else df
    gram = keyed_gram(src, keys, features)
    n = "_n"
    first = gram.filter("i = 0").select(*keys, F.col("row").alias("_top"))
    diag = gram.filter("i > 0").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", F.get("row", F.col("i")).alias("d")))).alias("_diag"))
    # one row of D numbers per key
    side = first.join(diag, keys).withColumn(n, F.col("_top")[0]).select(
        *keys, "_top", n, F.transform("_diag", lambda d: d["d"]).alias("_diag"))
    var = lambda sq, s: sq - s * s / F.col(n)
    j = gram.filter("i > 0").join(side, keys).select(
        *keys, (F.col("i") - 1).alias("feature"), n, F.slice("row", 2, F.size("row") - 1).alias("_g"), F.slice("_top", 2, F.size("_top") - 1).alias("_s"), "_diag",
        F.get("_top", F.col("i")).alias("_si"), F.get("_diag", F.col("i") - 1).alias("_di"))
    sd = lambda q, s: F.sqrt(F.greatest(var(q, s), F.lit(0.0)))
    floor = 1e-12 * F.col(n)

    def corr(g, qs):
        cov = g - F.col("_si") * qs["s"] / F.col(n)
        den = sd(F.col("_di"), F.col("_si")) * sd(qs["q"], qs["s"])
        return F.when(den > floor, F.least(F.abs(cov / F.nullif(den, F.lit(0.0))), F.lit(1.0)))

    zipped = F.zip_with("_diag", "_s", lambda q, s: F.struct(q.alias("q"), s.alias("s")))
    return j.select(*keys, "feature", F.zip_with("_g", zipped, corr).alias("corr"))


#: correlated pairs of a key that one task settles; larger keys go by rounds
TASK_EDGES = 4_000_000


def correlated_pairs(corr: DataFrame, keys, least) -> DataFrame:
    """(keys, a, b, r) above ``least``, and one row with b = -1 for every feature a."""
    above = F.filter(F.transform("corr", lambda c, i: F.struct(i.alias("b"), c.alias("r"))), lambda x: x["r"] > least)
    here = F.array(F.struct(F.lit(-1).alias("b"), F.lit(None).cast("double").alias("r")))
    rows = corr.select(*keys, F.col("feature").alias("a"), F.explode(F.concat(above, here)).alias("_n"))
    return rows.select(*keys, "a", "_n.b", "_n.r").filter("a != b")


def greedy_uncorrelated(pvals: DataFrame, corr: DataFrame, keys, thresholds, max_features=None, task_edges=TASK_EDGES) -> DataFrame:
    """Per (keys, threshold): take the smallest p, drop everything whose absolute
    correlation with it is above the threshold (strictly), repeat. ``thresholds``
    is a list, or the name of a key column that holds the threshold.

    Only pairs above the threshold are kept of the matrix. A key with at most
    ``task_edges`` of them is settled by one task in order of p; larger ones by
    rounds of joins, in which a feature is taken once every better correlated
    one is dropped, and dropped once one of them is taken. Both give the same.
    """
    keys = list(keys)
    own = isinstance(thresholds, str)
    values = None if own else [float(t) for t in thresholds]
    if values and not all(0 <= t <= 1 for t in values):
        raise ValueError(f"thresholds must lie between 0 and 1, found {values}")
    threshold = thresholds if own else "threshold"
    by = list(keys) if own else [*keys, threshold]
    pairs = durable(correlated_pairs(corr, keys, F.col(threshold) if own else F.lit(min(values, default=0.0))))
    nodes = pvals.select(*keys, F.col("feature").cast("int").alias("feature"), "p_value")
    nodes = join_same_key(nodes, pairs.filter("b = -1").select(*keys, F.col("a").alias("feature")), [*keys, "feature"])
    if not own:
        nodes = nodes.withColumn(threshold, F.explode(F.array(*[F.lit(t) for t in values])))
    nodes = durable(nodes.select(*by, "feature", "p_value"))
    one = nodes.select(*by, F.col("feature").alias("a"), F.col("p_value").alias("_pa"))
    two = nodes.select(*by, F.col("feature").alias("b"), F.col("p_value").alias("_pb"))
    met = join_same_key(join_same_key(pairs.filter("b >= 0"), one, [*keys, "a"]), two, [*by, "b"])
    first = (F.col("_pa") < F.col("_pb")) | ((F.col("_pa") == F.col("_pb")) & (F.col("a") < F.col("b")))
    edges = durable(met.filter((F.col("r") > F.col(threshold)) & first).select(*by, "a", "b"))
    large, rounds = None, edges.count() > task_edges  # a count of file footers
    if rounds:
        large = durable(edges.groupBy(*by).agg(F.count(F.lit(1)).alias("_edges")).filter(F.col("_edges") > task_edges).select(*by))
        rounds = large.count() > 0

    def without(t):
        if not rounds:
            return t
        same = [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in by]
        return t.join(large.select(*[F.col(c).alias(f"_key_{c}") for c in by]), same, "left_anti")

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        f, p = left.column("feature").to_numpy(), left.column("p_value").to_numpy()
        order = np.lexsort((f, p))
        place = np.empty(int(f.max(initial=0)) + 1, np.int64)
        place[f[order]] = np.arange(len(f))
        a, b = place[right.column("a").to_numpy()], place[right.column("b").to_numpy()]
        sort = np.argsort(a, kind="stable")
        b, at = b[sort], np.searchsorted(a[sort], np.arange(len(f) + 1))
        alive, got = np.ones(len(f), bool), []
        for j in range(len(f)):
            if alive[j]:
                if max_features is not None and len(got) >= max_features:
                    break
                got.append(order[j])
                alive[b[at[j]:at[j + 1]]] = False
        return left.select([*by, "feature", "p_value"]).take(pa.array(sorted(got), pa.int64()))

    kinds = "".join(f"`{c}` {nodes.schema[c].dataType.simpleString()}, " for c in by)
    schema = f"{kinds}feature int, p_value double"
    group = ["_all", *by]
    left, right = without(nodes).withColumn("_all", F.lit(1)), without(edges).withColumn("_all", F.lit(1))
    picked = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(scan, schema)
    if not rounds:
        return picked
    slow = _greedy_rounds(join_same_key(nodes, large, by), join_same_key(edges, large, by), by)
    if max_features is not None:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("p_value", "feature"))
        slow = slow.withColumn("_i", rank).filter(F.col("_i") <= max_features).drop("_i")
    return picked.unionByName(slow.select(*picked.columns))


def _greedy_rounds(nodes: DataFrame, edges: DataFrame, by) -> DataFrame:
    """The taken nodes of every key, all keys in the same rounds."""
    taken, open_ = None, durable(nodes.select(*by, "feature", "p_value"))
    edges = durable(edges)
    while open_.limit(1).count():
        worse = edges.select(*by, F.col("b").alias("feature")).distinct().withColumn("_worse", F.lit(1))
        now = durable(join_same_key(open_, worse, [*by, "feature"], "left").filter("_worse is null").drop("_worse"))
        taken = now if taken is None else taken.unionByName(now)
        hit = join_same_key(edges, now.select(*by, F.col("feature").alias("a")), [*by, "a"])
        gone = durable(now.select(*by, "feature").union(hit.select(*by, F.col("b").alias("feature"))).distinct().withColumn("_gone", F.lit(1)))

        def left(t, name):
            out = join_same_key(t, gone.withColumnRenamed("feature", name), [*by, name], "left")
            return out.filter("_gone is null").drop("_gone")

        open_ = durable(left(open_, "feature"))
        # what a dropped feature would have dropped stays, and taken ones have no open pairs left
        edges = durable(left(left(edges, "a"), "b"))
    return taken


def check_classes(df: DataFrame, cls: str) -> DataFrame:
    """Classes must be -1 or 1; any other value stops the job."""
    bad = F.raise_error(F.concat(F.lit("class labels must be -1 or 1, found "), F.coalesce(F.col(cls).cast("string"), F.lit("null"))))
    return df.withColumn(cls, F.when(F.col(cls).isin(-1, 1), F.col(cls)).otherwise(bad.cast("int")))


def whole_columns(df: DataFrame, keys, features: str) -> DataFrame:
    """(keys, kept): the positions, per key, that hold a number in every row.
    Counts per key and position are summed before the shuffle."""
    v = F.col("value").cast("double")
    gaps = feature_values(df, keys, features).groupBy(*keys, "feature").agg(
        F.sum((v.isNull() | F.isnan(v)).cast("long")).alias("_gaps"), F.count(F.lit(1)).alias("_rows"))
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    full = gaps.join(rows, keys).filter("_gaps = 0 and _rows = _all")
    return full.groupBy(*keys).agg(F.array_sort(F.collect_list("feature")).alias("kept"))


def select_features(df: DataFrame, keys, ids: str, features: str, cls: str, thresholds, method="pearson",
                    test=None, max_features=None, quality_filter=False) -> DataFrame:
    """p-values, correlation and greedy pick in one go.

    A feature with a missing value in any row of its key is dropped first and
    the rest goes on. ``quality_filter`` also drops features with at most
    floor(0.1 n) distinct values. ``method`` is pearson or spearman, ``test``
    t (the default with pearson), welch or ranksum (with spearman).
    """
    keys, method = list(keys), method.lower()
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}, expected one of {METHODS}")
    test = test or ("ranksum" if method == "spearman" else "t")
    rows = check_classes(df.select(*keys, ids, features, cls), cls)
    kept = durable(whole_columns(rows, keys, features))
    cut = rows.join(kept, keys).withColumn(features, pick_features(F.col(features), F.col("kept"))).drop("kept")
    cut = durable(cut.filter(F.size(features) > 0))
    counts = durable(value_counts(cut, keys, features, cls)) if quality_filter or test == "ranksum" else None
    p = feature_pvalues(cut, keys, features, cls, test, counts)
    if quality_filter:
        p = p.join(column_filter(counts, keys).select(*keys, "feature"), [*keys, "feature"], "left_semi")
    picked = greedy_uncorrelated(p, abs_correlation(cut, keys, ids, features, method), keys, thresholds, max_features)
    return picked.join(kept, keys).withColumn("feature", F.get("kept", F.col("feature")).cast("int")).select(*picked.columns)


# --- combining models ------------------------------------------------------------------
def keep_lists(selected: DataFrame, keys) -> DataFrame:
    return selected.groupBy(*keys).agg(F.array_sort(F.collect_list("feature")).alias("keep"))


def pick_features(features, keep):
    """Listed columns of a vector, in the order of the list."""
    return F.transform(keep, lambda i: F.get(features, i))


def concat_models(df: DataFrame, keys, features: str, n_models: int, model="model", out="features") -> DataFrame:
    """Vectors joined in model-name order; objects not all models have are left
    out. The join is on the object's key, not on row order."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(model, F.col(features).alias("_f")))).alias("_p"))
    return rows.filter(F.size("_p") == n_models).select(*keys, F.flatten(F.transform("_p", lambda p: p["_f"])).alias(out))


def feature_sources(keeps: DataFrame, keys, model="model") -> DataFrame:
    """(keys, pos, model, feature_index): where each joined column came from."""
    rows = keeps.select(*keys, model, F.posexplode("keep").alias("_i", "feature_index"))
    # a few thousand features per key
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy(model, "_i")) - 1
    return rows.select(*keys, pos.alias("pos"), model, "feature_index")


def two_stage_prune(tiles: DataFrame, labels: DataFrame, thresholds, top_k=100, score=None, align="coord",
                    method="pearson", test=None, coords=("slide_id", "x", "y"), ties=("tile_idx",), quality_filter=False):
    """Stage 1 prunes each model, stage 2 the joined survivors, per threshold.
    By default a t test and Pearson correlation; ``test="welch"`` for slides.

    ``labels`` holds (slide_id, class in -1/1). With ``score`` only each
    slide's ``top_k`` tiles per model take part. ``align="coord"`` joins
    models on the tile's coordinates, ``"rank"`` on its rank by score.
    Returns (sources, report, stage 1 sources).
    """
    from .sampling import top_k as best
    # the best tiles first: after the join its exchange would serve the window and a large slide meet in one task
    rows = tiles if score is None else best(tiles, ["model", "slide_id"], score, top_k, ties)
    rows = rows.join(labels.select("slide_id", "class"), "slide_id")
    on = list(coords) if align == "coord" else ["slide_id", "rank"]
    rows = durable(rows.withColumn("_id", F.concat_ws("|", *on)).select("model", "_id", "class", "features", *on))
    one = durable(select_features(rows, ["model"], "_id", "features", "class", thresholds, method, test, quality_filter=quality_filter))
    keeps = keep_lists(one, ["threshold", "model"])
    n_models = [r[0] for r in rows.select("model").distinct().sort("model").collect()]
    cut = rows.join(F.broadcast(keeps), "model").select(  # a few thousand indices per model
        "threshold", "model", "_id", "class", pick_features(F.col("features"), F.col("keep")).alias("features"))
    joined = concat_models(cut, ["threshold", "_id", "class"], "features", len(n_models))
    two = select_features(joined, ["threshold"], "_id", "features", "class", "threshold", method, test, quality_filter=quality_filter)
    stage1 = feature_sources(keeps, ["threshold"])
    sources = stage1.join(two.select("threshold", F.col("feature").alias("pos"), "p_value"), ["threshold", "pos"])
    dims = rows.groupBy("model").agg(F.max(F.size("features")).alias("dim"))
    return sources, pruning_report(stage1, sources, dims), stage1


def pruning_report(stage1: DataFrame, stage2: DataFrame, dims: DataFrame) -> DataFrame:
    """Features removed per (threshold, model) in each stage."""
    a = stage1.groupBy("threshold", "model").agg(F.count(F.lit(1)).alias("_k1"))
    b = stage2.groupBy("threshold", "model").agg(F.count(F.lit(1)).alias("_k2"))
    return a.join(dims, "model").join(b, ["threshold", "model"], "left").select(
        "threshold", "model", (F.col("dim") - F.col("_k1")).alias("removed_stage1"),
        (F.col("_k1") - F.coalesce("_k2", F.lit(0))).alias("removed_stage2"))


def apply_pruning(tiles: DataFrame, sources: DataFrame, keys=("slide_id", "x", "y")) -> DataFrame:
    """Pruned, joined vectors per threshold from the provenance rows."""
    keeps = sources.groupBy("threshold", "model").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "feature_index"))), lambda s: s["feature_index"]).alias("keep"))
    n = keeps.groupBy("threshold").agg(F.count(F.lit(1)).alias("_n"))
    cut = tiles.join(F.broadcast(keeps.join(n, "threshold")), "model").withColumn("_f", pick_features(F.col("features"), F.col("keep")))
    rows = cut.groupBy("threshold", *keys).agg(F.max("_n").alias("_n"), F.array_sort(F.collect_list(F.struct("model", "_f"))).alias("_p"))
    return rows.filter(F.size("_p") == F.col("_n")).select("threshold", *keys, F.flatten(F.transform("_p", lambda p: p["_f"])).alias("features"))


# --- stability ---------------------------------------------------------------------------
def stability_filter(stability: DataFrame, train: DataFrame, metric: str, category="overall", direction="high",
                     percentile=80.0, soft=False) -> DataFrame:
    """Mask (or weight) per feature from its mean over training slides only.
    ``high`` keeps means at or above the percentile, ``low`` at or below the
    mirrored one. The soft weight is the min-max scaled mean."""
    use = stability.filter((F.col("metric") == metric) & (F.col("category") == category)).join(
        train.select("slide_id").distinct(), "slide_id", "left_semi")
    avg = use.groupBy("model", "feature_index").agg(F.avg("value").alias("mean"))
    p = percentile / 100.0 if direction == "high" else 1 - percentile / 100.0
    edge = avg.groupBy("model").agg(F.percentile("mean", F.lit(p)).alias("_e"), F.min("mean").alias("_mn"), F.max("mean").alias("_mx"))
    keep = F.col("mean") >= F.col("_e") if direction == "high" else F.col("mean") <= F.col("_e")
    unit = F.coalesce((F.col("mean") - F.col("_mn")) / F.nullif(F.col("_mx") - F.col("_mn"), F.lit(0.0)), F.lit(1.0))
    weight = unit if direction == "high" else 1 - unit
    return avg.join(edge, "model").select(
        "model", "feature_index", "mean", keep.alias("keep"), (weight if soft else keep.cast("double")).alias("weight"))


# --- importance -----------------------------------------------------------------------------
def unified_feature_index(sources: DataFrame, order, dims: dict | None = None) -> DataFrame:
    """(model, dim, offset): each model's first slot in one shared index. The
    dimension is the registered one, raised when an index exceeds it."""
    seen = sources.groupBy("model").agg((F.max("feature_index") + 1).cast("long").alias("_seen"))
    rank = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    base = F.lit(0)
    for m, d in (dims or {}).items():
        base = F.when(F.col("model") == m, F.lit(d)).otherwise(base)
    a = seen.withColumn("dim", F.greatest("_seen", base.cast("long"))).withColumn("_o", rank)
    # one row per model
    before = Window.partitionBy(F.lit(1)).orderBy("_o", "model").rowsBetween(Window.unboundedPreceding, -1)
    return a.select("model", "dim", F.coalesce(F.sum("dim").over(before), F.lit(0)).alias("offset"))


def unified_sources(sources: DataFrame, index: DataFrame) -> DataFrame:
    return sources.join(F.broadcast(index.select("model", "offset")), "model").withColumn("idx", F.col("offset") + F.col("feature_index"))


def common_features(unified: DataFrame, n_diseases: int) -> DataFrame:
    """Per threshold: shared-index features selected for every disease."""
    return unified.groupBy("threshold", "idx").agg(F.count_distinct("disease").alias("_d")).filter(
        F.col("_d") == n_diseases).select("threshold", "idx")


def mean_abs_attribution(values: DataFrame, unified: DataFrame, by=("disease", "threshold")) -> DataFrame:
    """Absolute values, mean over a slide's samples, mean over the slides that
    have the position, placed at the shared index."""
    by = list(by)
    per_slide = values.select(*by, "slide_id", F.posexplode("values").alias("pos", "v")).groupBy(*by, "slide_id", "pos").agg(
        F.avg(F.abs(F.col("v").cast("double"))).alias("a"))
    mean = per_slide.groupBy(*by, "pos").agg(F.avg("a").alias("importance"), F.count(F.lit(1)).alias("slides"))
    return unified.select(*by, "pos", "model", "feature_index", "idx").join(mean, [*by, "pos"], "left").withColumn(
        "importance", F.coalesce("importance", F.lit(0.0)))


def global_importance(values: DataFrame, keys, col="values") -> DataFrame:
    """Mean absolute value per position over all rows: a vector aggregate."""
    v = array_to_vector(F.col(col).cast("array<double>"))
    s = values.groupBy(*keys).agg(Summarizer.metrics("normL1", "count").summary(v).alias("_s"))
    return s.select(*keys, F.posexplode(vector_to_array(F.col("_s.normL1"))).alias("pos", "_a"), F.col("_s.count").alias("_c")).select(
        *keys, "pos", (F.col("_a") / F.col("_c")).alias("importance"))


def pruning_percentages(counts: DataFrame, models, original="OG Features") -> DataFrame:
    """From the wide count table: each model's share of what a threshold keeps
    and the kept total over the original total."""
    long = counts.unpivot(["Threshold"], list(models), "model", "retained").filter(F.col("retained").isNotNull())
    total = long.groupBy("Threshold").agg(F.sum("retained").alias("_t"))
    # one row per threshold
    og = F.max(F.when(F.col("Threshold") == original, F.col("_t"))).over(Window.partitionBy(F.lit(1)))
    need = F.coalesce(og, F.raise_error(F.lit(f"row {original!r} is missing")).cast("long"))
    t = total.withColumn("_og", need).select("Threshold", "_t", (100.0 * F.col("_t") / F.col("_og")).alias("total_pct"))
    return long.filter(F.col("Threshold") != original).join(t, "Threshold").select(
        F.col("Threshold").alias("threshold"), "model", "retained", (100.0 * F.col("retained") / F.col("_t")).alias("model_pct"), "total_pct")
