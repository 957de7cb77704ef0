"""How alike two models' embeddings of the same objects are."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.draws import hash_take
from ..plans.gram import assemble, keyed_gram
from ..plans.neighbours import nearest
from ..session import durable

GRAM_METRICS = ("cka", "svcca", "procrustes", "ridge")
ALL_METRICS = GRAM_METRICS + ("knn",)


def _one_per_key(df: DataFrame, keys, features, order):
    return df.groupBy(*keys).agg(F.min_by(features, F.col(order)).alias(features))


def match_tiles(tiles: DataFrame, model1: str, model2: str, sample_size: int | None = None, seed=42,
                keys=("slide_id", "x", "y"), order="tile_idx") -> DataFrame:
    """Tiles both models embedded, unique by coordinate; all of them, or
    ``sample_size`` drawn by hash."""
    keys = list(keys)
    a = _one_per_key(tiles.filter(F.col("model") == model1), keys, "features", order)
    b = _one_per_key(tiles.filter(F.col("model") == model2), keys, "features", order)
    both = a.withColumnRenamed("features", "fx").join(b.withColumnRenamed("features", "fy"), keys)
    if sample_size is not None:
        both = hash_take(both, [], [*keys, seed], keys, sample_size)
    return both


def match_slides(vecs: DataFrame, model1: str, model2: str) -> DataFrame:
    return match_tiles(vecs, model1, model2, None, keys=("slide_id",), order="slide_id")


def paired_gram(pairs: DataFrame, keys=(), x="fx", y="fy") -> DataFrame:
    return keyed_gram(pairs, keys, x, y)


def centred_entries(gram: DataFrame, keys) -> DataFrame:
    """Long form (keys, i, j, value) of the centred matrix, 1-based columns."""
    keys = list(keys)
    top = gram.filter("i = 0").select(*keys, F.col("row").alias("_top"))
    joined = gram.filter("i > 0").join(F.broadcast(top), keys)  # one row per key
    n, si = F.col("_top")[0], F.get("_top", F.col("i"))
    centred = F.zip_with("row", "_top", lambda g, s: g - si * s / n)
    return joined.select(*keys, "i", F.posexplode(centred).alias("j", "value")).filter("j > 0")


def _basis(c, cap, var_thres=None):
    vals, vecs = np.linalg.eigh(c)
    order = np.argsort(vals)[::-1]
    vals, vecs = np.clip(vals[order], 0.0, None), vecs[:, order]
    k = len(vals)
    if var_thres is not None:
        cum = np.cumsum(vals) / vals.sum()
        k = int(np.searchsorted(cum, var_thres)) + 1
    k = min(k, cap, len(vals))
    return vals[:k], vecs[:, :k]


def gram_measures(cxx, cyy, cxy, metrics, var_thres=0.99, max_components=50, pca_dim=50, alpha=1.0) -> dict:
    """All measures that follow from the centred products alone."""
    out = {}
    if "cka" in metrics:
        out["cka"] = float((cxy**2).sum() / (np.linalg.norm(cxx) * np.linalg.norm(cyy) + 1e-12))
    if "svcca" in metrics:
        lx, vx = _basis(cxx, max_components, var_thres)
        ly, vy = _basis(cyy, max_components, var_thres)
        core = (vx / np.sqrt(lx)).T @ cxy @ (vy / np.sqrt(ly))
        out["svcca"] = float(np.linalg.svd(core, compute_uv=False)[: min(len(lx), len(ly))].mean())
    if "procrustes" in metrics:
        d = min(pca_dim, len(cxx), len(cyy))
        lx, vx = _basis(cxx, d)
        ly, vy = _basis(cyy, d)
        nuclear = np.linalg.svd(vx.T @ cxy @ vy, compute_uv=False).sum()
        gap = max(lx.sum() + ly.sum() - 2 * nuclear, 0.0)
        out["procrustes"] = float(np.sqrt(gap) / (np.sqrt(ly.sum()) + 1e-12))
    if "ridge" in metrics:
        for name, a, b, ab in (("r2_y2x", cyy, cxx, cxy.T), ("r2_x2y", cxx, cyy, cxy)):
            w = np.linalg.solve(a + alpha * np.eye(len(a)), ab)
            res = np.trace(b) - 2 * (w * ab).sum() + (w * (a @ w)).sum()
            out[name] = float(1 - res / (np.trace(b) + 1e-12))
    return out


MEASURE_COLS = ["cka", "svcca", "procrustes", "r2_y2x", "r2_x2y"]


def measures_from_gram(gram: DataFrame, keys, metrics=GRAM_METRICS, **params) -> DataFrame:
    """One row per key with n and the requested measures; the group a task sees
    is one D x D matrix."""
    keys = list(keys)
    fields = ", ".join(f"`{k}` {gram.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{fields}, n long, " + ", ".join(f"{c} double" for c in MEASURE_COLS)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n, dx, _, c = assemble(pdf)
        got = gram_measures(c[:dx, :dx], c[dx:, dx:], c[:dx, dx:], metrics, **params)
        row = {k: pdf[k].iloc[0] for k in keys} | {"n": int(round(n))} | {m: got.get(m) for m in MEASURE_COLS}
        return pd.DataFrame([row])

    return gram.groupBy(*keys).applyInPandas(solve, schema)


def nearest_in_spaces(rows: DataFrame, keys, ids: str, spaces, k: int, size=2048) -> DataFrame:
    """(keys, id, space, neighbour, d2): the k nearest other rows in every
    feature space, exact, through a metric index per key and space."""
    vec = lambda s: F.transform(s, lambda v: v.cast("double"))
    long = rows.select(*keys, ids, F.explode(F.array(*[F.struct(F.lit(s).alias("space"), vec(s).alias("vec")) for s in spaces])).alias("_s"))
    return nearest(long.select(*keys, ids, "_s.space", "_s.vec"), [*keys, "space"], ids, k, size)


def knn_overlap(pairs: DataFrame, keys, ids: str, k=10, x="fx", y="fy", size=2048) -> DataFrame:
    """Mean Jaccard overlap of each row's k nearest neighbours in both spaces,
    the row itself left out."""
    keys = list(keys)
    near = nearest_in_spaces(pairs, keys, ids, [x, y], k, size)
    hits = near.groupBy(*keys, ids, "neighbour").agg(F.count(F.lit(1)).alias("_in"))
    per = hits.groupBy(*keys, ids).agg(
        (F.sum((F.col("_in") == 2).cast("double")) / (F.count(F.lit(1)) + F.lit(1e-12))).alias("_j"))
    return per.groupBy(*keys).agg(F.avg("_j").alias("knn"))


def pairwise_similarity(tiles: DataFrame, models, metrics=("all",), sample_size: int | None = None, k=10,
                        seed=42, keys=("slide_id", "x", "y"), order="tile_idx", **params) -> DataFrame:
    """One row per unordered model pair. All pairs share one Gram job: the pair
    is a key of it. A pair without common objects gives no row."""
    metrics = ALL_METRICS if "all" in metrics else tuple(metrics)
    unknown = set(metrics) - set(ALL_METRICS)
    if unknown:
        raise ValueError(f"unknown metrics {sorted(unknown)}")
    both = None
    for a, b in itertools.combinations(models, 2):
        m = match_tiles(tiles, a, b, sample_size, seed, keys, order).withColumns(
            {"model1": F.lit(a), "model2": F.lit(b), "_id": F.concat_ws("|", *keys)})
        both = m if both is None else both.unionByName(m)
    by = ["model1", "model2"]
    both = durable(both)  # the sums and the neighbours read it
    out = measures_from_gram(paired_gram(both, by), by, metrics, **params)
    if "knn" in metrics:
        return out.join(knn_overlap(both, by, "_id", k), by, "left")
    return out.withColumn("knn", F.lit(None).cast("double"))


def model_average_over_pairs(pairs: DataFrame) -> DataFrame:
    """Each pair counts for both members; ridge is the mean of both directions."""
    metrics = [c for c in ("cka", "svcca", "procrustes", "knn") if c in pairs.columns]
    rows = pairs.withColumn("ridge", (F.col("r2_y2x") + F.col("r2_x2y")) / 2)
    metrics.append("ridge")
    both = rows.select(F.explode(F.array("model1", "model2")).alias("model"), *metrics)
    return both.groupBy("model").agg(*[F.avg(m).alias(m) for m in metrics])


def symmetric_matrix(pairs: DataFrame, metric: str, diagonal: float) -> DataFrame:
    """Long matrix with both triangles and the diagonal; models ranked by mean
    score, then name. ``pairs`` is one row per model pair."""
    half = pairs.select("model1", "model2", F.col(metric).alias("value"))
    both = half.unionByName(half.select(F.col("model2").alias("model1"), F.col("model1").alias("model2"), "value"))
    mean = both.groupBy("model1").agg(F.avg("value").alias("_m"))
    # one row per model
    place = mean.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("_m").desc(), "model1")))
    diag = place.select("model1", F.col("model1").alias("model2"), F.lit(float(diagonal)).alias("value"))
    return both.unionByName(diag).join(place.select("model1", "place"), "model1")
