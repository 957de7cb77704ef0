"""Raster operators on pixel tables (keys, px, py, v).

What can be an aggregate over pixels is one; neighbourhood work is done on
blocks of a map.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.blocks import spread
from ..plans.ordered import exact_percentiles, running_sums
from ..session import durable
from .geometry import edges
from .metrics import combinations_of


#: lines of a map that are dealt together
STRIP = 16
#: pixels of a line that travel as one row
PIECE = 64


def rasterize_tiles(attention: DataFrame, geometry: DataFrame, key="slide_id", order="tile_idx", min_side=1) -> DataFrame:
    """Heat per thumbnail pixel. Scores are min-max scaled per slide, a tile
    covers floor(side * scale) pixels (at least ``min_side``), the later tile
    overwrites. ``geometry``: key, w, h, thumb_w, thumb_h, tile_px, mag_ratio.

    Tiles are dealt by slide and strip of ``STRIP`` lines and become pixels where
    they are then: no pixel is shuffled."""
    sx, sy = F.col("thumb_w") / F.col("w"), F.col("thumb_h") / F.col("h")
    side = F.col("tile_px") * F.col("mag_ratio")
    wide, high = F.greatest(F.lit(min_side), F.floor(side * sx)), F.greatest(F.lit(min_side), F.floor(side * sy))
    per = attention.groupBy(key).agg(F.min("score").alias("_mn"), F.max("score").alias("_mx"), F.count(F.lit(1)).alias("_n"))
    slides = durable(per.join(geometry, key).select(key, "_mn", "_mx", "thumb_w", "thumb_h", sx.alias("_sx"), sy.alias("_sy"),
                                                    wide.alias("_wide"), high.alias("_high"), (F.col("_n") * wide * high).alias("_area")))
    area = slides.agg(F.sum("_area")).first()[0] or 0
    a = attention.select(key, F.col(order).alias("_order"), "x", "y", "score").join(slides, key)
    x0, y0 = F.floor(F.col("x") * F.col("_sx")), F.floor(F.col("y") * F.col("_sy"))
    x1 = F.least(F.col("thumb_w"), x0 + F.col("_wide")) - 1
    y1 = F.least(F.col("thumb_h"), y0 + F.col("_high")) - 1
    v = (F.col("score") - F.col("_mn")) / (F.col("_mx") - F.col("_mn") + 1e-6)
    box = a.select(key, "_order", v.alias("_v"), *[c.cast("int").alias(n) for c, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))]).filter("x1 >= x0 and y1 >= y0")
    strips = box.withColumn("_strip", F.explode(F.sequence(F.floor(F.col("y0") / STRIP), F.floor(F.col("y1") / STRIP))))
    dealt = spread(strips, None, [key, "_strip"], total=area)
    lines = F.sequence(F.greatest(F.col("y0"), (F.col("_strip") * STRIP).cast("int")), F.least(F.col("y1"), (F.col("_strip") * STRIP + STRIP - 1).cast("int")))
    px = dealt.withColumn("px", F.explode(F.sequence("x0", "x1"))).withColumn("py", F.explode(lines))
    return px.groupBy(key, "_strip", "px", "py").agg(F.max_by("_v", "_order").alias("v")).select(key, "px", "py", "v")


def fill_raster(pixels: DataFrame, dims: DataFrame, keys) -> DataFrame:
    """Every pixel of every map; missing ones are 0. ``dims``: keys, w, h."""
    full = dims.select(*keys, "h", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("px")).select(
        *keys, "px", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("py"))
    return full.join(pixels, [*keys, "px", "py"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def gaussian_kernel(sigma: float, truncate=4.0):
    r = int(truncate * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return k / k.sum()


def _along(img, kernel, axis):
    r = len(kernel) // 2
    pad = [(0, 0), (0, 0)]
    pad[axis] = (r, r)
    p = np.pad(img, pad, mode="symmetric")
    n = img.shape[axis]
    return sum(w * np.take(p, range(i, i + n), axis=axis) for i, w in enumerate(kernel))


def blur(img, method, strength):
    if method == "gaussian":
        k = gaussian_kernel(strength)
        out = _along(_along(img, k, 0), k, 1)
    elif method in ("uniform", "median"):
        size = int(2 * strength + 1)
        if method == "uniform":
            k = np.full(size, 1.0 / size)
            out = _along(_along(img, k, 0), k, 1)
        else:
            r, n = size // 2, size * size
            win = np.lib.stride_tricks.sliding_window_view(np.pad(img, r, mode="symmetric"), (size, size))
            win = win[: img.shape[0], : img.shape[1]].reshape(*img.shape, n)
            out = np.partition(win, n // 2, axis=-1)[..., n // 2]
    else:
        raise ValueError(f"unknown blur method {method!r}")
    return np.clip(out, 0.0, 1.0)


def reach(method, strength) -> int:
    """How many pixels away a blurred pixel looks."""
    return len(gaussian_kernel(strength)) // 2 if method == "gaussian" else int(2 * strength + 1) // 2


def smooth(pixels: DataFrame, dims: DataFrame, keys, method="gaussian", strength=1.0, block=512) -> DataFrame:
    """Blur each map (mirrored edges) and clip to [0, 1]; the result covers the
    whole raster.

    A map is cut into blocks of ``block`` pixels a side. A pixel goes to its own
    block and to those it is within reach of, so a task holds one block and its
    rim whatever the size of the map.
    """
    keys = list(keys)
    if method not in ("gaussian", "uniform", "median"):
        raise ValueError(f"unknown blur method {method!r}")
    r = reach(method, strength) if strength > 0 else 0
    size = dims.select(*keys, F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"))

    def near(c):
        return F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((F.col(c) - r) / block)), F.floor((F.col(c) + r) / block))

    # a block's pixels are lists already in the task that sends them; blocks outside the map find no partner
    sent = pixels.withColumn("_bx", F.explode(near("px"))).withColumn("_by", F.explode(near("py"))).groupBy(*keys, "_bx", "_by").agg(
        F.collect_list("px").alias("px"), F.collect_list("py").alias("py"), F.collect_list(F.coalesce("v", F.lit(float("nan")))).alias("v"))
    all_blocks = size.withColumn("_bx", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("w") - 1) / block)))).withColumn(
        "_by", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("h") - 1) / block))))
    rows = all_blocks.join(sent, [*keys, "_bx", "_by"], "left")
    fields = ", ".join(f"`{k}` {pixels.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, h, bx, by = (int(pdf[c].iloc[0]) for c in ("w", "h", "_bx", "_by"))
        x0, y0, x1, y1 = bx * block, by * block, min(w, (bx + 1) * block), min(h, (by + 1) * block)
        ax, ay = max(0, x0 - r), max(0, y0 - r)
        img = np.zeros((min(h, y1 + r) - ay, min(w, x1 + r) - ax))
        if pdf["px"].iloc[0] is not None:
            at_x, at_y = (np.asarray(pdf[c].iloc[0]).astype(int) for c in ("px", "py"))
            img[at_y - ay, at_x - ax] = pdf["v"].iloc[0]
        out = blur(img, method, strength) if strength > 0 else np.clip(img, 0.0, 1.0)
        out = out[y0 - ay: y1 - ay, x0 - ax: x1 - ax]
        py, px = np.mgrid[y0:y1, x0:x1].astype(np.int32)
        res = pd.DataFrame({"px": px.ravel(), "py": py.ravel(), "v": out.ravel()})
        for i, k in enumerate(keys):
            res.insert(i, k, pdf[k].iloc[0])
        return res

    return rows.groupBy(*keys, "_bx", "_by").applyInPandas(run, f"{fields}, px int, py int, v double")


def with_unset(pixels: DataFrame, dims: DataFrame, keys) -> DataFrame:
    """(keys, _set, _unset, _mn, _mx) of every map in ``dims`` (keys, w, h):
    how many pixels have a row and how many are left at 0, and the range of
    all values. So a sparse map never has its zeros written out."""
    keys = list(keys)
    return _with_unset(pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("_set"), F.min("v").alias("_mn"), F.max("v").alias("_mx")), dims, keys)


def _with_unset(s: DataFrame, dims: DataFrame, keys) -> DataFrame:
    j = dims.select(*keys, (F.col("w") * F.col("h")).cast("long").alias("_all")).join(s, keys, "left").withColumn("_set", F.coalesce("_set", F.lit(0)))
    some = F.col("_set") < F.col("_all")
    zero = lambda f, c: F.when(some, f(F.coalesce(c, F.lit(0.0)), F.lit(0.0))).otherwise(F.col(c))
    return j.select(*keys, "_set", (F.col("_all") - F.col("_set")).alias("_unset"), zero(F.least, "_mn").alias("_mn"), zero(F.greatest, "_mx").alias("_mx"))


def valued(pixels: DataFrame, sized: DataFrame, keys) -> DataFrame:
    """(keys, v, _times): the set pixels, and one row for all others of a map."""
    return pixels.select(*keys, "v", F.lit(1).cast("long").alias("_times")).unionByName(
        sized.select(*keys, F.lit(0.0).alias("v"), F.col("_unset").alias("_times")))


def cutoffs(pixels: DataFrame, keys, rule: str, percents, dims: DataFrame | None = None) -> DataFrame:
    """(keys, cuts): one cutoff per percent. Rules: ``pct_all`` percentile of
    all pixels, ``pct_nonzero`` percentile of the non-zero ones, ``range``
    min + p/100 (max - min) and null for a constant map, ``fixed`` p itself.
    With ``dims`` (keys, w, h) the pixels without a row count as 0."""
    keys, percents = list(keys), [float(p) for p in percents]
    parts = [p / 100 for p in percents]
    sized = None if dims is None else with_unset(pixels, dims, keys)
    if rule == "pct_all":
        if sized is None:
            return exact_percentiles(pixels, keys, "v", parts, "cuts")
        return exact_percentiles(valued(pixels, sized, keys), keys, "v", parts, "cuts", weight="_times")
    if rule == "pct_nonzero":
        some = exact_percentiles(pixels.filter(F.col("v") > 0), keys, "v", parts, "cuts")
        return (pixels if dims is None else dims).select(*keys).distinct().join(some, keys, "left")
    s = pixels.groupBy(*keys).agg(F.min("v").alias("_mn"), F.max("v").alias("_mx")) if sized is None else sized
    if rule == "range":
        cut = _range_cut
    elif rule == "fixed":
        cut = lambda p: F.lit(p)
    else:
        raise ValueError(f"unknown cutoff rule {rule!r}")
    return s.select(*keys, F.array(*[cut(p) for p in percents]).alias("cuts"))


def _range_cut(p: float):
    return F.when(F.col("_mx") > F.col("_mn"), F.col("_mn") + F.lit(p / 100) * (F.col("_mx") - F.col("_mn")))


def _pieces(pixels: DataFrame, keys, *lists) -> DataFrame:
    """Runs of ``PIECE`` pixels of a line as one row: (keys, py, _piece, lists)."""
    return pixels.groupBy(*keys, "py", F.floor(F.col("px") / PIECE).alias("_piece")).agg(*lists)


def binarize(pixels: DataFrame, keys, rule: str, percents, dims: DataFrame | None = None) -> DataFrame:
    """(keys, px, py, v, on array<boolean>): the mask at every percent, kept as
    one row per pixel. Pixels at or above the cutoff are on. With ``dims``
    the pixels without a row count for the cutoff but stay without a row."""
    keys = list(keys)
    on = F.transform("cuts", lambda c: F.coalesce(F.col("v") >= c, F.lit(False)))
    return pixels.join(cutoffs(pixels, keys, rule, percents, dims), keys).select(*keys, "px", "py", "v", on.alias("on"))


def rasterize_polygons(polygons: DataFrame, scale: DataFrame, keys=("slide_id", "tissue"), by="slide_id") -> DataFrame:
    """Filled thumbnail pixels per (slide, tissue). Vertices are floored at
    thumbnail scale, outline pixels count, polygons of one fill combine
    even-odd. ``scale``: by, sx, sy, thumb_w, thumb_h.

    Each edge is cut into the raster lines it spans; per line the crossings of
    all polygons, taken in pairs, are the filled spans. Work follows outline
    length and filled area, not vertices times area.
    """
    keys = list(keys)
    p = polygons.filter(F.size("verts") >= 3).join(scale, by)
    verts = F.transform("verts", lambda v: F.struct(
        F.floor(v["x"] * F.col("sx")).cast("double").alias("x"), F.floor(v["y"] * F.col("sy")).cast("double").alias("y")))
    p = p.select(*keys, "thumb_w", "thumb_h", verts.alias("_v"))
    extent = lambda c: F.array_max(F.transform("_v", lambda v: v[c])) - F.array_min(F.transform("_v", lambda v: v[c])) + 1
    filled = F.least(F.col("thumb_w"), extent("x")) * F.least(F.col("thumb_h"), extent("y"))
    e = p.select(*keys, "thumb_w", "thumb_h", F.explode(edges(F.col("_v"))).alias("e")).select(*keys, "thumb_w", "thumb_h", "e.*")
    y_lo, y_hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = F.greatest(F.lit(0), y_lo.cast("int")), F.least(F.col("thumb_h").cast("int") - 1, y_hi.cast("int"))
    lines = e.withColumns({"_a": first, "_b": last}).filter("_b >= _a").withColumn("py", F.explode(F.sequence("_a", "_b")))
    dx, dy, y = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("py").cast("double")
    at = (y - F.col("y1")) * dx / F.nullif(dy, F.lit(0.0)) + F.col("x1")
    # half open: the upper end of an edge does not cross its line
    cross = F.when((y > y_lo) & (y <= y_hi), F.floor(at).cast("int"))
    half = 0.5 * F.greatest(F.abs(dx), F.abs(dy)) / F.nullif(F.abs(dy), F.lit(0.0))
    left, right = F.least("x1", "x2"), F.greatest("x1", "x2")
    lo = F.when(dy == 0, left).otherwise(F.greatest(left, F.ceil(at - half).cast("double"))).cast("int")
    hi = F.when(dy == 0, right).otherwise(F.least(right, F.floor(at + half).cast("double"))).cast("int")
    per_line = lines.select(*keys, "py", F.col("thumb_w").cast("int").alias("w"), cross.alias("cross"), F.struct(lo.alias("a"), hi.alias("b")).alias("rim"))
    area = p.agg(F.sum(filled)).first()[0] or 0  # at least as many pixels as are filled
    spans = spread(per_line, None, [*keys, "py"], total=area).groupBy(*keys, "py").agg(
        F.max("w").alias("w"), F.array_sort(F.collect_list("cross")).alias("c"), F.collect_set("rim").alias("rim"))
    fill = F.transform(
        F.filter(F.sequence(F.lit(0), F.size("c")), lambda i: (i % 2 == 0) & (i + 1 < F.size("c"))),
        lambda i: F.struct((F.get("c", i) + 1).alias("a"), F.get("c", i + 1).alias("b")))
    cut = F.filter(F.transform(F.concat(fill, "rim"), lambda s: F.struct(F.greatest(F.lit(0), s["a"]).alias("a"), F.least(F.col("w") - 1, s["b"]).alias("b"))), lambda s: s["b"] >= s["a"])
    line = F.array_distinct(F.flatten(F.transform(cut, lambda s: F.sequence(s["a"], s["b"]))))  # a line is one row here: no pixel is shuffled
    return spans.select(*keys, F.explode(line).alias("px"), "py")


def mask_counts(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """|a|, |b| and |a and b| per key for two tables of set pixels."""
    keys = list(keys)
    both = a.select(*keys, "px", "py", F.lit(True).alias("_a")).unionByName(b.select(*keys, "px", "py", F.lit(False).alias("_a")))
    per = both.groupBy(*keys, "py").agg(F.collect_set(F.when(F.col("_a"), F.col("px"))).alias("_a"), F.collect_set(F.when(~F.col("_a"), F.col("px"))).alias("_b"))
    return per.groupBy(*keys).agg(
        F.sum(F.size("_a")).alias("a_px"), F.sum(F.size("_b")).alias("b_px"), F.sum(F.size(F.array_intersect("_a", "_b"))).alias("both_px"))


def dice(a_px, b_px, both_px, empty=None):
    """2|ab| / (|a| + |b|); ``empty`` is the value when both masks are empty."""
    d = 2.0 * both_px / F.nullif((a_px + b_px).cast("double"), F.lit(0.0))
    return d if empty is None else F.coalesce(d, F.lit(float(empty)))


def coverage(both_px, whole_px):
    return 100.0 * both_px / F.nullif(whole_px.cast("double"), F.lit(0.0))


PERCENTS = (25, 50, 60, 70, 80, 90)


def slide_overlap(heat: DataFrame, masks: DataFrame, annotated: DataFrame, percents=PERCENTS, key="slide_id",
                  dims: DataFrame | None = None) -> DataFrame:
    """Long rows (slide, tissue, percentile, metric, value): dice, coverage of the
    tissue and share of the attention in it, range cutoffs.

    ``heat`` covers the whole raster, or only set pixels if ``dims`` (slide, w,
    h) is given; then the others are 0 and are only counted. ``masks`` holds
    set pixels per tissue; ``annotated`` lists the (slide, tissue) pairs to
    report, so an empty mask still gives its row (null where undefined). The
    percents are columns of one aggregate, not copies of the pixels. Heat and
    masks travel in pieces of a line, not in pixels.
    """
    n = len(percents)
    seen = F.when(F.col("v").isNotNull(), F.col("px"))  # as long as the list of values
    heat = durable(_pieces(heat, [key], F.collect_list(seen).alias("_x"), F.collect_list("v").alias("_v"),
                           F.count(F.lit(1)).alias("_n"), F.min("v").alias("_mn"), F.max("v").alias("_mx")))
    sized = heat.groupBy(key).agg(F.sum("_n").alias("_set"), F.min("_mn").alias("_mn"), F.max("_mx").alias("_mx"))
    sized = sized.withColumn("_unset", F.lit(0).cast("long")) if dims is None else _with_unset(sized, dims, [key])
    cuts = durable(sized.select(key, F.array(*[_range_cut(float(p)) for p in percents]).alias("cuts"), "_unset"))
    drawn = _pieces(masks, [key, "tissue"], F.collect_list("px").alias("_m"))
    value = lambda p: F.get("_v", (F.array_position("_x", p) - 1).cast("int"))
    found = F.transform("_m", value if dims is None else lambda p: F.coalesce(value(p), F.lit(0.0)))
    under = drawn.join(heat.select(key, "py", "_piece", "_x", "_v"), [key, "py", "_piece"], "left").select(
        key, "tissue", F.lit(True).alias("_mask"), found.alias("_v"))
    both = under.unionByName(heat.select(key, F.lit(None).cast(masks.schema["tissue"].dataType).alias("tissue"), F.lit(False).alias("_mask"), "_v"))
    on = lambda i: F.size(F.filter("_v", lambda v: v >= F.col("cuts")[i])).cast("long")
    counted = durable(both.join(cuts, key).groupBy(key, "_mask", "tissue").agg(
        F.sum(F.size("_v")).alias("_px"), F.array(*[F.sum(on(i)) for i in range(n)]).alias("_on")))
    zero_on = lambda i: F.when(F.col("cuts")[i] <= 0, F.col("_unset")).otherwise(F.lit(0))
    set_on = counted.filter("not _mask").select(key, "_on")
    attn = cuts.join(set_on, key, "left").select(key, F.array(*[F.coalesce(F.col("_on")[i], F.lit(0)) + zero_on(i) for i in range(n)]).alias("_attn"))
    inter = counted.filter("_mask").select(key, "tissue", "_px", F.col("_on").alias("_both"))
    none = F.array_repeat(F.lit(0).cast("long"), n)
    base = annotated.select(key, "tissue").distinct().join(attn, key).join(inter, [key, "tissue"], "left").select(
        key, "tissue", "_attn", F.coalesce("_px", F.lit(0)).alias("_px"), F.coalesce("_both", none).alias("_both"))
    rows = base.select(key, "tissue", "_px", F.posexplode(F.arrays_zip("_attn", "_both")).alias("_i", "_z"))
    a, b, t = F.col("_z._attn"), F.col("_z._both"), F.col("_px")
    pct = F.get(F.array(*[F.lit(int(p)) for p in percents]), F.col("_i"))
    wide = rows.select(key, "tissue", pct.alias("percentile"), dice(a, t, b).alias("dice"), coverage(b, t).alias("coverage"),
                       coverage(b, a).alias("attention_in"))
    return wide.unpivot([key, "tissue", "percentile"], ["dice", "coverage", "attention_in"], "metric", "value")


def overlap_problems(slides: DataFrame, attention: DataFrame, annotated: DataFrame, geometry: DataFrame, key="slide_id") -> DataFrame:
    """(slide, reason): slides that cannot be compared. They are reported here;
    the others go on."""
    has = lambda d, c: d.select(key).distinct().withColumn(c, F.lit(True))
    sized = geometry.filter("w > 0 and h > 0 and thumb_w > 0 and thumb_h > 0")
    j = slides.select(key).distinct().join(has(attention, "_a"), key, "left").join(has(annotated, "_p"), key, "left").join(has(sized, "_g"), key, "left")
    reason = F.when(F.col("_a").isNull(), "no attention").when(F.col("_p").isNull(), "no annotation").when(F.col("_g").isNull(), "no usable geometry")
    return j.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(key, "reason")


def pixel_counts(heat: DataFrame, masks: DataFrame, key="slide_id") -> DataFrame:
    """Set pixels per (slide, tissue) and non-zero heat pixels (tissue ``heat``)."""
    a = heat.filter("v > 0").groupBy(key).agg(F.count(F.lit(1)).alias("n_px")).select(key, F.lit("heat").alias("tissue"), "n_px")
    return a.unionByName(masks.groupBy(key, "tissue").agg(F.count(F.lit(1)).alias("n_px")))


def overlap_summary(rows: DataFrame, keys=("tissue", "percentile", "metric"), value="value") -> DataFrame:
    """Mean, sample std (0.0 for one value, null for none) and valid count."""
    n = F.count(value)
    return rows.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.when(n == 1, F.lit(0.0)).otherwise(F.stddev_samp(value)).alias("std"), n.alias("n_valid"))


def map_overlap(pixels: DataFrame, percents=(50, 60, 70, 80, 90), rule="pct_all", tile="tile_id", dims: DataFrame | None = None) -> DataFrame:
    """(model1, model2, tile, percentile, dice) for all model pairs over common
    tiles. Each pixel row carries its masks; a pixel's set models give its pair
    contributions, so maps are read once for all pairs and percents.

    With ``dims`` (model, tile, w, h) pixels without a row are 0 and values are
    not negative: a cutoff of 0 or less then switches a whole map on, and its
    overlap with another map is that map's size.
    """
    keys, n = ["model", tile], len(percents)
    pixels = durable(pixels)
    rows = binarize(pixels, keys, rule, percents, dims)
    count = F.array(*[F.sum(F.col("on")[i].cast("long")) for i in range(n)]).alias("_n")
    sizes = rows.groupBy(*keys).agg(count)
    if dims is not None:
        whole = cutoffs(pixels, keys, rule, percents, dims).join(with_unset(pixels, dims, keys).select(*keys, (F.col("_set") + F.col("_unset")).alias("_all")), keys)
        full = F.transform("cuts", lambda c: F.coalesce(c <= 0, F.lit(False)))
        sizes = whole.withColumn("full", full).join(sizes, keys, "left").select(*keys, "full", F.array(*[
            F.when(F.col("full")[i], F.col("_all")).otherwise(F.coalesce(F.col("_n")[i], F.lit(0))) for i in range(n)]).alias("_n"))
    else:
        sizes = sizes.withColumn("full", F.array_repeat(F.lit(False), n))
    sizes = durable(sizes)
    listed = sizes.groupBy(tile).agg(F.array_sort(F.collect_list(F.struct("model", F.arrays_zip("_n", "full").alias("_n")))).alias("_l"))
    pairs = listed.select(tile, F.explode(combinations_of(F.transform("_l", lambda s: s["model"]), 2)).alias("_p"), F.map_from_entries("_l").alias("_m"))
    base = pairs.select(tile, F.col("_p")[0].alias("model1"), F.col("_p")[1].alias("model2"),
                        F.posexplode(F.arrays_zip(F.col("_m")[F.col("_p")[0]].alias("a"), F.col("_m")[F.col("_p")[1]].alias("b"))).alias("_i", "_z"))
    on = rows.select(tile, "model", "px", "py", F.posexplode("on").alias("_i", "_on")).filter("_on")
    inter = on.groupBy(tile, "_i", "px", "py").agg(F.collect_set("model").alias("_s")).filter(F.size("_s") >= 2).select(
        tile, "_i", F.explode(combinations_of(F.col("_s"), 2)).alias("_p")).groupBy(
        tile, "_i", F.col("_p")[0].alias("model1"), F.col("_p")[1].alias("model2")).agg(F.count(F.lit(1)).alias("_both"))
    pct = F.get(F.array(*[F.lit(float(p)) for p in percents]), F.col("_i"))
    size = lambda x: F.col(f"_z.{x}._n")
    both = F.when(F.col("_z.a.full"), size("b")).when(F.col("_z.b.full"), size("a")).otherwise(F.coalesce("_both", F.lit(0)))
    return base.join(inter, [tile, "_i", "model1", "model2"], "left").select(
        "model1", "model2", tile, pct.alias("percentile"), dice(size("a"), size("b"), both, 1.0).alias("dice"))


def map_overlap_summary(overlap: DataFrame) -> DataFrame:
    v = lambda c: F.round(c, 4)
    return overlap.filter(F.col("dice").isNotNull()).groupBy("model1", "model2", "percentile").agg(
        v(F.avg("dice")).alias("mean_dice"), v(F.stddev_pop("dice")).alias("std_dice"), v(F.min("dice")).alias("min_dice"),
        v(F.max("dice")).alias("max_dice"), F.count("dice").alias("num_tiles"))


def map_stats(pixels: DataFrame, keys=("model", "tile_id"), first_only_of=None, dims: DataFrame | None = None) -> DataFrame:
    """Range, mean, population std, median and zero counts per map; with
    ``first_only_of="tile_id"`` only each model's first map by name. With
    ``dims`` (keys, w, h) pixels without a row count as 0."""
    keys = list(keys)
    if first_only_of:
        group = [k for k in keys if k != first_only_of]
        base = pixels if dims is None else dims
        first = base.groupBy(*group).agg(F.min(first_only_of).alias(first_only_of))
        pixels = pixels.join(first, keys, "left_semi")
        dims = None if dims is None else dims.join(first, keys, "left_semi")
    if dims is None:
        rows = pixels.select(*keys, "v", F.lit(1).cast("long").alias("_times"))
    else:
        rows = valued(pixels, with_unset(pixels, dims, keys), keys).filter("_times > 0")
    rows = rows.groupBy(*keys, "v").agg(F.sum("_times").alias("_times"))  # one row per value
    t, v = F.col("_times"), F.col("v")
    mean = F.sum(v * t) / F.sum(t)
    s = rows.groupBy(*keys).agg(
        F.min("v").alias("min"), F.max("v").alias("max"), mean.alias("mean"),
        F.sqrt(F.greatest(F.sum(v * v * t) / F.sum(t) - mean * mean, F.lit(0.0))).alias("std"),
        F.sum(t).alias("n"), F.sum(F.when(v != 0, t).otherwise(F.lit(0))).alias("n_nonzero"))
    med = exact_percentiles(rows, keys, "v", [0.5], "_m", weight="_times")
    flat = F.col("max") <= F.col("min")
    return s.join(med, keys).select(
        *keys, "min", "max", "mean", "std", F.col("_m")[0].alias("median"), "n", "n_nonzero", (F.col("n") - F.col("n_nonzero")).alias("n_zero"),
        F.when(flat, F.col("min")).otherwise(F.lit(0.0)).alias("norm_min"), F.when(flat, F.col("max")).otherwise(F.lit(1.0)).alias("norm_max"))


def histogram(df: DataFrame, keys, value: str, bins: int) -> DataFrame:
    """Equal-width counts between a group's minimum and maximum; the last bin is
    closed, empty bins are listed. A constant group spans value +- 0.5."""
    keys = list(keys)
    s = df.groupBy(*keys).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    flat = F.col("_a") == F.col("_b")
    s = s.select(*keys, F.when(flat, F.col("_a") - 0.5).otherwise(F.col("_a")).alias("lo"), F.when(flat, F.col("_b") + 0.5).otherwise(F.col("_b")).alias("hi"))
    j = df.join(s, keys)
    b = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("int")
    counts = j.filter(F.col(value).isNotNull()).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("_c"))
    slots = s.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("hi") - F.col("lo")) / bins
    return slots.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin", (F.col("lo") + F.col("bin") * width).alias("left"), F.coalesce("_c", F.lit(0)).alias("count"))


# fixed values: classes that never vote
BACKGROUND_CLASSES = ("BACK", "DEB")


def _vote(columns: DataFrame, keys) -> DataFrame:
    """Most votes per cell of (keys, class_id, gx, _rows): the columns are dealt,
    the cells of a column are then counted where they are."""
    cells = spread(columns, F.size("_rows"), [*keys, "gx"]).select(*keys, "class_id", "gx", F.explode("_rows").alias("gy"))
    votes = cells.groupBy(*keys, "gx", "gy", "class_id").agg(F.count(F.lit(1)).alias("_v"))
    return votes.groupBy(*keys, "gx", "gy").agg(
        F.min_by("class_id", F.struct((-F.col("_v")).alias("v"), F.col("class_id"))).alias("class_id"), F.sum("_v").alias("votes"))


def class_grid(patches: DataFrame, keys, x0, y0, x1, y1, step=256, exclude=BACKGROUND_CLASSES, label="label") -> DataFrame:
    """Each patch votes for its class in every cell it covers; most votes win,
    the first class name on ties. Cells without votes have no row."""
    p = patches.filter(~F.col(label).isin(*exclude))
    span = lambda a, b: F.sequence(F.floor(a / step), F.greatest(F.floor(a / step), F.ceil(b / step) - 1))
    columns = p.select(*keys, F.col(label).alias("class_id"), F.explode(span(F.col(x0), F.col(x1))).alias("gx"), span(F.col(y0), F.col(y1)).alias("_rows"))
    return _vote(columns, list(keys))


def pixel_majority_vote(patches: DataFrame, keys, x0, y0, x1, y1, scale: float, width: int, height: int, include=None, exclude=(),
                        label="label", class_id="class_id") -> DataFrame:
    """The same at thumbnail scale: floor top-left, ceil bottom-right, clipped."""
    p = patches
    if include:
        p = p.filter(F.col(label).isin(*include))
    if exclude:
        p = p.filter(~F.col(label).isin(*exclude))
    lo = lambda c: F.greatest(F.lit(0), F.floor(F.col(c) * scale).cast("int"))
    hi = lambda c, m: F.least(F.lit(m), F.ceil(F.col(c) * scale).cast("int")) - 1
    box = p.select(*keys, F.col(class_id).alias("class_id"), lo(x0).alias("a"), hi(x1, width).alias("b"), lo(y0).alias("c"), hi(y1, height).alias("d")).filter(
        "b >= a and d >= c")
    columns = box.select(*keys, "class_id", F.explode(F.sequence("a", "b")).alias("gx"), F.sequence("c", "d").alias("_rows"))
    return _vote(columns, list(keys))


def _surrounded(line: str, r: int, size: int):
    """The numbers of a sorted line whose r neighbours on either side, inside 0..size - 1, are in it."""
    def whole(x, i):
        lo, hi = F.greatest(F.lit(0), x - r), F.least(F.lit(size - 1), x + r)
        at = lambda j: F.when((j >= 0) & (j < F.size(line)), F.get(line, j))
        return F.coalesce((at(i - (x - lo)) == lo) & (at(i + (hi - x)) == hi), F.lit(False))

    return F.filter(line, whole)


def erode(mask: DataFrame, keys, r: int, width: int, height: int) -> DataFrame:
    """Square erosion: a pixel stays when its (2r+1) x (2r+1) surroundings inside
    the image are set. Two passes, one per axis, over the sorted pixels of a line:
    the ends of a pixel's surroundings stand as far from it as they are away."""
    keys = list(keys)
    out, dealt = mask.select(*keys, "px", "py"), None
    for axis, across, size in (("px", "py", width), ("py", "px", height)):
        if dealt is not None:
            out = spread(out, None, [*keys, across], total=dealt.agg(F.sum(F.size("_kept"))).first()[0] or 0)
        lines = out.groupBy(*keys, across).agg(F.array_sort(F.collect_set(axis)).alias("_line"))
        kept = lines.select(*keys, across, _surrounded("_line", r, size).alias("_kept")).filter(F.size("_kept") > 0)
        dealt = durable(kept) if dealt is None else kept
        out = dealt.select(*keys, F.explode("_kept").alias(axis), across)
    return out.select(*keys, "px", "py")


#: pixels whose regions are found together
BLOCK_PIXELS = 250_000


def label_runs(x, y, reach_diagonal=False):
    """Connected regions of pixels sorted by (y, x): the index of each region's
    first pixel, per pixel. Runs of pixels per line are merged, not pixels."""
    slack = 1 if reach_diagonal else 0
    start = np.ones(len(x), dtype=bool)
    start[1:] = (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)
    run_of = np.cumsum(start) - 1
    first = np.flatnonzero(start)
    last = np.append(first[1:], len(x)) - 1
    ry, lo, hi = y[first], x[first], x[last]
    parent = list(range(len(first)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above = 0  # first run that can still touch the current one
    for b in range(len(first)):
        while above < b and (ry[above] < ry[b] - 1 or (ry[above] == ry[b] - 1 and hi[above] + slack < lo[b])):
            above += 1
        c = above
        while c < b and ry[c] == ry[b] - 1 and lo[c] <= hi[b] + slack:
            p, q = root(c), root(b)
            parent[max(p, q)] = min(p, q)
            c += 1
    roots = np.array([root(i) for i in range(len(first))], dtype=int)
    return first[roots][run_of]


def _merge_labels(links: DataFrame, keys) -> DataFrame:
    """(keys, a, root): smallest label reachable over ``links`` (keys, a, b).
    Labels take the smallest of their neighbours' and then jump to that label's
    own; the rounds grow with the logarithm of the longest chain in most cases."""
    both = durable(links.unionByName(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    root = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    while True:
        root = durable(root)
        seen = both.join(root.select(*keys, F.col("a").alias("b"), F.col("root").alias("_r")), [*keys, "b"])
        low = seen.groupBy(*keys, "a").agg(F.min("_r").alias("_m"))
        step = root.join(low, [*keys, "a"]).select(*keys, "a", F.col("root").alias("_old"), F.least("root", "_m").alias("_new"))
        jump = root.select(*keys, F.col("a").alias("_new"), F.col("root").alias("_j"))
        moved = durable(step.join(jump, [*keys, "_new"], "left").select(*keys, "a", "_old", F.least("_new", "_j").alias("root")))
        if moved.filter("root < _old").isEmpty():
            return root
        root = moved.drop("_old")


def region_components(mask: DataFrame, keys, connectivity=4, block=512) -> DataFrame:
    """(keys, px, py, component): connected regions per map, numbered from 0 in
    raster order of their first pixel.

    Regions are found inside blocks of ``block`` pixels a side, as many small
    blocks together as make ``BLOCK_PIXELS``; regions that touch across block
    borders are then merged by label.
    """
    keys = list(keys)
    wide = 1 << 32
    fields = ", ".join(f"`{k}` {mask.schema[k].dataType.simpleString()}" for k in keys)
    px = durable(mask.select(*keys, F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py")).distinct())
    piles = max(1, -(-px.count() // BLOCK_PIXELS))
    px = px.withColumns({"_bx": F.floor(F.col("px") / block), "_by": F.floor(F.col("py") / block)})
    px = px.withColumn("_pile", F.pmod(F.xxhash64(*keys, "_bx", "_by"), F.lit(piles)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        which = pdf.groupby([*keys, "_bx", "_by"], dropna=False, sort=False).ngroup().to_numpy()
        x, y = pdf["px"].to_numpy(), pdf["py"].to_numpy().astype(np.int64)
        own = which * np.int64(block + 2) + y - pdf["_by"].to_numpy() * block  # blocks one below the other, a line or more apart
        order = np.lexsort((x, own))
        x, y, own = x[order], y[order], own[order]
        at = label_runs(x, own, connectivity == 8)
        pdf = pdf.iloc[order]
        return pdf[[*keys, "px", "py"]].assign(a=y[at] * wide + x[at])

    local = durable(px.groupBy("_pile").applyInPandas(run, f"{fields}, px int, py int, a long"))
    steps = [(1, 0), (0, 1)] + ([(1, 1), (-1, 1)] if connectivity == 8 else [])
    rim = local.filter((F.col("px") % block).isin(0, block - 1) | (F.col("py") % block).isin(0, block - 1))
    out = rim.select(*keys, "a", F.explode(F.array(*[F.struct((F.col("px") + dx).alias("px"), (F.col("py") + dy).alias("py")) for dx, dy in steps])).alias("_n"))
    links = durable(out.select(*keys, "a", "_n.px", "_n.py").join(
        rim.select(*keys, "px", "py", F.col("a").alias("b")), [*keys, "px", "py"]).filter("a <> b").select(*keys, "a", "b").distinct())
    if links.isEmpty():
        named = local.withColumn("root", F.col("a"))
    else:
        named = local.join(_merge_labels(links, keys), [*keys, "a"], "left").withColumn("root", F.coalesce("root", "a"))
    roots = named.select(*keys, "root").distinct().withColumn("_one", F.lit(1))
    numbered = running_sums(roots, keys, "root", {"_one": "component"}).select(*keys, "root", F.col("component").cast("int").alias("component"))
    return named.join(numbered, [*keys, "root"]).select(*keys, "px", "py", "component")
