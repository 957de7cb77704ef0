import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortile.operators import geometry as G
from cohortile.operators import raster as R
from cohortile.plans.blocks import spread
from cohortile.operators import reports as P


def sq(a, b, c, d):
    return [(float(a), float(b)), (float(c), float(b)), (float(c), float(d)), (float(a), float(d))]


POLY = "slide_id string, tissue string, verts array<struct<x:double,y:double>>"


def test_point_in_polygon(spark):
    ell = [(0., 0.), (4., 0.), (4., 2.), (2., 2.), (2., 4.), (0., 4.)]
    pts = [(1., 1., True), (3., 1., True), (3., 3., False), (1., 3., True), (5., 1., False), (-1., 1., False)]
    df = spark.createDataFrame([(p[0], p[1], p[2], ell) for p in pts], "x double, y double, want boolean, verts array<struct<x:double,y:double>>")
    assert all(r.got == r.want for r in df.select("want", G.point_in_polygon(F.col("x"), F.col("y"), F.col("verts")).alias("got")).collect())


def test_tile_labels(spark):
    tri = [(0., 0.), (100., 0.), (0., 100.)]
    polys = spark.createDataFrame([("s", "tumor", tri), ("s", "normal", sq(200, 200, 260, 260)), ("s", "tumor", tri[:2]), ("only", "tumor", tri)], POLY)
    t = spark.createDataFrame([("s", 1, 5, 5), ("s", 2, 80, 80), ("s", 3, 210, 210), ("s", 4, 500, 500), ("only", 5, 5, 5)], "slide_id string, tile_idx int, x int, y int")
    lab = lambda mode, **k: {r.tile_idx: r.tissue for r in G.label_tiles_by_polygon(t, polys, 10, mode, **k).collect()}
    assert lab("exact") == {1: "tumor", 3: "normal"}
    assert lab("bbox") == {1: "tumor", 2: "tumor", 3: "normal"}
    assert lab("exact", require_both=False)[5] == "tumor"
    # a box that contains the whole polygon, and one crossed without any vertex inside
    big = spark.createDataFrame([("s", 1, 190, 190), ("s", 2, 225, 150)], "slide_id string, tile_idx int, x int, y int")
    got = {r.tile_idx: r.tissue for r in G.label_tiles_by_polygon(big, polys, 100, "exact", require_both=False).collect()}
    assert got == {1: "normal", 2: "normal"}
    pts = spark.createDataFrame([("s", 1, 10., 10.), ("s", 2, 90., 90.)], "slide_id string, point_id int, px double, py double")
    assert [r.point_id for r in G.points_in_any(pts, polys, 64.0).collect()] == [1]


def test_edge_rows_equal_whole_outlines(spark):
    """Random stars over many cells: the same tiles and points as with the rule over the whole outline; no vertices on the cell side."""
    rng = np.random.default_rng(5)
    polys = []
    for i in range(12):
        n, cx, cy = int(rng.integers(3, 40)), rng.uniform(0, 900), rng.uniform(0, 900)
        a, r = np.sort(rng.uniform(0, 2 * np.pi, n)), rng.uniform(5, 300, n)
        polys.append(("s", "tumor" if i % 2 else "normal", [(float(round(cx + x)), float(round(cy + y))) for x, y in zip(r * np.cos(a), r * np.sin(a))]))
    p = spark.createDataFrame(polys, POLY)
    t = spark.createDataFrame([("s", i, int(x), int(y)) for i, (x, y) in enumerate(rng.integers(-200, 1200, (400, 2)))], "slide_id string, tile_idx int, x int, y int")
    side = 20
    met = t.join(p, "slide_id").filter(G.box_meets_polygon(F.col("x").cast("double"), F.col("y").cast("double"), F.col("x") + side, F.col("y") + side, F.col("verts")))
    want = {r.tile_idx: r.t for r in met.groupBy("tile_idx").agg(F.max("tissue").alias("t")).collect()}  # tumor is the greater name and the first in priority
    got = G.label_tiles_by_polygon(t, p, side, "exact", require_both=False, cell=64)
    assert {r.tile_idx: r.tissue for r in got.collect()} == want and len(want) > 100
    pts = t.withColumnsRenamed({"x": "px", "y": "py", "tile_idx": "point_id"})
    inside = {r.point_id for r in pts.join(p, "slide_id").filter(G.point_in_polygon(F.col("px"), F.col("py"), F.col("verts"))).collect()}
    found = G.points_in_any(pts, p, 50.0)
    assert {r.point_id for r in found.collect()} == inside and len(inside) > 50
    extents, lines = G.outline_tables(p, 50.0)
    assert "verts" not in extents.columns and "verts" not in lines.columns


def test_boundary_sides(spark):
    g = spark.createDataFrame([("m", 0, 0, "a", 1), ("m", 0, 1, "b", 1), ("m", 1, 0, "x", 1), ("m", 1, 0, "a", 2)], "m string, r int, c int, label string, ord int")
    s = {(r.r, r.c): r for r in G.boundary_sides(g, ["m"], 2, 2).collect()}
    assert (s[(0, 0)].top, s[(0, 0)].right, s[(0, 0)].bottom, s[(0, 0)].left) == (False, True, False, False)
    assert s[(0, 1)].bottom is True and s[(1, 0)].label == "a"
    assert {(r.r, r.c): r for r in G.boundary_sides(g, ["m"], 2, 2, edge_is_border=True).collect()}[(0, 0)].top is True


def test_blur():
    img = np.zeros((7, 9))
    img[3, 4] = 1
    g = R.blur(img, "gaussian", 1.0)
    assert g.sum() == pytest.approx(1, abs=2e-3) and g[3, 4] == g.max() and g[3, 3] == pytest.approx(g[3, 5])
    assert R.blur(np.full((5, 5), .3), "gaussian", 2.0) == pytest.approx(np.full((5, 5), .3))
    u = R.blur(img, "uniform", 1.0)
    assert u[2:5, 3:6] == pytest.approx(np.full((3, 3), 1 / 9)) and u[0, 0] == 0
    assert R.blur(img, "median", 1.0).max() == 0 and R.blur(np.ones((4, 4)), "median", 0.5).shape == (4, 4)


@pytest.mark.parametrize("method,strength", [("gaussian", 1.0), ("uniform", 1.0), ("median", 1.0)])
def test_blocks_do_not_change_the_blur(spark, method, strength):
    rng = np.random.default_rng(2)
    img = rng.random((17, 23))
    img[5:, 12:] = 0
    px = spark.createDataFrame([("m", int(x), int(y), float(img[y, x])) for y, x in zip(*np.nonzero(img))], "k string, px int, py int, v double")
    dims = spark.createDataFrame([("m", 23, 17), ("blank", 3, 2)], "k string, w int, h int")
    got = R.smooth(px, dims, ["k"], method, strength, block=6).collect()
    want = R.blur(img, method, strength)
    assert len(got) == 17 * 23 + 6
    assert max(abs(r.v - (want[r.py, r.px] if r.k == "m" else 0)) for r in got) < 1e-12


def test_binarize_and_dice(spark):
    vals = [0.0, 0.0, 0.2, 0.4, 0.6, 1.0]
    df = spark.createDataFrame([("m", i, 0, v) for i, v in enumerate(vals)] + [("flat", i, 0, .5) for i in range(3)], "k string, px int, py int, v double")
    on = lambda rule, p: {r.k: r.n for r in R.binarize(df, ["k"], rule, [p]).groupBy("k").agg(F.sum(F.col("on")[0].cast("int")).alias("n")).collect()}
    assert on("range", 50) == {"m": 2, "flat": 0}
    assert on("pct_all", 50) == {"m": 3, "flat": 3}
    assert on("pct_nonzero", 50) == {"m": 2, "flat": 3}
    assert on("fixed", 0.5) == {"m": 2, "flat": 3}
    c = spark.createDataFrame([(2, 2, 2), (1, 1, 0), (0, 0, 0)], "a long, b long, i long")
    d = c.select(R.dice(F.col("a"), F.col("b"), F.col("i")).alias("t"), R.dice(F.col("a"), F.col("b"), F.col("i"), 1.0).alias("m"), R.coverage(F.col("i"), F.col("a")).alias("c")).collect()
    assert [(x.t, x.m, x.c) for x in d] == [(1, 1, 100), (0, 0, 0), (None, 1, None)]


def test_raster_and_overlap(spark):
    att = spark.createDataFrame([("s", 0, 0, 0, 0.0), ("s", 1, 10, 10, 1.0), ("s", 2, 10, 0, .6)], "slide_id string, tile_idx int, x int, y int, score double")
    geo = spark.createDataFrame([("s", 40, 40, 4, 4, 15, 1.0)], "slide_id string, w int, h int, thumb_w int, thumb_h int, tile_px int, mag_ratio double")
    heat = R.rasterize_tiles(att, geo)
    assert {(r.px, r.py): round(r.v, 4) for r in heat.collect()} == {(0, 0): 0.0, (1, 1): 1.0, (1, 0): 0.6}
    full = R.fill_raster(heat, geo.select("slide_id", F.col("thumb_w").alias("w"), F.col("thumb_h").alias("h")), ["slide_id"])
    assert full.count() == 16
    scale = spark.createDataFrame([("s", .1, .1, 4, 4)], "slide_id string, sx double, sy double, thumb_w int, thumb_h int")
    polys = spark.createDataFrame([("s", "tumor", sq(10, 10, 29, 29)), ("s", "empty", sq(900, 900, 950, 950))], POLY)
    masks = R.rasterize_polygons(polys, scale)
    assert {(r.px, r.py) for r in masks.collect()} == {(1, 1), (2, 1), (1, 2), (2, 2)}
    o = {(r.tissue, r.metric): r.value for r in R.slide_overlap(full, masks, polys, (50,)).collect()}
    assert o[("tumor", "dice")] == pytest.approx(2 * 1 / (2 + 4))
    assert o[("tumor", "coverage")] == 25.0 and o[("empty", "coverage")] is None and o[("empty", "dice")] == 0.0
    n = {r.tissue: r.n_px for r in R.pixel_counts(full, masks).collect()}
    assert n == {"heat": 2, "tumor": 4}


def test_polygon_hole_is_even_odd(spark):
    scale = spark.createDataFrame([("s", 1.0, 1.0, 12, 12)], "slide_id string, sx double, sy double, thumb_w int, thumb_h int")
    polys = spark.createDataFrame([("s", "t", sq(0, 0, 10, 10)), ("s", "t", sq(3, 3, 7, 7))], POLY)
    px = {(r.px, r.py) for r in R.rasterize_polygons(polys, scale).collect()}
    assert (5, 5) not in px and (3, 5) in px and (1, 1) in px and (10, 10) in px and (11, 5) not in px


def test_map_overlap_symmetry_and_empty(spark):
    rng = np.random.default_rng(0)
    rows = [(m, "t", x, y, float(rng.random())) for m in ("a", "b", "c") for x in range(6) for y in range(6)]
    df = spark.createDataFrame(rows, "model string, tile_id string, px int, py int, v double")
    got = {(r.model1, r.model2): r.dice for r in R.map_overlap(df, (70,)).collect()}
    v = {m: np.array([r[4] for r in rows if r[0] == m]) for m in "abc"}
    for (p, q), d in got.items():
        a, b = v[p] >= np.percentile(v[p], 70), v[q] >= np.percentile(v[q], 70)
        assert d == pytest.approx(2 * (a & b).sum() / (a.sum() + b.sum()))
    assert len(got) == 3
    none = R.map_overlap(df.withColumn("v", F.lit(0.1)), (0.5,), "fixed").collect()
    assert [r.dice for r in none] == [1.0] * 3
    assert R.map_overlap_summary(R.map_overlap(df, (70,))).count() == 3


def test_regions_and_erosion(spark):
    px = [(0, 0), (1, 0), (0, 1), (3, 3), (4, 4), (4, 3), (2, 1 + 1)]
    m = spark.createDataFrame([("s", x, y) for x, y in px], "k string, px int, py int")
    four = {(r.px, r.py): r.component for r in R.region_components(m, ["k"], 4).collect()}
    assert len(set(four.values())) == 3 and four[(0, 0)] == four[(0, 1)] and four[(3, 3)] == four[(4, 4)] != four[(2, 2)]
    eight = {(r.px, r.py): r.component for r in R.region_components(m, ["k"], 8).collect()}
    assert eight[(2, 2)] == eight[(3, 3)] and len(set(eight.values())) == 2
    u = spark.createDataFrame([("s", x, y) for x, y in [(0, 0), (2, 0), (0, 1), (1, 1), (2, 1)]], "k string, px int, py int")
    assert R.region_components(u, ["k"], 4).select("component").distinct().count() == 1
    rng = np.random.default_rng(1)
    img = rng.random((20, 20)) < 0.55
    r = spark.createDataFrame([("s", int(x), int(y)) for y, x in zip(*np.nonzero(img))], "k string, px int, py int")
    seen, label = {}, 0
    for y, x in zip(*np.nonzero(img)):
        if (x, y) not in seen:
            stack = [(x, y)]
            while stack:
                p = stack.pop()
                if p in seen:
                    continue
                seen[p] = label
                stack += [q for q in [(p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)]
                          if 0 <= q[0] < 20 and 0 <= q[1] < 20 and img[q[1], q[0]]]
            label += 1
    for block in (512, 6):
        got = {(a.px, a.py): a.component for a in R.region_components(r, ["k"], 4, block=block).collect()}
        assert got == {(int(a), int(b)): c for (a, b), c in seen.items()}
    diag = spark.createDataFrame([("s", i, i) for i in range(9)] + [("s", 20, 0)], "k string, px int, py int")
    assert {a.component for a in R.region_components(diag, ["k"], 8, block=3).collect() if a.px == a.py} == {0}
    block = spark.createDataFrame([("s", x, y) for x in range(5) for y in range(4)], "k string, px int, py int")
    assert {(a.px, a.py) for a in R.erode(block, ["k"], 1, 10, 10).collect()} == {(x, y) for x in range(4) for y in range(3)}


def test_votes_histogram_reports(spark):
    p = spark.createDataFrame([("s", "TUM", 0, 0, 512, 256), ("s", "STR", 256, 0, 512, 256), ("s", "BACK", 0, 0, 512, 512)], "slide_id string, label string, x0 int, y0 int, x1 int, y1 int")
    g = {(r.gx, r.gy): r.class_id for r in R.class_grid(p, ["slide_id"], "x0", "y0", "x1", "y1").collect()}
    assert g == {(0, 0): "TUM", (1, 0): "STR"}
    v = R.pixel_majority_vote(p, ["slide_id"], "x0", "y0", "x1", "y1", 1 / 256, 2, 1, exclude=("BACK",), class_id="label").collect()
    assert {(r.gx, r.gy): r.class_id for r in v} == {(0, 0): "TUM", (1, 0): "STR"}
    h = [r["count"] for r in R.histogram(spark.createDataFrame([("k", x) for x in (0., 1., 1., 10.)], "k string, v double"), ["k"], "v", 10).orderBy("bin").collect()]
    assert h == [1, 2, 0, 0, 0, 0, 0, 0, 0, 1]
    s = spark.createDataFrame([("PRUNED", 25, 5., 1.), ("b", 25, 9., 9.), ("a", 25, 9., 2.)], "model string, percentile int, mean_tumor_cov double, mean_benign_cov double")
    assert {r.model: r["rank"] for r in P.rank_models(s, "mean_tumor_cov").collect()} == {"a": 1, "b": 2, "PRUNED": 3}
    ag = {r.model: (r.rank_sum, r["rank"]) for r in P.aggregated_rank(s, "mean_tumor_cov", P.detect_other(s.columns)).collect()}
    assert ag == {"a": (3, 1), "PRUNED": (4, 2), "b": (5, 3)}
    c = P.reshape_coverage(s, ["tumor", "normal"]).collect()
    assert len(c) == 6 and {r.model for r in c if r.model_order == 0} == {"PRUNED"}
    one = R.overlap_summary(spark.createDataFrame([("t", 1, "m", 5.0), ("t", 2, "m", None)], "tissue string, percentile int, metric string, value double"))
    assert {r.percentile: (r["mean"], r["std"], r.n_valid) for r in one.collect()} == {1: (5.0, 0.0, 1), 2: (None, None, 0)}


def test_lines_are_dealt_by_what_they_hold(spark):
    """Tasks follow the number of pixels, not the bytes of a shuffle; a line of a mask is one row until it is given out."""
    df = spark.range(100).select((F.col("id") % 50).alias("k"), F.lit(10).alias("n"))
    assert spread(df, F.col("n"), ["k"], each=40).rdd.getNumPartitions() == 25
    polys = spark.createDataFrame([("a", "t", [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)])], "slide_id string, tissue string, verts array<struct<x:double,y:double>>")
    scale = spark.createDataFrame([("a", 1.0, 1.0, 20, 20)], "slide_id string, sx double, sy double, thumb_w int, thumb_h int")
    mask = R.rasterize_polygons(polys, scale)
    plan = mask._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3  # both sides of the scale's join, and the lines
    assert mask.count() == mask.distinct().count() == 100
    for r in (1, 3):
        got = {(x.px, x.py) for x in R.erode(mask, ["slide_id", "tissue"], r, 20, 20).collect()}
        assert got == {(x, y) for x in range(10 - r) for y in range(10 - r)}


def test_tiles_over_several_strips(spark):
    """Tiles of ten lines over strips of sixteen: later ones overwrite, sparse heat gives the overlap of the filled map, no pixel is shuffled."""
    rng = np.random.default_rng(4)
    rows = [(s, i, int(rng.integers(0, 41)) * 10, int(rng.integers(0, 41)) * 10, float(rng.random())) for s in ("s", "t") for i in range(25)]
    att = spark.createDataFrame(rows, "slide_id string, tile_idx int, x int, y int, score double")
    geo = spark.createDataFrame([(s, 400, 1400, 40, 140, 100, 1.0) for s in ("s", "t", "bare")], "slide_id string, w int, h int, thumb_w int, thumb_h int, tile_px int, mag_ratio double")
    img = {}
    for s in ("s", "t"):
        of = [r[4] for r in rows if r[0] == s]
        for _, i, x, y, v in sorted(r for r in rows if r[0] == s):
            for px in range(x // 10, min(40, x // 10 + 10)):
                for py in range(y // 10, min(140, y // 10 + 10)):
                    img[s, px, py] = (v - min(of)) / (max(of) - min(of) + 1e-6)
    heat = R.rasterize_tiles(att, geo)
    got = heat.collect()
    assert len(got) == len(img) and max(abs(r.v - img[r.slide_id, r.px, r.py]) for r in got) < 1e-12
    sent = [line for line in heat._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert sent and not any(" px#" in line or "(px#" in line for line in sent)
    size = geo.select("slide_id", F.col("thumb_w").alias("w"), F.col("thumb_h").alias("h"))
    polys = spark.createDataFrame([("s", "tumor", sq(35, 35, 290, 380)), ("s", "normal", sq(200, 300, 390, 1390)), ("t", "tumor", sq(0, 0, 120, 150)), ("bare", "tumor", sq(0, 0, 50, 50))], POLY)
    scale = size.select("slide_id", F.lit(.1).alias("sx"), F.lit(.1).alias("sy"), F.col("w").alias("thumb_w"), F.col("h").alias("thumb_h"))
    masks = R.rasterize_polygons(polys, scale)
    key = lambda d: sorted((r.slide_id, r.tissue, r.percentile, r.metric, r.value) for r in d.filter("value is not null").collect())
    sparse = key(R.slide_overlap(heat, masks, polys, (25, 50), dims=size))
    assert sparse == key(R.slide_overlap(R.fill_raster(heat, size, ["slide_id"]), masks, polys, (25, 50))) and len(sparse) >= 18
    on = {p for p in img if p[0] == "s" and img[p] >= .5 * max(v for q, v in img.items() if q[0] == "s")}
    tumor = {("s", r.px, r.py) for r in masks.filter("slide_id = 's' and tissue = 'tumor'").collect()}
    assert dict(((s[0], s[1], s[2], s[3]), s[4]) for s in sparse)["s", "tumor", 50, "dice"] == pytest.approx(2 * len(on & tumor) / (len(on) + len(tumor)))


def test_regions_of_many_small_maps_together(spark, monkeypatch):
    """Blocks of several maps labelled in one pile give what each gives alone."""
    rng = np.random.default_rng(6)
    px = sorted({(f"m{i % 9}", int(x), int(y)) for i, (x, y) in enumerate(rng.integers(0, 14, (900, 2)))})
    df = spark.createDataFrame(px + px[:40], "k string, px int, py int")
    got = {}
    for pixels in (20, 10_000):
        monkeypatch.setattr(R, "BLOCK_PIXELS", pixels)
        got[pixels] = {(r.k, r.px, r.py): r.component for r in R.region_components(df, ["k"], 4, block=5).collect()}
    assert got[20] == got[10_000] and len(got[20]) == len(px)
    for k in {p[0] for p in px}:
        left, number = sorted((y, x) for m, x, y in px if m == k), 0
        while left:
            todo = [left[0]]
            while todo:
                y, x = todo.pop()
                if (y, x) in left:
                    left.remove((y, x))
                    assert got[20][k, x, y] == number
                    todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
            number += 1
