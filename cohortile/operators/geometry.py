"""Polygons, tiles and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.blocks import spread
from ..session import durable


def edges(verts):
    """array<struct(x1, y1, x2, y2)> of a closed polygon."""
    nxt = F.concat(F.slice(verts, 2, F.size(verts)), F.slice(verts, 1, 1))
    return F.zip_with(verts, nxt, lambda a, b: F.struct(
        a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def point_in_polygon(px, py, verts):
    """Ray casting, half-open in y; a point on the right border counts as in."""
    def crosses(e):
        spans = (py > F.least(e["y1"], e["y2"])) & (py <= F.greatest(e["y1"], e["y2"])) & (px <= F.greatest(e["x1"], e["x2"]))
        at = (py - e["y1"]) * (e["x2"] - e["x1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
        return spans & ((e["x1"] == e["x2"]) | (px <= at))

    hits = F.aggregate(edges(verts), F.lit(0), lambda n, e: n + F.coalesce(crosses(e), F.lit(False)).cast("int"))
    return hits % 2 == 1


def box_meets_polygon(x0, y0, x1, y1, verts):
    """True polygon-box intersection: an edge touches the box, or the box lies
    inside. An edge misses the box when their extents are apart or all corners
    are on one side of it."""
    def touches(e):
        apart = (F.greatest(e["x1"], e["x2"]) < x0) | (F.least(e["x1"], e["x2"]) > x1) | (
            F.greatest(e["y1"], e["y2"]) < y0) | (F.least(e["y1"], e["y2"]) > y1)
        side = lambda x, y: (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        s = [side(x, y) for x in (x0, x1) for y in (y0, y1)]
        return ~apart & (F.least(*s) <= 0) & (F.greatest(*s) >= 0)

    return F.exists(edges(verts), touches) | point_in_polygon(x0, y0, verts)


def with_bounds(polygons: DataFrame) -> DataFrame:
    """Add the polygon's extent; fewer than three vertices are dropped."""
    xs, ys = F.transform("verts", lambda v: v["x"]), F.transform("verts", lambda v: v["y"])
    return polygons.filter(F.size("verts") >= 3).select(
        "*", F.array_min(xs).alias("bx0"), F.array_max(xs).alias("bx1"), F.array_min(ys).alias("by0"), F.array_max(ys).alias("by1"))


def _cells(lo, hi, cell):
    return F.sequence(F.floor(lo / cell), F.floor(hi / cell))


def outline_tables(polygons: DataFrame, cell: float) -> tuple[DataFrame, DataFrame]:
    """(extents, lines): every polygon's extent with a number, without its
    vertices, and its edges by the rows of ``cell`` they pass through."""
    whole = durable(with_bounds(polygons).withColumn("_pid", F.monotonically_increasing_id()))
    lines = whole.select("slide_id", "_pid", F.explode(edges(F.col("verts"))).alias("_e")).select("slide_id", "_pid", "_e.*")
    rows = F.sequence(F.floor(F.least("y1", "y2") / cell), F.floor(F.greatest("y1", "y2") / cell))
    names = {"x1": "ex1", "y1": "ey1", "x2": "ex2", "y2": "ey2"}
    return whole.drop("verts"), lines.withColumn("_row", F.explode(rows)).withColumnsRenamed(names)


def crosses_right(px, py):
    """The edge of a ``lines`` row meets the ray from the point to the right, by
    the rule of ``point_in_polygon``."""
    x1, y1, x2, y2 = (F.col(c) for c in ("ex1", "ey1", "ex2", "ey2"))
    spans = (py > F.least(y1, y2)) & (py <= F.greatest(y1, y2)) & (px <= F.greatest(x1, x2))
    at = (py - y1) * (x2 - x1) / F.nullif(y2 - y1, F.lit(0.0)) + x1
    return F.coalesce(spans & ((x1 == x2) | (px <= at)), F.lit(False))


def touches_box(x0, y0, x1, y1):
    """The edge of a ``lines`` row touches the box, by the rule of ``box_meets_polygon``."""
    a1, b1, a2, b2 = (F.col(c) for c in ("ex1", "ey1", "ex2", "ey2"))
    apart = (F.greatest(a1, a2) < x0) | (F.least(a1, a2) > x1) | (F.greatest(b1, b2) < y0) | (F.least(b1, b2) > y1)
    s = [(a2 - a1) * (y - b1) - (b2 - b1) * (x - a1) for x in (x0, x1) for y in (y0, y1)]
    return ~apart & (F.least(*s) <= 0) & (F.greatest(*s) >= 0)


def label_tiles_by_polygon(tiles: DataFrame, polygons: DataFrame, side, mode="exact", priority=("tumor", "normal"),
                           require_both=True, cell=None, ids=("slide_id", "tile_idx")) -> DataFrame:
    """Tissue of each tile box that meets a polygon; the first tissue in
    ``priority`` wins. ``mode="bbox"`` accepts overlapping extents.

    A tile lies in the coarse square cell of its corner; a polygon's extent, made
    larger by a tile's side, is cut into such cells. They are joined on
    (slide, cell): only neighbours are compared, a pair meets once, and a slide
    with very many tiles spreads over its cells instead of landing on one task.
    What is left meets the polygon's edges of the same rows only: one that touches
    the box decides, else the parity of those on the line through the box's
    corner. Tiles are dealt by their number.
    """
    ids = list(ids)
    cell = float(cell or 8 * side)
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("tissue"))
    x1, y1 = F.col("x") + side, F.col("y") + side
    t = durable(tiles.select(*ids, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    n = t.count()
    t = t.withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)})
    t = spread(t, None, ["slide_id", "_cx", "_cy"], total=n).withColumns({"x1": x1, "y1": y1})
    known = polygons.withColumn("_rank", rank).filter(F.col("_rank") > 0).select("slide_id", "verts", "_rank")
    extents, lines = outline_tables(known, cell) if mode == "exact" else (with_bounds(known).drop("verts"), None)
    p = extents.withColumn("_cx", F.explode(_cells(F.col("bx0") - side, F.col("bx1"), cell))).withColumn(
        "_cy", F.explode(_cells(F.col("by0") - side, F.col("by1"), cell)))
    near = (F.col("x") <= F.col("bx1")) & (F.col("x1") >= F.col("bx0")) & (F.col("y") <= F.col("by1")) & (F.col("y1") >= F.col("by0"))
    hit = t.join(p, ["slide_id", "_cx", "_cy"]).filter(near)
    if mode == "exact":
        first = F.floor(F.col("y") / cell)
        pairs = hit.select(*ids, "x", "y", "x1", "y1", "_pid", "_rank", F.explode(F.sequence(first, F.floor(F.col("y1") / cell))).alias("_row"))
        met = pairs.join(lines, ["slide_id", "_pid", "_row"]).groupBy(*ids, "x", "y", "_pid", "_rank").agg(
            F.max(touches_box(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"))).alias("_touch"),
            F.sum((crosses_right(F.col("x"), F.col("y")) & (F.col("_row") == first)).cast("int")).alias("_cross"))
        hit = met.filter("_touch or _cross % 2 = 1")
    else:  # one row a tile leaves its cell
        hit = hit.groupBy(*dict.fromkeys([*ids, "slide_id", "_cx", "_cy"])).agg(F.min("_rank").alias("_rank"))
    hit = spread(hit.select(*ids, "_rank"), None, ids, total=n)
    best = hit.groupBy(*ids).agg(F.min("_rank").cast("int").alias("_rank"))
    out = best.select(*ids, F.element_at(F.array(*[F.lit(q) for q in priority]), F.col("_rank")).alias("tissue"))
    if require_both:
        ok = out.groupBy("slide_id").agg(F.count_distinct("tissue").alias("_k")).filter(F.col("_k") == len(priority))
        out = out.join(ok.select("slide_id"), "slide_id", "left_semi")
    return out


def points_in_any(points: DataFrame, polygons: DataFrame, cell: float, ids=("point_id",)) -> DataFrame:
    """Points (slide_id, ids, px, py) inside at least one polygon of their slide:
    by extent and cell first, then by the parity of the edges in the point's row."""
    pts = points.select("slide_id", *[c for c in dict.fromkeys([*ids, "px", "py"])]).withColumns({"_cx": F.floor(F.col("px") / cell), "_cy": F.floor(F.col("py") / cell)})
    extents, lines = outline_tables(polygons.select("slide_id", "verts"), cell)
    p = extents.withColumn("_cx", F.explode(_cells(F.col("bx0"), F.col("bx1"), cell))).withColumn(
        "_cy", F.explode(_cells(F.col("by0"), F.col("by1"), cell)))
    near = F.col("px").between(F.col("bx0"), F.col("bx1")) & F.col("py").between(F.col("by0"), F.col("by1"))
    j = pts.join(p, ["slide_id", "_cx", "_cy"]).filter(near).withColumnRenamed("_cy", "_row").join(lines, ["slide_id", "_pid", "_row"])
    inside = j.groupBy("slide_id", *dict.fromkeys([*ids, "px", "py"]), "_pid").agg(F.sum(crosses_right(F.col("px"), F.col("py")).cast("int")).alias("_cross"))
    return inside.filter("_cross % 2 = 1").select("slide_id", *ids).distinct()


SIDES = (("top", -1, 0), ("bottom", 1, 0), ("left", 0, -1), ("right", 0, 1))


def boundary_sides(grid: DataFrame, keys, rows: int, cols: int, label="label", order="ord", edge_is_border=False) -> DataFrame:
    """Per occupied cell which sides are borders: the neighbour inside the grid is
    empty or has another label. Cells tell their neighbours their label, so one
    shuffle does for all four sides; of several entries in a cell the last one
    in ``order`` is looked up."""
    keys = list(keys)
    cells = grid.groupBy(*keys, "r", "c").agg(F.max_by(label, F.col(order)).alias("_l"))
    msgs = [F.struct(F.col("r").alias("r"), F.col("c").alias("c"), F.lit("self").alias("side"), F.col("_l").alias("l"))]
    # the cell above me sees me as its bottom neighbour, and so on
    for side, dr, dc in SIDES:
        msgs.append(F.struct((F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), F.lit(side).alias("side"), F.col("_l").alias("l")))
    seen = cells.select(*keys, F.explode(F.array(*msgs)).alias("_m")).select(*keys, "_m.*")
    of = lambda s: F.max(F.when(F.col("side") == s, F.col("l")))
    agg = seen.groupBy(*keys, "r", "c").agg(of("self").alias(label), *[of(s).alias(f"_{s}") for s, _, _ in SIDES]).filter(
        F.col(label).isNotNull())
    out = []
    for s, dr, dc in SIDES:
        inside = (F.col("r") + dr).between(0, rows - 1) & (F.col("c") + dc).between(0, cols - 1)
        differs = F.coalesce(F.col(f"_{s}") != F.col(label), F.lit(True))
        out.append(F.when(inside, differs).otherwise(F.lit(bool(edge_is_border))).alias(s))
    return agg.select(*keys, "r", "c", label, *out)


def lookup_grid_class(tiles: DataFrame, grid: DataFrame, step: int) -> DataFrame:
    """Class of the grid cell a tile's corner falls in; tiles outside the grid or
    over a cell without votes give no row."""
    t = tiles.withColumns({"gx": F.floor(F.col("x") / step), "gy": F.floor(F.col("y") / step)})
    return t.join(grid.filter(F.col("class_id").isNotNull()), ["slide_id", "gx", "gy"])
