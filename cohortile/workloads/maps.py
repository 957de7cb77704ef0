"""Rasters, polygons, grids, rankings and sources on the given tables."""

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import geometry as G
from ..operators import matching as M
from ..operators import raster as R
from ..operators import reports as P
from ..operators import sampling as A
from ..operators import similarity as S
from ..plans.blocks import spread
from ..session import r6
from ..sources import readers as I
from . import standins as D
from .registry import query

SIDE = 32

# --- pixel maps: one per (event type, group of users) ----------------------------------
def pixels(spark, sf):
    e = D.table(spark, sf, "events")
    p = e.groupBy(F.col("event_type").alias("model"), F.floor(F.col("user_id") / 15).cast("string").alias("tile_id"),
                  (F.col("event_id") % SIDE).cast("int").alias("px"), (F.floor(F.col("event_id") / SIDE) % SIDE).cast("int").alias("py")).agg(
        F.round(F.max(F.least(F.lit(1.0), F.col("value") / 200.0)), 6).alias("v"))
    return p


def dims(p):
    return p.select("model", "tile_id").distinct().select("model", "tile_id", F.lit(SIDE).alias("w"), F.lit(SIDE).alias("h"))


def sparse(spark, sf):
    """Set pixels and the sizes of their maps."""
    p = pixels(spark, sf)
    return p, dims(p)


PIX_SQL = f"""pix as (select event_type as model, cast(user_id // 15 as varchar) as tile_id, cast(event_id % {SIDE} as integer) as px,
  cast((event_id // {SIDE}) % {SIDE} as integer) as py, round(max(least(1.0::double, value / 200.0::double)), 6) as v from events group by 1, 2, 3, 4),
maps as (select distinct model, tile_id from pix),
xs as (select cast(unnest(range(0, {SIDE})) as integer) as px), ys as (select cast(unnest(range(0, {SIDE})) as integer) as py),
full_pix as (select m.model, m.tile_id, px, py, coalesce(v, 0) as v from maps m cross join xs cross join ys left join pix using (model, tile_id, px, py))"""


@query("map_stats", f"""with {PIX_SQL} select model, tile_id, round(min(v), 6) as min, round(max(v), 6) as max, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std,
round(median(v), 6) as median, count(*) as n, count(*) filter (v <> 0) as n_nonzero, count(*) filter (v = 0) as n_zero,
case when max(v) > min(v) then 0.0 else min(v) end as norm_min, case when max(v) > min(v) then 1.0 else max(v) end as norm_max from full_pix group by 1, 2""")
def map_stats(spark, sf):
    p, d = sparse(spark, sf)
    s = R.map_stats(p, dims=d)
    return s.select("model", "tile_id", *[r6(c).alias(c) for c in ["min", "max", "mean", "std", "median"]], "n", "n_nonzero", "n_zero", "norm_min", "norm_max")


@query("map_stats_first", f"""with {PIX_SQL}, f as (select model, min(tile_id) as tile_id from maps group by model)
select model, tile_id, round(avg(v), 6) as mean, count(*) as n from full_pix join f using (model, tile_id) group by 1, 2""")
def map_stats_first(spark, sf):
    p, d = sparse(spark, sf)
    s = R.map_stats(p, first_only_of="tile_id", dims=d)
    return s.select("model", "tile_id", r6("mean").alias("mean"), "n")


@query("histogram", """with s as (select event_type, min(value) as lo, max(value) as hi from events group by event_type),
b as (select event_type, least(29, cast(floor((value - lo) / (hi - lo) * 30) as integer)) as bin, count(*) as c from events join s using (event_type) group by 1, 2),
slots as (select event_type, lo, hi, cast(unnest(range(0, 30)) as integer) as bin from s)
select event_type, bin, round(lo + bin * ((hi - lo) / 30), 6) as "left", coalesce(c, 0) as count from slots left join b using (event_type, bin)""")
def histogram(spark, sf):
    h = R.histogram(D.table(spark, sf, "events"), ["event_type"], "value", 30)
    return h.select("event_type", "bin", r6("left").alias("left"), "count")


@query("binarize", f"""with {PIX_SQL}, c as (select model, tile_id, quantile_cont(v, 0.9) as p90, min(v) + 0.9 * (max(v) - min(v)) as r90, quantile_cont(v, 0.5) filter (v > 0) as nz from full_pix group by 1, 2)
select model, tile_id, count(*) filter (v >= p90) as pct_all, count(*) filter (v >= nz) as pct_nonzero, count(*) filter (v >= r90) as "range", count(*) filter (v >= 0.5) as fixed
from full_pix join c using (model, tile_id) group by 1, 2""")
def binarize(spark, sf):
    p, d = sparse(spark, sf)
    keys = ["model", "tile_id"]
    out = None
    for rule, pct in (("pct_all", 90), ("pct_nonzero", 50), ("range", 90), ("fixed", 0.5)):
        n = R.binarize(p, keys, rule, [pct], d).groupBy(*keys).agg(F.sum(F.col("on")[0].cast("long")).alias(rule))
        out = n if out is None else out.join(n, keys)
    return out


OVER_SQL = f"""{PIX_SQL}, pc as (select cast(unnest([50, 70, 90]) as double) as percentile),
cut as (select model, tile_id, percentile, quantile_cont(v, [0.5, 0.7, 0.9]) as q from full_pix, pc group by 1, 2, 3),
bin as (select f.model, f.tile_id, px, py, c.percentile, v >= q[case c.percentile when 50 then 1 when 70 then 2 else 3 end] as ison from full_pix f join cut c using (model, tile_id)),
over_ as (select a.model as model1, b.model as model2, tile_id, percentile,
  coalesce(2.0::double * sum(case when a.ison and b.ison then 1 else 0 end) / nullif(sum(case when a.ison then 1 else 0 end) + sum(case when b.ison then 1 else 0 end), 0), 1.0) as dice
  from bin a join bin b using (tile_id, percentile, px, py) where a.model < b.model group by 1, 2, 3, 4)"""


@query("map_overlap", f"with {OVER_SQL} select model1, model2, tile_id, percentile, round(dice, 6) as dice from over_")
def map_overlap(spark, sf):
    p, d = sparse(spark, sf)
    o = R.map_overlap(p, (50, 70, 90), dims=d)
    return o.select("model1", "model2", "tile_id", "percentile", r6("dice").alias("dice"))


@query("map_overlap_summary", f"""with {OVER_SQL} select model1, model2, percentile, round(avg(dice), 4) as mean_dice, round(stddev_pop(dice), 4) as std_dice,
round(min(dice), 4) as min_dice, round(max(dice), 4) as max_dice, count(*) as num_tiles from over_ group by 1, 2, 3""")
def map_overlap_summary(spark, sf):
    p, d = sparse(spark, sf)
    return R.map_overlap_summary(R.map_overlap(p, (50, 70, 90), dims=d))


@query("symmetric_matrix", f"""with {OVER_SQL}, h as (select model1, model2, round(avg(dice), 6) as value from over_ where percentile = 90 group by 1, 2),
b as (select * from h union all select model2, model1, value from h), m as (select model1, round(avg(value), 9) as m from b group by 1),
pl as (select model1, cast(row_number() over (order by m desc, model1) as integer) as place from m)
select b.model1, b.model2, b.value, place from b join pl using (model1) union all select model1, model1, 1.0, place from pl""")
def symmetric_matrix(spark, sf):
    p, d = sparse(spark, sf)
    o = R.map_overlap(p, (90,), dims=d)
    pairs = o.groupBy("model1", "model2").agg(F.round(F.avg("dice"), 6).alias("dice"))
    return S.symmetric_matrix(pairs, "dice", 1.0)


def _gauss():
    k = R.gaussian_kernel(1.0)
    return ", ".join(f"({i - len(k) // 2}, {w!r}::double)" for i, w in enumerate(float(x) for x in k))


@query("smooth", f"""with {PIX_SQL}, k(o, w) as (values {_gauss()}),
refl as (select i, o, case when i + o < 0 then -(i + o) - 1 when i + o >= {SIDE} then {2 * SIDE - 1} - (i + o) else i + o end as j from (select cast(unnest(range(0, {SIDE})) as integer) as i), k),
a as (select model, tile_id, px, i as py, sum(v * w) as v from refl join k using (o) join full_pix on py = j group by 1, 2, 3, 4),
b as (select model, tile_id, i as px, py, sum(v * w) as v from refl join k using (o) join a on px = j group by 1, 2, 3, 4)
select model, tile_id, px, py, round(greatest(0, least(1, v)), 6) as v from b""")
def smooth(spark, sf):
    p = pixels(spark, sf)
    return R.smooth(p, dims(p), ["model", "tile_id"], "gaussian", 1.0).select("model", "tile_id", "px", "py", r6("v").alias("v"))


@query("smooth_median", f"""with {PIX_SQL}, k(o) as (values (-1), (0), (1)),
refl as (select i, o, case when i + o < 0 then 0 when i + o >= {SIDE} then {SIDE - 1} else i + o end as j from (select cast(unnest(range(0, {SIDE})) as integer) as i), k)
select f.model, f.tile_id, rx.i as px, ry.i as py, round(median(f.v), 6) as v from refl rx join full_pix f on f.px = rx.j join refl ry on f.py = ry.j group by 1, 2, 3, 4""")
def smooth_median(spark, sf):
    p = pixels(spark, sf)
    return R.smooth(p, dims(p), ["model", "tile_id"], "median", 1.0).select("model", "tile_id", "px", "py", r6("v").alias("v"))


# --- slides: tiles of a supplier on a 60 x 40 thumbnail ------------------------------------
TILE, W, H = 256, 60, 40


def slide_tiles(spark, sf):
    li = D.table(spark, sf, "lineitem")
    return li.select(
        F.col("l_suppkey").cast("string").alias("slide_id"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("tile_idx"),
        (F.col("l_orderkey") % W * TILE).alias("x"), (F.col("l_partkey") % H * TILE).alias("y"), F.col("l_extendedprice").alias("score"))


def geometry(spark, sf):
    return D.table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("slide_id"), F.lit(W * TILE).alias("w"), F.lit(H * TILE).alias("h"),
        F.lit(W).alias("thumb_w"), F.lit(H).alias("thumb_h"), F.lit(TILE).alias("tile_px"), F.lit(2.0).alias("mag_ratio"))


def polygons(spark, sf):
    """An L shape per part."""
    p = D.table(spark, sf, "part")
    x, y = TILE * (F.col("p_partkey") * 7 % 50), TILE * (F.col("p_size") % 35)
    s = F.lit(200) + 60 * F.col("p_size")
    v = lambda a, b: F.struct((x + a * s).cast("double").alias("x"), (y + b * s).cast("double").alias("y"))
    return p.select(
        F.floor(F.col("p_partkey") / 20).cast("string").alias("slide_id"), "p_partkey",
        F.when(F.col("p_type").isin("ECONOMY", "PROMO", "LARGE"), "tumor").otherwise("normal").alias("tissue"),
        F.array(v(0, 0), v(1, 0), v(1, 0.5), v(0.5, 0.5), v(0.5, 1), v(0, 1)).alias("verts"))


POLY_SQL = """poly as (select cast(p_partkey // 20 as varchar) as slide_id, p_partkey, case when p_type in ('ECONOMY', 'PROMO', 'LARGE') then 'tumor' else 'normal' end as tissue,
  (256 * (p_partkey * 7 % 50))::double as bx, (256 * (p_size % 35))::double as by_, (200 + 60 * p_size)::double as s from part),
shape(k, ax, ay) as (values (0, 0.0, 0.0), (1, 1.0, 0.0), (2, 1.0, 0.5), (3, 0.5, 0.5), (4, 0.5, 1.0), (5, 0.0, 1.0)),
vert as (select slide_id, p_partkey, tissue, k, bx + ax::double * s as x, by_ + ay::double * s as y, bx as bx0, bx + s as bx1, by_ as by0, by_ + s as by1 from poly, shape),
edge as (select a.slide_id, a.p_partkey, a.tissue, a.bx0, a.bx1, a.by0, a.by1, a.x as x1, a.y as y1, b.x as x2, b.y as y2 from vert a join vert b on a.p_partkey = b.p_partkey and b.k = (a.k + 1) % 6)"""
TILE_SQL = f"""tl as (select distinct cast(l_suppkey as varchar) as slide_id, (l_orderkey % {W} * {TILE})::double as x, (l_partkey % {H} * {TILE})::double as y from lineitem)"""


def _distinct_tiles(spark, sf):
    corners = slide_tiles(spark, sf).select("slide_id", "x", "y")
    return spread(corners, None, corners.columns, total=D.table(spark, sf, "lineitem").count()).distinct()


def _label_sql(hits):
    return f"""{hits}, best as (select slide_id, x, y, max(tissue) as tissue from hit group by 1, 2, 3),
ok as (select slide_id from best group by 1 having count(distinct tissue) = 2)
select slide_id, cast(x as bigint) as x, cast(y as bigint) as y, tissue from best where slide_id in (select slide_id from ok)"""


@query("tile_polygon_label", f"""with {POLY_SQL}, {TILE_SQL}, """ + _label_sql(f"""
hit as (select t.*, p.tissue from tl t join poly p using (slide_id) where t.x <= bx + s and t.x + {TILE} >= bx and t.y <= by_ + s and t.y + {TILE} >= by_)"""))
def tile_polygon_label(spark, sf):
    t = _distinct_tiles(spark, sf).select("slide_id", "x", "y", F.struct("x", "y").alias("tile_idx"))
    lab = G.label_tiles_by_polygon(t, polygons(spark, sf), TILE, "bbox")
    return lab.select("slide_id", "tile_idx.x", "tile_idx.y", "tissue")


@query("tile_polygon_label_exact", f"""with {POLY_SQL}, {TILE_SQL}, """ + _label_sql(f"""
near as (select t.*, e.* exclude (slide_id) from tl t join edge e using (slide_id) where t.x <= bx1 and t.x + {TILE} >= bx0 and t.y <= by1 and t.y + {TILE} >= by0),
sides as (select *, (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) as s1, (x2 - x1) * (y + {TILE} - y1) - (y2 - y1) * (x - x1) as s2,
  (x2 - x1) * (y - y1) - (y2 - y1) * (x + {TILE} - x1) as s3, (x2 - x1) * (y + {TILE} - y1) - (y2 - y1) * (x + {TILE} - x1) as s4 from near),
test as (select slide_id, x, y, p_partkey, tissue,
  bool_or(greatest(x1, x2) >= x and least(x1, x2) <= x + {TILE} and greatest(y1, y2) >= y and least(y1, y2) <= y + {TILE} and least(s1, s2, s3, s4) <= 0 and greatest(s1, s2, s3, s4) >= 0) as touch,
  sum(case when y > least(y1, y2) and y <= greatest(y1, y2) and x <= greatest(x1, x2) and (x1 = x2 or x <= (y - y1) * (x2 - x1) / nullif(y2 - y1, 0) + x1) then 1 else 0 end) % 2 = 1 as inside
  from sides group by 1, 2, 3, 4, 5),
hit as (select * from test where touch or inside)"""))
def tile_polygon_label_exact(spark, sf):
    t = _distinct_tiles(spark, sf).select("slide_id", "x", "y", F.struct("x", "y").alias("tile_idx"))
    lab = G.label_tiles_by_polygon(t, polygons(spark, sf), TILE, "exact")
    return lab.select("slide_id", "tile_idx.x", "tile_idx.y", "tissue")


@query("point_in_polygon", f"""with {POLY_SQL}, {TILE_SQL}, pt as (select slide_id, x + 100 as px, y + 60 as py from tl),
test as (select pt.slide_id, px, py, p_partkey, sum(case when py > least(y1, y2) and py <= greatest(y1, y2) and px <= greatest(x1, x2)
  and (x1 = x2 or px <= (py - y1) * (x2 - x1) / nullif(y2 - y1, 0) + x1) then 1 else 0 end) % 2 = 1 as inside
  from pt join edge e using (slide_id) where px between bx0 and bx1 and py between by0 and by1 group by 1, 2, 3, 4)
select distinct slide_id, cast(px as bigint) as px, cast(py as bigint) as py from test where inside""")
def point_in_polygon(spark, sf):
    pts = _distinct_tiles(spark, sf).select("slide_id", (F.col("x") + 100).alias("px"), (F.col("y") + 60).alias("py"))
    return G.points_in_any(pts, polygons(spark, sf), 2048.0, ["px", "py"])


HEAT_SQL = f"""att as (select cast(l_suppkey as varchar) as slide_id, (l_orderkey, l_linenumber, l_partkey, l_extendedprice) as tile_idx, l_orderkey % {W} as tx, l_partkey % {H} as ty, l_extendedprice as score from lineitem),
mm as (select slide_id, min(score) as mn, max(score) as mx from att group by 1),
cov as (select slide_id, tile_idx, (score - mn) / (mx - mn + 1e-6) as v, unnest(range(tx, least({W}, tx + 2))) as px, ty from att join mm using (slide_id)),
cov2 as (select slide_id, tile_idx, v, px, unnest(range(ty, least({H}, ty + 2))) as py from cov),
heat as (select slide_id, cast(px as integer) as px, cast(py as integer) as py, arg_max(v, tile_idx) as v from cov2 group by 1, 2, 3)"""


@query("tile_raster", f"with {HEAT_SQL} select slide_id, px, py, round(v, 6) as v from heat")
def tile_raster(spark, sf):
    h = R.rasterize_tiles(slide_tiles(spark, sf), geometry(spark, sf))
    return h.select("slide_id", "px", "py", r6("v").alias("v"))


MASK_SQL = f"""fe as (select slide_id, p_partkey, tissue, floor(x1 / {TILE}) as x1, floor(y1 / {TILE}) as y1, floor(x2 / {TILE}) as x2, floor(y2 / {TILE}) as y2 from edge),
bb as (select slide_id, p_partkey, tissue, min(least(x1, x2)) as x0, max(greatest(x1, x2)) as xm, min(least(y1, y2)) as y0, max(greatest(y1, y2)) as ym from fe group by 1, 2, 3),
bx as (select slide_id, p_partkey, tissue, y0, ym, unnest(range(x0::bigint, least({W - 1}, xm::bigint) + 1)) as px from bb),
bp as (select slide_id, p_partkey, tissue, px, unnest(range(y0::bigint, least({H - 1}, ym::bigint) + 1)) as py from bx),
bt as (select bp.slide_id, bp.tissue, p_partkey, px, py,
  sum(case when py > least(y1, y2) and py <= greatest(y1, y2) and px <= greatest(x1, x2) and (x1 = x2 or px <= (py - y1) * (x2 - x1) / nullif(y2 - y1, 0) + x1) then 1 else 0 end) % 2 as inside,
  max(case when px between least(x1, x2) and greatest(x1, x2) and py between least(y1, y2) and greatest(y1, y2)
    and abs((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)) <= 0.5 * greatest(abs(x2 - x1), abs(y2 - y1)) then 1 else 0 end) as edge
  from bp join fe using (p_partkey) group by 1, 2, 3, 4, 5),
mask as (select slide_id, tissue, cast(px as integer) as px, cast(py as integer) as py from bt where inside = 1 or edge = 1 group by 1, 2, 3, 4 having sum(inside) % 2 = 1 or max(edge) = 1)"""


def masks(spark, sf):
    scale = geometry(spark, sf).select("slide_id", (F.col("thumb_w") / F.col("w")).alias("sx"), (F.col("thumb_h") / F.col("h")).alias("sy"), "thumb_w", "thumb_h")
    return R.rasterize_polygons(polygons(spark, sf), scale)


@query("polygon_raster", f"with {POLY_SQL}, {MASK_SQL} select * from mask")
def polygon_raster(spark, sf):
    return masks(spark, sf)


@query("mask_dice", f"""with {POLY_SQL}, {MASK_SQL}, c as (select slide_id, px, py, max(case when tissue = 'tumor' then 1 else 0 end) as a, max(case when tissue = 'normal' then 1 else 0 end) as b from mask group by 1, 2, 3)
select slide_id, cast(sum(a) as bigint) as a_px, cast(sum(b) as bigint) as b_px, cast(sum(a * b) as bigint) as both_px, round(2.0::double * sum(a * b) / (sum(a) + sum(b)), 6) as dice from c group by 1""")
def mask_dice(spark, sf):
    m = masks(spark, sf)
    c = R.mask_counts(m.filter("tissue = 'tumor'"), m.filter("tissue = 'normal'"), ["slide_id"])
    return c.withColumn("dice", r6(R.dice(F.col("a_px"), F.col("b_px"), F.col("both_px"))))


OVERLAP_SQL = f"""{POLY_SQL}, {MASK_SQL}, {HEAT_SQL},
xs as (select cast(unnest(range(0, {W})) as integer) as px), ys as (select cast(unnest(range(0, {H})) as integer) as py),
fh as (select cast(s_suppkey as varchar) as slide_id, xs.px, ys.py, coalesce(v, 0) as v from supplier cross join xs cross join ys left join heat on heat.slide_id = cast(s_suppkey as varchar) and heat.px = xs.px and heat.py = ys.py),
rng as (select slide_id, min(v) as mn, max(v) as mx from fh group by 1),
pcs as (select cast(unnest([25, 50, 60, 70, 80, 90]) as integer) as percentile),
ob as (select fh.slide_id, px, py, percentile from fh join rng using (slide_id), pcs where mx > mn and v >= mn + (percentile / 100.0::double) * (mx - mn)),
na as (select slide_id, percentile, count(*) as a from ob group by 1, 2),
nt as (select slide_id, tissue, count(*) as t from mask group by 1, 2),
nb as (select slide_id, tissue, percentile, count(*) as b from ob join mask using (slide_id, px, py) group by 1, 2, 3),
o as (select nt.slide_id, nt.tissue, pcs.percentile, coalesce(a, 0)::double as a, t::double as t, coalesce(b, 0)::double as b from nt join rng using (slide_id) cross join pcs left join na on na.slide_id = nt.slide_id and na.percentile = pcs.percentile
      left join nb on nb.slide_id = nt.slide_id and nb.tissue = nt.tissue and nb.percentile = pcs.percentile),
lng as (select slide_id, tissue, percentile, 'dice' as metric, 2 * b / nullif(a + t, 0) as value from o union all select slide_id, tissue, percentile, 'coverage', 100 * b / nullif(t, 0) from o
        union all select slide_id, tissue, percentile, 'attention_in', 100 * b / nullif(a, 0) from o)"""


def _overlap(spark, sf):
    geo = geometry(spark, sf)
    heat = R.rasterize_tiles(slide_tiles(spark, sf), geo)
    size = geo.select("slide_id", F.col("thumb_w").alias("w"), F.col("thumb_h").alias("h"))
    return R.slide_overlap(heat, masks(spark, sf), polygons(spark, sf), dims=size)


@query("slide_overlap", f"with {OVERLAP_SQL} select slide_id, tissue, percentile, metric, round(value, 6) as value from lng")
def slide_overlap(spark, sf):
    o = _overlap(spark, sf)
    return o.select("slide_id", "tissue", "percentile", "metric", r6("value").alias("value"))


@query("overlap_summary", f"""with {OVERLAP_SQL} select tissue, percentile, metric, round(avg(value), 6) as mean,
round(case when count(value) = 1 then 0 else stddev_samp(value) end, 6) as std, count(value) as n_valid from lng group by 1, 2, 3""")
def overlap_summary(spark, sf):
    s = R.overlap_summary(_overlap(spark, sf))
    return s.select("tissue", "percentile", "metric", r6("mean").alias("mean"), r6("std").alias("std"), "n_valid")


@query("slide_overlap_blurred")
def slide_overlap_blurred(spark, sf):
    geo = geometry(spark, sf)
    heat = R.rasterize_tiles(slide_tiles(spark, sf), geo)
    blurred = R.smooth(heat, geo.select("slide_id", F.col("thumb_w").alias("w"), F.col("thumb_h").alias("h")), ["slide_id"])
    return R.slide_overlap(blurred, masks(spark, sf), polygons(spark, sf))


@query("erode", f"""with {POLY_SQL}, {MASK_SQL}, m as (select slide_id, tissue, px, py from mask),
d as (select unnest([-1, 0, 1]) as d),
n as (select m.slide_id, m.tissue, m.px, m.py, count(*) as c from m cross join d dx cross join d dy join m o on o.slide_id = m.slide_id and o.tissue = m.tissue and o.px = m.px + dx.d and o.py = m.py + dy.d group by 1, 2, 3, 4)
select slide_id, tissue, px, py from n where c = (least({W - 1}, px + 1) - greatest(0, px - 1) + 1) * (least({H - 1}, py + 1) - greatest(0, py - 1) + 1)""")
def erode(spark, sf):
    return R.erode(masks(spark, sf), ["slide_id", "tissue"], 1, W, H)


@query("region_components")
def region_components(spark, sf):
    return R.region_components(masks(spark, sf), ["slide_id", "tissue"], 4)


# --- patches --------------------------------------------------------------------------------
def patches(spark, sf):
    p = D.table(spark, sf, "part")
    x, y = 256 * (F.col("p_partkey") % 40) + 64, 256 * (F.col("p_size") % 20) + 64
    return p.select(F.floor(F.col("p_partkey") / 400).cast("string").alias("slide_id"), F.col("p_type").alias("label"),
                    x.alias("x0"), y.alias("y0"), (x + 512).alias("x1"), (y + 512).alias("y1"))


PATCH_SQL = """patch as (select cast(p_partkey // 400 as varchar) as slide_id, p_type as label, 256 * (p_partkey % 40) + 64 as x0, 256 * (p_size % 20) + 64 as y0 from part where p_type <> 'SMALL'),
cx as (select slide_id, label, y0, unnest(range(x0 // 256, (x0 + 512 - 1) // 256 + 1)) as gx from patch),
cy as (select slide_id, label, gx, unnest(range(y0 // 256, (y0 + 512 - 1) // 256 + 1)) as gy from cx),
v as (select slide_id, gx, gy, label, count(*) as n from cy group by 1, 2, 3, 4),
grid as (select slide_id, gx, gy, arg_min(label, (-n, label)) as class_id, cast(sum(n) as bigint) as votes from v group by 1, 2, 3)"""


def _grid(spark, sf):
    return R.class_grid(patches(spark, sf), ["slide_id"], "x0", "y0", "x1", "y1", exclude=("SMALL",))


@query("class_grid", f"with {PATCH_SQL} select slide_id, gx, cast(gy as bigint) as gy, class_id, votes from grid")
def class_grid(spark, sf):
    return _grid(spark, sf)


@query("pixel_vote", """with p as (select cast(p_partkey // 400 as varchar) as slide_id, p_type as label, (256 * (p_partkey % 40) + 64)::double as x0, (256 * (p_size % 20) + 64)::double as y0 from part),
b as (select slide_id, label, greatest(0, floor(x0 / 128))::bigint as a, least(70, ceil((x0 + 512) / 128))::bigint as b, greatest(0, floor(y0 / 128))::bigint as c, least(36, ceil((y0 + 512) / 128))::bigint as d from p),
cx as (select slide_id, label, c, d, unnest(range(a, b)) as gx from b), cy as (select slide_id, label, gx, unnest(range(c, d)) as gy from cx),
v as (select slide_id, gx, gy, label, count(*) as n from cy group by 1, 2, 3, 4)
select slide_id, cast(gx as integer) as gx, cast(gy as integer) as gy, arg_min(label, (-n, label)) as class_id, cast(sum(n) as bigint) as votes from v group by 1, 2, 3""")
def pixel_vote(spark, sf):
    return R.pixel_majority_vote(patches(spark, sf), ["slide_id"], "x0", "y0", "x1", "y1", 1 / 128, 70, 36, class_id="label")


@query("grid_lookup", f"""with {PATCH_SQL}, t as (select l_orderkey, l_linenumber, l_partkey, l_extendedprice, cast(l_suppkey % 5 as varchar) as slide_id, l_orderkey * 31 % 12000 as x, l_partkey * 17 % 6000 as y from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_extendedprice, class_id from t join grid on grid.slide_id = t.slide_id and gx = x // 256 and gy = y // 256""")
def grid_lookup(spark, sf):
    t = D.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", (F.col("l_suppkey") % 5).cast("string").alias("slide_id"),
        (F.col("l_orderkey") * 31 % 12000).alias("x"), (F.col("l_partkey") * 17 % 6000).alias("y"))
    return G.lookup_grid_class(t, _grid(spark, sf), 256).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "class_id")


BOUNDARY_SQL = f"""with {PATCH_SQL}, g as (select slide_id, gy as r, gx as c, class_id as label from grid)
select g.slide_id, g.r, g.c, g.label, case when g.r - 1 between 0 and 21 then coalesce(t.label <> g.label, true) else false end as top,
 case when g.r + 1 between 0 and 21 then coalesce(b.label <> g.label, true) else false end as bottom,
 case when g.c - 1 between 0 and 41 then coalesce(l.label <> g.label, true) else false end as "left",
 case when g.c + 1 between 0 and 41 then coalesce(rr.label <> g.label, true) else false end as "right"
from g left join g t on t.slide_id = g.slide_id and t.r = g.r - 1 and t.c = g.c left join g b on b.slide_id = g.slide_id and b.r = g.r + 1 and b.c = g.c
left join g l on l.slide_id = g.slide_id and l.r = g.r and l.c = g.c - 1 left join g rr on rr.slide_id = g.slide_id and rr.r = g.r and rr.c = g.c + 1"""


@query("boundary_sides", BOUNDARY_SQL)
def boundary_sides(spark, sf):
    g = _grid(spark, sf).select("slide_id", F.col("gy").alias("r"), F.col("gx").alias("c"), F.col("class_id").alias("label"), F.lit(1).alias("ord"))
    return G.boundary_sides(g, ["slide_id"], 22, 42)


# --- summaries and rankings ------------------------------------------------------------------
SUMMARY_SQL = """summ as (select event_type as model, cast(hour(ts) // 4 as integer) as percentile, avg(value) filter (user_id % 2 = 0) as mean_tumor_cov, avg(value) filter (user_id % 2 = 1) as mean_normal_cov,
 stddev_samp(value) filter (user_id % 2 = 0) as std_tumor_cov, stddev_samp(value) filter (user_id % 2 = 1) as std_normal_cov,
 count(*) filter (user_id % 2 = 0) as n_valid_tumor_cov, count(*) filter (user_id % 2 = 1) as n_valid_normal_cov from events group by 1, 2)"""


def summary(spark, sf):
    e = D.table(spark, sf, "events")
    even = F.col("user_id") % 2 == 0
    v = lambda c: F.when(c, F.col("value"))
    aggs = []
    for name, c in (("tumor", even), ("normal", ~even)):
        aggs += [F.avg(v(c)).alias(f"mean_{name}_cov"), F.stddev_samp(v(c)).alias(f"std_{name}_cov"), F.count(v(c)).alias(f"n_valid_{name}_cov")]
    return e.groupBy(F.col("event_type").alias("model"), F.floor(F.hour("ts") / 4).cast("int").alias("percentile")).agg(*aggs)


@query("rank_models", f"""with {SUMMARY_SQL} select model, percentile, round(mean_tumor_cov, 6) as coverage, cast(row_number() over (partition by percentile order by mean_tumor_cov desc, model) as integer) as rank from summ""")
def rank_models(spark, sf):
    r = P.rank_models(summary(spark, sf), "mean_tumor_cov")
    return r.select("model", "percentile", r6("mean_tumor_cov").alias("coverage"), "rank")


@query("aggregated_rank", f"""with {SUMMARY_SQL}, r as (select model, percentile, row_number() over (partition by percentile order by mean_tumor_cov desc, model) as t,
 count(*) over (partition by percentile) + 1 - row_number() over (partition by percentile order by mean_normal_cov desc, model) as o from summ)
select model, percentile, cast(t + o as integer) as rank_sum, cast(row_number() over (partition by percentile order by t + o, model) as integer) as rank from r""")
def aggregated_rank(spark, sf):
    s = summary(spark, sf)
    r = P.aggregated_rank(s, "mean_tumor_cov", P.detect_other(s.columns))
    return r.select("model", "percentile", "rank_sum", "rank")


@query("coverage_long", f"""with {SUMMARY_SQL} select model, percentile, 'tumor' as tissue, round(mean_tumor_cov, 6) as mean, round(std_tumor_cov, 6) as std, n_valid_tumor_cov::double as n from summ
union all select model, percentile, 'normal', round(mean_normal_cov, 6), round(std_normal_cov, 6), n_valid_normal_cov::double from summ""")
def coverage_long(spark, sf):
    c = P.reshape_coverage(summary(spark, sf), ["tumor", "normal"])
    return c.select("model", "percentile", "tissue", r6("mean").alias("mean"), r6("std").alias("std"), "n")


@query("combine_pivot", f"""with {SUMMARY_SQL} select model, round(max(mean_tumor_cov) filter (percentile = 0), 6) as p0, round(max(mean_tumor_cov) filter (percentile = 2), 6) as p2,
round(max(mean_tumor_cov) filter (percentile = 5), 6) as p5 from summ group by model""")
def combine_pivot(spark, sf):
    s = summary(spark, sf)
    combined = P.combine_models({m: s.filter(F.col("model") == m).drop("model") for m in ("click", "view", "error", "purchase", "signup")})
    p = P.metric_pivot(combined, "mean_tumor_cov", [0, 2, 5])
    return p.select("model", *[r6(str(c)).alias(f"p{c}") for c in (0, 2, 5)])


# --- files and annotations ---------------------------------------------------------------------
@query("pair_files", "select s_name || case when s_suppkey % 2 = 0 then '' else '_20x' end as tile_stem, s_name as attention_stem from supplier")
def pair_files(spark, sf):
    s = D.table(spark, sf, "supplier")
    tiles = s.select(F.concat("s_name", F.when(F.col("s_suppkey") % 2 == 0, "").otherwise("_20x")).alias("stem"))
    return M.pair_files(tiles, s.select(F.col("s_name").alias("stem")))


@query("match_with_fallback", """select s_name as stem, s_name || case s_suppkey % 3 when 0 then '' when 1 then '_L-1' else '_b' end as file_stem, cast(s_suppkey % 3 as integer) as priority from supplier""")
def match_with_fallback(spark, sf):
    s = D.table(spark, sf, "supplier")
    kind = F.col("s_suppkey") % 3
    ends = F.when(kind == 0, F.array(F.lit(""), F.lit("_L-1"))).when(kind == 1, F.array(F.lit("_A"), F.lit("_L-1"))).otherwise(F.array(F.lit("_c_1"), F.lit("_b")))
    files = s.select("s_name", F.explode(ends).alias("end")).select(F.concat("s_name", "end").alias("file_stem"))
    return M.match_with_fallback(s.select(F.col("s_name").alias("stem")), files)


@query("alignment_mismatches", """select o_orderkey as slide_id, o_custkey as tile_idx from orders left join customer on c_custkey = o_custkey where c_nationkey is distinct from o_orderkey % 25""")
def alignment_mismatches(spark, sf):
    o = D.table(spark, sf, "orders")
    c = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("x"))
    key = [F.col("o_orderkey").alias("slide_id"), F.col("o_custkey").alias("tile_idx")]
    a = o.select(*key, (F.col("o_orderkey") % 25).alias("x"))
    b = o.join(c, "o_custkey", "left").select(*key, "x")
    return M.alignment_mismatches(a, b, coords=["x"]).select("slide_id", "tile_idx")


@query("annotation_xml", f"""with {POLY_SQL} select slide_id, case when tissue = 'tumor' then 65280 else 65535 end as color, case when tissue = 'tumor' then 'tumor' else 'benign' end as tissue,
count(*) as regions, cast(count(*) * 6 as bigint) as vertices, round(min(bx), 6) as min_x, round(max(by_ + s), 6) as max_y from poly group by 1, 2, 3""")
def annotation_xml(spark, sf):
    """Write each slide's polygons as one XML document, then parse them back."""
    got = G.with_bounds(I.parse_annotations(annotation_documents(spark, sf), dialect="color"))
    return got.groupBy("slide_id", F.col("color").cast("int").alias("color"), "tissue").agg(
        F.count(F.lit(1)).alias("regions"), F.sum(F.size("verts")).alias("vertices"), r6(F.min("bx0")).alias("min_x"), r6(F.max("by1")).alias("max_y"))


def annotation_documents(spark, sf):
    """(slide_id, content): tumor polygons in green, the others in yellow."""
    color = F.when(F.col("tissue") == "tumor", I.TUMOR_COLOR).otherwise(I.BENIGN_COLOR)
    vert = lambda v: F.concat(F.lit('<Vertex X="'), v["x"].cast("string"), F.lit('" Y="'), v["y"].cast("string"), F.lit('"/>'))
    region = F.concat(F.lit("<Region><Vertices>"), F.array_join(F.transform("verts", vert), ""), F.lit("</Vertices></Region>"))
    per_color = polygons(spark, sf).groupBy("slide_id", color.alias("color")).agg(F.array_join(F.collect_list(region), "").alias("r")).select(
        "slide_id", F.concat(F.lit('<Annotation LineColor="'), F.col("color").cast("string"), F.lit('"><Regions>'), "r", F.lit("</Regions></Annotation>")).alias("a"))
    return per_color.groupBy("slide_id").agg(F.concat(F.lit("<Annotations>"), F.array_join(F.collect_list("a"), ""), F.lit("</Annotations>")).alias("content"))



@query("infer_dim", """with d as (select lang, len(string_split(text, ' ')) as d, count(*) as n from documents group by 1, 2)
select lang, cast(arg_max(d, (n, d)) as integer) as dim, cast(sum(n) as bigint) as n, cast(sum(n) - max(n) as bigint) as mismatched from d group by lang""")
def infer_dim(spark, sf):
    d = D.table(spark, sf, "documents").select("lang", F.split("text", " ").alias("features"))
    return I.infer_dim(d, "lang")


@query("path_metadata", """with p as (select page_id, '/data/' || case when page_id % 3 = 0 then '20x_512px/features_uni' when page_id % 3 = 1 then '40X/256px_o' else 'plain' end as path from pages)
select page_id, case page_id % 3 when 0 then 20 when 1 then 40 else 20 end as magnification, case page_id % 3 when 0 then 512 else 256 end as tile_px,
case page_id % 3 when 0 then 'uni' when 1 then '256px_o' else 'plain' end as embedding_name from p""")
def path_metadata(spark, sf):
    k = F.col("page_id") % 3
    tail = F.when(k == 0, "20x_512px/features_uni").when(k == 1, "40X/256px_o").otherwise("plain")
    p = D.table(spark, sf, "pages").select("page_id", F.concat(F.lit("/data/"), tail).alias("path"))
    return I.path_metadata(p, "path").drop("path")


@query("long_splits", f"""with {D.SQL_SPLITS} select fold, slide_id, split from splits""")
def long_splits(spark, sf):
    code = X.map_values("split", {"train": 1, "val": 2, "test": 3})
    return I.long_splits(D.splits(spark, sf).withColumn("split", code)).select(F.col("fold").cast("long").alias("fold"), "slide_id", "split")


@query("slide_params", """select s_suppkey, case when s_acctbal > 0 then cast(floor(s_acctbal) as integer) else 7 end as a_t, 'four_pt' as contour_fn from supplier where s_nationkey < 20""")
def slide_params(spark, sf):
    s = D.table(spark, sf, "supplier").select(
        "s_suppkey", (F.col("s_nationkey") < 20).cast("int").alias("process"),
        F.when(F.col("s_acctbal") > 0, F.floor("s_acctbal").cast("string")).otherwise(F.lit(" ")).alias("a_t"))
    return I.per_slide_params(s, {"a_t": 7, "contour_fn": "four_pt"})


@query("random_centers", f"""with {POLY_SQL}, {MASK_SQL}, r as (select slide_id, px, py, row_number() over (partition by slide_id
 order by md5(concat_ws('|', slide_id, cast(px as varchar), cast(py as varchar), '42')), px, py) as i from (select distinct slide_id, px, py from mask where tissue = 'tumor'))
select slide_id, (px + 0.5::double) * 256 as cx, (py + 0.5::double) * 256 as cy from r where i <= 5""")
def random_centers(spark, sf):
    return A.random_centers(masks(spark, sf).filter("tissue = 'tumor'"), "slide_id", 5, 256.0, 256.0)


@query("overlap_problems", """select cast(s_suppkey as varchar) as slide_id, 'no annotation' as reason from supplier where s_suppkey not in (select p_partkey // 20 from part where p_size > 45)""")
def overlap_problems(spark, sf):
    geo = geometry(spark, sf)
    annotated = D.table(spark, sf, "part").filter("p_size > 45").select(F.floor(F.col("p_partkey") / 20).cast("string").alias("slide_id"))
    return R.overlap_problems(geo, slide_tiles(spark, sf), annotated, geo)
