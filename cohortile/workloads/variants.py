"""Named parameter values that the main queries leave out, and invariants of
results that have no closed SQL form."""

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import clustering as K
from ..operators import geometry as G
from ..operators import metrics as M
from ..operators import raster as R
from ..session import r6
from ..sources import readers as I
from . import classifier as C
from . import embedding as B
from . import maps as P
from . import standins as D
from .registry import query

RULES = {"f1": "round(f1, 6) desc nulls last", "f1_auc": "round(f1, 6) desc nulls last, round(auc, 6) desc nulls last", "auc": "round(auc, 6) desc nulls last",
         "auc_accuracy": "round(case when some_auc is not null then auc else accuracy end, 6) desc nulls last"}


@query("best_fold_rules", f"""with {C.FOLD_SQL}, t as (select *, max(auc) over (partition by model) as some_auc from metrics where split = 'test')
""" + " union all ".join(f"(select '{r}' as rule, model, fold from t qualify row_number() over (partition by model order by {o}, fold) = 1)" for r, o in RULES.items()))
def best_fold_rules(spark, sf):
    m = C.fold_metrics(spark, sf)
    out = None
    for r in RULES:
        b = M.best_fold(m, r).select(F.lit(r).alias("rule"), "model", "fold")
        out = b if out is None else out.unionByName(b)
    return out


@query("binary_f1", f"""with {D.SQL_PREDS}, {D.SQL_SPLITS}
select model, fold, split, round(coalesce(2.0::double * count(*) filter (label = 1 and pred = 1) / nullif(count(*) filter (label = 1) + count(*) filter (pred = 1), 0), 0), 6) as f1
from preds join splits using (slide_id) group by 1, 2, 3""")
def binary_f1(spark, sf):
    m = M.fold_metrics(D.preds(spark, sf).drop("label"), D.labels(spark, sf), D.splits(spark, sf), f1="binary")
    return m.select("model", "fold", "split", r6("f1").alias("f1"))


@query("task_labels", """with p as (select p_partkey, p_size % 12 as grade, case p_size % 6 when 0 then 'T' when 1 then 't2b' when 2 then 'T4' when 3 then 'N1' when 4 then 'T3a' else 'T9' end as stage from part)
select p_partkey, case when grade <= 7 then 0 when grade <= 10 then 1 end as prostate, case when grade in (1, 2) then 0 when grade in (3, 4) then 1 end as rectal, grade as plain,
  cast(nullif(regexp_extract(stage, '^[Tt]([1-4])', 1), '') as integer) as stage from p""")
def task_labels(spark, sf):
    grade = (F.col("p_size") % 12).cast("int")
    texts = ["T", "t2b", "T4", "N1", "T3a", "T9"]
    stage = F.get(F.array(*[F.lit(t) for t in texts]), (F.col("p_size") % 6).cast("int"))
    return D.table(spark, sf, "part").select("p_partkey", X.remap_task_label(grade, "prostate").alias("prostate"), X.remap_task_label(grade, "rectal").alias("rectal"),
                                             X.remap_task_label(grade, "none").alias("plain"), X.parse_stage(stage).alias("stage"))


@query("boundary_sides_edge", P.BOUNDARY_SQL.replace("else false", "else true"))
def boundary_sides_edge(spark, sf):
    g = P._grid(spark, sf).select("slide_id", F.col("gy").alias("r"), F.col("gx").alias("c"), F.col("class_id").alias("label"), F.lit(1).alias("ord"))
    return G.boundary_sides(g, ["slide_id"], 22, 42, edge_is_border=True)


@query("smooth_uniform", f"""with {P.PIX_SQL}, k(o) as (values (-1), (0), (1)),
refl as (select i, o, case when i + o < 0 then 0 when i + o >= {P.SIDE} then {P.SIDE - 1} else i + o end as j from (select cast(unnest(range(0, {P.SIDE})) as integer) as i), k)
select f.model, f.tile_id, rx.i as px, ry.i as py, round(avg(f.v), 6) as v from refl rx join full_pix f on f.px = rx.j join refl ry on f.py = ry.j group by 1, 2, 3, 4""")
def smooth_uniform(spark, sf):
    p, d = P.sparse(spark, sf)
    return R.smooth(p, d, ["model", "tile_id"], "uniform", 1.0).select("model", "tile_id", "px", "py", r6("v").alias("v"))


def _mirror(n, name):
    return (f"{name} as (select i, o, w, case when i + o < 0 then -(i + o) - 1 when i + o >= {n} then {2 * n - 1} - (i + o) else i + o end as j "
            f"from (select cast(unnest(range(0, {n})) as integer) as i), k)")


_HEAD, _, _TAIL = P.OVERLAP_SQL.partition("rng as (")
BLUR_SQL = (_HEAD.replace("fh as (", "f0 as (") + f"k(o, w) as (values {P._gauss()}), {_mirror(P.W, 'mx')}, {_mirror(P.H, 'my')},\n"
            "f1 as (select slide_id, px, i as py, sum(v * w) as v from my join f0 on py = j group by 1, 2, 3),\n"
            "fh as (select slide_id, i as px, py, greatest(0, least(1, sum(v * w))) as v from mx join f1 on px = j group by 1, 2, 3),\nrng as (" + _TAIL)


@query("slide_overlap_blurred_counts", f"""with {BLUR_SQL} select tissue, percentile, metric, count(value) as n, round(avg(value), 2) as mean from lng group by 1, 2, 3""")
def slide_overlap_blurred_counts(spark, sf):
    """Blurred values differ in their last digits between engines, so means are compared."""
    o = P.slide_overlap_blurred(spark, sf)
    return o.groupBy("tissue", "percentile", "metric").agg(F.count("value").alias("n"), F.round(F.avg("value"), 2).alias("mean"))


@query("region_sizes", f"""with recursive {P.POLY_SQL}, {P.MASK_SQL}, m as (select slide_id, tissue, px, py, (py * 4294967296 + px)::bigint as id from mask),
near as (select a.slide_id, a.tissue, a.id as x, b.id as y from m a join m b on a.slide_id = b.slide_id and a.tissue = b.tissue and abs(a.px - b.px) + abs(a.py - b.py) = 1),
lab as (select slide_id, tissue, id, id as root, 0 as step from m
  union all select * from (select l.slide_id, l.tissue, l.id, least(min(l.root), min(n2.root)) as root, max(l.step) + 1 as step
    from lab l left join near on near.slide_id = l.slide_id and near.tissue = l.tissue and near.x = l.id
    left join lab n2 on n2.slide_id = l.slide_id and n2.tissue = l.tissue and n2.id = near.y where l.step < {P.W + P.H} group by 1, 2, 3)),
last as (select slide_id, tissue, id, min(root) as root from lab group by 1, 2, 3)
select slide_id, tissue, (dense_rank() over (partition by slide_id, tissue order by root) - 1)::integer as component, count(*) as n from last group by slide_id, tissue, root""")
def region_sizes(spark, sf):
    return P.region_components(spark, sf).groupBy("slide_id", "tissue", "component").agg(F.count("*").alias("n"))


@query("pca_invariants", f"""with {D.SQL_TILES}, x as (select model, tile_idx, [v::double for v in features] as f from tiles),
m as (select model, i, avg(f[i]) as mu, count(*) as n from x, (select unnest(range(1, 33)) as i) group by 1, 2)
select model, max(n)::bigint as n, round(sum(v), 3) as total_variance, 0.0::double as largest_mean, 0.0::double as largest_correlation
from (select x.model, i, any_value(n) as n, sum((f[i] - mu) * (f[i] - mu)) / (any_value(n) - 1) as v from x join m on x.model = m.model group by 1, 2) group by 1""")
def pca_invariants(spark, sf):
    """All 32 components keep the total variance, have mean 0 and are uncorrelated."""
    from ..operators.clustering import pca_project
    p = pca_project(D.tiles(spark, sf), ["model"], "features", 32)
    v = p.select("model", "tile_idx", F.posexplode("pcs").alias("i", "v"))
    one = v.groupBy("model", "i").agg(F.var_samp("v").alias("var"), F.abs(F.avg("v")).alias("mean"), F.count("*").alias("n"))
    nxt = v.select("model", "tile_idx", (F.col("i") - 1).alias("i"), F.col("v").alias("w"))
    rho = v.join(nxt, ["model", "tile_idx", "i"]).groupBy("model", "i").agg(F.abs(F.corr("v", "w")).alias("rho")).groupBy("model").agg(F.max("rho").alias("rho"))
    all_ = one.groupBy("model").agg(F.max("n").alias("n"), F.round(F.sum("var"), 3).alias("total_variance"), (F.round(F.max("mean"), 6) + 0.0).alias("largest_mean"))
    return all_.join(rho, "model").select("model", "n", "total_variance", "largest_mean", (F.round("rho", 6) + 0.0).alias("largest_correlation"))


_EIGHT = """near as (select a.slide_id, a.tissue, a.id as x, b.id as y from m a join m b on a.slide_id = b.slide_id and a.tissue = b.tissue and a.id <> b.id
 and abs(a.px - b.px) <= 1 and abs(a.py - b.py) <= 1),"""


@query("region_sizes_8", f"""with recursive {P.POLY_SQL}, {P.MASK_SQL}, m as (select slide_id, tissue, px, py, (py * 4294967296 + px)::bigint as id from mask where (px + py) % 7 <> 0 and (px - py) % 5 <> 0),
{_EIGHT}
lab as (select slide_id, tissue, id, id as root, 0 as step from m
  union all select * from (select l.slide_id, l.tissue, l.id, least(min(l.root), min(n2.root)) as root, max(l.step) + 1 as step
    from lab l left join near on near.slide_id = l.slide_id and near.tissue = l.tissue and near.x = l.id
    left join lab n2 on n2.slide_id = l.slide_id and n2.tissue = l.tissue and n2.id = near.y where l.step < {P.W + P.H} group by 1, 2, 3)),
last as (select slide_id, tissue, id, min(root) as root from lab group by 1, 2, 3)
select slide_id, tissue, (dense_rank() over (partition by slide_id, tissue order by root) - 1)::integer as component, count(*) as n from last group by slide_id, tissue, root""")
def region_sizes_8(spark, sf):
    """Masks cut by diagonals, whose pieces meet at corners only."""
    cut = P.masks(spark, sf).filter("(px + py) % 7 <> 0 and (px - py) % 5 <> 0")
    return R.region_components(cut, ["slide_id", "tissue"], 8).groupBy("slide_id", "tissue", "component").agg(F.count("*").alias("n"))


@query("vote_decided_ensemble", f"""with {D.SQL_PREDS}, {C._combo_sql()},
v as (select combo, slide_id, label, pred, count(*) as n from preds join combos using (model) group by all),
w as (select combo, slide_id, label, arg_max(pred, (n, -pred)) as pred from v group by all),
e as (select combo, slide_id, label, round(avg(score), 6) as score from preds join combos using (model) group by all)
select combo, slide_id, label, score, pred from e join w using (combo, slide_id, label)""")
def vote_decided_ensemble(spark, sf):
    p = D.preds(spark, sf)
    out = M.mean_prob_ensemble(p, M.model_combinations(p.select("model"), (2, 3)), decide="vote")
    return out.select("combo", "slide_id", "label", r6("score").alias("score"), "pred")


_SLIDE_SIL = f"""{B.DIST_SQL.replace("select model, tile_idx", "select slide_id, model, tile_idx")},
n as (select slide_id, model, class, count(*) as n from pt group by 1, 2, 3),
s as (select a.slide_id, a.model, a.tile_idx, a.class as own, b.class as other, sum(list_distance(a.f, b.f)) as d from pt a join pt b using (slide_id, model) group by 1, 2, 3, 4, 5),
m as (select s.*, n.n, case when own = other then d / nullif(n.n - 1, 0) else d / n.n end as mean from s join n on n.slide_id = s.slide_id and n.model = s.model and n.class = s.other),
ab as (select slide_id, model, tile_idx, max(mean) filter (own = other) as a, min(mean) filter (own <> other) as b, max(n) filter (own = other) as own_n from m group by 1, 2, 3)"""


@query("slide_silhouettes", f"""with {_SLIDE_SIL}, c as (select slide_id, model, count(*) filter (class = 1) as n_pos, count(*) filter (class = 0) as n_neg from pt group by 1, 2),
sc as (select slide_id, model, avg(case when b is null then null when own_n <= 1 then 0 else (b - a) / greatest(a, b) end) as sil from ab group by 1, 2)
select slide_id, model, n_pos, n_neg, round(sil, 6) as silhouette from c left join sc using (slide_id, model)""")
def slide_silhouettes(spark, sf):
    t = D.tiles(spark, sf)
    return K.slide_cluster_summary(t, K.silhouette(t, ["slide_id", "model"], "tile_idx", "features", "class")).select(
        "slide_id", "model", "n_pos", "n_neg", r6("silhouette").alias("silhouette"))


@query("annotation_dialects", f"""with {P.POLY_SQL}, d as (select unnest(['all', 'union', 'color']) as dialect)
select dialect, slide_id, case dialect when 'all' then 'normal' when 'union' then 'tumor' else case when tissue = 'tumor' then 'tumor' else 'benign' end end as tissue,
count(*) as regions, cast(count(*) * 6 as bigint) as vertices from poly, d group by 1, 2, 3""")
def annotation_dialects(spark, sf):
    """The same documents read by each dialect: every region as one tissue, both colours as tumor, colours told apart."""
    docs, out = P.annotation_documents(spark, sf), None
    for d in ("all", "union", "color"):
        one = I.parse_annotations(docs, dialect=d, tissue="normal").groupBy(F.lit(d).alias("dialect"), "slide_id", "tissue").agg(
            F.count(F.lit(1)).alias("regions"), F.sum(F.size("verts")).alias("vertices"))
        out = one if out is None else out.unionByName(one)
    return out
