"""Embedding similarity, cluster quality and feature selection."""

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import clustering as K
from ..operators import features as E
from ..operators import similarity as S
from ..operators import training as T
from ..operators.bootstrap import draw_weights
from ..plans.draws import hash_number
from ..session import r6
from . import standins as D
from .registry import query


def _pairs(spark, sf):
    t = D.tiles(spark, sf)
    return S.match_tiles(t, "A", "B", None).withColumns({"model1": F.lit("A"), "model2": F.lit("B")})


MATCH_SQL = f"""{D.SQL_TILES},
pairs as (select a.slide_id, a.x, a.y, a.tile_idx, a.features as fx, b.features as fy from tiles a join tiles b
          on a.slide_id = b.slide_id and a.x = b.x and a.y = b.y and a.model = 'A' and b.model = 'B')"""


@query("match_tiles", f"""with {MATCH_SQL}
select slide_id, x, y from pairs qualify row_number() over (order by
 md5(concat_ws('|', slide_id, cast(x as varchar), cast(y as varchar), '42')), slide_id, x, y) <= 300""")
def match_tiles(spark, sf):
    return S.match_tiles(D.tiles(spark, sf), "A", "B", 300).select("slide_id", "x", "y")


GRAM_SQL = f"""{MATCH_SQL},
d as (select unnest(range(1, 33)) as i),
lx as (select tile_idx, i, fx[i]::double as v from pairs, d),
ly as (select tile_idx, i, fy[i]::double as v from pairs, d),
cx as (select tile_idx, i, v - avg(v) over (partition by i) as v from lx),
cy as (select tile_idx, i, v - avg(v) over (partition by i) as v from ly),
xy as (select a.i, b.i as j, sum(a.v * b.v) as value from cx a join cy b using (tile_idx) group by a.i, b.i),
xx as (select a.i, b.i as j, sum(a.v * b.v) as value from cx a join cx b using (tile_idx) group by a.i, b.i),
yy as (select a.i, b.i as j, sum(a.v * b.v) as value from cy a join cy b using (tile_idx) group by a.i, b.i)"""


@query("paired_gram", f"""with {GRAM_SQL}
select i, j, round(value, 6) as value from xx union all select i, j + 32, round(value, 6) from xy
union all select j + 32, i, round(value, 6) from xy union all select i + 32, j + 32, round(value, 6) from yy""")
def paired_gram(spark, sf):
    g = S.paired_gram(_pairs(spark, sf), ["model1"])
    return S.centred_entries(g, ["model1"]).select(F.col("i").cast("long"), F.col("j").cast("long"), r6("value").alias("value"))


@query("cka", f"""with {GRAM_SQL}, s as (select (select sum(value * value) from xy) as xy, (select sqrt(sum(value * value)) from xx) as xx,
 (select sqrt(sum(value * value)) from yy) as yy) select 'A' as model1, 'B' as model2, (select count(*) from pairs) as n, round(xy / (xx * yy + 1e-12), 6) as cka from s""")
def cka(spark, sf):
    m = S.pairwise_similarity(D.tiles(spark, sf), ["A", "B"], ["cka"], None)
    return m.select("model1", "model2", "n", r6("cka").alias("cka"))


@query("pairwise_similarity")
def pairwise_similarity(spark, sf):
    return S.pairwise_similarity(D.tiles(spark, sf), ["A", "B"], ["all"])


@query("knn_overlap", f"""with {MATCH_SQL},
k as (select row_number() over (order by slide_id || '|' || x || '|' || y) as r, slide_id || '|' || x || '|' || y as id, fx::double[] as fx, fy::double[] as fy from pairs),
dd as (select a.id, b.id as nb, round(pow(list_distance(a.fx, b.fx), 2), 9) as dx, round(pow(list_distance(a.fy, b.fy), 2), 9) as dy from k a join k b on a.id <> b.id),
nx as (select id, nb from dd qualify row_number() over (partition by id order by dx, nb) <= 10),
ny as (select id, nb from dd qualify row_number() over (partition by id order by dy, nb) <= 10),
i as (select id, count(*) as both_ from nx join ny using (id, nb) group by id),
j as (select k.id, coalesce(both_, 0)::double / (20 - coalesce(both_, 0) + 1e-12) as jac from k left join i using (id))
select 'A' as model1, 'B' as model2, round(avg(jac), 6) as knn from j""")
def knn_overlap(spark, sf):
    p = _pairs(spark, sf).withColumn("_id", F.concat_ws("|", "slide_id", "x", "y"))
    return S.knn_overlap(p, ["model1", "model2"], "_id", 10).select("model1", "model2", r6("knn").alias("knn"))


@query("pca_project")
def pca_project(spark, sf):
    z = K.pca_project(D.tiles(spark, sf), ["model"], "features", 5)
    return z.select("model", "tile_idx", *[r6(F.col("pcs")[i]).alias(f"pc{i}") for i in range(5)])


# Planes of two vector components: eigenvalues and singular values of 2 x 2 matrices have closed forms.
PLANE_SQL = f"""{D.SQL_TILES},
pl as (select slide_id, x, y, model || n::varchar as model, [features[2 * n + 1]::double, features[2 * n + 2]::double] as f from tiles, (select unnest([0, 1]) as n)),
pr as (select a.model as model1, b.model as model2, a.slide_id || '|' || a.x || '|' || a.y as id, a.f[1] as p, a.f[2] as q, b.f[1] as u, b.f[2] as v
  from pl a join pl b on a.slide_id = b.slide_id and a.x = b.x and a.y = b.y and a.model < b.model),
c as (select model1, model2, count(*) as n, var_pop(p) * count(*) as a11, covar_pop(p, q) * count(*) as a12, var_pop(q) * count(*) as a22, var_pop(u) * count(*) as b11, covar_pop(u, v) * count(*) as b12,
  var_pop(v) * count(*) as b22, covar_pop(p, u) * count(*) as c11, covar_pop(p, v) * count(*) as c12, covar_pop(q, u) * count(*) as c21, covar_pop(q, v) * count(*) as c22 from pr group by 1, 2),
d as (select *, a11 * a22 - a12 * a12 as da, b11 * b22 - b12 * b12 as db, c11 * c22 - c12 * c21 as dc, c11 * c11 + c12 * c12 + c21 * c21 + c22 * c22 as fc,
  (a11 + 1) * (a22 + 1) - a12 * a12 as ra, (b11 + 1) * (b22 + 1) - b12 * b12 as rb from c),
e as (select *,
  -- trace of inv(A) C inv(B) C': rows of inv(A) C, then inv(B) C'
  (a22 * c11 - a12 * c21) / da as m11, (a22 * c12 - a12 * c22) / da as m12, (a11 * c21 - a12 * c11) / da as m21, (a11 * c22 - a12 * c12) / da as m22,
  (b22 * c11 - b12 * c12) / db as o11, (b22 * c21 - b12 * c22) / db as o12, (b11 * c12 - b12 * c11) / db as o21, (b11 * c22 - b12 * c21) / db as o22,
  -- w = inv(A + 1) C and inv(B + 1) C'
  ((a22 + 1) * c11 - a12 * c21) / ra as w11, ((a22 + 1) * c12 - a12 * c22) / ra as w12, ((a11 + 1) * c21 - a12 * c11) / ra as w21, ((a11 + 1) * c22 - a12 * c12) / ra as w22,
  ((b22 + 1) * c11 - b12 * c12) / rb as z11, ((b22 + 1) * c21 - b12 * c22) / rb as z12, ((b11 + 1) * c12 - b12 * c11) / rb as z21, ((b11 + 1) * c22 - b12 * c21) / rb as z22 from d),
ms as (select model1, model2, n, fc / (sqrt(a11 * a11 + 2 * a12 * a12 + a22 * a22) * sqrt(b11 * b11 + 2 * b12 * b12 + b22 * b22) + 1e-12) as cka,
  sqrt(greatest(m11 * o11 + m12 * o21 + m21 * o12 + m22 * o22 + 2 * abs(dc) / sqrt(da * db), 0)) / 2 as svcca,
  sqrt(greatest(a11 + a22 + b11 + b22 - 2 * sqrt(fc + 2 * abs(dc)), 0)) / (sqrt(b11 + b22) + 1e-12) as procrustes,
  1 - (a11 + a22 - 2 * (z11 * c11 + z12 * c21 + z21 * c12 + z22 * c22) + z11 * (b11 * z11 + b12 * z21) + z12 * (b11 * z12 + b12 * z22) + z21 * (b12 * z11 + b22 * z21) + z22 * (b12 * z12 + b22 * z22)) / (a11 + a22 + 1e-12) as r2_y2x,
  1 - (b11 + b22 - 2 * (w11 * c11 + w12 * c12 + w21 * c21 + w22 * c22) + w11 * (a11 * w11 + a12 * w21) + w12 * (a11 * w12 + a12 * w22) + w21 * (a12 * w11 + a22 * w21) + w22 * (a12 * w12 + a22 * w22)) / (b11 + b22 + 1e-12) as r2_x2y from e),
dd as (select a.model1, a.model2, a.id, b.id as nb, round(pow(a.p - b.p, 2) + pow(a.q - b.q, 2), 9) as dx, round(pow(a.u - b.u, 2) + pow(a.v - b.v, 2), 9) as dy from pr a join pr b on a.model1 = b.model1 and a.model2 = b.model2 and a.id <> b.id),
nx as (select model1, model2, id, nb from dd qualify row_number() over (partition by model1, model2, id order by dx, nb) <= 10),
ny as (select model1, model2, id, nb from dd qualify row_number() over (partition by model1, model2, id order by dy, nb) <= 10),
i as (select model1, model2, id, count(*) as both_ from nx join ny using (model1, model2, id, nb) group by all),
kn as (select model1, model2, avg(coalesce(both_, 0)::double / (20 - coalesce(both_, 0) + 1e-12)) as knn from pr left join i using (model1, model2, id) group by all),
pm as (select ms.*, knn from ms join kn using (model1, model2))"""


def _planes(spark, sf):
    t = D.tiles(spark, sf)
    both = t.withColumn("_n", F.explode(F.array(F.lit(0), F.lit(1))))
    planes = both.withColumn("model", F.concat("model", F.col("_n").cast("string"))).withColumn(
        "features", F.transform(F.slice("features", F.col("_n") * 2 + 1, F.lit(2)), lambda v: v.cast("double")))
    return S.pairwise_similarity(planes, ["A0", "A1", "B0", "B1"], ["all"], var_thres=1.0)


@query("similarity_of_planes", f"""with {PLANE_SQL} select model1, model2, n, round(cka, 6) as cka, round(svcca, 6) as svcca, round(procrustes, 6) as procrustes,
 round(r2_y2x, 6) as r2_y2x, round(r2_x2y, 6) as r2_x2y, round(knn, 6) as knn from pm""")
def similarity_of_planes(spark, sf):
    return _planes(spark, sf).select("model1", "model2", "n", *[r6(c).alias(c) for c in ("cka", "svcca", "procrustes", "r2_y2x", "r2_x2y", "knn")])


@query("model_average_over_pairs", f"""with {PLANE_SQL}, b as (select unnest([model1, model2]) as model, cka, svcca, procrustes, knn, (r2_y2x + r2_x2y) / 2 as ridge from pm)
select model, round(avg(cka), 6) as cka, round(avg(svcca), 6) as svcca, round(avg(procrustes), 6) as procrustes, round(avg(knn), 6) as knn, round(avg(ridge), 6) as ridge from b group by model""")
def model_average_over_pairs(spark, sf):
    return S.model_average_over_pairs(_planes(spark, sf)).select("model", *[r6(c).alias(c) for c in ("cka", "svcca", "procrustes", "knn", "ridge")])


# --- clusters ------------------------------------------------------------------------
DIST_SQL = f"""{D.SQL_TILES},
pt as (select model, tile_idx, site, class, features::double[] as f from tiles)"""


def _sil_sql(label):
    return f"""n as (select model, {label} as lab, count(*) as n from pt group by 1, 2),
s as (select a.model, a.tile_idx, a.{label} as own, b.{label} as other, sum(list_distance(a.f, b.f)) as d from pt a join pt b using (model) group by 1, 2, 3, 4),
m as (select s.*, n.n, case when own = other then d / nullif(n.n - 1, 0) else d / n.n end as mean from s join n on n.model = s.model and n.lab = s.other),
ab as (select model, tile_idx, max(mean) filter (own = other) as a, min(mean) filter (own <> other) as b, max(n) filter (own = other) as own_n from m group by model, tile_idx)
select model, count(distinct (select 1)) as dummy, round(avg(case when own_n <= 1 then 0 else (b - a) / greatest(a, b) end), 6) as silhouette from ab group by model"""


@query("silhouette", f"with {DIST_SQL}, {_sil_sql('site')}".replace("count(distinct (select 1)) as dummy, ", ""))
def silhouette(spark, sf):
    return K.silhouette(D.tiles(spark, sf), ["model"], "tile_idx", "features", "site").select("model", r6("silhouette").alias("silhouette"))


@query("silhouette_grouped", f"with {DIST_SQL.replace('pt as (', 'pt0 as (')}, pt as (select * replace (case when site in (0, 1) then 'L' else 'H' end as site) from pt0 where site in (0, 1, 2, 3)), {_sil_sql('site')}".replace("count(distinct (select 1)) as dummy, ", ""))
def silhouette_grouped(spark, sf):
    t = D.tiles(spark, sf)
    s = K.silhouette_grouped(t, ["model"], "tile_idx", "features", "site", {"L": (0, 1), "H": (2, 3)})
    return s.select("model", r6("silhouette").alias("silhouette"))


@query("silhouette_squared", f"""with {DIST_SQL}, {_sil_sql('site')}""".replace("count(distinct (select 1)) as dummy, ", "").replace("sum(list_distance(a.f, b.f))", "sum(pow(list_distance(a.f, b.f), 2))"))
def silhouette_squared(spark, sf):
    return K.silhouette_squared(D.tiles(spark, sf), ["model"], "features", "site").select("model", r6("silhouette").alias("silhouette"))


CENT_SQL = f"""{DIST_SQL},
dims as (select unnest(range(1, 33)) as i),
c as (select model, site, i, avg(f[i]) as c from pt, dims group by model, site, i),
cd as (select model, site, tile_idx, sqrt(sum((f[c.i] - c.c) * (f[c.i] - c.c))) as d from pt join c using (model, site) group by model, site, tile_idx),
comp as (select model, site, avg(d) as s, count(*) as n from cd group by model, site)"""


@query("compactness", f"with {CENT_SQL} select model, site, round(s, 6) as compactness, n::double as n from comp")
def compactness(spark, sf):
    c = K.compactness(D.tiles(spark, sf), ["model"], "features", "site")
    return c.select("model", "site", r6("compactness").alias("compactness"), "n")


@query("davies_bouldin", f"""with {CENT_SQL},
cc as (select a.model, a.site as s1, b.site as s2, sqrt(sum((a.c - b.c) * (a.c - b.c))) as d from c a join c b on a.model = b.model and a.i = b.i and a.site <> b.site group by 1, 2, 3),
r as (select cc.model, s1, max((x.s + y.s) / d) as r from cc join comp x on x.model = cc.model and x.site = s1 join comp y on y.model = cc.model and y.site = s2 group by 1, 2)
select model, round(avg(r), 6) as davies_bouldin from r group by model""")
def davies_bouldin(spark, sf):
    return K.davies_bouldin(D.tiles(spark, sf), ["model"], "features", "site").select("model", r6("davies_bouldin").alias("davies_bouldin"))


@query("min_slides_filter", f"""with {D.SQL_TILES}, ok as (select model, site, count(distinct slide_id) as s from tiles group by 1, 2 having s >= 19),
e as (select model from ok group by model having count(*) >= 2)
select model, site, tile_idx from tiles semi join ok using (model, site) semi join e using (model)""".replace("semi join ok using (model, site) semi join e using (model)", "where (model, site) in (select (model, site) from ok) and model in (select model from e)"))
def min_slides_filter(spark, sf):
    return K.min_slides_filter(D.tiles(spark, sf), ["model"], "site", 19).select("model", "site", "tile_idx")


@query("site_bias")
def site_bias(spark, sf):
    t = D.tiles(spark, sf).withColumn("tissue", F.when(F.col("class") == 1, "tumor").otherwise("normal"))
    return K.institution_bias(t, sample_frac=0.5, min_slides=5, n_iter=50, pca=50)


# All 32 components are a rotation of the centred vectors, so distances and with them every cluster metric stay as they are.
FULL_BIAS_SQL = f"""{D.SQL_TILES},
t0 as (select model, slide_id, x, y, site, case when class = 1 then 'tumor' else 'normal' end as tissue, features::double[] as f, slide_id || '|' || x || '|' || y as id from tiles),
co as (select distinct slide_id, tissue, x, y from t0),
ke as (select *, row_number() over (partition by slide_id, tissue order by md5(concat_ws('|', slide_id, x::varchar, y::varchar, '42')), slide_id, x, y) - 1 as pos, count(*) over (partition by slide_id, tissue) as n from co),
t1 as (select t0.* from t0 join ke using (slide_id, tissue, x, y) where pos < greatest(1, floor(n * 0.5))),
ok as (select model, tissue, site from t1 group by all having count(distinct slide_id) >= 5),
en as (select model, tissue from ok group by all having count(*) >= 2),
t as materialized (select t1.* from t1 join ok using (model, tissue, site) join en using (model, tissue)),
ids as (select tissue, id, row_number() over (partition by tissue order by md5(concat_ws('|', id, '42')), id) - 1 as pos, count(*) over (partition by tissue) as n from (select distinct tissue, id from t)),
it as (select unnest(range(0, 50)) as iter),
dr as (select tissue, iter, {D.sql_hash("cast(iter as varchar)", "cast(pos as varchar)", "'42'")} % n as pos from ids, it where pos < floor(n * 0.5)),
w as (select tissue, iter, pos, count(*) as w from dr group by all),
s as materialized (select w.iter, w.w, t.model, t.tissue, t.id, t.site, t.f from w join ids using (tissue, pos) join t on t.tissue = ids.tissue and t.id = ids.id),
big as (select model, tissue, iter, sum(w)::bigint as n_rows, count(distinct site) as n_labels from s group by all having sum(w) >= 10 and count(distinct site) >= 2),
cnt as (select model, tissue, iter, site, sum(w) as n from s group by all),
dm as (select unnest(range(1, 33)) as i),
cv as (select model, tissue, iter, site, i, sum(w * f[i]) / sum(w) as c from s, dm group by all),
ce as materialized (select model, tissue, iter, site, list(c order by i) as c from cv group by all),
ds as materialized (select a.model, a.tissue, a.id as x, b.id as y, list_distance(a.f, b.f) as d from t a join t b on a.model = b.model and a.tissue = b.tissue),
q as (select a.model, a.tissue, a.iter, a.id, a.site, a.w, b.site as other, sum(b.w * d) as q from s a join s b on a.model = b.model and a.tissue = b.tissue and a.iter = b.iter
  join ds on ds.model = a.model and ds.tissue = a.tissue and ds.x = a.id and ds.y = b.id group by all),
per as (select q.model, q.tissue, q.iter, q.id, q.w, max(case when other = q.site then n end) as own, max(case when other = q.site and n > 1 then q / (n - 1) end) as a, min(case when other <> q.site then q / n end) as b
  from q join cnt on cnt.model = q.model and cnt.tissue = q.tissue and cnt.iter = q.iter and cnt.site = q.other group by all),
sil as (select model, tissue, iter, sum(w * case when own <= 1 then 0 when greatest(a, b) > 0 then (b - a) / greatest(a, b) else 0 end) / sum(w) as silhouette from per group by all),
comp as (select s.model, s.tissue, s.iter, s.site, sum(w * list_distance(s.f, ce.c)) / sum(w) as c from s join ce on ce.model = s.model and ce.tissue = s.tissue and ce.iter = s.iter and ce.site = s.site group by all),
worst as (select x.model, x.tissue, x.iter, x.site, max((x.c + y.c) / nullif(list_distance(p.c, r.c), 0)) as r from comp x join comp y on x.model = y.model and x.tissue = y.tissue and x.iter = y.iter and x.site <> y.site
  join ce p on p.model = x.model and p.tissue = x.tissue and p.iter = x.iter and p.site = x.site join ce r on r.model = y.model and r.tissue = y.tissue and r.iter = y.iter and r.site = y.site group by all),
db as (select model, tissue, iter, avg(r) as davies_bouldin from worst group by all)"""


@query("site_bias_components", f"""with {FULL_BIAS_SQL} select model, tissue, cast(iter as integer) as iter, n_rows, n_labels, round(silhouette, 6) as silhouette, round(davies_bouldin, 6) as davies_bouldin
from big join sil using (model, tissue, iter) join db using (model, tissue, iter)""")
def site_bias_components(spark, sf):
    return site_bias(spark, sf).select("model", "tissue", "iter", "n_rows", "n_labels", r6("silhouette").alias("silhouette"), r6("davies_bouldin").alias("davies_bouldin"))


# Bootstrap on given 2-D points: 50 draws of half of each tissue's tiles, no components.
BIAS_SQL = f"""{D.SQL_TILES},
t as (select model, tile_idx, site, case when class = 1 then 'tumor' else 'normal' end as tissue, features[1]::double as a, features[2]::double as b from tiles),
ids as (select tissue, tile_idx, row_number() over (partition by tissue order by md5(concat_ws('|', tile_idx::varchar, '42')), tile_idx) - 1 as pos, count(*) over (partition by tissue) as n
  from (select distinct tissue, tile_idx from t)),
it as (select unnest(range(0, 50)) as iter),
dr as (select tissue, iter, {D.sql_hash("cast(iter as varchar)", "cast(pos as varchar)", "'42'")} % n as pos from ids, it where pos < floor(n * 0.5)),
w as (select tissue, iter, pos, count(*) as w from dr group by all),
s as (select w.iter, w.w, t.* from w join ids using (tissue, pos) join t on t.tissue = ids.tissue and t.tile_idx = ids.tile_idx),
cnt as (select model, tissue, iter, site, sum(w) as n, sum(w * a) / sum(w) as ca, sum(w * b) / sum(w) as cb from s group by all),
q as (select x.model, x.tissue, x.iter, x.tile_idx, x.site, x.w, y.site as other, sum(y.w * sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b))) as q
  from s x join s y on x.model = y.model and x.tissue = y.tissue and x.iter = y.iter group by all),
per as (select q.model, q.tissue, q.iter, q.tile_idx, q.w, max(case when other = q.site then n end) as own, max(case when other = q.site and n > 1 then q / (n - 1) end) as a, min(case when other <> q.site then q / n end) as b
  from q join cnt on cnt.model = q.model and cnt.tissue = q.tissue and cnt.iter = q.iter and cnt.site = q.other group by all),
sil as (select model, tissue, iter, sum(w)::bigint as n_rows, sum(w * case when own <= 1 then 0 when greatest(a, b) > 0 then (b - a) / greatest(a, b) else 0 end) / sum(w) as silhouette from per group by all),
comp as (select s.model, s.tissue, s.iter, s.site, ca, cb, sum(w * sqrt((a - ca) * (a - ca) + (b - cb) * (b - cb))) / sum(w) as c
  from s join cnt on cnt.model = s.model and cnt.tissue = s.tissue and cnt.iter = s.iter and cnt.site = s.site group by all),
worst as (select x.model, x.tissue, x.iter, x.site, max((x.c + y.c) / nullif(sqrt((x.ca - y.ca) * (x.ca - y.ca) + (x.cb - y.cb) * (x.cb - y.cb)), 0)) as r
  from comp x join comp y on x.model = y.model and x.tissue = y.tissue and x.iter = y.iter and x.site <> y.site group by all),
db as (select model, tissue, iter, avg(r) as davies_bouldin, count(*) as n_labels from worst group by all)"""


def _bias_2d(spark, sf):
    t = D.tiles(spark, sf).withColumn("tissue", F.when(F.col("class") == 1, "tumor").otherwise("normal"))
    t = t.withColumn("xy", F.transform(F.slice("features", 1, 2), lambda v: v.cast("double")))
    return K.bootstrap_cluster_metrics(t, ["model", "tissue"], "tile_idx", "xy", "site", 50, 0.5, pca=0, within=["tissue"])


@query("site_bias_2d", f"""with {BIAS_SQL} select sil.model, sil.tissue, cast(sil.iter as integer) as iter, n_rows, n_labels, round(silhouette, 6) as silhouette, round(davies_bouldin, 6) as davies_bouldin
from sil join db on sil.model = db.model and sil.tissue = db.tissue and sil.iter = db.iter""")
def site_bias_2d(spark, sf):
    return _bias_2d(spark, sf).select("model", "tissue", "iter", "n_rows", "n_labels", r6("silhouette").alias("silhouette"), r6("davies_bouldin").alias("davies_bouldin"))


@query("site_bias_compactness", f"""with {BIAS_SQL} select model, tissue, cast(iter as integer) as iter, site::varchar || '_compactness' as metric, round(c, 6) as value from comp""")
def site_bias_compactness(spark, sf):
    return K.bias_values(_bias_2d(spark, sf)).filter("metric like '%compactness'").select("model", "tissue", "iter", "metric", r6("value").alias("value"))


@query("bootstrap_draws", f"with {BIAS_SQL} select tissue, cast(iter as integer) as iter, sum(w)::bigint as drawn, count(*) as items from w group by all")
def bootstrap_draws(spark, sf):
    t = D.tiles(spark, sf).withColumn("tissue", F.when(F.col("class") == 1, "tumor").otherwise("normal"))
    w = draw_weights(t, "tile_idx", 50, 0.5, 42, ["tissue"]).select("tissue", F.explode("draws").alias("d"))
    return w.groupBy("tissue", F.col("d.iter").alias("iter")).agg(F.sum("d.weight").alias("drawn"), F.count("*").alias("items"))


@query("site_bias_tests")
def site_bias_tests(spark, sf):
    return K.bias_comparison(_bias_2d(spark, sf))


@query("kmeans_assign", f"""with {DIST_SQL}, dims as (select unnest(range(1, 33)) as i),
a as (select * from pt where model = 'A'),
c as (select site as cluster, i, avg(f[i]) as c from a, dims group by 1, 2),
dd as (select tile_idx, cluster, round(sqrt(sum((f[c.i] - c.c) * (f[c.i] - c.c))), 9) as d from a, c group by 1, 2)
select tile_idx, arg_min(cluster, (d, cluster)) as cluster, round(min(d), 6) as distance from dd group by tile_idx""")
def kmeans_assign(spark, sf):
    t = D.tiles(spark, sf).filter("model = 'A'")
    c = K.centroids(t.withColumnRenamed("site", "cluster"), [], "features", "cluster").select("cluster", "centroid")
    return K.assign_to_centroids(t, c, "features").select("tile_idx", "cluster", r6("distance").alias("distance"))


def lloyd_sql(name, points, k, seed, steps, dims):
    """CTEs of a k-means per key over the CTE ``points`` (key, id, f): {name}_c
    (key, c, f) are the centroids and {name} (key, id, c) the assignment after
    ``steps`` rounds, of which those after convergence change nothing."""
    out = [f"""{name}_s0 as materialized (select key, i - 1 as c, f from (select *, row_number() over (partition by key order by md5(concat_ws('|', id::varchar, '{seed}')), id) as i from {points}) where i <= {k})"""]
    near = lambda j: f"""select key, id, arg_min(c, (d, c)) as c from (select p.key, p.id, s.c, round(pow(list_distance(p.f, s.f), 2), 9) as d from {points} p join {name}_s{j} s on p.key = s.key) group by key, id"""
    for j in range(steps):
        out.append(f"""{name}_a{j} as materialized ({near(j)})""")
        out.append(f"""{name}_s{j + 1} as materialized (select s.key, s.c, coalesce(m.f, s.f) as f from {name}_s{j} s left join (select key, c, list(v order by i) as f from
 (select a.key, a.c, i, avg(p.f[i]) as v from {name}_a{j} a join {points} p on a.key = p.key and a.id = p.id, (select unnest(range(1, {dims + 1})) as i) group by 1, 2, 3) group by 1, 2) m on m.key = s.key and m.c = s.c)""")
    return ",\n".join([*out, f"{name}_c as materialized (select * from {name}_s{steps})", f"{name} as materialized ({near(steps)})"])


CACHE_SQL = f"""{D.SQL_TILES},
pa as materialized (select slide_id as key, tile_idx as id, features::double[] as f from tiles where model = 'A'),
{lloyd_sql('l', 'pa', 10, 42, 12, 32)},
n as (select key, c, count(*) as n from l group by 1, 2),
part as (select *, greatest(1, floor(sum(n) over (partition by key) * 0.5)) as total, greatest(1, floor(n * greatest(1, floor(sum(n) over (partition by key) * 0.5)) / sum(n) over (partition by key))) as p from n),
placed as (select *, sum(p) over (partition by key) - total as excess, row_number() over (partition by key order by p desc, c) as place from part),
quota as (select key, c, p + case when p > 1 and place <= excess then -1 when place <= -excess then 1 else 0 end as q from placed),
kept as (select l.key as slide_id, id from l join quota using (key, c) qualify row_number() over (partition by l.key, l.c order by md5(concat_ws('|', l.key, id::varchar, '42')), id) <= max(q) over (partition by l.key, l.c)),
ps as materialized (select 1 as key, pa.id, pa.f from pa join kept on kept.slide_id = pa.key and kept.id = pa.id),
{lloyd_sql('g', 'ps', 5, 42, 40, 32)}"""


@query("cluster_cache", f"""with {CACHE_SQL}
select pa.key as slide_id, pa.id as tile_idx, cast(arg_min(c.c, (round(pow(list_distance(pa.f, c.f), 2), 9), c.c)) as integer) as cluster from pa, g_c c group by 1, 2""")
def cluster_cache(spark, sf):
    t = D.tiles(spark, sf).filter("model = 'A'").select("slide_id", "tile_idx", "features")
    _, cents = K.keyed_kmeans(K.local_cluster_sample(t, 10, 0.5), [], "tile_idx", "features", 5)
    return K.assign_to_centroids(t, cents, "features").select("slide_id", "tile_idx", "cluster")


@query("local_sample", f"with {CACHE_SQL} select slide_id, id as tile_idx from kept")
def local_sample(spark, sf):
    t = D.tiles(spark, sf).filter("model = 'A'").select("slide_id", "tile_idx", "features")
    return K.local_cluster_sample(t, 10, 0.5).select("slide_id", "tile_idx")


@query("kmeans_2d", f"""with pts as materialized (select 1 as key, event_id as id, [event_id * 37 % 1009 / 1009.0::double, event_id * 91 % 1013 / 1013.0::double] as f from events),
{lloyd_sql('g', 'pts', 5, 42, 60, 2)} select cast(c as integer) as cluster, count(*) as n, round(count(*)::double / sum(count(*)) over (), 6) as share from g group by c""")
def kmeans_2d(spark, sf):
    from .cohorts import grid_points
    return K.kmeans_2d(grid_points(spark, sf), "event_id", 5)[1].select("cluster", "n", r6("share").alias("share"))


def _items(spark, sf):
    return D.tiles(spark, sf).withColumn("item", F.concat_ws("|", "model", "tile_idx"))


@query("consensus")
def consensus(spark, sf):
    """100 runs for each of two numbers of clusters."""
    t = _items(spark, sf)
    return K.consensus_summary(K.repeated_kmeans(t, "item", "features", [3, 4], listed=True), t, "item", ["k"])


# Given assignments: an item is drawn in a run by its hash, its cluster follows from its label.
GIVEN_SQL = f"""{D.SQL_TILES},
it as (select model || '|' || tile_idx as item, model, site from tiles),
g as (select item, model, run, k, (site + run) % k as cluster from it, (select unnest(range(0, 20)) as run), (select unnest([3, 4]) as k) where {D.sql_hash('item', 'run::varchar')} % 10 < 8),
m as (select a.k, a.item as x, b.item as y, any_value(least(a.model, b.model)) as model1, any_value(greatest(a.model, b.model)) as model2, avg((a.cluster = b.cluster)::int) as m
  from g a join g b on a.k = b.k and a.run = b.run and a.item < b.item group by 1, 2, 3)"""


def _given(spark, sf):
    t = _items(spark, sf)
    runs = t.select("item", "site", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("run")).filter(hash_number("item", "run") % 10 < 8)
    a = runs.withColumn("k", F.explode(F.array(F.lit(3), F.lit(4)))).select("k", "item", "run", ((F.col("site") + F.col("run")) % F.col("k")).cast("int").alias("cluster"))
    return K.consensus_summary(a, t, "item", ["k"])


@query("consensus_given", f"""with {GIVEN_SQL},
n as (select model, count(*) as n from it group by model),
p as (select a.model as model1, b.model as model2, case when a.model = b.model then a.n * (a.n - 1) // 2 else a.n * b.n end as pairs from n a join n b on a.model <= b.model)
select k, model1, model2, round(sum(m) / pairs, 6) as consensus, pairs from m join p using (model1, model2) group by k, model1, model2, pairs""")
def consensus_given(spark, sf):
    return _given(spark, sf).select("k", "model1", "model2", r6("consensus").alias("consensus"), "pairs")


@query("consensus_overall", f"""with {GIVEN_SQL}, n as (select sum((model = 'A')::int) as a, sum((model = 'B')::int) as b from it)
select k, round(sum(m) filter (model1 = model2) / (select (a * (a - 1) + b * (b - 1)) // 2 from n), 6) as within, round(sum(m) filter (model1 <> model2) / (select a * b from n), 6) as between from m group by k""")
def consensus_overall(spark, sf):
    return K.consensus_overall(_given(spark, sf), ["k"]).select("k", r6("within").alias("within"), r6("between").alias("between"))


@query("slide_cluster_summary", f"""with {D.SQL_TILES}, p as (select slide_id, model, count(*) filter (class = 1) as n_pos, count(*) filter (class = 0) as n_neg from tiles group by 1, 2)
select *, round(n_pos::double / nullif(n_neg, 0), 6) as ratio from p""")
def slide_cluster_summary(spark, sf):
    t = D.tiles(spark, sf)
    s = K.silhouette(t, ["slide_id", "model"], "tile_idx", "features", "class")
    return K.slide_cluster_summary(t, s).select("slide_id", "model", "n_pos", "n_neg", r6("ratio").alias("ratio"))


# --- feature selection ---------------------------------------------------------------------
FEAT_SQL = f"""{D.SQL_TILES}, dims as (select unnest(range(0, 32)) as feature),
v as (select model, tile_idx, feature, class, round(features[feature + 1]::double, 2) as value from tiles, dims)"""


def _feat(spark, sf):
    """Values rounded to two digits, so that ties occur."""
    t = D.tiles(spark, sf)
    return t.withColumn("features", F.transform("features", lambda v: F.round(v.cast("double"), 2))).withColumn("class", X.class_sign("class"))


@query("column_filter", f"""with {FEAT_SQL}, s as (select model, feature, count(*) as n, count(distinct value) as distinct_values from v group by 1, 2)
select model, cast(feature as integer) as feature, n, distinct_values from s where distinct_values > floor(n * 0.1::double)""")
def column_filter(spark, sf):
    f = _feat(spark, sf)
    return E.column_filter(E.value_counts(f, ["model"], "features", "class"), ["model"])


@query("feature_tstat", f"""with {FEAT_SQL}, s as (select model, feature, count(*) filter (class = 1) as n1, count(*) filter (class = 0) as n0, avg(value) filter (class = 1) as m1,
avg(value) filter (class = 0) as m0, var_samp(value) filter (class = 1) as v1, var_samp(value) filter (class = 0) as v0 from v group by 1, 2)
select model, cast(feature as integer) as feature, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0::double / n1 + 1.0::double / n0)), 6) as t_equal,
round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) as t_welch from s""")
def feature_tstat(spark, sf):
    f = _feat(spark, sf)
    a = E.t_statistics(f, ["model"], "features", "class").select("model", "feature", r6("statistic").alias("t_equal"))
    b = E.t_statistics(f, ["model"], "features", "class", welch=True).select("model", "feature", r6("statistic").alias("t_welch"))
    return a.join(b, ["model", "feature"])


@query("feature_rank_sum", f"""with {FEAT_SQL}, r as (select *, rank() over (partition by model, feature order by value) + (count(*) over (partition by model, feature, value) - 1) / 2.0::double as r from v),
s as (select model, feature, sum(case when class = 1 then r else 0 end) as w, sum(class)::double as n1, sum(1 - class)::double as n0 from r group by 1, 2)
select model, cast(feature as integer) as feature, round((w - n1 * (n1 + n0 + 1) / 2) / sqrt(n1 * n0 * (n1 + n0 + 1) / 12), 6) as z from s""")
def feature_rank_sum(spark, sf):
    f = _feat(spark, sf)
    s = E.rank_sum_statistics(E.value_counts(f, ["model"], "features", "class"), ["model"])
    return s.select("model", "feature", r6("statistic").alias("z"))


def _corr_sql(col):
    return f"""select a.model, cast(a.feature as integer) as feature, cast(b.feature as integer) as other, round(abs(corr(a.{col}, b.{col})), 6) as r
from r a join r b on a.model = b.model and a.tile_idx = b.tile_idx group by 1, 2, 3"""


def _corr(spark, sf, method):
    c = E.abs_correlation(_feat(spark, sf), ["model"], "tile_idx", "features", method)
    return c.select("model", "feature", F.posexplode("corr").alias("other", "r")).withColumn("r", r6("r"))


@query("pearson_matrix", f"with {FEAT_SQL}, r as (select * from v) {_corr_sql('value')}")
def pearson_matrix(spark, sf):
    return _corr(spark, sf, "pearson")


@query("spearman_matrix", f"""with {FEAT_SQL}, r as (select model, tile_idx, feature, rank() over (partition by model, feature order by value)
 + (count(*) over (partition by model, feature, value) - 1) / 2.0::double as rk from v) {_corr_sql('rk')}""")
def spearman_matrix(spark, sf):
    return _corr(spark, sf, "spearman")


def _greedy_sql(name, order, conf, keys):
    """Greedy pick as a recursive query over (keys, feature, score) and
    (keys, feature, list of features it rules out)."""
    on = " and ".join(f"c.{k} = g.{k}" for k in keys)
    ks, gk = ", ".join(keys), ", ".join(f"g.{k}" for k in keys)
    return f"""{name}_g({ks}, alive, sel) as (
  select {ks}, list(feature order by score desc, feature), []::bigint[] from {order} group by {ks}
  union all select {gk}, list_filter(g.alive, lambda x: not list_contains(c.conf, x)), list_append(g.sel, g.alive[1])
  from {name}_g g join {conf} c on {on} and c.feature = g.alive[1] where len(g.alive) > 0),
{name} as (select {ks}, unnest(sel) as feature from {name}_g where len(alive) = 0)"""


GREEDY_SQL = f"""{FEAT_SQL},
st as (select model, feature, count(*) filter (class = 1) as n1, count(*) filter (class = 0) as n0, avg(value) filter (class = 1) as m1, avg(value) filter (class = 0) as m0,
 var_samp(value) filter (class = 1) as v1, var_samp(value) filter (class = 0) as v0, count(distinct value) as dv, count(*) as n from v group by 1, 2),
th as (select unnest([0.1, 0.2, 0.6])::double as threshold),
score as (select model, threshold, feature::bigint as feature, abs(m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0::double / n1 + 1.0::double / n0)) as score
 from st, th where dv > floor(n * 0.1::double)),
cr as (select a.model, a.feature::bigint as feature, b.feature::bigint as other, abs(corr(a.value, b.value)) as r from v a join v b on a.model = b.model and a.tile_idx = b.tile_idx group by 1, 2, 3),
conf as (select model, threshold, feature, list(other) as conf from cr, th where r > threshold or feature = other group by 1, 2, 3)"""


@query("greedy_uncorrelated", f"with recursive {GREEDY_SQL}, {_greedy_sql('pick', 'score', 'conf', ['model', 'threshold'])} select model, threshold, feature from pick")
def greedy_uncorrelated(spark, sf):
    return E.select_features(_feat(spark, sf), ["model"], "tile_idx", "features", "class", [0.1, 0.2, 0.6], "pearson", quality_filter=True).drop("p_value")


def _two_stage(spark, sf):
    t = _feat(spark, sf).withColumn("slide_id", F.concat_ws("-", "slide_id", "class")).withColumn("score", F.col("features")[0])
    labels = t.select("slide_id", "class").distinct()
    return t, E.two_stage_prune(t.drop("class"), labels, [0.15, 0.3], 100, "score", "coord", "spearman", quality_filter=True)


# Features of both models side by side; the 100 best tiles per slide and model
# by the first feature, joined on the tile.
STAGE_SQL = f"""{FEAT_SQL},
ranked as (select model, tile_idx, row_number() over (partition by model, slide_id, class order by round(features[1]::double, 2) desc, tile_idx) as i from tiles),
top as (select model, tile_idx from ranked where i <= 100),
v1 as (select v.* from v join top using (model, tile_idx)),
v2 as (select v1.* from v1 where tile_idx in (select tile_idx from top group by 1 having count(*) = 2)),
r1 as (select model, feature, tile_idx, class, value, rank() over w + (count(*) over (partition by model, feature, value) - 1) / 2.0::double as rk from v1 window w as (partition by model, feature order by value)),
r2 as (select model, feature, tile_idx, class, value, rank() over w + (count(*) over (partition by model, feature, value) - 1) / 2.0::double as rk from v2 window w as (partition by model, feature order by value)),
th as (select unnest([0.15, 0.3])::double as threshold),
z1 as (select model, feature, abs((sum(case when class = 1 then rk else 0 end) - sum(class)::double * (count(*) + 1) / 2) / sqrt(sum(class)::double * sum(1 - class)::double * (count(*) + 1) / 12)) as score,
  count(distinct value) > floor(count(*) * 0.1::double) as ok from r1 group by 1, 2),
z2 as (select model, feature, abs((sum(case when class = 1 then rk else 0 end) - sum(class)::double * (count(*) + 1) / 2) / sqrt(sum(class)::double * sum(1 - class)::double * (count(*) + 1) / 12)) as score,
  count(distinct value) > floor(count(*) * 0.1::double) as ok from r2 group by 1, 2),
c1 as (select a.model, a.feature, b.feature as other, abs(corr(a.rk, b.rk)) as r from r1 a join r1 b on a.model = b.model and a.tile_idx = b.tile_idx group by 1, 2, 3),
c2 as (select a.model, a.feature, b.model as model2, b.feature as other, abs(corr(a.rk, b.rk)) as r from r2 a join r2 b on a.tile_idx = b.tile_idx group by 1, 2, 3, 4),
s1 as (select model, threshold, feature::bigint as feature, round(score, 9) as score from z1, th where ok),
f1 as (select model, threshold, feature::bigint as feature, list(other::bigint) as conf from c1, th where r > threshold or feature = other group by 1, 2, 3),
{_greedy_sql('one', 's1', 'f1', ['model', 'threshold'])},
pos1 as (select threshold, model, feature as feature_index, row_number() over (partition by threshold order by model, feature) - 1 as pos from one),
s2 as (select p.threshold, p.pos::bigint as feature, round(z2.score, 9) as score from pos1 p join z2 on z2.model = p.model and z2.feature = p.feature_index where ok),
f2 as (select a.threshold, a.pos::bigint as feature, list(b.pos::bigint) as conf from pos1 a join pos1 b on a.threshold = b.threshold
  join c2 on c2.model = a.model and c2.feature = a.feature_index and c2.model2 = b.model and c2.other = b.feature_index where c2.r > a.threshold or a.pos = b.pos group by 1, 2),
{_greedy_sql('two', 's2', 'f2', ['threshold'])},
srcs as (select p.threshold, p.pos, p.model, p.feature_index from pos1 p join two on two.threshold = p.threshold and two.feature = p.pos)"""


@query("two_stage_prune", f"with recursive {STAGE_SQL} select threshold, cast(pos as integer) as pos, model, cast(feature_index as integer) as feature_index from srcs")
def two_stage_prune(spark, sf):
    return _two_stage(spark, sf)[1][0].drop("p_value")


@query("pruning_report", f"""with recursive {STAGE_SQL}, k1 as (select threshold, model, count(*) as k1 from pos1 group by 1, 2), k2 as (select threshold, model, count(*) as k2 from srcs group by 1, 2)
select threshold, model, 32 - k1 as removed_stage1, k1 - coalesce(k2, 0) as removed_stage2 from k1 left join k2 using (threshold, model)""")
def pruning_report(spark, sf):
    return _two_stage(spark, sf)[1][1]


# The same two stages by t test and Pearson correlation, on values with gaps: the
# features a rule picks lose their value in some rows. No filter of distinct values.
GAP = "(tile_idx + feature) % 7 = 0 and feature % 5 = 1"


def _gapped(spark, sf):
    t = _feat(spark, sf)
    gap = lambda v, i: F.when(~(((F.col("tile_idx") + i) % 7 == 0) & (i % 5 == 1)), v)
    return t.withColumn("features", F.transform("features", gap))


def _t_sql(welch):
    se = "v1 / n1 + v0 / n0" if welch else "((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0::double / n1 + 1.0::double / n0)"
    return f"abs(m1 - m0) / nullif(sqrt({se}), 0)"


MOMENTS = """count(*) filter (class = 1) as n1, count(*) filter (class = 0) as n0, avg(value) filter (class = 1) as m1, avg(value) filter (class = 0) as m0,
 var_samp(value) filter (class = 1) as v1, var_samp(value) filter (class = 0) as v0, count(*) = count(value) as whole"""


@query("feature_selection_with_gaps", f"""with recursive {FEAT_SQL},
vg as (select model, tile_idx, feature, class, case when {GAP} then null else value end as value from v),
st as (select model, feature, {MOMENTS} from vg group by 1, 2), ok as (select * from st where whole),
th as (select unnest([0.1, 0.2, 0.6])::double as threshold),
score as (select model, threshold, feature::bigint as feature, {_t_sql(False)} as score from ok, th),
cr as (select a.model, a.feature::bigint as feature, b.feature::bigint as other, abs(corr(a.value, b.value)) as r from v a join v b on a.model = b.model and a.tile_idx = b.tile_idx group by 1, 2, 3),
conf as (select model, threshold, feature, list(other) as conf from cr, th where r > threshold or feature = other group by 1, 2, 3),
{_greedy_sql('pick', 'score', 'conf', ['model', 'threshold'])} select model, threshold, feature from pick""")
def feature_selection_with_gaps(spark, sf):
    return E.select_features(_gapped(spark, sf), ["model"], "tile_idx", "features", "class", [0.1, 0.2, 0.6]).drop("p_value")


def _stage_t_sql(welch, align):
    """align: the tile by its coordinate, or its place among its slide's tiles."""
    on = {"coord": "tile_idx::varchar", "rank": "slide_id || '-' || class || '|' || i"}[align]
    return f"""{FEAT_SQL},
ranked as (select model, tile_idx, slide_id, class, row_number() over (partition by model, slide_id, class order by round(features[1]::double, 2) desc, tile_idx) as i from tiles),
top as (select model, tile_idx, {on} as obj from ranked where i <= 100),
w1 as (select v.*, obj from v join top using (model, tile_idx)),
w2 as (select * from w1 where obj in (select obj from top group by 1 having count(*) = 2)),
th as (select unnest([0.15, 0.3])::double as threshold),
z1 as (select model, feature, {MOMENTS} from w1 group by 1, 2), z2 as (select model, feature, {MOMENTS} from w2 group by 1, 2),
c1 as (select a.model, a.feature, b.feature as other, abs(corr(a.value, b.value)) as r from w1 a join w1 b on a.model = b.model and a.tile_idx = b.tile_idx group by 1, 2, 3),
c2 as (select a.model, a.feature, b.model as model2, b.feature as other, abs(corr(a.value, b.value)) as r from w2 a join w2 b on a.obj = b.obj group by 1, 2, 3, 4),
s1 as (select model, threshold, feature::bigint as feature, round({_t_sql(welch)}, 9) as score from z1, th),
f1 as (select model, threshold, feature::bigint as feature, list(other::bigint) as conf from c1, th where r > threshold or feature = other group by 1, 2, 3),
{_greedy_sql('one', 's1', 'f1', ['model', 'threshold'])},
pos1 as (select threshold, model, feature as feature_index, row_number() over (partition by threshold order by model, feature) - 1 as pos from one),
s2 as (select p.threshold, p.pos::bigint as feature, round({_t_sql(welch)}, 9) as score from pos1 p join z2 on z2.model = p.model and z2.feature = p.feature_index),
f2 as (select a.threshold, a.pos::bigint as feature, list(b.pos::bigint) as conf from pos1 a join pos1 b on a.threshold = b.threshold
  join c2 on c2.model = a.model and c2.feature = a.feature_index and c2.model2 = b.model and c2.other = b.feature_index where c2.r > a.threshold or a.pos = b.pos group by 1, 2),
{_greedy_sql('two', 's2', 'f2', ['threshold'])},
srcs as (select p.threshold, p.pos, p.model, p.feature_index from pos1 p join two on two.threshold = p.threshold and two.feature = p.pos)
select threshold, cast(pos as integer) as pos, model, cast(feature_index as integer) as feature_index from srcs"""


def _two_stage_t(spark, sf, **how):
    t = _feat(spark, sf).withColumn("slide_id", F.concat_ws("-", "slide_id", "class")).withColumn("score", F.col("features")[0])
    return E.two_stage_prune(t.drop("class"), t.select("slide_id", "class").distinct(), [0.15, 0.3], 100, "score", **how)[0].drop("p_value")


@query("two_stage_prune_tile", f"with recursive {_stage_t_sql(False, 'coord')}")
def two_stage_prune_tile(spark, sf):
    return _two_stage_t(spark, sf)


@query("two_stage_prune_slide", f"with recursive {_stage_t_sql(True, 'rank')}")
def two_stage_prune_slide(spark, sf):
    return _two_stage_t(spark, sf, align="rank", test="welch")


@query("apply_pruning", f"""with recursive {STAGE_SQL}
select threshold, slide_id || '-' || (case when class = 1 then '1' else '-1' end) as slide_id, x, y, count(*) as width, round(sum(round(features[feature_index + 1]::double, 2)), 6) as total
from srcs join tiles using (model) group by 1, 2, 3, 4""")
def apply_pruning(spark, sf):
    t, (sources, _, _) = _two_stage(spark, sf)
    total = F.aggregate("features", F.lit(0.0), lambda a, v: a + v)
    return E.apply_pruning(t, sources).select("threshold", "slide_id", "x", "y", F.size("features").cast("long").alias("width"), r6(total).alias("total"))


@query("concat_models", f"""with {D.SQL_TILES}
select a.slide_id, a.x, a.y, len(a.features) + len(b.features) as width, round(a.features[1]::double, 6) as first_a, round(b.features[32]::double, 6) as last_b
from tiles a join tiles b using (slide_id, x, y) where a.model = 'A' and b.model = 'B'""")
def concat_models(spark, sf):
    c = E.concat_models(D.tiles(spark, sf), ["slide_id", "x", "y"], "features", 2)
    f = F.col("features")
    return c.select("slide_id", "x", "y", F.size("features").cast("long").alias("width"), r6(f[0].cast("double")).alias("first_a"),
                    r6(F.element_at("features", -1).cast("double")).alias("last_b"))


# Provenance stand-in: a "disease" is a market segment, a "model" an order
# priority, a selected feature the customer's nation.
SRC_SQL = """src as (select distinct c_mktsegment as disease, o_orderpriority as model, c_nationkey as feature_index
  from customer join orders on o_custkey = c_custkey where o_totalprice >= 400000),
sources as (select disease, 0.6::double as threshold, cast(row_number() over (partition by disease order by model, feature_index) - 1 as integer) as pos, model, feature_index from src),
dims as (select model, max(feature_index) + 1 as dim from sources group by model),
idx as (select model, dim, coalesce(sum(dim) over (order by model rows between unbounded preceding and 1 preceding), 0) as "offset" from dims),
uni as (select s.*, i."offset" + s.feature_index as idx from sources s join idx i using (model))"""
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _sources(spark, sf):
    c = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    o = D.table(spark, sf, "orders").filter("o_totalprice >= 400000").select("o_custkey", "o_orderpriority")
    rows = o.join(c, "o_custkey").select(F.col("c_mktsegment").alias("disease"), F.lit(0.6).alias("threshold"), F.col("o_orderpriority").alias("model"),
                                         F.col("c_nationkey").alias("feature")).distinct()
    return E.feature_sources(E.keep_lists(rows, ["disease", "threshold", "model"]), ["disease", "threshold"])


@query("feature_sources", f"with {SRC_SQL} select * from sources")
def feature_sources(spark, sf):
    return _sources(spark, sf)


@query("unified_index", f"with {SRC_SQL} select model, cast(dim as bigint) as dim, cast(\"offset\" as bigint) as \"offset\" from idx")
def unified_index(spark, sf):
    return E.unified_feature_index(_sources(spark, sf), PRIORITIES)


@query("common_features", f"""with {SRC_SQL} select threshold, cast(idx as bigint) as idx from uni group by threshold, idx
having count(distinct disease) = 5""")
def common_features(spark, sf):
    s = _sources(spark, sf)
    return E.common_features(E.unified_sources(s, E.unified_feature_index(s, PRIORITIES)), 5)


SHAP_SQL = f"""{D.SQL_TILES}, dims as (select unnest(range(0, 32)) as pos),
sl as (select slide_id, pos, avg(abs(features[pos + 1]::double)) as a from tiles, dims where model = 'A' group by 1, 2),
imp as (select pos, avg(a) as importance, count(*) as slides from sl group by pos)"""


@query("mean_abs_attribution", f"with {SHAP_SQL} select cast(pos as integer) as pos, 'A' as model, round(importance, 6) as importance, slides from imp")
def mean_abs_attribution(spark, sf):
    t = D.tiles(spark, sf).filter("model = 'A'").withColumns({"disease": F.lit("d"), "threshold": F.lit(0.6)})
    width = t.groupBy("disease", "threshold", "model").agg(F.max(F.size("features")).alias("_w"))
    src = width.select("disease", "threshold", "model", F.explode(F.sequence(F.lit(0), F.col("_w") - 1)).alias("feature_index")).withColumn(
        "pos", F.col("feature_index"))
    uni = E.unified_sources(src, E.unified_feature_index(src, ["A"]))
    m = E.mean_abs_attribution(t.withColumnRenamed("features", "values"), uni)
    return m.select("pos", "model", r6("importance").alias("importance"), "slides")


@query("global_importance", f"""with {D.SQL_TILES}, dims as (select unnest(range(0, 32)) as pos)
select model, cast(pos as integer) as pos, round(avg(abs(features[pos + 1]::double)), 6) as importance from tiles, dims group by 1, 2""")
def global_importance(spark, sf):
    g = E.global_importance(D.tiles(spark, sf), ["model"], "features")
    return g.select("model", "pos", r6("importance").alias("importance"))


@query("pruning_pct", """with c as (select case when p_size <= 10 then '0.2' when p_size <= 25 then '0.4' when p_size <= 40 then '0.6' else 'OG Features' end as threshold,
 p_type as model, count(*) as retained from part where p_type in ('ECONOMY', 'PROMO', 'LARGE') group by 1, 2),
t as (select *, sum(retained) over (partition by threshold) as tot from c), og as (select max(tot) as og from t where threshold = 'OG Features')
select threshold, model, retained, round(100.0::double * retained / tot, 6) as model_pct, round(100.0::double * tot / og, 6) as total_pct from t, og where threshold <> 'OG Features'""")
def pruning_pct(spark, sf):
    s = F.col("p_size")
    t = F.when(s <= 10, "0.2").when(s <= 25, "0.4").when(s <= 40, "0.6").otherwise("OG Features").alias("Threshold")
    models = ["ECONOMY", "PROMO", "LARGE"]
    wide = D.table(spark, sf, "part").groupBy(t).pivot("p_type", models).agg(F.count(F.lit(1)))
    p = E.pruning_percentages(wide, models)
    return p.select("threshold", "model", "retained", r6("model_pct").alias("model_pct"), r6("total_pct").alias("total_pct"))


@query("stability_filter", f"""with {D.SQL_TILES}, dims as (select unnest(range(0, 32)) as feature_index),
m as (select model, feature_index, round(avg(abs(features[feature_index + 1]::double)), 9) as mean from tiles, dims where cast(slide_id as integer) < 15 group by 1, 2),
e as (select model, quantile_cont(mean, 0.8) as e from m group by model)
select model, cast(feature_index as integer) as feature_index, round(mean, 6) as mean, mean >= e as keep from m join e using (model)""")
def stability_filter(spark, sf):
    t = D.tiles(spark, sf)
    st = t.select("model", "slide_id", F.lit("icc").alias("metric"), F.lit("overall").alias("category"),
                  F.posexplode("features").alias("feature_index", "value")).withColumn("value", F.abs(F.col("value").cast("double")))
    train = t.select("slide_id").distinct().filter(F.col("slide_id").cast("int") < 15)
    s = E.stability_filter(st, train, "icc")
    return s.select("model", "feature_index", r6("mean").alias("mean"), "keep")


@query("fold_train_metrics")
def fold_train_metrics(spark, sf):
    """Logistic regression per fold on the vectors; class = label below 5."""
    e = D.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("slide_id"), (F.col("label") < 5).cast("int").alias("label"), F.col("embedding").alias("features"))
    part = hash_number("slide_id", "fold", 42) % 10
    splits = e.select("slide_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("fold")).withColumn(
        "split", F.when(part == 0, "test").when(part == 1, "val").otherwise("train"))
    return T.fold_train_metrics(e.select("slide_id", "features"), e.select("slide_id", "label"), splits, [0, 1, 2], max_iter=20)


@query("joint_scatter")
def joint_scatter(spark, sf):
    z = K.joint_scatter(D.tiles(spark, sf).select("model", "tile_idx", "features"), "features", 10)
    return z.select("model", "tile_idx", r6(F.col("xy")[0]).alias("pc1"), r6(F.col("xy")[1]).alias("pc2"))


@query("model_cluster_summary", f"""with {DIST_SQL.replace("select model, tile_idx", "select slide_id, model, tile_idx")},
n as (select slide_id, model, class, count(*) as n from pt group by 1, 2, 3),
s as (select a.slide_id, a.model, a.tile_idx, a.class as own, b.class as other, sum(list_distance(a.f, b.f)) as d from pt a join pt b using (slide_id, model) group by 1, 2, 3, 4, 5),
m as (select s.*, n.n, case when own = other then d / nullif(n.n - 1, 0) else d / n.n end as mean from s join n on n.slide_id = s.slide_id and n.model = s.model and n.class = s.other),
ab as (select slide_id, model, tile_idx, max(mean) filter (own = other) as a, min(mean) filter (own <> other) as b, max(n) filter (own = other) as own_n from m group by 1, 2, 3),
sc as (select slide_id, model, avg(case when b is null then null when own_n <= 1 then 0 else (b - a) / greatest(a, b) end) as sil from ab group by 1, 2)
select model, round(avg(sil), 6) as mean, round(stddev_samp(sil), 6) as std, count(sil) as n from sc group by model""")
def model_cluster_summary(spark, sf):
    t = D.tiles(spark, sf)
    s = K.silhouette(t, ["slide_id", "model"], "tile_idx", "features", "class")
    m = K.model_cluster_summary(K.slide_cluster_summary(t, s))
    return m.select("model", r6("mean").alias("mean"), r6("std").alias("std"), "n")
