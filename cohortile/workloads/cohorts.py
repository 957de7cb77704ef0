"""Cohort building, splits and sampling on the given tables."""

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions import scaling
from ..operators import cohort as C
from ..operators import sampling as A
from ..operators import splits as P
from ..session import r6
from . import standins as D
from .registry import query


@query("patient_label_join", f"""with {D.SQL_SLIDES}, {D.SQL_PATIENTS},
g as (select patient_id, case tumor_grade when 'G1' then 0 when 'G2' then 1 when 'G3' then 2 when 'G4' then 3 end as label from patients)
select slide_id, s.pid as patient_id, g.label from (select slide_id, regexp_extract(slide_id, '^(TCGA-[^-]+-[^-]+)', 1) as pid from slides) s
join g on g.patient_id = s.pid where g.label is not null""")
def patient_label_join(spark, sf):
    pats = D.patients(spark, sf).select("patient_id", X.map_grade("tumor_grade").alias("label"), "row_ord")
    return C.attach_patient_label(D.slides(spark, sf).select("slide_id"), pats)


SURV_SQL = f"""{D.SQL_SLIDES}, {D.SQL_PATIENTS},
keyed as (select *, array_to_string(string_split(slide_id, '-')[1:3], '-') as patient_id from slides),
j as (select k.slide_id, k.case_id, p.patient_id, try_cast(p.death_days_to as double) as d, try_cast(p.days_to_last_followup as double) as f
      from keyed k left join patients p using (patient_id))"""


@query("survival_labels", f"""with {SURV_SQL}
select slide_id, case_id, case when d > 0 then d else f end as time, case when d > 0 then 1 else 0 end as event
from j where patient_id is not null and (d > 0 or f > 0)""")
def survival_labels(spark, sf):
    rows, _ = C.survival_labels(D.slides(spark, sf), D.patients(spark, sf))
    return rows


@query("survival_rejects", f"""with {SURV_SQL}
select slide_id, case when patient_id is null then 'not found in master file' else 'invalid survival data' end as reason
from j where patient_id is null or not (coalesce(d > 0, false) or coalesce(f > 0, false))""")
def survival_rejects(spark, sf):
    _, bad = C.survival_labels(D.slides(spark, sf), D.patients(spark, sf))
    return bad.select("slide_id", "reason")


@query("case_label", """with c as (select o_custkey as case_id, case o_orderpriority when '1-URGENT' then 'T1' when '2-HIGH' then 't2a'
  when '3-MEDIUM' then 'T3' when '4-NOT SPECIFIED' then 'T4b' else 'TX' end as v from orders),
s as (select case_id, cast(nullif(regexp_extract(v, '^[Tt]([1-4])', 1), '') as integer) as label from c),
n as (select case_id, label, count(*) as n from s where label is not null group by case_id, label)
select case_id, arg_max(label, (n, label)) as label from n group by case_id""")
def case_label(spark, sf):
    o = D.table(spark, sf, "orders")
    stage = X.map_values("o_orderpriority", {"1-URGENT": "T1", "2-HIGH": "t2a", "3-MEDIUM": "T3", "4-NOT SPECIFIED": "T4b"}, "TX")
    return C.case_label(o.select(F.col("o_custkey").alias("case_id"), stage.alias("value")), "stage")


@query("case_label_numeric", """with n as (select l_suppkey as case_id, cast(l_quantity as integer) as label, count(*) as n from lineitem group by 1, 2)
select case_id, arg_max(label, (n, label)) as label from n group by case_id""")
def case_label_numeric(spark, sf):
    li = D.table(spark, sf, "lineitem")
    return C.case_label(li.select(F.col("l_suppkey").alias("case_id"), F.col("l_quantity").alias("value")), "numeric")


@query("collapse_patients", f"""with {D.SQL_SLIDES}
select case_id, count(*) as n_slides, arg_min(label, row_ord) as label from slides group by case_id""")
def collapse_patients(spark, sf):
    return C.collapse_patients(D.slides(spark, sf))


@query("last_row_wins", """select cast(o_custkey as varchar) as patient_id, arg_max(o_orderstatus, o_orderkey) as status,
max(o_orderkey) as row_ord from orders group by o_custkey""")
def last_row_wins(spark, sf):
    o = D.table(spark, sf, "orders").select(
        F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("patient_id"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderkey").alias("row_ord"))
    return C.last_row_wins(o)


@query("split_validation", f"""with {D.SQL_SLIDES}, {D.SQL_PATIENTS},
v as (select patient_id, vital_status <> '' and (coalesce(try_cast(days_to_last_followup as double) <> 0, days_to_last_followup <> '')
       or coalesce(try_cast(death_days_to as double) <> 0, death_days_to <> '')) as ok from patients),
s as (select case row_ord % 10 when 0 then 'test' when 1 then 'val' else 'train' end as split,
      array_to_string(string_split(slide_id, '-')[1:3], '-') as patient_id from slides),
a as (select split, count(*) as total, count(ok) as matched, cast(coalesce(sum(case when ok then 1 else 0 end), 0) as bigint) as valid
      from s left join v using (patient_id) group by split)
select *, round(100.0::double * matched / total, 6) as matched_pct, round(100.0::double * valid / total, 6) as valid_pct from a""")
def split_validation(spark, sf):
    part = F.col("row_ord") % 10
    s = D.slides(spark, sf).withColumn("split", F.when(part == 0, "test").when(part == 1, "val").otherwise("train"))
    v = C.split_validation(s.select("slide_id", "split"), D.patients(spark, sf))
    return v.select("split", "total", "matched", "valid", r6("matched_pct").alias("matched_pct"), r6("valid_pct").alias("valid_pct"))


@query("clinical_flags", f"""with {D.SQL_PATIENTS}
select patient_id, try_cast(days_to_last_followup as double) <> 0 as followup_valid,
       coalesce(try_cast(death_days_to as double) <> 0, trim(death_days_to) <> '') as death_valid,
       split_part(patient_id, '-', 2) as institution, cast(null as integer) as stage,
       case when tumor_grade in ('G1', 'G2') then 0 when tumor_grade in ('G3', 'G4') then 1 end as task_label,
       case when tumor_grade in ('G1', 'G2') then -1 when tumor_grade in ('G3', 'G4') then 1 end as sign from patients""")
def clinical_flags(spark, sf):
    p = D.patients(spark, sf)
    task = X.remap_task_label(X.map_grade("tumor_grade"), "kidney")
    return p.select(
        "patient_id", X.is_valid_value("days_to_last_followup").alias("followup_valid"),
        X.is_valid_value("death_days_to").alias("death_valid"), X.institution_code("patient_id").alias("institution"),
        X.parse_stage("tumor_grade").alias("stage"), task.alias("task_label"), X.class_sign(task).alias("sign"))


# --- keys -------------------------------------------------------------------------
@query("common_keys", """select user_id from events group by user_id
having count(distinct event_type) = (select count(distinct event_type) from events)""")
def common_keys(spark, sf):
    return C.common_keys(D.table(spark, sf, "events"), ["user_id"], "event_type")


@query("any_keys", "select c_custkey from customer where c_custkey in (select o_custkey from orders)")
def any_keys(spark, sf):
    c, o = D.table(spark, sf, "customer"), D.table(spark, sf, "orders")
    return C.keys_in_any(c.select("c_custkey"), o.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("missing_keys", "select distinct doc_id from documents where doc_id not in (select doc_id from labels)")
def missing_keys(spark, sf):
    return C.missing_keys(D.table(spark, sf, "documents"), D.table(spark, sf, "labels"), ["doc_id"])


# --- splits ------------------------------------------------------------------------
def _quota_sql(src, frac, scope=""):
    part = f"partition by {scope}" if scope else ""
    sc = f"{scope}," if scope else ""
    return f"""(select {sc} label, base + case when row_number() over ({part} order by raw - base desc, label) <= size - sum(base) over ({part}) then 1 else 0 end as quota
 from (select *, floor(raw) as base from (select *, n::double / tot * size as raw from (
   select {sc} label, n, sum(n) over ({part}) as tot, ceil(sum(n) over ({part}) * {frac}::double - 1e-9) as size
   from (select {sc} label, count(*) as n from {src} group by {sc} label)))))"""


STRAT_SQL = f"""{D.SQL_SLIDES},
pats as (select case_id, arg_min(label, row_ord) as label from slides group by case_id),
o as (select p.*, row_number() over (partition by p.label order by md5(concat_ws('|', case_id, 'test', '42')), case_id) <= quota as taken
      from pats p join {_quota_sql("pats", "0.1")} q using (label)),
folds as (select cast(unnest(range(0, 5)) as integer) as fold),
pool as (select fold, case_id, label from o, folds where not taken),
i as (select p.*, row_number() over (partition by p.fold, p.label order by md5(concat_ws('|', case_id, 'val', cast(p.fold as varchar), '42')), case_id) <= quota as taken
      from pool p join {_quota_sql("pool", "(0.1::double / 0.9::double)", "fold")} q on q.fold = p.fold and q.label = p.label),
splits as (select fold, case_id, label, case when taken then 'val' else 'train' end as split from i
           union all select fold, case_id, label, 'test' from o, folds where taken)"""


@query("stratified_split", f"with {STRAT_SQL} select fold, slide_id, case_id, split from slides s join splits using (case_id)")
def stratified_split(spark, sf):
    s = D.slides(spark, sf)
    return P.expand_to_slides(P.stratified_patient_splits(s), s)


SEQ_SQL = f"""{D.SQL_SLIDES},
pats as (select case_id, arg_min(label, row_ord) as label from slides group by case_id),
folds as (select cast(unnest(range(0, 5)) as integer) as fold),
r as (select fold, case_id, label, row_number() over (partition by fold, label order by md5(concat_ws('|', case_id, cast(fold as varchar), '42')), case_id) - 1 as pos
      from pats, folds),
n as (select label, round_even(count(*) * 0.1::double, 0) as nv, count(*) as n from pats group by label),
splits as (select fold, case_id, label, case when pos < nv then 'val' when pos < 2 * nv then 'test'
             when pos < 2 * nv + ceil((n - 2 * nv) * 0.5::double) then 'train' end as split from r join n using (label))"""


@query("sequential_split", f"with {SEQ_SQL} select fold, case_id, label, split from splits where split is not null")
def sequential_split(spark, sf):
    return P.sequential_splits(D.slides(spark, sf), label_frac=0.5)


@query("split_descriptor", f"""with {SEQ_SQL} select fold, label, count(*) filter (split = 'train') as train,
count(*) filter (split = 'val') as val, count(*) filter (split = 'test') as test from splits where split is not null group by fold, label""")
def split_descriptor(spark, sf):
    return P.split_descriptor(P.sequential_splits(D.slides(spark, sf), label_frac=0.5))


@query("split_wide", f"""with {SEQ_SQL},
p as (select fold, split, case_id, row_number() over (partition by fold, split order by md5(case_id), case_id) - 1 as "row" from splits where split is not null)
select fold, "row", coalesce(max(case_id) filter (split = 'train'), '') as train, coalesce(max(case_id) filter (split = 'val'), '') as val,
       coalesce(max(case_id) filter (split = 'test'), '') as test from p group by fold, "row" """)
def split_wide(spark, sf):
    return P.split_wide(P.sequential_splits(D.slides(spark, sf), label_frac=0.5).select("fold", "case_id", "split"), "case_id")


# --- sampling ------------------------------------------------------------------------
TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
TIE = ", ".join(TIES)


@query("topk_tiles", f"""with {D.SQL_ATTENTION} select slide_id, {TIE}, score,
cast(row_number() over (partition by slide_id order by score desc, {TIE}) as integer) as rank from attention
qualify row_number() over (partition by slide_id order by score desc, {TIE}) <= 100""")
def topk_tiles(spark, sf):
    return A.top_k(D.attention(spark, sf), ["slide_id"], "score", 100, TIES)


@query("bottomk_padded", """with a as (select l_partkey, [l_quantity, l_discount] as f, l_extendedprice as score,
 row_number() over (partition by l_partkey order by l_extendedprice, l_orderkey, l_linenumber, l_suppkey) as rank from lineitem),
slots as (select l_partkey, cast(unnest(range(1, 41)) as integer) as rank from (select distinct l_partkey from lineitem))
select l_partkey, rank, f is null as padded, coalesce(f[1], 0.0::double) as f0, coalesce(f[2], 0.0::double) as f1
from slots left join a using (l_partkey, rank)""")
def bottomk_padded(spark, sf):
    li = D.table(spark, sf, "lineitem").withColumn("f", F.array("l_quantity", "l_discount"))
    out = A.bottom_k_padded(li, "l_partkey", "l_extendedprice", 40, "f", 2, ["l_orderkey", "l_linenumber", "l_suppkey"])
    return out.select("l_partkey", "rank", "padded", F.col("f")[0].alias("f0"), F.col("f")[1].alias("f1"))


def _hash_sql(*parts):
    return f"md5(concat_ws('|', {', '.join(parts)}))"


@query("fraction_per_group", f"""with t as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey
 order by {_hash_sql("cast(o_orderkey as varchar)", "'42'")}, o_orderkey) as i, count(*) over (partition by o_custkey) as n from orders)
select o_custkey, o_orderkey from t where i <= greatest(1, floor(n * 0.1::double))""")
def fraction_per_group(spark, sf):
    o = D.table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return A.fraction_per_group(o, ["o_custkey"], ["o_orderkey"], 0.1)


@query("sample_total", f"""select event_id, event_type from events qualify row_number() over (
 order by {_hash_sql("cast(event_id as varchar)", "'42'")}, event_id) <= 2000""")
def sample_total(spark, sf):
    return A.sample_total(D.table(spark, sf, "events").select("event_id", "event_type"), ["event_id"], 2000)


@query("sample_background", f"""with {D.SQL_SPLITS}
select slide_id from splits where fold = 0 and split = 'train' qualify row_number() over (order by {_hash_sql("slide_id", "'42'")}, slide_id) <= 50""")
def sample_background(spark, sf):
    train = D.splits(spark, sf).filter("fold = 0 and split = 'train'").select("slide_id")
    return A.sample_total(train, ["slide_id"], 50)


@query("sample_items", f"""select p_name from (select distinct p_name from part) qualify row_number() over (order by {_hash_sql("p_name", "'7'")}, p_name) <= 10""")
def sample_items(spark, sf):
    return A.sample_names(D.table(spark, sf, "part"), "p_name", 10, 7)


@query("location_sample", f"""with t as (select l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity, l_orderkey % 4000 as x, l_partkey as y from lineitem),
s as (select l_suppkey, count(*) as n, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from t group by l_suppkey),
b as (select t.*, n, least(31, floor((x - x0) / greatest((x1 - x0)::double, 1.0) * 32)) as bx, least(31, floor((y - y0) / greatest((y1 - y0)::double, 1.0) * 32)) as by_,
      {_hash_sql("cast(l_orderkey as varchar)", "cast(l_linenumber as varchar)", "cast(l_partkey as varchar)", "cast(l_quantity as varchar)", "'42'")} as h from t join s using (l_suppkey)),
one as (select * from b where n > 300 qualify row_number() over (partition by l_suppkey, bx, by_ order by h, l_orderkey, l_linenumber, l_partkey, l_quantity) = 1)
select l_suppkey, l_orderkey, l_linenumber, l_partkey, x, y from b where n <= 300
union all select l_suppkey, l_orderkey, l_linenumber, l_partkey, x, y from one qualify row_number() over (partition by l_suppkey order by h) <= 300""")
def location_sample(spark, sf):
    t = D.table(spark, sf, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", (F.col("l_orderkey") % 4000).alias("x"), F.col("l_partkey").alias("y"))
    return A.location_sample(t, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], 300).drop("l_quantity")


QUOTA_SQL = """c as (select n_regionkey as scope, c_nationkey as k, count(*) as n from customer join nation on n_nationkey = c_nationkey group by 1, 2),
a as (select *, sum(n) over (partition by scope) as tot from c),
b as (select *, n::double / tot * 100 as raw from a),
d as (select *, floor(raw) as base, raw - floor(raw) as frac from b),
e as (select *, least(base + case when row_number() over (partition by scope order by frac desc, k) <= 100 - sum(base) over (partition by scope) then 1 else 0 end, n) as q from d),
f as (select *, 100 - sum(q) over (partition by scope) as short, n - q as lft from e),
g as (select *, least(lft, greatest(0, short - coalesce(sum(lft) over (partition by scope order by lft desc, k rows between unbounded preceding and 1 preceding), 0))) as more from f),
quotas as (select scope, k, n, cast(case when tot <= 100 then n else q + more end as bigint) as quota from g)"""


def _quotas(spark, sf):
    c = D.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    nat = D.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("scope"))
    counts = c.groupBy("k").agg(F.count(F.lit(1)).alias("n")).join(nat, "k")
    return c, A.largest_remainder_quota(counts, 100, "scope", "k")


@query("quotas", f"with {QUOTA_SQL} select * from quotas")
def quotas(spark, sf):
    return _quotas(spark, sf)[1]


@query("quota_sample", f"""with {QUOTA_SQL}, r as (select c_custkey, c_nationkey as k, row_number() over (partition by c_nationkey
 order by {_hash_sql("cast(c_custkey as varchar)", "'42'")}, c_custkey) as i from customer)
select r.k, c_custkey from r join quotas on quotas.k = r.k where i <= quota""")
def quota_sample(spark, sf):
    c, q = _quotas(spark, sf)
    return A.quota_sample(c, q, "k", ["c_custkey"])


@query("sample_by_score", f"""with {D.SQL_ATTENTION}, p as (select *, percent_rank() over (partition by slide_id order by score) as pr from attention)
select slide_id, {TIE}, round(pr, 6) as percentile from p where pr between 0.25 and 0.75
qualify row_number() over (partition by slide_id order by score desc, {TIE}) <= 15""")
def sample_by_score(spark, sf):
    s = A.sample_by_score(D.attention(spark, sf), "slide_id", "score", 15, "top", 0.25, 0.75, TIES)
    return s.select("slide_id", *TIES, r6("percentile").alias("percentile"))


@query("percentile_score", f"""with {D.SQL_ATTENTION} select slide_id, {TIE},
round(percent_rank() over (partition by slide_id order by score), 6) as percentile from attention""")
def percentile_score(spark, sf):
    p = scaling.percentile_score(D.attention(spark, sf), ["slide_id"], "score", "percentile")
    return p.select("slide_id", *TIES, r6("percentile").alias("percentile"))


@query("minmax", f"""with {D.SQL_ATTENTION}, s as (select slide_id, min(score) as mn, max(score) as mx from attention group by slide_id)
select slide_id, {TIE}, round((score - mn) / (mx - mn + 1e-6), 6) as heat, round(case when mx > mn then (score - mn) / (mx - mn) else 0 end, 6) as unit
from attention join s using (slide_id)""")
def minmax(spark, sf):
    a = scaling.minmax(D.attention(spark, sf), ["slide_id"], "score", "heat", "heat")
    return scaling.minmax(a, ["slide_id"], "score", "unit", "zero").select(
        "slide_id", *TIES, r6("heat").alias("heat"), r6("unit").alias("unit"))


@query("zscore", f"""with {D.SQL_ATTENTION}, s as (select slide_id, avg(score) as m, stddev_pop(score) as sd from attention group by slide_id)
select slide_id, {TIE}, round(case when sd < 1e-8 then 0 else (greatest(-3, least(3, (score - m) / sd)) + 3) / 6 end, 5) as z
from attention join s using (slide_id)""")
def zscore(spark, sf):
    z = scaling.zscore01(D.attention(spark, sf), ["slide_id"], "score", "z")
    return z.select("slide_id", *TIES, F.round("z", 5).alias("z"))


@query("top_k_classes", f"""with {D.SQL_MULTI}, r as (select slide_id, class, p, row_number() over (partition by slide_id order by p desc, class) as i from multi)
select slide_id, cast(max(class) filter (i = 1) as integer) as Pred_0, max(p) filter (i = 1) as p_0, cast(max(class) filter (i = 2) as integer) as Pred_1,
       max(p) filter (i = 2) as p_1, cast(max(class) filter (i = 3) as integer) as Pred_2, max(p) filter (i = 3) as p_2 from r group by slide_id""")
def top_k_classes(spark, sf):
    return A.top_k_classes(D.multi(spark, sf), ["slide_id"], "prob", 3)


# --- grids ----------------------------------------------------------------------------
GRID_SQL = """pts as (select event_id, event_type as model, case when value >= 50 then 1 else 0 end as class,
  (event_id * 37 % 1009) / 1009.0::double as x01, (event_id * 91 % 1013) / 1013.0::double as y01 from events),
cells as (select *, least(19, cast(floor(y01 * 20) as integer)) as r, least(19, cast(floor(x01 * 20) as integer)) as c from pts)"""


def grid_points(spark, sf):
    e = D.table(spark, sf, "events")
    return e.select("event_id", F.col("event_type").alias("model"), (F.col("value") >= 50).cast("int").alias("class"),
                    (F.col("event_id") * 37 % 1009 / 1009.0).alias("x01"), (F.col("event_id") * 91 % 1013 / 1013.0).alias("y01"))


@query("grid_direct", f"""with {GRID_SQL},
d as (select *, count(*) over (partition by model, r, c) as n_points, {_hash_sql("cast(event_id as varchar)", "'42'")} as h,
      (x01 - (c + 0.5::double) / 20) * (x01 - (c + 0.5::double) / 20) + (y01 - (r + 0.5::double) / 20) * (y01 - (r + 0.5::double) / 20) as dist from cells)
select model, r, c, n_points, event_id, class from d qualify case when n_points = 2 then row_number() over (partition by model, r, c order by h, event_id)
  else row_number() over (partition by model, r, c order by dist, event_id) end = 1""")
def grid_direct(spark, sf):
    return A.grid_direct(grid_points(spark, sf), ["model"], ["event_id"], 20, 20).drop("x01", "y01")


@query("occupancy", f"""with {GRID_SQL}, o as (select model, r, c, count(*) filter (class = 1) as n_pos, count(*) filter (class = 0) as n_neg from cells group by model, r, c)
select *, case when n_pos > n_neg then 'pos' when n_pos < n_neg then 'neg' else 'mixed' end as majority from o""")
def occupancy(spark, sf):
    return A.occupancy(grid_points(spark, sf), ["model"], 20, 20)


# --- colours and names -------------------------------------------------------------------
@query("colorref", """with p as (select p_partkey, p_partkey * 7919 % 16777216 as v from part)
select p_partkey, cast(v & 255 as integer) as r, cast((v >> 8) & 255 as integer) as g, cast((v >> 16) & 255 as integer) as b,
       printf('#%02X%02X%02X', v & 255, (v >> 8) & 255, (v >> 16) & 255) as hex from p""")
def colorref(spark, sf):
    p = D.table(spark, sf, "part").withColumn("v", F.col("p_partkey") * 7919 % 16777216)
    c = X.colorref_channels("v")
    return p.select("p_partkey", c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"), X.colorref_to_hex("v").alias("hex"))


@query("annotation_colors", """with p as (select p_type as color, p_brand as file from part),
f as (select color, file, count(*) as n from p group by color, file)
select color, cast(sum(n) as bigint) as count, count(*) as files, array_to_string(list(file order by file)[1:3], ',') as sample_files from f group by color""")
def annotation_colors(spark, sf):
    p = D.table(spark, sf, "part").select(F.col("p_type").alias("color"), F.col("p_brand").alias("file"))
    return C.annotation_colors(p).withColumn("sample_files", F.array_join("sample_files", ","))


@query("tile_geometry", """with t as (select l_orderkey, l_linenumber, l_partkey, l_extendedprice, (l_orderkey % 60 * 256)::double as x, (l_partkey % 40 * 256)::double as y,
 case when l_quantity > 10 then case when l_quantity > 30 then 40.0::double else 20.0::double end end as objective from lineitem),
r as (select *, coalesce(objective, 20) / 20 as ratio, coalesce(objective, 20) / 10 as want from t)
select l_orderkey, l_linenumber, l_partkey, l_extendedprice, x + 256 * ratio as x1, y + 256 * ratio as y1,
 cast(case when abs(1 - want) <= abs(4 - want) and abs(1 - want) <= abs(16 - want) then 0 when abs(4 - want) <= abs(16 - want) then 1 else 2 end as integer) as level,
 cast(greatest(0, round(x - 0.5 * 224 * 4)) as bigint) as left0 from r""")
def tile_geometry(spark, sf):
    li = D.table(spark, sf, "lineitem")
    q = F.col("l_quantity")
    t = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", (F.col("l_orderkey") % 60 * 256).cast("double").alias("x"),
                  (F.col("l_partkey") % 40 * 256).cast("double").alias("y"), F.when(q > 10, F.when(q > 30, 40.0).otherwise(20.0)).alias("objective"))
    box = X.tile_bounds("x", "y", F.lit(256), X.magnification_ratio("objective", F.lit(20)))
    levels = F.array(F.lit(1.0), F.lit(4.0), F.lit(16.0))
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", box["x1"].alias("x1"), box["y1"].alias("y1"),
                    X.pick_level(levels, "objective", F.lit(10)).alias("level"), X.level0_top_left("x", F.lit(224), F.lit(4.0)).alias("left0"))


@query("cohort_filter", f"""with {D.SQL_SLIDES}, s as (select case row_ord % 4 when 0 then 'hcm-' || slide_id when 1 then slide_id || '-ts' else slide_id end as slide_id from slides)
select slide_id from s where not (upper(slide_id) like 'HCM-%' or (upper(slide_id) like '%TCGA%' and upper(slide_id) like '%-TS%'))""")
def cohort_filter(spark, sf):
    k = F.col("row_ord") % 4
    s = D.slides(spark, sf).select(F.when(k == 0, F.concat(F.lit("hcm-"), "slide_id")).when(k == 1, F.concat("slide_id", F.lit("-ts"))).otherwise(
        F.col("slide_id")).alias("slide_id"))
    return s.filter(~X.exclude_cohort("slide_id"))


@query("tissue_mask", """with p as (select p_partkey, cast(p_partkey * 53 % 256 as integer) as r, cast(p_partkey * 101 % 256 as integer) as g, cast(p_size * 5 as integer) as b from part),
h as (select *, greatest(r, g, b) as hi, least(r, g, b) as lo from p)
select p_partkey, case when hi > 0 then (hi - lo) * 255.0::double / hi else 0 end >= 120 and hi <= 220 as tissue, (r + g + b) / 3.0::double > 220 as bright from h""")
def tissue_mask(spark, sf):
    p = D.table(spark, sf, "part")
    rgb = p.select("p_partkey", (F.col("p_partkey") * 53 % 256).cast("int").alias("r"), (F.col("p_partkey") * 101 % 256).cast("int").alias("g"),
                   (F.col("p_size") * 5).cast("int").alias("b"))
    return rgb.select("p_partkey", X.tissue_pixel("r", "g", "b", 120, 220).alias("tissue"), X.proxy_nontumor("r", "g", "b", F.lit(False)).alias("bright"))


@query("names_and_marks", """with p as (select page_id, case page_id % 3 when 0 then 'run_X_m' || (page_id % 7) || '_s1' when 1 then 'plain_' || (page_id % 5) else 'combpruned0' || (page_id % 10) end as name,
 (page_id % 100) / 1000.0::double as p, (page_id % 13) / 10.0::double - 0.6 as d from pages)
select page_id, case when page_id % 3 = 0 then 'm' || (page_id % 7) else replace(name, '_', ' ') end as model, case when page_id % 3 = 2 then round((page_id % 10) / 10.0::double, 1) end as threshold,
 case when p < 0.001 then '***' when p < 0.01 then '**' when p < 0.05 then '*' else '' end as stars,
 case when abs(d) < 0.2 then 'negligible' when abs(d) < 0.5 then 'small' when abs(d) < 0.8 then 'medium' else 'large' end as effect from p""")
def names_and_marks(spark, sf):
    i = F.col("page_id")
    name = F.when(i % 3 == 0, F.concat(F.lit("run_X_m"), (i % 7).cast("string"), F.lit("_s1"))).when(i % 3 == 1, F.concat(F.lit("plain_"), (i % 5).cast("string"))).otherwise(
        F.concat(F.lit("combpruned0"), (i % 10).cast("string")))
    p = D.table(spark, sf, "pages").select("page_id", name.alias("name"), ((i % 100) / 1000.0).alias("p"), ((i % 13) / 10.0 - 0.6).alias("d"))
    return p.select("page_id", X.model_from_dir("name", "_X_").alias("model"), X.parse_threshold("name").alias("threshold"),
                    X.significance_stars("p").alias("stars"), X.effect_magnitude("d").alias("effect"))


@query("id_sets", """with a as (select distinct user_id from events where event_type = 'click' and value > 50), b as (select distinct user_id from events where event_type = 'view' and value > 50)
select 'both' as kind, user_id from (select * from a intersect select * from b) union all select 'any', user_id from (select * from a union select * from b)
union all select 'only_first', user_id from (select * from a except select * from b)""")
def id_sets(spark, sf):
    e = D.table(spark, sf, "events").filter("value > 50")
    a, b = (e.filter(F.col("event_type") == t).select("user_id") for t in ("click", "view"))
    tag = lambda d, k: d.select(F.lit(k).alias("kind"), "user_id")
    return tag(a.intersect(b), "both").unionByName(tag(a.union(b).distinct(), "any")).unionByName(tag(a.subtract(b), "only_first"))
