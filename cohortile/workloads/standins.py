"""How the given tables play the roles of the study tables.

Each role is a DataFrame function and the same rule as SQL text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.draws import hash_number, hash_unit

N_FOLDS = 5
SEED = 42


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sql_hash(*parts):
    return f"cast('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15) as bigint)"


# --- labels and predictions of three models --------------------------------
def scored(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return lab.join(docs, "doc_id").select(
        F.col("doc_id").cast("string").alias("slide_id"), F.col("quality").cast("int").alias("label"),
        hash_unit("doc_id").alias("m1"), F.least(F.lit(1.0), F.col("n_chars") / 3000.0).alias("m2"),
    ).withColumn("m3", (F.col("m1") + F.col("m2")) / 2.0)


def labels(spark, sf):
    return table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("slide_id"), F.col("quality").cast("int").alias("label"))


def preds(spark, sf):
    long = scored(spark, sf).unpivot(["slide_id", "label"], ["m1", "m2", "m3"], "model", "score")
    return long.withColumn("pred", (F.col("score") >= 0.5).cast("int")).withColumn(
        "prob", F.array(1 - F.col("score"), F.col("score")))


SQL_PREDS = f"""
scored as (
  select cast(l.doc_id as varchar) as slide_id, l.quality as label,
         {sql_hash("cast(l.doc_id as varchar)")} / 1152921504606846976.0::double as m1,
         least(1.0::double, d.n_chars / 3000.0::double) as m2
  from labels l join documents d on l.doc_id = d.doc_id),
long_preds as (
  select slide_id, label, 'm1' as model, m1 as score from scored
  union all select slide_id, label, 'm2', m2 from scored
  union all select slide_id, label, 'm3', (m1 + m2) / 2.0::double from scored),
preds as (select *, case when score >= 0.5 then 1 else 0 end as pred from long_preds)"""


def splits(spark, sf):
    ids = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("slide_id"))
    rows = ids.select("slide_id", F.explode(F.sequence(F.lit(0), F.lit(N_FOLDS - 1))).alias("fold"))
    part = hash_number("slide_id", "fold", SEED) % 10
    return rows.withColumn("split", F.when(part == 0, "test").when(part == 1, "val").otherwise("train"))


SQL_SPLITS = f"""
folds as (select unnest(range(0, {N_FOLDS})) as fold),
split_hash as (
  select cast(doc_id as varchar) as slide_id, fold,
         {sql_hash("cast(doc_id as varchar)", "cast(fold as varchar)", f"'{SEED}'")} % 10 as part
  from labels, folds),
splits as (select slide_id, fold, case when part = 0 then 'test' when part = 1 then 'val' else 'train' end as split
           from split_hash)"""


def sql_metrics(src: str, keys: str, weight="1") -> str:
    """CTEs ``cells .. metrics`` over a relation with label, pred, score."""
    k = [c.strip() for c in keys.split(",")]
    on = " and ".join(f"m.{c} = a.{c}" for c in k)
    return f"""
cls as (
  select {keys}, label as class, case when label = pred then {weight} else 0 end as tp, 0 as fp,
         case when label <> pred then {weight} else 0 end as fn from {src}
  union all
  select {keys}, pred, 0, case when label <> pred then {weight} else 0 end, 0 from {src}),
per_class as (
  select {keys}, class, sum(tp)::double as tp, sum(fp)::double as fp, sum(fn)::double as fn from cls group by {keys}, class),
conf as (
  select {keys}, cast(sum(tp + fn) as bigint) as n, sum(tp) / sum(tp + fn) as accuracy,
         coalesce(max(case when class = 1 and tp + fn > 0 then tp / (tp + fn) end), 0.0::double) as sensitivity,
         coalesce(max(case when class = 0 and tp + fn > 0 then tp / (tp + fn) end), 0.0::double) as specificity,
         avg(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0.0::double end) as f1
  from per_class group by {keys}),
by_score as (
  select {keys}, score, sum(case when label = 1 then {weight} else 0 end)::double as pos,
         sum(case when label = 1 then 0 else {weight} end)::double as neg from {src} group by {keys}, score),
by_score_cum as (
  select *, coalesce(sum(neg) over (partition by {keys} order by score rows between unbounded preceding and 1 preceding), 0) as below
  from by_score),
auc as (
  select {keys}, case when sum(pos) * sum(neg) > 0 then sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) end as auc
  from by_score_cum group by {keys}),
metrics as (select m.*, a.auc from conf m join auc a on {on})"""


# --- several probabilities per row: softmax of the first ten dimensions -----
def multi(spark, sf):
    e = table(spark, sf, "embeddings")
    ex = F.transform(F.slice("embedding", 1, 10), lambda v: F.round(F.exp(v.cast("double")), 6))
    return e.select(F.col("vec_id").cast("string").alias("slide_id"), F.col("label").cast("int").alias("label"),
                    ex.alias("prob"))


SQL_MULTI = """
multi as (
  select cast(vec_id as varchar) as slide_id, label, unnest(range(0, 10)) as class,
         unnest(list_transform(embedding[1:10], lambda v: round(exp(v::double), 6))) as p from embeddings),
multi_pred as (
  select slide_id, any_value(label) as label,
         cast(arg_max(class, (p, -class)) as integer) as pred from multi group by slide_id)"""


# --- survival ---------------------------------------------------------------
def survival(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("slide_id"),
        F.datediff(F.lit("2001-09-01").cast("date"), F.col("o_orderdate").cast("date")).cast("double").alias("time"),
        (F.col("o_orderstatus") == "F").cast("int").alias("event"), "o_totalprice")


SQL_SURVIVAL = """
med as (select median(o_totalprice) as m from orders),
surv as (
  select cast(date_diff('day', o_orderdate::date, date '2001-09-01') as double) as time,
         case when o_orderstatus = 'F' then 1 else 0 end as event,
         case when o_totalprice >= m then 1 else 0 end as grp from orders, med)"""


# --- bootstrap-like values: one per (event type, user) ----------------------
def boot_values(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("model"), F.col("user_id").alias("iter")).agg(
        F.round(F.avg("value"), 3).alias("value")).withColumn("metric", F.lit("value"))


SQL_BOOT = """
boot as (
  select event_type as model, user_id as iter, round(avg(value), 3) as value, 'value' as metric
  from events group by event_type, user_id)"""


# --- two models' tiles -------------------------------------------------------
def tiles(spark, sf):
    e = table(spark, sf, "embeddings")
    base = e.select(
        (F.col("vec_id") % 20).cast("string").alias("slide_id"), F.col("vec_id").alias("tile_idx"),
        (256 * (F.col("vec_id") % 25)).alias("x"), (256 * F.floor(F.col("vec_id") / 25)).alias("y"),
        F.col("label").cast("int").alias("site"), (F.col("label") < 5).cast("int").alias("class"), "embedding")
    a = base.withColumn("model", F.lit("A")).withColumn("features", F.slice("embedding", 1, 32))
    b = base.withColumn("model", F.lit("B")).withColumn("features", F.slice("embedding", 33, 32))
    return a.unionByName(b).drop("embedding")


SQL_TILES = """
base_tiles as (
  select cast(vec_id % 20 as varchar) as slide_id, vec_id as tile_idx, 256 * (vec_id % 25) as x,
         256 * (vec_id // 25) as y, label as site, case when label < 5 then 1 else 0 end as class, embedding from embeddings),
tiles as (
  select * exclude (embedding), 'A' as model, embedding[1:32] as features from base_tiles
  union all select * exclude (embedding), 'B', embedding[33:64] from base_tiles)"""


# --- attention scores per tile ------------------------------------------------
def attention(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_suppkey").cast("string").alias("slide_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
        F.col("l_extendedprice").alias("score"))


SQL_ATTENTION = """
attention as (
  select cast(l_suppkey as varchar) as slide_id, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice as score
  from lineitem)"""


# --- patients and slides ------------------------------------------------------
def sql_barcode(key, site):
    return f"'TCGA-' || lpad(cast({site} as varchar), 2, '0') || '-' || lpad(cast({key} as varchar), 8, '0')"


def barcode(key, site):
    return F.concat(F.lit("TCGA-"), F.lpad(F.col(site).cast("string"), 2, "0"), F.lit("-"),
                    F.lpad(F.col(key).cast("string"), 8, "0"))


def patients(spark, sf):
    """Master table: grade by market segment (one segment has none), follow-up
    days from the balance, death days where the balance is negative."""
    c = table(spark, sf, "customer")
    grade = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "G1").when(F.col("c_mktsegment") == "BUILDING", "G2").when(
        F.col("c_mktsegment") == "FURNITURE", "G3").when(F.col("c_mktsegment") == "HOUSEHOLD", "G4").otherwise("GX")
    days = F.floor(F.abs("c_acctbal")).cast("string")
    return c.select(
        barcode("c_custkey", "c_nationkey").alias("patient_id"), grade.alias("tumor_grade"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "").otherwise(F.col("c_mktsegment")).alias("vital_status"),
        F.when(F.col("c_custkey") % 7 == 0, F.lit("0")).otherwise(days).alias("days_to_last_followup"),
        F.when(F.col("c_acctbal") < 0, days).otherwise(F.lit("")).alias("death_days_to"),
        F.col("c_custkey").alias("row_ord"))


SQL_PATIENTS = f"""
patients as (
  select {sql_barcode("c_custkey", "c_nationkey")} as patient_id,
         case c_mktsegment when 'AUTOMOBILE' then 'G1' when 'BUILDING' then 'G2' when 'FURNITURE' then 'G3'
              when 'HOUSEHOLD' then 'G4' else 'GX' end as tumor_grade,
         case when c_mktsegment = 'MACHINERY' then '' else c_mktsegment end as vital_status,
         case when c_custkey % 7 = 0 then '0' else cast(cast(floor(abs(c_acctbal)) as bigint) as varchar) end as days_to_last_followup,
         case when c_acctbal < 0 then cast(cast(floor(abs(c_acctbal)) as bigint) as varchar) else '' end as death_days_to,
         c_custkey as row_ord from customer)"""


def slides(spark, sf):
    """One slide per order, named after its customer's barcode."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    j = o.join(c, "o_custkey", "left")
    site = F.coalesce(F.col("c_nationkey"), F.lit(99))
    return j.withColumn("_site", site).select(
        F.concat(barcode("o_custkey", "_site"), F.lit("-"), F.col("o_orderkey").cast("string")).alias("slide_id"),
        F.col("o_custkey").cast("string").alias("case_id"),
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("label"),
        F.col("o_orderkey").alias("row_ord"))


SQL_SLIDES = f"""
slides as (
  select {sql_barcode("o_custkey", "coalesce(c_nationkey, 99)")} || '-' || cast(o_orderkey as varchar) as slide_id,
         cast(o_custkey as varchar) as case_id,
         case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as label, o_orderkey as row_ord
  from orders left join customer on o_custkey = c_custkey)"""
