"""Readers, sinks and registries: inputs derived from the given tables are
written below the shared folder and go through the operator."""

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import similarity as S
from ..session import r6, shared_folder
from ..sources import readers as R
from ..sources import writers as W
from . import standins as D
from .registry import query


def _folder(spark):
    return f"{shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


@query("read_tiles", f"""with {D.SQL_TILES}, t as (select *, case when tile_idx % 211 = 7 then null else features end as f from tiles where model = 'A')
select slide_id, count(*) as n, min(tile_idx) as first_tile from t where slide_id not in (select slide_id from t where f is null) group by 1""")
def read_tiles(spark, sf):
    path = _folder(spark)
    t = D.tiles(spark, sf).withColumn("features", F.when(F.col("tile_idx") % 211 != 7, F.col("features")))
    t.write.partitionBy("model").parquet(path)
    return R.read_tiles(spark, path, "A").groupBy("slide_id").agg(F.count("*").alias("n"), F.min("tile_idx").alias("first_tile"))


@query("normalize_attention", f"""with {D.SQL_TILES} select model, tile_idx, x, y, round(features[1]::double, 6) as score from tiles""")
def normalize_attention(spark, sf):
    t = D.tiles(spark, sf).select("model", "tile_idx", F.col("features")[0].cast("double").alias("attn"), F.array("x", "y").alias("coords"))
    return R.normalize_attention_columns(t).select("model", "tile_idx", "x", "y", r6("score").alias("score"))


@query("read_clinical", """select c_custkey, c_mktsegment, case when c_custkey % 10 = 3 then null else c_acctbal::double end as c_acctbal from customer""")
def read_clinical(spark, sf):
    path = _folder(spark)
    c = D.table(spark, sf, "customer").withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 == 3, float("nan")).otherwise(F.col("c_acctbal").cast("double")))
    c.select("c_custkey", "c_mktsegment", "c_acctbal", "c_name").write.option("header", True).csv(path)
    return R.read_clinical(spark, path, ["c_custkey", "c_mktsegment", "c_acctbal"], "c_custkey long, c_mktsegment string, c_acctbal double, c_name string")


FILES_SQL = """files as (select 'ann/s' || (page_id % 50) || case when page_id % 3 = 0 then '_normal_' else '_tumor_' end || page_id || '.xml' as path from pages),
named as (select path, substr(path, 5) as name from files), slides as (select distinct 's' || (page_id % 40) as slide_id from pages)"""


@query("annotation_candidates", f"""with {FILES_SQL}, tissues as (select unnest(['tumor', 'normal']) as tissue)
select slide_id, tissue, min(path) as path from named, slides, tissues
where starts_with(name, slide_id) and contains(substr(name, length(slide_id) + 1, length(name) - length(slide_id) - 4), tissue) group by 1, 2""")
def annotation_candidates(spark, sf):
    p = D.table(spark, sf, "pages").select("page_id")
    kind = F.when(F.col("page_id") % 3 == 0, "_normal_").otherwise("_tumor_")
    files = p.select(F.concat(F.lit("ann/s"), (F.col("page_id") % 50).cast("string"), kind, F.col("page_id").cast("string"), F.lit(".xml")).alias("path"))
    slides = p.select(F.concat(F.lit("s"), (F.col("page_id") % 40).cast("string")).alias("slide_id"))
    return R.annotation_candidates(files, slides, "kidney")


@query("require_patches", "select doc_id, lang as classification, source as metadata, n_chars as classification_labels from documents")
def require_patches(spark, sf):
    return R.require_patches(D.table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("classification"), F.col("source").alias("metadata"), F.col("n_chars").alias("classification_labels")))


SEGMENT_SQL = "select c_mktsegment as segment, count(*) as n, round(avg(c_acctbal), 4) as mean from customer group by 1"


def _segments(spark, sf):
    return D.table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


@query("small_csv", SEGMENT_SQL)
def small_csv(spark, sf):
    path = _folder(spark)
    W.write_small_csv(_segments(spark, sf), path)
    return spark.read.option("header", True).schema("segment string, n long, mean double").csv(path)


@query("report_tables", f"with s as ({SEGMENT_SQL}) select 'segments' as sheet, segment as name, n from s union all select 'langs', lang, count(*) from documents group by lang")
def report_tables(spark, sf):
    path = _folder(spark)
    langs = D.table(spark, sf, "documents").groupBy(F.col("lang").alias("name")).agg(F.count("*").alias("n"))
    W.write_report({"segments": _segments(spark, sf).select(F.col("segment").alias("name"), "n"), "langs": langs}, path)
    sheet = lambda s: spark.read.parquet(f"{path}/{s}").select(F.lit(s).alias("sheet"), "name", "n")
    return sheet("segments").unionByName(sheet("langs"))


@query("run_metadata", """with m as (select doc_id from documents where doc_id not in (select doc_id from labels))
select (select count(*) from documents) as n_wanted, (select count(*) from documents) - count(*) as n_present, count(*) as n_missing, 0.5::double as frac,
  sum(doc_id)::bigint as missing_ids from m""")
def run_metadata(spark, sf):
    path = _folder(spark)
    W.write_run_metadata(D.table(spark, sf, "documents"), D.table(spark, sf, "labels"), {"frac": 0.5}, path, ["doc_id"])
    row = spark.read.schema("n_wanted long, n_present long, n_missing long, frac double").json(f"{path}/metadata")
    missing = spark.read.text(f"{path}/missing").agg(F.sum(F.col("value").cast("long")).alias("missing_ids"))
    return row.join(missing, how="cross")  # one row each


@query("resume", "select doc_id, n_chars * 2 as size from documents")
def resume(spark, sf):
    path, docs = _folder(spark), D.table(spark, sf, "documents").select("doc_id", "n_chars")
    size = lambda todo: todo.select("doc_id", (F.col("n_chars") * 2).alias("size"))
    W.resume(spark, docs.filter("doc_id % 3 = 0"), path, ["doc_id"], size)
    return W.resume(spark, docs, path, ["doc_id"], size)


@query("model_registry", f"""with {D.SQL_TILES}
select model, 'in/' || lower(model) as data_dir, 'stable' as stability_dir, case model when 'A' then 32 else 1024 end as dim, count(*) as n from tiles group by model""")
def model_registry(spark, sf):
    registry = R.model_registry(spark, "A,B", "in/a,in/b", "stable", {"A": 32})
    return registry.join(D.tiles(spark, sf).groupBy("model").agg(F.count("*").alias("n")), "model")


@query("embed_dim", f"with {D.SQL_TILES} select model, tile_idx, case model when 'A' then 32 else 1024 end as dim from tiles")
def embed_dim(spark, sf):
    registry = D.tiles(spark, sf).filter("model = 'A'").select("model", F.size("features").alias("dim")).distinct()
    return X.lookup_embed_dim(D.tiles(spark, sf).select("model", "tile_idx"), registry)


@query("bag_label_text", "select doc_id, quality, case quality when 0 then 'poor' when 1 then 'good' end as label_text from labels")
def bag_label_text(spark, sf):
    return R.bag_label_text(D.table(spark, sf, "labels").select("doc_id", "quality"), {0: "poor", 1: "good"}, "quality")


@query("match_slides", f"""with {D.SQL_TILES}, v as (select model, slide_id, arg_min(features, tile_idx) as f from tiles where not (model = 'B' and slide_id = '3') group by 1, 2)
select a.slide_id, round(a.f[1]::double, 6) as first_a, round(b.f[32]::double, 6) as last_b from v a join v b on a.slide_id = b.slide_id and a.model = 'A' and b.model = 'B'""")
def match_slides(spark, sf):
    t = D.tiles(spark, sf).filter("not (model = 'B' and slide_id = '3')")
    vecs = t.groupBy("model", "slide_id").agg(F.min_by("features", "tile_idx").alias("features"))
    got = S.match_slides(vecs, "A", "B")
    return got.select("slide_id", r6(F.col("fx")[0].cast("double")).alias("first_a"), r6(F.col("fy")[31].cast("double")).alias("last_b"))
