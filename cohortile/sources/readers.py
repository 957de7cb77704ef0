"""Readers: tables the operators expect, from parquet, CSV, JSON and XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import DEFAULT_TILE, map_values, nan_to_null
from ..session import require_columns

# --- fixed values: alternative column names, split codes, path patterns, colours
ATTENTION_NAMES = ("attention", "attn", "attention_scores", "scores")
COORD_NAMES = ("coords", "coord", "coordinates")
SPLIT_CODES = {1: "train", 2: "val", 3: "test"}
MAG_TILE_STRICT = r"(?i)(\d+)\s*x[_/\\]+(\d+)\s*px"
MAG_TILE_LOOSE = r"(?i)(\d+)\s*x.*?_(\d+)\s*px"
EMBEDDING_NAME = r"(?i)features[_-](\w+)"
TUMOR_COLOR = 65280
BENIGN_COLOR = 65535
TISSUE_CLASSES = ("ADI", "CSTR", "DEB", "LYM", "MUC", "MUS", "NORM", "STR", "TUM")
PATCH_KEYS = ("classification", "metadata", "classification_labels")
# -----------------------------------------------------------------------------


def read_tiles(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """Tile table. Slides whose feature and coordinate counts differ are left
    out, as are empty vectors. Filters on ``model`` reach the partitions."""
    df = require_columns(spark.read.parquet(path), ["slide_id", "x", "y", "features"])
    if model is not None:
        df = df.filter(F.col("model") == model) if "model" in df.columns else df.withColumn("model", F.lit(model))
    return drop_unaligned_slides(df)


def drop_unaligned_slides(tiles: DataFrame) -> DataFrame:
    ok = (F.size("features") > 0) & F.col("x").isNotNull() & F.col("y").isNotNull()
    keys = [k for k in ("model", "slide_id") if k in tiles.columns]
    has_f, has_c = F.col("features").isNotNull(), F.col("x").isNotNull()
    bad = tiles.groupBy(*keys).agg(F.sum(has_f.cast("long")).alias("_f"), F.sum(has_c.cast("long")).alias("_c")).filter("_f <> _c")
    return tiles.join(bad.select(*keys), keys, "left_anti").filter(ok)


def first_present(df: DataFrame, names, out: str) -> DataFrame:
    """Rename the first of ``names`` the table has; none is an error."""
    for n in names:
        if n in df.columns:
            return df.withColumnRenamed(n, out)
    raise ValueError(f"none of the columns {list(names)} found in {df.columns}")


def normalize_attention_columns(df: DataFrame) -> DataFrame:
    """``score`` and, from a coordinate pair column, ``x`` and ``y``."""
    df = first_present(df, ATTENTION_NAMES, "score")
    if "x" in df.columns and "y" in df.columns:
        return df
    df = first_present(df, COORD_NAMES, "_xy")
    return df.withColumns({"x": F.col("_xy")[0], "y": F.col("_xy")[1]}).drop("_xy")


def read_clinical(spark: SparkSession, path: str, required, schema=None) -> DataFrame:
    """CSV with header, or parquet by extension; only ``required`` columns are
    read. Not-a-number becomes null."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        reader = spark.read.option("header", True)
        df = (reader.schema(schema) if schema else reader).csv(path)
    return nan_to_null(require_columns(df, required).select(*required))


def read_table_columns(df: DataFrame, cols) -> DataFrame:
    return nan_to_null(require_columns(df, cols).select(*cols))


def long_splits(df: DataFrame, fold: int | None = None) -> DataFrame:
    """Wide train/val/test columns, or long slide_id/split with 1, 2, 3, to
    (fold, slide_id, split); blanks are dropped."""
    if {"train", "val", "test"} & set(df.columns):
        names = [c for c in ("train", "val", "test") if c in df.columns]
        keep = ["fold"] if "fold" in df.columns else []
        rows = df.select(*keep, *[F.col(c).cast("string").alias(c) for c in names]).unpivot(keep, names, "split", "slide_id")
    else:
        require_columns(df, ["slide_id", "split"])
        code = F.col("split").cast("string").try_cast("double").cast("int")
        name = F.coalesce(map_values(code, SPLIT_CODES), F.when(F.col("split").cast("string").isin(*SPLIT_CODES.values()), F.col("split").cast("string")))
        rows = df.withColumn("split", name).select(*[c for c in df.columns if c in ("fold", "slide_id", "split")])
    rows = rows.filter(F.col("slide_id").isNotNull() & (F.trim("slide_id") != "") & F.col("split").isNotNull())
    if "fold" not in rows.columns:
        rows = rows.withColumn("fold", F.lit(fold if fold is not None else 0))
    return rows.select("fold", "slide_id", "split")


def read_splits(spark: SparkSession, path: str, fold: int) -> DataFrame:
    return long_splits(spark.read.option("header", True).csv(path), fold)


# --- annotations --------------------------------------------------------------------
VERTEX = "struct<_X: string, _Y: string>"
REGIONS = f"struct<Region: array<struct<Vertices: struct<Vertex: array<{VERTEX}>>>>>"
ANNOTATION = f"_LineColor: string, Regions: {REGIONS}"
DOCUMENT = f"Annotation array<struct<{ANNOTATION}>>"
DIALECTS = ("all", "color", "union")


def _regions_to_polygons(rows: DataFrame, keys, dialect: str, tissue="tumor") -> DataFrame:
    """Rows (keys, color, region) -> polygons."""
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}")
    num = lambda v: F.struct(v["_X"].cast("double").alias("x"), v["_Y"].cast("double").alias("y"))
    verts = F.transform(F.col("region.Vertices.Vertex"), num)
    both = lambda v: v["x"].isNotNull() & v["y"].isNotNull()
    if dialect == "all":
        lost = F.raise_error(F.lit("vertex without X or Y")).cast("boolean")
        verts = F.when(F.forall(verts, both) | lost, verts)
        label = F.lit(tissue)
    else:
        verts = F.filter(verts, both)
        label = F.when(F.col("color") == TUMOR_COLOR, "tumor").when(F.col("color") == BENIGN_COLOR, "benign" if dialect == "color" else "tumor")
    out = rows.withColumn("verts", verts).withColumn("tissue", label)
    return out.filter((F.size("verts") >= 3) & F.col("tissue").isNotNull()).select(*keys, "color", "tissue", "verts")


def parse_annotations(docs: DataFrame, content="content", keys=("slide_id",), dialect="all", tissue="tumor") -> DataFrame:
    """Polygons (keys, color, tissue, verts) from whole XML documents in a column.

    ``all``: every region is ``tissue``; ``color``: green is tumor, yellow is
    benign, others are left out; ``union``: both colours as tumor. Fewer than
    three vertices are dropped.
    """
    doc = docs.select(*keys, F.from_xml(F.col(content), DOCUMENT).alias("_d"))
    ann = doc.select(*keys, F.explode("_d.Annotation").alias("_a"))
    reg = ann.select(*keys, F.col("_a._LineColor").try_cast("long").alias("color"), F.explode("_a.Regions.Region").alias("region"))
    return _regions_to_polygons(reg, list(keys), dialect, tissue)


def read_polygons(spark: SparkSession, path: str, dialect="all", tissue="tumor") -> DataFrame:
    """Annotation files with the XML source and an explicit schema. The slide id
    is the file name up to the first dot."""
    df = spark.read.format("xml").option("rowTag", "Annotation").schema(ANNOTATION.replace(": ", " ", 2)).load(path)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    rows = df.select(F.substring_index(name, ".", 1).alias("slide_id"), name.alias("file"),
                     F.col("_LineColor").try_cast("long").alias("color"), F.explode("Regions.Region").alias("region"))
    return _regions_to_polygons(rows, ["slide_id", "file"], dialect, tissue)


def annotation_candidates(files: DataFrame, slides: DataFrame, data_type: str, path="path") -> DataFrame:
    """(slide_id, tissue, path): the annotation file of each slide by the naming
    rule of the data type; the first in sorted order where several match.

    kidney ``{stem}*tumor*.xml``; prostate ``{stem}.xml``; rectal
    ``{stem}/{stem}.tumor.xml``; rectal_classes ``{stem}/{stem}.{CLASS}.xml``.
    """
    parts = F.split(F.col(path), "/")
    f = files.withColumn("_name", F.element_at(parts, -1)).withColumn("_dir", F.get(parts, F.size(parts) - 2)).filter(F.col("_name").endswith(".xml"))
    base = F.expr("substring(_name, 1, length(_name) - 4)")
    if data_type == "prostate":
        hits = f.withColumns({"slide_id": base, "tissue": F.lit("tumor")})
    elif data_type in ("rectal", "rectal_classes"):
        want = ("tumor", "normal") if data_type == "rectal" else TISSUE_CLASSES
        hits = f.withColumn("slide_id", F.col("_dir")).withColumn(
            "tissue", F.expr("substring(_name, length(_dir) + 2, length(_name) - length(_dir) - 5)")).filter(
            F.col("_name").startswith(F.concat(F.col("_dir"), F.lit("."))) & F.col("tissue").isin(*want))
    elif data_type == "kidney":
        # every prefix of the name that could be a stem is offered for an equi-join
        found = F.filter(F.array(*[F.when(F.regexp_extract("_name", rf"^(.*{t}.*)\.xml$", 1) != "", F.lit(t)) for t in ("tumor", "normal")]), lambda t: t.isNotNull())
        tagged = f.withColumn("tissue", F.explode(found))
        cut = F.length("_name") - 4 - F.length("tissue")
        stems = F.transform(F.sequence(F.lit(1), cut), lambda i: F.substring(F.col("_name"), F.lit(1), i))
        rest = lambda s: F.contains(F.substring(F.col("_name"), F.length(s) + 1, F.length("_name")), F.col("tissue"))
        hits = tagged.withColumn("slide_id", F.explode(F.filter(stems, rest)))
    else:
        raise ValueError(f"unknown data type {data_type!r}")
    j = hits.join(slides.select("slide_id").distinct(), "slide_id")
    return j.groupBy("slide_id", "tissue").agg(F.min(path).alias("path"))


def require_patches(df: DataFrame) -> DataFrame:
    """Patch classification rows; the three parts are mandatory."""
    return require_columns(df, PATCH_KEYS)


# --- paths ------------------------------------------------------------------------------
def path_metadata(df: DataFrame, path, strict=False) -> DataFrame:
    """Add magnification, tile_px and embedding read from a path column."""
    p = F.col(path)

    def pick(group):
        a, b = (F.regexp_extract(p, rx, group).try_cast("int") for rx in (MAG_TILE_STRICT, MAG_TILE_LOOSE))
        return F.coalesce(a, b)

    mag, px = pick(1), pick(2)
    if strict:
        fail = F.raise_error(F.concat(F.lit("no magnification and tile size in "), p)).cast("int")
        mag, px = F.coalesce(mag, fail), F.coalesce(px, fail)
    named = F.regexp_extract(p, EMBEDDING_NAME, 1)
    last = F.element_at(F.filter(F.split(p, "/"), lambda s: ~s.isin("", ".", "..")), -1)
    return df.withColumns({
        "magnification": F.coalesce(mag, F.lit(DEFAULT_TILE[0])), "tile_px": F.coalesce(px, F.lit(DEFAULT_TILE[1])),
        "embedding_name": F.when(named != "", named).otherwise(last)})


def with_source_path(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.input_file_name())


def infer_dim(df: DataFrame, key="model", features="features") -> DataFrame:
    """(key, dim, n, mismatched): the most frequent vector length per model."""
    c = df.groupBy(key, F.size(features).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    return c.groupBy(key).agg(
        F.max_by("_d", F.struct("_n", "_d")).alias("dim"), F.sum("_n").alias("n"), (F.sum("_n") - F.max("_n")).alias("mismatched"))


def split_by_dim(df: DataFrame, key="model", features="features"):
    """(rows of the model's dimension, the rest with a reason)."""
    j = df.join(infer_dim(df, key, features).select(key, "dim"), key)
    good = j.filter(F.size(features) == F.col("dim")).drop("dim")
    bad = j.filter(F.size(features) != F.col("dim")).withColumn(
        "reason", F.format_string("length %d, expected %d", F.size(features), F.col("dim"))).drop("dim")
    return good, bad


# --- parameters ---------------------------------------------------------------------------
def per_slide_params(process_list: DataFrame, defaults: dict) -> DataFrame:
    """Rows with process = 1; a non-empty cell wins over the default, and keeps
    the default's type."""
    cols = []
    for name, value in defaults.items():
        t = {int: "int", float: "double", bool: "boolean"}.get(type(value), "string")
        if name in process_list.columns:
            cell = F.nullif(F.trim(F.col(name).cast("string")), F.lit(""))
            cell = cell.cast(t) if t != "int" else cell.cast("double").cast("int")
            cols.append(F.coalesce(cell, F.lit(value).cast(t)).alias(name))
        else:
            cols.append(F.lit(value).cast(t).alias(name))
    keep = [c for c in process_list.columns if c not in defaults and c != "process"]
    return process_list.filter(F.col("process").cast("int") == 1).select(*keep, *cols)


def model_registry(spark: SparkSession, models: str, data_dirs: str, stability_dirs: str | None = None, dims: dict | None = None) -> DataFrame:
    """Comma lists zipped by position; one value is repeated for all; other
    unequal lengths are an error."""
    names = models.split(",")

    def spread(text):
        parts = text.split(",") if text else [None]
        parts = parts * len(names) if len(parts) == 1 else parts
        if len(parts) != len(names):
            raise ValueError(f"{len(names)} models but {len(parts)} directories")
        return parts

    rows = [(n, d, s, (dims or {}).get(n, 1024)) for n, d, s in zip(names, spread(data_dirs), spread(stability_dirs))]
    return spark.createDataFrame(rows, "model string, data_dir string, stability_dir string, dim int")


def bag_label_text(df: DataFrame, names: dict, label="label") -> DataFrame:
    """Class name of a numeric label, and back from a name."""
    return df.withColumn("label_text", map_values(F.col(label), names))
