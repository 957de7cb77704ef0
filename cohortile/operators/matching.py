"""Finding the file that belongs to a name, by equi-joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_files(tiles: DataFrame, attention: DataFrame, stem="stem") -> DataFrame:
    """(tile stem, attention stem): equal stems, else an attention stem that is a
    substring of the tile stem. Several candidates, or none, stop the job.

    A tile stem is cut into its substrings of the lengths that occur among the
    attention stems; the search is then an equi-join.
    """
    t, a = tiles.select(F.col(stem).alias("tile_stem")).distinct(), attention.select(F.col(stem).alias("attention_stem")).distinct()
    exact = t.join(a, F.col("tile_stem") == F.col("attention_stem"))
    rest = t.join(a, F.col("tile_stem") == F.col("attention_stem"), "left_anti")
    lens = [r[0] for r in a.select(F.length("attention_stem")).distinct().collect()]  # at most one per name length
    parts = rest.withColumn("_n", F.explode(F.array(*[F.lit(n) for n in lens]))).filter(F.col("_n") <= F.length("tile_stem")).withColumn(
        "_s", F.explode(F.sequence(F.lit(1), F.length("tile_stem") - F.col("_n") + 1)))
    sub = parts.select("tile_stem", F.substring(F.col("tile_stem"), F.col("_s"), F.col("_n")).alias("attention_stem")).distinct().join(
        a, "attention_stem").select("tile_stem", "attention_stem")
    found = rest.join(sub, "tile_stem", "left").groupBy("tile_stem").agg(
        F.count("attention_stem").alias("_k"), F.min("attention_stem").alias("attention_stem"))
    fail = lambda text: F.raise_error(F.concat(F.lit(text), F.col("tile_stem")))
    checked = found.select("tile_stem", F.when(F.col("_k") == 1, F.col("attention_stem")).when(
        F.col("_k") == 0, fail("no attention file for ")).otherwise(fail("more than one attention file for ")).alias("attention_stem"))
    return exact.unionByName(checked)


def match_with_fallback(names: DataFrame, files: DataFrame, name="stem", file="file_stem") -> DataFrame:
    """Per name: the file of that name, else ``{name}_L-1``, else the first
    ``{name}_*``. A file stem offers itself under each of its prefixes that end
    before an underscore."""
    f = files.select(file).distinct()
    own = f.select(F.col(file).alias(name), file, F.lit(0).alias("_prio"))
    cut = F.transform(F.sequence(F.lit(1), F.size(F.split(file, "_")) - 1), lambda i: F.array_join(F.slice(F.split(file, "_"), 1, i), "_"))
    pre = f.filter(F.contains(F.col(file), F.lit("_"))).select(F.explode(cut).alias(name), file).withColumn(
        "_prio", F.when(F.col(file) == F.concat(F.col(name), F.lit("_L-1")), 1).otherwise(2))
    offers = own.unionByName(pre.select(name, file, "_prio"))
    best = names.select(name).distinct().join(offers, name).groupBy(name).agg(
        F.min_by(F.struct(F.col(file).alias("f"), F.col("_prio").alias("p")), F.struct("_prio", file)).alias("_b"))
    return best.select(name, F.col("_b.f").alias(file), F.col("_b.p").alias("priority"))


def alignment_mismatches(a: DataFrame, b: DataFrame, keys=("slide_id", "tile_idx"), coords=("x", "y")) -> DataFrame:
    """Rows whose key is missing on a side or whose coordinates differ."""
    left = a.select(*keys, F.struct(*coords).alias("_a"))
    right = b.select(*keys, F.struct(*coords).alias("_b"))
    return left.join(right, list(keys), "full").filter(~F.col("_a").eqNullSafe(F.col("_b")))


def assert_aligned(a: DataFrame, b: DataFrame, keys=("slide_id", "tile_idx"), coords=("x", "y")) -> None:
    if not alignment_mismatches(a, b, keys, coords).isEmpty():
        raise ValueError("coordinates of the two tables are not aligned")
