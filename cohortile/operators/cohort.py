"""Patients, slides and labels: matching, de-duplication, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import has_vital_data, parse_stage, patient_id, survival_time_event


def last_row_wins(df: DataFrame, key="patient_id", order="row_ord") -> DataFrame:
    """One row per trimmed key: the last in ``order``; null keys go."""
    rows = df.withColumn(key, F.trim(F.col(key))).filter(F.col(key).isNotNull())
    others = [c for c in df.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("_r")).select(
        key, *[F.col(f"_r.{c}").alias(c) for c in others])


def attach_patient_label(slides: DataFrame, patients: DataFrame, mode="prefix", order="row_ord") -> DataFrame:
    """Inner join of slides with the patients' labels on the derived id."""
    keyed = slides.withColumn("patient_id", patient_id("slide_id", mode)).filter(F.col("patient_id").isNotNull())
    labels = last_row_wins(patients.filter(F.col("label").isNotNull()), "patient_id", order)
    return keyed.join(labels.select("patient_id", "label"), "patient_id")


def slides_to_master(slides: DataFrame, master: DataFrame, mode="segments", order="row_ord"):
    """(matched, unmatched). Unmatched rows carry the reason."""
    keyed = slides.withColumn("patient_id", patient_id("slide_id", mode))
    unique = last_row_wins(master, "patient_id", order).withColumn("_hit", F.lit(True))
    extra = [c for c in unique.columns if c in slides.columns and c != "patient_id"]
    joined = keyed.join(unique.drop(*extra), "patient_id", "left")
    reason = (
        F.when(F.col("slide_id").isNull(), "missing slide_id")
        .when(F.col("patient_id").isNull(), "could not extract patient id")
        .when(F.col("_hit").isNull(), "not found in master file"))
    tagged = joined.withColumn("reason", reason)
    matched = tagged.filter(F.col("reason").isNull()).drop("reason", "_hit")
    unmatched = tagged.filter(F.col("reason").isNotNull()).select("slide_id", "patient_id", "reason")
    return matched, unmatched


def survival_labels(labels: DataFrame, master: DataFrame, mode="segments"):
    """(survival rows, rejects). Rejects are never among the rows."""
    matched, unmatched = slides_to_master(labels, master, mode)
    tagged = matched.withColumn("_s", survival_time_event("death_days_to", "days_to_last_followup"))
    rows = tagged.filter(F.col("_s").isNotNull()).select(
        "slide_id", "case_id", F.col("_s.time").alias("time"), F.col("_s.event").alias("event"))
    bad = tagged.filter(F.col("_s").isNull()).select(
        "slide_id", "patient_id", F.lit("invalid survival data").alias("reason"))
    rejects = unmatched.unionByName(bad)
    return rows, rejects


def case_label(clinical: DataFrame, kind: str, case="case_id", value="value") -> DataFrame:
    """Most frequent label per case, the largest on ties. ``numeric`` reads
    whole numbers, ``stage`` reads T1 to T4; other values do not vote."""
    if kind == "numeric":
        v = F.col(value).cast("string").try_cast("double").cast("int")
    elif kind == "stage":
        v = parse_stage(value)
    else:
        raise ValueError(f"unknown label type {kind!r}")
    votes = clinical.select(case, v.alias("label")).filter(F.col("label").isNotNull()).groupBy(case, "label").agg(
        F.count(F.lit(1)).alias("_n"))
    return votes.groupBy(case).agg(F.max_by("label", F.struct("_n", "label")).alias("label"))


def collapse_patients(labels: DataFrame, order="row_ord") -> DataFrame:
    """One row per case: number of slides and the first label. Slides stay in
    the long table, so a case with very many slides is no wide row."""
    return labels.groupBy("case_id").agg(
        F.count("slide_id").alias("n_slides"), F.min_by("label", F.col(order)).alias("label"))


def common_keys(df: DataFrame, keys=("slide_id",), model="model", n_models=None, expected=None) -> DataFrame:
    """Keys every model has: one groupBy instead of a chain of joins.
    ``expected`` names the models that must exist; a missing one is an error."""
    keys = list(keys)
    have = df.groupBy(*keys).agg(F.count_distinct(model).alias("_m"))
    if expected is not None:
        n_models = len(set(expected))
        seen = df.groupBy().agg(F.collect_set(model).alias("_s"))
        lost = F.array_except(F.array(*[F.lit(e) for e in sorted(expected)]), "_s")
        want = seen.select(F.when(F.size(lost) == 0, F.lit(n_models)).otherwise(F.raise_error(
            F.concat(F.lit("models without data: "), F.array_join(lost, ", "))).cast("int")).alias("_want"))
    elif n_models is not None:
        return have.filter(F.col("_m") == n_models).select(*keys)
    else:
        want = df.groupBy().agg(F.count_distinct(model).alias("_want"))
    # one-row scalar side
    return have.join(F.broadcast(want), F.col("_m") == F.col("_want")).select(*keys)


def keep_common(df: DataFrame, keys=("slide_id",), **kw) -> DataFrame:
    return df.join(common_keys(df, keys, **kw), list(keys), "left_semi")


def keys_in_any(wanted: DataFrame, df: DataFrame, keys=("slide_id",)) -> DataFrame:
    return wanted.join(df.select(*keys), list(keys), "left_semi")


def missing_keys(wanted: DataFrame, present: DataFrame, keys=("slide_id",)) -> DataFrame:
    return wanted.select(*keys).distinct().join(present.select(*keys), list(keys), "left_anti")


def split_validation(splits: DataFrame, master: DataFrame, mode="segments") -> DataFrame:
    """Per split: slides listed (repeats counted), matched to the master table,
    and with usable vital data, with percentages of the listed ones."""
    unique = last_row_wins(master, "patient_id").withColumn(
        "_valid", has_vital_data("vital_status", "days_to_last_followup", "death_days_to"))
    j = splits.withColumn("patient_id", patient_id("slide_id", mode)).join(
        unique.select("patient_id", "_valid"), "patient_id", "left")
    total, hit = F.count(F.lit(1)), F.count("_valid")
    good = F.coalesce(F.sum(F.col("_valid").cast("long")), F.lit(0))
    return j.groupBy("split").agg(
        total.alias("total"), hit.alias("matched"), good.alias("valid"),
        (100.0 * hit / total).alias("matched_pct"), (100.0 * good / total).alias("valid_pct"))


def annotation_colors(polygons: DataFrame, color="color", file="file", samples=3) -> DataFrame:
    """Per colour: annotations, distinct files, the first few file names."""
    files = polygons.groupBy(color, file).agg(F.count(F.lit(1)).alias("_n"))
    per = files.groupBy(color).agg(F.sum("_n").alias("count"), F.count(F.lit(1)).alias("files"))
    # the limit of three names is part of the report
    first = files.withColumn("_i", F.row_number().over(Window.partitionBy(color).orderBy(file))).filter(
        F.col("_i") <= samples).groupBy(color).agg(F.array_sort(F.collect_list(file)).alias("sample_files"))
    return per.join(first, color)

