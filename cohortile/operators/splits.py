"""Patient-safe train/validation/test splits, always long."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.draws import hash_rank, order_hash
from ..session import durable
from .cohort import collapse_patients


def _stratum_quota(counts: DataFrame, frac: float, scope=()) -> DataFrame:
    """Test rows per label: ceil(frac * n) in all, shared by largest remainder.
    ``counts`` holds one row per label (few)."""
    w = Window.partitionBy(*scope) if scope else Window.partitionBy(F.lit(1))
    size = F.ceil(F.sum("n").over(w) * F.lit(frac) - 1e-9)
    a = counts.withColumn("_size", size).withColumn("_raw", F.col("n") / F.sum("n").over(w) * F.col("_size"))
    a = a.withColumn("_base", F.floor("_raw"))
    rest = F.col("_size") - F.sum("_base").over(w)
    extra = F.row_number().over(w.orderBy((F.col("_raw") - F.col("_base")).desc(), "label")) <= rest
    return a.select(*scope, "label", (F.col("_base") + extra.cast("long")).alias("_quota"))


def _take_by_stratum(patients: DataFrame, frac: float, parts, scope=()) -> DataFrame:
    """Add boolean ``_taken``: inside the stratum's quota by hash rank."""
    keys = [*scope, "label"]
    counts = patients.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    ranked = hash_rank(patients.withColumn("_h", order_hash("case_id", *parts)), keys, "_h", ["case_id"], "_pos")
    return ranked.join(F.broadcast(_stratum_quota(counts, frac, scope)), keys).withColumn(
        "_taken", F.col("_pos") < F.col("_quota")).drop("_h", "_pos", "_quota")


def stratified_patient_splits(labels: DataFrame, k=5, val_frac=0.1, test_frac=0.1, seed=42) -> DataFrame:
    """(fold, case_id, label, split). One fixed test set; k independent
    validation draws of val/(1-test) of the rest; strata by label."""
    pats = collapse_patients(labels).select("case_id", "label")
    outer = durable(_take_by_stratum(pats, test_frac, [F.lit("test"), seed]))
    folds = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold")
    pool = outer.filter(~F.col("_taken")).select("case_id", "label", folds)
    inner = _take_by_stratum(pool, val_frac / (1 - test_frac), [F.lit("val"), "fold", seed], ["fold"]).select(
        "fold", "case_id", "label", F.when(F.col("_taken"), "val").otherwise("train").alias("split"))
    test = outer.filter("_taken").select(folds, "case_id", "label", F.lit("test").alias("split"))
    return inner.unionByName(test)


def expand_to_slides(patient_splits: DataFrame, labels: DataFrame) -> DataFrame:
    return labels.select("slide_id", "case_id").join(patient_splits.select("fold", "case_id", "split"), "case_id").select(
        "fold", "slide_id", "case_id", "split")


def sequential_splits(labels: DataFrame, k=5, val_frac=0.1, test_frac=0.1, label_frac=1.0, seed=42) -> DataFrame:
    """Per class round(frac * n) validation and test patients in hash order, the
    rest train, of which the first ceil(label_frac * rest) are kept."""
    pats = collapse_patients(labels).select("case_id", "label")
    sizes = pats.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    rows = pats.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    ranked = hash_rank(rows.withColumn("_h", order_hash("case_id", "fold", seed)), ["fold", "label"], "_h", ["case_id"], "_pos")
    nv, nt = F.bround(F.col("_n") * val_frac), F.bround(F.col("_n") * test_frac)
    train = F.ceil((F.col("_n") - nv - nt) * label_frac)
    p = F.col("_pos")
    split = F.when(p < nv, "val").when(p < nv + nt, "test").when(p < nv + nt + train, "train")
    return ranked.join(sizes, "label").withColumn("split", split).filter(F.col("split").isNotNull()).select(
        "fold", "case_id", "label", "split")


LABEL_FRACTIONS = (0.1, 0.25, 0.5, 0.75, 1.0)


def sequential_split_series(labels: DataFrame, label_frac=0.0, **kw) -> DataFrame:
    """One split set per label fraction; the fixed series when none is given."""
    out = None
    for f in (label_frac,) if label_frac > 0 else LABEL_FRACTIONS:
        part = sequential_splits(labels, label_frac=f, **kw).withColumn("label_frac", F.lit(f))
        out = part if out is None else out.unionByName(part)
    return out


def split_boolean(splits: DataFrame, item="case_id") -> DataFrame:
    flag = lambda s: (F.col("split") == s).alias(s)
    return splits.select("fold", item, flag("train"), flag("val"), flag("test"))


def split_descriptor(splits: DataFrame) -> DataFrame:
    n = lambda s: F.sum((F.col("split") == s).cast("long")).alias(s)
    return splits.groupBy("fold", "label").agg(n("train"), n("val"), n("test"))


def split_wide(splits: DataFrame, item="slide_id") -> DataFrame:
    """Columns train, val, test of equal length; the shorter ones end in ''."""
    pos = hash_rank(splits.withColumn("_h", order_hash(item)), ["fold", "split"], "_h", [item], "row")
    wide = pos.groupBy("fold", "row").pivot("split", ["train", "val", "test"]).agg(F.first(item))
    return wide.na.fill("", ["train", "val", "test"])
