"""Column expressions: identifiers, labels, clinical values, geometry."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Barcode patterns of the public cohort ids.
PATIENT_PREFIX = r"^(TCGA-[^-]+-[^-]+)"
PATIENT_STRICT = r"^(TCGA-[A-Za-z0-9]{2}-[A-Za-z0-9]{4})"
PATIENT_FALLBACK = r"^(TCGA-[A-Z0-9]+-[A-Z0-9]+)"
GRADES = {"G1": 0, "G2": 1, "G3": 2, "G4": 3}
# Raw label -> binary label per task.
TASK_LABELS = {
    "kidney": {0: 0, 1: 0, 2: 1, 3: 1},
    "prostate": {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 1, 9: 1, 10: 1},
    "rectal": {1: 0, 2: 0, 3: 1, 4: 1},
}
STARS = ((0.001, "***"), (0.01, "**"), (0.05, "*"))
EFFECTS = ((0.2, "negligible"), (0.5, "small"), (0.8, "medium"))
DEFAULT_TILE = (20, 256)
DEFAULT_DIM = 1024
# ----------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _blank_to_null(col: Column) -> Column:
    return F.when(F.trim(col) != "", col)


def _match(col: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(col, pattern, 1), F.lit(""))


def map_values(col, mapping: dict, default=None) -> Column:
    """A CASE over a small fixed dictionary; values outside it give ``default``."""
    col = _c(col)
    whens = reduce(lambda acc, kv: acc.when(col == F.lit(kv[0]), F.lit(kv[1])), list(mapping.items())[1:],
                   F.when(col == F.lit(next(iter(mapping))), F.lit(next(iter(mapping.values())))))
    return whens.otherwise(F.lit(default)) if default is not None else whens


def patient_id(slide_id, mode="segments") -> Column:
    """``prefix``: barcode start; ``strict``: two- and four-character fields;
    ``segments``: first three dash parts of any id, barcode as fallback."""
    s = _c(slide_id)
    if mode == "prefix":
        return _match(s, PATIENT_PREFIX)
    if mode == "strict":
        return _match(s, PATIENT_STRICT)
    if mode != "segments":
        raise ValueError(f"unknown patient id mode {mode!r}")
    s = _blank_to_null(s)
    return F.when(F.size(F.split(s, "-")) >= 3, F.substring_index(s, "-", 3)).otherwise(_match(s, PATIENT_FALLBACK))


def institution_code(slide_id) -> Column:
    parts = F.split(_c(slide_id), "-")
    return F.when((F.upper(parts[0]) == "TCGA") & (F.size(parts) >= 2), F.get(parts, F.lit(1)))


def parse_stage(value) -> Column:
    return _match(_c(value), r"^[Tt]([1-4])").cast("int")


def map_grade(value) -> Column:
    return map_values(value, GRADES)


def remap_task_label(label, task: str, on_unmapped="null") -> Column:
    if task == "none":
        return _c(label)
    if task not in TASK_LABELS:
        raise ValueError(f"unknown task {task!r}")
    out = map_values(label, TASK_LABELS[task])
    if on_unmapped == "error":
        msg = F.concat(F.lit("label outside the task mapping: "), F.coalesce(_c(label).cast("string"), F.lit("null")))
        out = F.coalesce(out, F.raise_error(msg).cast("int"))
    return out


def class_sign(binary) -> Column:
    b = _c(binary)
    return F.when(b == 0, F.lit(-1)).when(b == 1, F.lit(1))


def is_valid_value(value, is_string=True) -> Column:
    """Present and not zero. Text that reads as a number follows the number."""
    v = _c(value)
    if not is_string:
        return F.coalesce((v != 0) & ~F.isnan(v.cast("double")), F.lit(False))
    t = F.trim(v)
    num = t.try_cast("double")
    return F.coalesce(F.when(num.isNotNull(), num != 0).otherwise(F.length(t) > 0), F.lit(False))


def survival_time_event(death, followup) -> Column:
    """struct(time, event): death first, follow-up second, else null."""
    d, f = (F.trim(_c(x).cast("string")).try_cast("double") for x in (death, followup))

    def days(x):
        return (x > 0) & ~F.isnan(x)

    return F.when(days(d), F.struct(d.alias("time"), F.lit(1).alias("event"))).when(
        days(f), F.struct(f.alias("time"), F.lit(0).alias("event")))


def has_vital_data(vital_status, followup, death) -> Column:
    return is_valid_value(vital_status) & (is_valid_value(followup) | is_valid_value(death))


def exclude_cohort(slide_id) -> Column:
    s = F.upper(_c(slide_id))
    return s.startswith("HCM-") | (s.contains("TCGA") & s.contains("-TS"))


def colorref_channels(value) -> Column:
    """struct(r, g, b) of a 0x00BBGGRR integer given as a number or text."""
    v = F.trim(_c(value).cast("string")).try_cast("long")
    byte = lambda shift: F.shiftright(v, shift).bitwiseAND(F.lit(255)).cast("int")
    return F.when(v.isNotNull(), F.struct(byte(0).alias("r"), byte(8).alias("g"), byte(16).alias("b")))


def colorref_to_hex(value) -> Column:
    c = colorref_channels(value)
    return F.when(c.isNotNull(), F.format_string("#%02X%02X%02X", c["r"], c["g"], c["b"]))


def colorref_to_bgr(value) -> Column:
    """Blue, green, red; red where the value cannot be read."""
    c = colorref_channels(value)
    return F.coalesce(F.when(c.isNotNull(), F.array(c["b"], c["g"], c["r"])), F.array(F.lit(0), F.lit(0), F.lit(255)))


def magnification_ratio(objective_power, extraction_mag) -> Column:
    m = _c(extraction_mag).cast("double")
    return F.coalesce(_c(objective_power).cast("double"), m) / m


def tile_bounds(x, y, tile_px, mag_ratio) -> Column:
    side = _c(tile_px) * _c(mag_ratio)
    x, y = _c(x), _c(y)
    return F.struct(x.alias("x0"), y.alias("y0"), (x + side).alias("x1"), (y + side).alias("y1"))


def pick_level(levels, objective, target_mag) -> Column:
    """Index of the pyramid level whose downsample is nearest the wanted one
    (the first on ties); objective falls back to 20."""
    want = F.coalesce(_c(objective).cast("double"), F.lit(20.0)) / _c(target_mag)
    gap = F.transform(_c(levels), lambda d: F.abs(d - want))
    return (F.array_position(gap, F.array_min(gap)) - 1).cast("int")


def level0_top_left(center, size_px, downsample) -> Column:
    return F.greatest(F.lit(0), F.round(_c(center) - 0.5 * _c(size_px) * _c(downsample)).cast("long"))


def threshold_label(t) -> Column:
    return F.concat(F.lit("thr_"), F.replace(_c(t).cast("string"), F.lit("."), F.lit("p")))


def parse_threshold(name, two_digit=False) -> Column:
    """``combpruned0D`` -> D/10; with ``two_digit`` also a bare ``0D``."""
    digit = _match(_c(name), r"combpruned0(\d)")
    if two_digit:
        digit = F.coalesce(digit, _match(_c(name), r"^0(\d)$"))
    return F.round(digit.cast("double") / 10.0, 1)


def model_from_dir(name, marker: str) -> Column:
    """The part after ``marker`` up to the next underscore, else the name with
    spaces for underscores."""
    part = _match(_c(name), re.escape(marker) + r"([^_]+)")
    return F.coalesce(part, F.replace(_c(name), F.lit("_"), F.lit(" ")))


def number_duplicates(df: DataFrame, name: str, order: str, out: str) -> DataFrame:
    """Repeated names get _1, _2, ... from the second on, in ``order``."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return df.withColumn(out, F.when(n == 1, F.col(name)).otherwise(F.concat_ws("_", name, (n - 1).cast("string"))))


def significance_stars(p, missing="") -> Column:
    p = _c(p)
    out = F.when(p < STARS[0][0], STARS[0][1])
    for bound, s in STARS[1:]:
        out = out.when(p < bound, s)
    return out.otherwise(F.lit(missing))


def effect_magnitude(d) -> Column:
    a = F.abs(_c(d))
    out = F.when(a < EFFECTS[0][0], EFFECTS[0][1])
    for bound, s in EFFECTS[1:]:
        out = out.when(a < bound, s)
    return F.when(a.isNotNull(), out.otherwise(F.lit("large")))


def lookup_embed_dim(df: DataFrame, registry: DataFrame, model="model") -> DataFrame:
    """Attach ``dim`` from a (model, dim) table, default 1024. The registry is
    one row per model; Spark decides whether it is small enough to broadcast."""
    return df.join(registry.select(model, "dim"), model, "left").withColumn(
        "dim", F.coalesce("dim", F.lit(DEFAULT_DIM)))


def tissue_pixel(r, g, b, min_saturation, max_value) -> Column:
    """HSV test on 0-255 channels: saturation >= minimum and value <= maximum."""
    hi, lo = F.greatest(_c(r), _c(g), _c(b)), F.least(_c(r), _c(g), _c(b))
    sat = F.when(hi > 0, (hi - lo) * 255.0 / hi).otherwise(F.lit(0.0))
    return (sat >= min_saturation) & (hi <= max_value)


def proxy_nontumor(r, g, b, in_tumor) -> Column:
    return ((_c(r) + _c(g) + _c(b)) / 3.0 > 220) & ~_c(in_tumor)


def hard_label(prob) -> Column:
    """Probability >= 0.5 -> 1."""
    return (_c(prob) >= 0.5).cast("int")


def argmax(probs) -> Column:
    """Index of the largest entry, the first one on ties."""
    p = _c(probs)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def nan_to_null(df: DataFrame) -> DataFrame:
    cols = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(*cols)
