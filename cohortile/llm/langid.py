"""Language identification by nearest centroid.

A text is the TF-IDF vector of its hashed byte 2- and 3-grams (A-Z lowered,
ASCII that is no letter read as a space), scaled to length one. Each language
has several centroids (spherical k-means); the nearest by cosine decides. A
text is rejected if its cosine is under ``SLACK`` times the lowest of any
training text of that language. Few n-grams can only give a small cosine, so
for a text of less than ``ENOUGH`` of them the bound falls with the root of
their number, and a training text's cosine counts as divided by that root, but
not as more than the highest of its language. Training takes texts with a
letter and, for centroids and bound, with an n-gram.

Bounds, all parameters: ``per_language`` texts of a language form its
centroids (those with the smallest hash of their id); the document frequencies
come from every training row. The model has languages x centroids x dims
floats.

Defined cases: null text, empty text or one without a letter gives ``und``,
score 0, rejected. Null ids pass through. No training row: every text is
``und``. Ties of cosine go to the smaller language name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import LOWER, flat, neutral, pieces, short_batches

DIMS = 4096
ROWS = 256
SALTS = 32
SLACK, ENOUGH = 0.8, 400
_FOLD = LOWER.copy()
_FOLD[:128] = np.where([chr(i).isalpha() for i in range(128)], LOWER[:128], 32)


def gram_counts(column, dims=DIMS) -> np.ndarray:
    """Texts x dims counts of hashed 2- and 3-grams inside each text."""
    data, offs = flat(column)
    rows = len(offs) - 1
    b = _FOLD[data].astype(np.int64)
    base = np.repeat(np.arange(rows) * dims, np.diff(offs))
    ends = np.repeat(offs[1:], np.diff(offs))
    out = np.zeros(rows * dims, np.int64)
    at = np.arange(len(b))
    h = b
    for n in (2, 3):
        if len(b) < n:
            break
        h = h[:len(b) - n + 1] * 257 + b[n - 1:]
        ok = at[:len(h)] + n <= ends[:len(h)]
        slot = ((h * 0x9E3779B1) >> 15) % dims
        out += np.bincount((base[:len(h)] + slot)[ok], minlength=rows * dims)
    return out.reshape(rows, dims)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts.astype(np.float32)) * idf.astype(np.float32)
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def scale(counts: np.ndarray) -> np.ndarray:
    """Share of the cosine that a text with this few n-grams can be asked for."""
    return np.sqrt(np.minimum(1, counts.sum(1) / ENOUGH))


def document_frequency(docs: DataFrame, dims=DIMS) -> DataFrame:
    """(dim, df) over all texts; every task sends one sum per dim. Dim -1 counts the texts."""
    def count(batches):
        total = np.zeros(dims + 1, np.int64)
        for b in pieces(batches, rows=ROWS):
            c = gram_counts(b.column("text"), dims)
            total[1:] += (c > 0).sum(0)
            total[0] += len(c)
        yield pa.RecordBatch.from_pydict({"dim": np.arange(-1, dims, dtype=np.int32), "df": total})
    return docs.select("text").mapInArrow(count, "dim int, df long").groupBy("dim").agg(F.sum("df").alias("df"))


def spherical_centroids(v: np.ndarray, k: int, steps: int) -> np.ndarray:
    """Spherical k-means from rows spread evenly by their cosine to the mean; stops when nothing moves."""
    k = min(k, len(v))
    centers = v[np.argsort(v @ v.mean(0), kind="stable")[(2 * np.arange(k) + 1) * len(v) // (2 * k)]]
    owner = None
    for _ in range(steps):
        new = (v @ centers.T).argmax(1)
        if owner is not None and (new == owner).all():
            break
        owner = new
        sums = np.zeros_like(centers)
        np.add.at(sums, owner, v)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        centers = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centers)
    return centers


def fit(docs: DataFrame, train: Column, dims=DIMS, centroids=4, per_language=1000, steps=50, seed=11) -> dict:
    """Model from the rows of ``docs`` (doc_id, text, lang) under ``train``."""
    rows = short_batches(docs).select("doc_id", "text", "lang").filter(train & F.col("lang").isNotNull() & has_letter())
    df = {r["dim"]: r["df"] for r in document_frequency(rows, dims).collect()}  # dims + 1 numbers
    n = df.get(-1) or 0
    if not n:
        return {"langs": [], "dims": dims}
    idf = np.array([np.log((1 + n) / (1 + (df.get(i) or 0))) + 1e-3 for i in range(dims)], np.float32)
    # first within parts of a language, so that the last rank sees SALTS x per_language ids of it at most
    ids = rows.select("lang", "doc_id", F.xxhash64("doc_id", F.lit(seed)).alias("hash")).withColumn("salt", F.pmod("doc_id", F.lit(SALTS)))
    for by in (["lang", "salt"], ["lang"]):
        ids = ids.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("hash", "doc_id"))).filter(F.col("rank") <= per_language)
    sample = rows.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi")  # per_language ids a language at most

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        v, share = [], []
        for b in pieces([pa.RecordBatch.from_pydict({"text": pa.array(pdf["text"], pa.string())})], rows=ROWS):
            counts = gram_counts(b.column(0), dims)
            some = counts.any(1)  # a text of one byte has no n-gram
            v.append(vectors(counts[some], idf))
            share.append(scale(counts[some]))
        v, share = np.vstack(v), np.concatenate(share)
        if not len(v):
            return pd.DataFrame({"lang": pd.Series([], dtype=object), "centroid": pd.Series([], dtype=object), "radius": pd.Series([], dtype=float)})
        c = spherical_centroids(v, centroids, steps)
        best = (v @ c.T).max(1)
        least = min((best / share).min(), best.max())
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": [x.tolist() for x in c], "radius": float(1 - least)})

    model = sample.groupBy("lang").applyInPandas(learn, "lang string, centroid array<float>, radius double").collect()
    if not model:
        return {"langs": [], "dims": dims}
    model.sort(key=lambda r: r["lang"])
    return {"langs": [r["lang"] for r in model], "centers": np.array([r["centroid"] for r in model], np.float32),
            "radius": np.array([r["radius"] for r in model]), "idf": idf, "dims": dims}


def nearest(batch, model):
    """Language, score and rejection of the rows of one Arrow batch, whose last column tells if the text has a letter."""
    n = batch.num_rows
    letter = np.asarray(batch.column(batch.num_columns - 1))
    if not model["langs"]:
        return np.full(n, "und", object), np.zeros(n), np.ones(n, bool)
    counts = gram_counts(batch.column("text"), model["dims"])
    cos = vectors(counts, model["idf"]) @ model["centers"].T
    best = cos.argmax(1)
    top = cos[np.arange(n), best]
    names = np.where(letter, np.array(model["langs"], object)[best], "und")
    need = SLACK * (1 - model["radius"][best]) * scale(counts)
    return names, np.where(letter, np.clip(top, 0, 1), 0).astype(float), ~letter | (top < need)


def has_letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score (cosine of the nearest centroid), distance, rejected; one row per input row."""
    def run(batches):
        for b in pieces(batches, rows=ROWS):
            names, score, far = nearest(b, model)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(1 - score), pa.array(far)],
                                             names=["doc_id", "lang_pred", "score", "distance", "rejected"])
    rows = docs.select(F.col("doc_id").cast("long"), "text", has_letter().alias("letter"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, distance double, rejected boolean")


def accepted(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    names = docs.columns

    def run(batches):
        for b in pieces(batches, rows=ROWS):
            keep = b.filter(pa.array(~nearest(b, model)[2]))
            yield pa.RecordBatch.from_arrays(keep.columns[:len(names)], names=names)
    return neutral(docs).withColumn("_letter", has_letter()).mapInArrow(run, docs.schema)
