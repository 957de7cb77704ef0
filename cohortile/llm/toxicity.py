"""Toxicity by FTRL-proximal logistic regression.

Features are the hashed words, word 2-grams and one-word skip-grams of the
whole text (A-Z lowered, punctuation at the ends of a word ignored), each
counted as present or not. Rates are per coordinate; the L1 term leaves a few
weights, and only those travel to the tasks that score.

Bound: ``max_rows`` labelled rows (those with the smallest hash of their id)
form the training sample; scoring reads every text whole.

Defined cases: null or empty text has no features and gets the bias alone. No
labelled row: every score is the 0.5 of an untrained model. A doc_id with
several labels counts as toxic if one of them is 1; null labels are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LOWER, M1, M3, ODD, flat, mix, pieces, prefix_sums, short_batches, span_hashes, words

BITS = 20
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(column, bits=BITS) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and slots of all features, repeats included."""
    data, offs = flat(column)
    starts, ends, doc = words(data, offs, _LETTERS)
    h = span_hashes(prefix_sums(LOWER[data]), starts, ends)
    at, slots = [doc], [h]
    for gap, salt in ((1, M1), (2, M3)):
        if len(h) > gap:
            same = doc[:-gap] == doc[gap:]
            at.append(doc[:-gap][same])
            slots.append(mix(h[:-gap] * ODD + h[gap:] + salt)[same])
    shift = np.uint64(64 - bits)
    return np.concatenate(at), np.concatenate([s >> shift for s in slots]).astype(np.int64)


def distinct_features(column, bits=BITS):
    """Sorted distinct (text, slot) pairs as one key array."""
    doc, slot = features(column, bits)
    return np.unique((doc << bits) | slot)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, bits=BITS, alpha=1.0, beta=1.0, l1=8.0, l2=0.0, epochs=5, positive=3.0):
    """FTRL-proximal over rows of slots; returns the weights and the bias.
    ``positive`` weighs the rows of label 1."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits
    for _ in range(epochs):
        for slots, y in zip(rows, labels, strict=True):
            i = np.append(slots, bias)
            zi, ni = z[i], n[i]
            w = np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2), 0)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            g *= positive if y else 1
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[i] += g - step * w
            n[i] += g * g
    w = np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, max_rows=16_000, bits=BITS, seed=5, **ftrl_args) -> dict:
    """Weights from texts (doc_id, text) and their labels (doc_id, label).

    The sample is drawn from ids alone; only its texts are then read out, so
    no text outside the sample is moved. One task learns from the sample.
    """
    labels = labels.select(F.col("doc_id").cast("long"), F.col("label").cast("double")).filter("label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    docs = short_batches(docs).select(F.col("doc_id").cast("long"), "text")
    ids = docs.select("doc_id").distinct().join(labels, "doc_id").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_rows)
    sample = docs.join(F.broadcast(ids), "doc_id")  # max_rows ids at most

    def slots(batches):
        for b in pieces(batches):
            key = distinct_features(b.column("text"), bits)
            at = np.searchsorted(key >> bits, np.arange(b.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(key & ((1 << bits) - 1), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), lists], names=["doc_id", "label", "slots"])

    def learn(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending")])
        x = [np.asarray(s.values) for s in t.column("slots")]
        w, b = ftrl([x[i] for i in np.random.default_rng(seed).permutation(len(x))],
                    np.asarray(t.column("label"))[np.random.default_rng(seed).permutation(len(x))], bits, **ftrl_args)
        at = np.flatnonzero(w)
        return pa.table({"slot": pa.array(np.append(at, -1), pa.int64()), "weight": np.append(w[at], b)})

    got = sample.mapInArrow(slots, "doc_id long, label double, slots array<int>").withColumn("all", F.lit(1)).groupBy("all").applyInArrow(learn, "slot long, weight double").collect()
    return {"bits": bits, "slots": np.array([r["slot"] for r in got if r["slot"] >= 0], np.int64),
            "weights": np.array([r["weight"] for r in got if r["slot"] >= 0]), "bias": next((r["weight"] for r in got if r["slot"] < 0), 0.0)}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score in [0, 1]; one row per input row."""
    def run(batches):
        bits = model["bits"]
        w = np.zeros(1 << bits)
        w[model["slots"]] = model["weights"]
        for b in pieces(batches):
            doc, slot = features(b.column("text"), bits)
            hit = w[slot] != 0
            key = np.unique((doc[hit] << bits) | slot[hit])
            margin = np.bincount(key >> bits, w[key & ((1 << bits) - 1)], minlength=b.num_rows) + model["bias"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(margin, -35, 35))))], names=["doc_id", "score"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
