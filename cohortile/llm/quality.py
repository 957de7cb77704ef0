"""Ordinal quality classifier: cumulative-link regression on graded ratings.

P(grade > k | text) = sigmoid(w.x - theta_k) with one weight vector over hashed
words and ordered thresholds theta_0 < theta_1 < ..., so the grades share all
text evidence. x holds log counts of hashed words (A-Z lowered, punctuation
kept) and word 2-grams, scaled to length one.

Bound: ``max_rows`` rated rows (smallest hash of their id) form the training
sample; every text is scored whole.

Defined cases: null or empty text is the zero vector and gets what the
thresholds alone say. One grade only, or no rating: that grade (0) with tail
probability by the same formula. A doc_id rated twice counts with its lowest
grade; null grades are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import M1, ODD, flat, mix, pieces, short_batches, word_hashes

BITS = 18


def bag(column, bits=BITS):
    """Text numbers, slots and normalised values of the hashed words and 2-grams."""
    data, offs = flat(column)
    h, at = word_hashes(data, offs)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    same = doc[:-1] == doc[1:]
    two = mix(h[:-1] * ODD + h[1:] + M1)[same]
    slot = (np.concatenate([h, two]) >> np.uint64(64 - bits)).astype(np.int64)
    key, count = np.unique((np.concatenate([doc, doc[:-1][same]]) << bits) | slot, return_counts=True)
    doc, value = key >> bits, np.log1p(count)
    norm = np.sqrt(np.bincount(doc, value * value, minlength=len(offs) - 1))
    return doc, key & ((1 << bits) - 1), value / norm[doc]


def cumulative_link(rows, grades, bits=BITS, rate=0.5, l2=1e-6, epochs=8, seed=3):
    """AdaGrad over (slots, values); thresholds stay ordered as sums of exponentials."""
    levels = int(grades.max()) if len(grades) else 0
    w, h = np.zeros(1 << bits), np.full(1 << bits, 1e-2)
    if levels == 0:
        return w, np.zeros(0)
    share = np.clip([(grades > k).mean() for k in range(levels)], 1e-3, 1 - 1e-3)
    theta = np.maximum.accumulate(np.log((1 - share) / share) + np.arange(levels) * 1e-3)
    first, gaps = theta[0], np.log(np.maximum(np.diff(theta), 1e-3))
    seen = np.full(levels, 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            i, v = rows[r]
            y = int(grades[r])
            theta = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
            up = 1 / (1 + np.exp(-np.clip(w[i] @ v - theta, -35, 35)))  # P(grade > k)
            edge = np.concatenate([[1.0], up, [0.0]])
            slope = np.concatenate([[0.0], up * (1 - up), [0.0]])
            p = max(edge[y] - edge[y + 1], 1e-9)
            g = -(slope[y] - slope[y + 1]) / p  # of the loss by w.x
            gt = np.zeros(levels)
            if y > 0:
                gt[y - 1] += slope[y] / p
            if y < levels:
                gt[y] -= slope[y + 1] / p
            gi = g * v + l2 * w[i]
            h[i] += gi * gi
            w[i] -= rate * gi / np.sqrt(h[i])
            gp = np.concatenate([[gt.sum()], [gt[k + 1:].sum() * np.exp(gaps[k]) for k in range(levels - 1)]])
            seen += gp * gp
            move = 0.1 * gp / np.sqrt(seen)
            first -= move[0]
            gaps = np.clip(gaps - move[1:], -7, 4)
    return w, first + np.concatenate([[0], np.cumsum(np.exp(gaps))])


def fit(docs: DataFrame, labels: DataFrame, max_rows=10_000, bits=BITS, seed=7, **args) -> dict:
    """Weights from texts (doc_id, text) and their labels (doc_id, grade).

    The sample is drawn from ids alone; only its texts are then read out, so
    no text outside the sample is moved. One task learns from the sample.
    """
    labels = labels.select(F.col("doc_id").cast("long"), F.col("grade").cast("int")).filter("grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    docs = short_batches(docs).select(F.col("doc_id").cast("long"), "text")
    ids = docs.select("doc_id").distinct().join(labels, "doc_id").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_rows)
    sample = docs.join(F.broadcast(ids), "doc_id")  # max_rows ids at most

    def bags(batches):
        for b in pieces(batches):
            doc, slot, value = bag(b.column("text"), bits)
            at = pa.array(np.searchsorted(doc, np.arange(b.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("grade"), pa.ListArray.from_arrays(at, pa.array(slot, pa.int32())),
                 pa.ListArray.from_arrays(at, pa.array(value, pa.float32()))], names=["doc_id", "grade", "slots", "values"])

    def learn(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending")])
        x = [(np.asarray(i.values, np.int64), np.asarray(v.values, float)) for i, v in zip(t.column("slots"), t.column("values"), strict=True)]
        w, theta = cumulative_link(x, np.asarray(t.column("grade")), bits, seed=seed, **args)
        at = np.flatnonzero(w)
        return pa.table({"slot": np.concatenate([at, -1 - np.arange(len(theta))]).astype(np.int64), "weight": np.concatenate([w[at], theta])})

    got = sample.mapInArrow(bags, "doc_id long, grade int, slots array<int>, values array<float>").withColumn("all", F.lit(1)).groupBy("all").applyInArrow(
        learn, "slot long, weight double").toPandas()  # 2**bits weights at most
    text = got[got.slot >= 0]
    return {"bits": bits, "slots": text.slot.to_numpy(), "weights": text.weight.to_numpy(np.float32),
            "theta": got[got.slot < 0].sort_values("slot", ascending=False).weight.to_numpy()}


def score(docs: DataFrame, model: dict, at_least=1) -> DataFrame:
    """doc_id, expected_grade, p_tail = P(grade >= at_least); one row per input row."""
    def run(batches):
        bits, theta = model["bits"], model["theta"]
        w = np.zeros(1 << bits)
        w[model["slots"]] = model["weights"]
        for b in pieces(batches):
            doc, slot, value = bag(b.column("text"), bits)
            margin = np.bincount(doc, w[slot] * value, minlength=b.num_rows)
            up = 1 / (1 + np.exp(-np.clip(margin[:, None] - theta[None, :], -35, 35))) if len(theta) else np.zeros((b.num_rows, 1))
            tail = np.ones(b.num_rows) if at_least <= 0 else up[:, at_least - 1] if at_least <= up.shape[1] else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"expected_grade": up.sum(1), "p_tail": tail}), preserve_index=False).add_column(
                0, "doc_id", b.column("doc_id"))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, expected_grade double, p_tail double")
