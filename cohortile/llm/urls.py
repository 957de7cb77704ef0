"""URL filter: rules first, then logistic regression on hashed character n-grams.

The classifier reads the host and the path (3-, 4- and 5-grams of their UTF-8
bytes, host and path hashed apart, ends marked) and learns from a small labelled
URL table. Rules are a short list given by the caller; they are expressions in
the plan, so a page is never shuffled. The longest fitting rule wins.

Bound: the labelled table is a parameter of ``max_rows`` rows at most (smallest
hash of the url); one task fits it.

Defined cases: a null url or one without ``://`` has empty host and path, fits
no rule and is scored on its empty strings by the bias. Repeated labelled urls
count once, blocked if one of them is. No labelled url: score 0.5, allowed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import LOWER, flat, pieces

DIMS = 4096
UPPER, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: a small labelled URL table (fixed values); 1 is to be blocked
SEED_URLS = [
    ("http://spam-farm.example.org/en/1", 1), ("https://www.spam-farm.example.com/de/22?ref=x", 1), ("http://best-casino-bonus.example.net/en/3", 1),
    ("https://cheap-pills.example.com/en/4", 1), ("http://www.cheap-pills.example.net/fr/57/", 1), ("http://m.cheap-pills.example.org/es/6.html", 1),
    ("https://buy-followers.example.com/en/71", 1), ("http://free-money-now.example.org/en/8", 1), ("http://adult-chat.example.net/de/9", 1),
    ("https://casino-spins.example.com/es/10", 1), ("http://pills-online.example.org/en/11", 1), ("http://link-farm.example.net/en/12", 1),
    ("https://spam-links.example.com/fr/13", 1), ("http://win-prizes.example.org/en/14?utm_source=feed", 1), ("http://payday-loans.example.net/en/15#top", 1),
    ("https://keyword-stuffing-farm.example.org/en/16", 1),
    ("http://library.example.org/en/101", 0), ("https://www.theater.example.com/en/214", 0), ("https://blog.thethe.example.net/en/303/", 0),
    ("http://news.example.org/de/44", 0), ("https://m.weather.example.net/en/51#top", 0), ("https://thering.example.org/en/660?page=2&ref=x", 0),
    ("http://blog.thersh.example.com/es/70.html", 0), ("https://www.university.example.org/fr/8", 0), ("http://museum.example.net/de/91", 0),
    ("https://thation.example.com/de/310?utm_source=feed", 0), ("http://docs.example.org/en/11", 0), ("https://blog.thoned.example.org/fr/512", 0),
    ("http://cooking.example.net/en/13/", 0), ("https://thwhth.example.org/es/914.html", 0), ("http://www.history.example.com/en/15", 0),
    ("https://m.therea.example.net/en/616", 0), ("http://garden.example.org/en/717", 0), ("https://travel.example.net/en/88", 0),
    ("https://blog.theres.example.org/de/919#top", 0), ("http://ththed.example.net/en/20?page=2&ref=x", 0),
]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; empty for null or a url without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    return F.translate(host, UPPER, LOWER_AZ), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (size, rule, verdict) of the longest rule that fits, or null.
    rules: (host, path, verdict); equal length: the greater text."""
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
                   F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in rules]
    return fits[0] if len(fits) == 1 else F.greatest(*fits)


def grams(hosts, paths, dims=DIMS) -> np.ndarray:
    """Length-one vectors of the hashed n-grams of host and path."""
    rows = len(hosts)
    out = np.zeros(rows * dims, np.float32)
    for side, column in ((1, hosts), (2, paths)):
        data, offs = flat(column)
        size = np.diff(offs) + 2  # a mark at each end
        at = np.concatenate([[0], np.cumsum(size)])
        b = np.full(at[-1], side, np.int64)
        inner = np.ones(at[-1], bool)
        inner[at[:-1]] = inner[at[1:] - 1] = False
        b[inner] = LOWER[data]
        base, ends = np.repeat(np.arange(rows) * dims, size), np.repeat(at[1:], size)
        h = b + side * 1000
        for n in (2, 3, 4, 5):
            if len(b) < n:
                break
            h = (h[:len(b) - n + 1] * 1000003 + b[n - 1:]) & 0xFFFFFFFFFFF
            if n > 2:
                ok = np.arange(len(h)) + n <= ends[:len(h)]
                slot = ((h * 0x9E3779B1) >> 17) % dims
                out += np.bincount((base[:len(h)] + slot)[ok], minlength=rows * dims)
    v = np.sqrt(out.reshape(rows, dims))
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def logistic(x: np.ndarray, y: np.ndarray, l2=1e-3, steps=400, rate=8.0):
    """Full-batch gradient descent; both labels weigh the same."""
    w, b = np.zeros(x.shape[1]), 0.0
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(steps):
        e = (1 / (1 + np.exp(-(x @ w + b))) - y) * weight
        w -= rate * (x.T @ e + l2 * w)
        b -= rate * e.sum()
    return w, b


def fit(labelled: DataFrame, max_rows=4000, dims=DIMS) -> dict:
    """Weights from (url, label); label 1 means block."""
    host, path = url_parts(F.col("url"))
    rows = labelled.filter("url is not null and label is not null").groupBy("url").agg(F.max("label").alias("label"))
    rows = rows.orderBy(F.xxhash64("url"), "url").limit(max_rows).select("url", host.alias("host"), path.alias("path"), "label")

    def learn(t: pa.Table) -> pa.Table:
        t = t.sort_by([("url", "ascending")])
        w, b = logistic(grams(t.column("host"), t.column("path"), dims).astype(float), np.asarray(t.column("label"), float))
        return pa.table({"slot": np.arange(-1, dims), "weight": np.append([b], w)})

    got = rows.withColumn("all", F.lit(1)).groupBy("all").applyInArrow(learn, "slot long, weight double").toPandas().sort_values("slot")  # dims + 1 rows
    return {"bias": float(got.weight.iloc[0]) if len(got) else 0.0, "weights": got.weight.to_numpy()[1:] if len(got) else np.zeros(dims), "dims": dims}


def judge(pages: DataFrame, rules, model: dict, at=0.5) -> DataFrame:
    """page_id, url, host, path, rule, score, verdict; one row per page."""
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long"), "url", host.alias("host"), path.alias("path"))

    def run(batches):
        for b in pieces(batches, "url", rows=512):
            x = grams(b.column("host"), b.column("path"), model["dims"])
            p = 1 / (1 + np.exp(-(x @ model["weights"] + model["bias"])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*b.schema.names, "score"])

    scored = rows.mapInArrow(run, "page_id long, url string, host string, path string, score double")
    hit = longest_rule(F.col("host"), F.col("path"), rules)
    return scored.withColumn("hit", hit).select(
        "page_id", "url", "host", "path", F.col("hit.rule").alias("rule"), "score",
        F.coalesce(F.col("hit.verdict"), F.when(F.col("score") > at, "block").otherwise("allow")).alias("verdict"))
