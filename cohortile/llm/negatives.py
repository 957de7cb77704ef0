"""Hard negatives through an inverted multi-index with certified windows.

Index: the two halves of a vector have a codebook each, learnt on a bounded
sample; a row lies in the cell (code of its first half, code of its second).
Every row is indexed. For an anchor a code of either half has a bound, its
centroid's product with the anchor's half plus the code's radius times that
half's length, so no row of a cell scores above the sum of its two bounds.

Search: a heap walks both sorted lists of half bounds and yields the cells in
order of their summed bounds. Two walks find the positives: the first cells
give each anchor a score that its n-th positive reaches at least, the second
walk goes on until the bound falls below it. What is then unseen cannot enter,
so the list is certified. Two more walks do the same for the windows of
allowed negative scores that the positives open; a cell whose rows all score
above every open window is passed over.

Work on a cell is dealt out in chunks of ``CHUNK`` rows, so a cell with a third
of all rows is many pieces of work. A task holds one chunk; the anchors that
visit it stream past in blocks, and only the best rows per anchor are passed on. Anchors and rows meet by cell, not all by all;
how many cells must be opened depends on how well the data cluster.

Scores are exact integers. Components are scaled by 256 and rounded down; one
whose result would not fit (beyond 2^27 / sqrt(dimensions) in size, so that
percentages of products fit a long) counts as that limit. Defined results: rows with a null
id, label or vector, or any null or non-finite component take no part; a
shorter vector counts as filled up with zeros; rows with one id are rows of
their own, of which none is the other's positive; equal scores come in order
of id. An empty table or one without anchors gives no rows.
Only the three named columns are read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

SAMPLE = 20_000
CHUNK = 32_768
#: scores a task holds at once
BLOCK = 4_000_000
#: cells opened by the first of two walks
FIRST_CELLS = 4


def quantised(vectors: DataFrame, scale=256) -> DataFrame:
    """id, label, v (long components), of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists(
        x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(math.inf)))
    rows = vectors.filter(sound).select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), x.alias("_x"))
    limit = F.floor(F.lit(float(1 << 27)) / F.sqrt(F.greatest(F.size("_x"), F.lit(1)).cast("double"))).cast("double")
    return rows.withColumn("v", F.transform("_x", lambda c: F.greatest(-limit, F.least(limit, F.floor(c * F.lit(float(scale))).cast("double"))).cast("long"))).drop("_x")


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of a list column as float64, filled up with zeros to ``dim``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = np.asarray(column.flatten(), np.float64)
    if len(flat) == n * dim:
        return flat.reshape(n, dim)
    lengths = np.diff(np.asarray(column.offsets)) if n else np.zeros(0, int)
    out = np.zeros((n, dim))
    row = np.repeat(np.arange(n), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of all rows; in floating point while that is exact."""
    if len(a) == 0 or len(b) == 0 or np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1) < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _lloyd(x: np.ndarray, k: int, seed: int, rounds=15) -> np.ndarray:
    """Centroids of x, started from rows drawn in proportion to their distance."""
    rng = np.random.default_rng(seed)
    c = x[rng.integers(len(x))][None]
    far = ((x - c[0]) ** 2).sum(1)
    while len(c) < k and far.sum() > 0:
        c = np.vstack([c, x[rng.choice(len(x), p=far / far.sum())]])
        far = np.minimum(far, ((x - c[-1]) ** 2).sum(1))
    for _ in range(rounds):
        near = ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)
        c = np.vstack([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
    return c


def fit(rows: DataFrame, codes: int, dim: int, n: int, sample=SAMPLE, seed=13) -> list[np.ndarray]:
    """Codebooks of both halves from about ``sample`` rows chosen by a bound on
    the hash of their id; one task learns from them."""
    share = F.lit(int(min(1.0, sample / max(n, 1)) * (1 << 31)))
    drawn = rows.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 31)) < share).select("id", "v", F.lit(1).alias("_all"))
    cut = dim // 2

    def learn(t: pa.Table) -> pa.Table:
        x = _matrix(t.sort_by("id").column("v"), dim)
        half, code, centroid = [], [], []
        for h, part in enumerate((x[:, :cut], x[:, cut:])):
            for j, c in enumerate(_lloyd(part, codes, seed)):
                half.append(h)
                code.append(j)
                centroid.append(c)
        return pa.table({"half": pa.array(half, pa.int32()), "code": pa.array(code, pa.int32()), "centroid": pa.array(centroid, pa.list_(pa.float64()))})

    got = drawn.groupBy("_all").applyInArrow(learn, "half int, code int, centroid array<double>").collect()  # 2 x codes rows
    books = []
    for h, width in ((0, cut), (1, dim - cut)):
        found = sorted((r["code"], r["centroid"]) for r in got if r["half"] == h)
        books.append(np.array([c for _, c in found], float).reshape(-1, width) if found else np.zeros((1, width)))
    return books


def index(rows: DataFrame, books: list[np.ndarray], dim: int) -> DataFrame:
    """Adds c1, c2 (codes) and d1, d2 (distances to their centroids)."""
    cut = dim // 2

    def run(batches):
        for b in batches:
            x, got = _matrix(b.column("v"), dim), []
            for part, book in ((x[:, :cut], books[0]), (x[:, cut:], books[1])):
                near = ((book * book).sum(1)[None] - 2 * part @ book.T).argmin(1)
                got.append((near.astype(np.int32), np.sqrt(((part - book[near]) ** 2).sum(1))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got[0][0]), pa.array(got[1][0]), pa.array(got[0][1]), pa.array(got[1][1])],
                                             names=[*b.schema.names, "c1", "c2", "d1", "d2"])

    return rows.mapInArrow(run, "id long, label long, v array<long>, c1 int, c2 int, d1 double, d2 double")


def cells_in_order(one: np.ndarray, two: np.ndarray):
    """(bound, i, j) of all pairs of codes, greatest sum of half bounds first."""
    a, b = np.argsort(-one, kind="stable"), np.argsort(-two, kind="stable")
    heap, seen = [(-(one[a[0]] + two[b[0]]), 0, 0)], {(0, 0)}
    while heap:
        s, i, j = heapq.heappop(heap)
        yield -s, int(a[i]), int(b[j])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (-(one[a[p]] + two[b[q]]), p, q))


def visits(anchors: DataFrame, books, radii, sizes: np.ndarray, dim: int, floor=None, ceiling=None, skip=0, most=None) -> DataFrame:
    """(anchor columns, cell, chunk): the walk of every anchor over the filled
    cells. ``floor`` names the score below which it stops, ``most`` the number
    of cells after which it stops, ``skip`` how many it leaves to an earlier
    walk; cells that only hold scores above ``ceiling`` are passed over."""
    cut = dim // 2
    names = anchors.columns

    def run(batches):
        for b in batches:
            x = _matrix(b.column("v"), dim)
            low = np.asarray(b.column(floor), float) if floor else np.full(len(x), -np.inf)
            high = np.asarray(b.column(ceiling), float) if ceiling else None
            side = []
            for part, book, radius in ((x[:, :cut], books[0], radii[0]), (x[:, cut:], books[1], radii[1])):
                middle, reach = part @ book.T, np.sqrt((part * part).sum(1))[:, None] * radius[None]
                slack = 1e-9 * (1 + np.abs(middle) + reach)  # rounding of the bounds
                side.append((middle + reach + slack, middle - reach - slack))
            who, cell, chunk = [], [], []
            for i in range(len(x)):
                opened = 0
                for bound, p, q in cells_in_order(side[0][0][i], side[1][0][i]):
                    if bound < low[i] or opened == most:
                        break
                    if sizes[p, q] == 0:
                        continue
                    if high is not None and side[0][1][i, p] + side[1][1][i, q] > high[i]:
                        continue
                    opened += 1
                    if opened <= skip:
                        continue
                    for c in range(-(-int(sizes[p, q]) // CHUNK)):
                        who.append(i)
                        cell.append(p * sizes.shape[1] + q)
                        chunk.append(c)
            at = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns), pa.array(cell, pa.int32()), pa.array(chunk, pa.int32())], names=[*names, "cell", "chunk"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in anchors.schema.fields)
    return anchors.mapInArrow(run, f"{kinds}, cell int, chunk int")


def _best(score: np.ndarray, fits: np.ndarray, n: int):
    """Row and column numbers of the n best fitting entries of every row; of
    equal scores those of smaller ids (columns are in order of id)."""
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(len(score)):
        at = np.flatnonzero(fits[i])
        if len(at) > n:
            s = score[i, at]
            at = at[s >= np.partition(s, len(s) - n)[len(s) - n]]
        at = at[np.argsort(-score[i, at], kind="stable")[:n]]
        rows.append(np.full(len(at), i))
        cols.append(at)
    return np.concatenate(rows), np.concatenate(cols)


def _windows(column) -> np.ndarray:
    """(rows, windows) from a list column; missing places are null there."""
    lists = column.to_pylist()
    out = np.full((len(lists), max((len(x) for x in lists), default=0), 2), (1, 0), np.int64)  # (1, 0): nothing fits
    for i, x in enumerate(lists):
        for k, w in enumerate(x):
            out[i, k] = w["low"], w["high"]
    return out


def search(visited: DataFrame, indexed: DataFrame, dim: int, n: int, windows: bool) -> DataFrame:
    """(row, nth, id, score): per anchor the n best other rows of its label among
    the visited chunks that score ``least`` or more (nth is 0), or the n best of
    other labels in each of its windows (nth from 1)."""
    def work(part, ids, labels, x):
        a, row, label = _matrix(part.column("v"), dim), np.asarray(part.column("row")), np.asarray(part.column("label"))
        score = exact_products(a, x)
        if not windows:
            least = np.asarray(part.column("least"), float)[:, None]
            r, c = _best(score, (label[:, None] == labels[None]) & (np.asarray(part.column("id"))[:, None] != ids[None]) & (score >= least), n)
            return row[r], np.zeros(len(r), np.int64), ids[c], score[r, c]
        w, apart, got = _windows(part.column("windows")), label[:, None] != labels[None], []
        for k in range(w.shape[1]):
            r, c = _best(score, apart & (score >= w[:, k, :1]) & (score <= w[:, k, 1:]), n)
            got.append((row[r], np.full(len(r), k + 1), ids[c], score[r, c]))
        return [np.concatenate(v) for v in zip(*got, strict=True)] if got else [np.zeros(0, np.int64)] * 4

    def run(batches):
        key, held, rows = None, [], None
        for b in batches:
            if b.num_rows == 0:
                continue
            marks = np.column_stack([np.asarray(b.column(c), np.int64) for c in ("cell", "chunk", "anchor")])
            starts = np.concatenate([[0], np.flatnonzero((np.diff(marks, axis=0) != 0).any(1)) + 1, [len(marks)]])
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                part, here = b.slice(s, e - s), (marks[s, 0], marks[s, 1])
                if here != key:
                    key, held, rows = here, [], None
                if marks[s, 2] == 0:
                    held.append(part)
                    continue
                if rows is None:
                    t = pa.Table.from_batches(held).sort_by("id") if held else None
                    rows = (np.asarray(t.column("id")), np.asarray(t.column("label")), _matrix(t.column("v"), dim)) if held else ()
                    held = []
                step = max(1, BLOCK // len(rows[0])) if rows else 0
                for i in range(0, part.num_rows if rows else 0, step or 1):
                    found = work(part.slice(i, step), *rows)
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(v, np.int64)) for v in found], names=["row", "nth", "id", "score"])

    asked = "windows" if windows else "least"
    none = F.lit(None).cast(visited.schema[asked].dataType).alias(asked)
    mine = indexed.select("cell", "chunk", F.lit(0).alias("anchor"), "row", "id", "label", "v", none)
    theirs = visited.select("cell", "chunk", F.lit(1).alias("anchor"), "row", "id", "label", "v", asked)
    both = mine.union(theirs).repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "anchor")
    return both.mapInArrow(run, "row long, nth long, id long, score long")


def _first(found: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("row", "nth").orderBy(F.col("score").desc(), "id")
    return found.select("row", "nth", "id", "score").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def mine(rows: DataFrame, anchor, n_positives=5, n_negatives=10, low=30, high=90, codes=None, sample=SAMPLE, seed=13) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has id, label, v (see ``quantised``); ``anchor`` is the condition
    that makes a row an anchor. A negative's score lies between ``low`` and
    ``high`` percent of the positive's, which a negative score has no window
    for. ``codes`` per half default to the fourth root of the rows, 64 at most."""
    rows = durable(rows)
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    dim = max(int(dim or 0), 2)
    codes = codes or int(min(64, max(2, round(n ** 0.25))))
    books = fit(rows, codes, dim, n, sample, seed)
    width = len(books[1])
    indexed = durable(index(rows, books, dim).withColumn("cell", F.col("c1") * width + F.col("c2")))
    sizes, radii = np.zeros((len(books[0]), width), np.int64), [np.zeros(len(books[0])), np.zeros(width)]
    for r in indexed.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.max("d1").alias("d1"), F.max("d2").alias("d2")).collect():  # codes^2 rows
        sizes[r["c1"], r["c2"]] = r["n"]
        radii[0][r["c1"]], radii[1][r["c2"]] = max(radii[0][r["c1"]], r["d1"]), max(radii[1][r["c2"]], r["d2"])
    parts = F.array(*[F.lit(max(1, -(-int(s) // CHUNK))) for s in sizes.ravel()])
    indexed = indexed.withColumn("row", F.monotonically_increasing_id()).withColumn(
        "chunk", F.pmod(F.xxhash64("id", "row", F.lit(seed)), F.get(parts, F.col("cell"))).cast("int"))
    anchors = durable(indexed.filter(anchor).select("row", "id", "label", "v"))

    def walk(who, **kw):
        return visits(who, books, radii, sizes, dim, **kw)

    # positives
    unknown = F.lit(-math.inf)
    near = durable(_first(search(walk(anchors.withColumn("least", unknown), most=FIRST_CELLS), indexed, dim, n_positives, False), n_positives))
    reached = near.filter(F.col("rank") == n_positives).select("row", F.col("score").cast("double").alias("least"))
    todo = anchors.join(reached, "row", "left").withColumn("least", F.coalesce("least", unknown))
    best = durable(_first(near.drop("rank").union(search(walk(todo, floor="least", skip=FIRST_CELLS), indexed, dim, n_positives, False)), n_positives))

    # windows: low * positive <= 100 * score <= high * positive, in whole numbers
    opened = best.filter("score >= 0").select(
        "row", F.col("rank").alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
        F.expr(f"({low} * score + 99) div 100").alias("low"), F.expr(f"({high} * score) div 100").alias("high"))
    # all of an anchor's scores >= 0 rank first, so nth is the place in the list of its windows
    listed = F.array_sort(F.collect_list(F.struct("nth", "low", "high"))).alias("windows")
    seekers = anchors.join(opened.groupBy("row").agg(listed, F.max("high").cast("double").alias("most")), "row")
    some = durable(_first(search(walk(seekers, ceiling="most", most=FIRST_CELLS), indexed, dim, n_negatives, True), n_negatives))
    full = some.filter(F.col("rank") == n_negatives).select("row", "nth", "score")
    # a full window is only open above its last place
    needed = opened.join(full, ["row", "nth"], "left").withColumn("low", F.coalesce("score", "low"))
    needed = needed.groupBy("row").agg(listed, F.max("high").cast("double").alias("most"), F.min("low").cast("double").alias("least"))
    rest = search(walk(anchors.join(needed, "row"), floor="least", ceiling="most", skip=FIRST_CELLS), indexed, dim, n_negatives, True)
    found = _first(some.drop("rank").union(rest), n_negatives)
    return found.join(opened, ["row", "nth"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
