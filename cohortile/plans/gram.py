"""One-pass sums of products.

Every task folds its Arrow batches into centred partial matrices, merged batch
by batch with the shift of their means, so large means do not cancel digits.
The partials of all tasks are moved to one reference point per key (the mean of
one of them) and added up row by row with a vector aggregate. Rows of data
never leave the executors, whatever their number.

A wide matrix is cut into stripes of rows: a task folds one stripe, of at most
``STRIPE`` bytes, and gives it out once. With more keys than fit beside each
other the rows are sorted by key first, and a task holds one key at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import durable, join_same_key

STRIPE = 64 << 20
#: bytes of the matrices of all keys that a task holds beside each other
BESIDE = 256 << 20
#: vector components that are worked on at once
NUMBERS = 4_000_000


def matrix(col) -> np.ndarray:
    """(rows, D) float64 from an Arrow list column of equal-length lists."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks)
    n = len(col)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1)


def key_groups(batch, keys) -> dict:
    """{key tuple: row numbers} of a batch; None stands for all rows."""
    if not keys:
        return {(): None}
    code = np.zeros(batch.num_rows, np.int64)
    for c in keys:  # one number per combination of keys, from the codes of each
        col = batch.column(c)
        d = (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).dictionary_encode(null_encoding="encode")
        code = np.unique(code * max(1, len(d.dictionary)) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    starts = np.concatenate([[0], np.flatnonzero(np.diff(code[order])) + 1, [len(code)]])
    if len(starts) == 2:
        return {tuple(batch.column(c)[0].as_py() for c in keys): None}
    return {tuple(batch.column(c)[int(order[s])].as_py() for c in keys): order[s:e] for s, e in zip(starts[:-1], starts[1:], strict=True)}


def _arrow_schema(df, keys):
    from pyspark.sql.pandas.types import to_arrow_type
    return [(k, to_arrow_type(df.schema[k].dataType)) for k in keys]


class Centred:
    """Weight, mean and rows lo..hi of the centred products of some rows."""

    def __init__(self, z, w, lo, hi):
        self.lo, self.hi = lo, hi
        self.n = float(w.sum()) if w is not None else float(len(z))
        self.mean = (w @ z if w is not None else z.sum(0)) / self.n
        c = z - self.mean
        left = c[:, lo:hi] if w is None else c[:, lo:hi] * w[:, None]
        self.m = left.T @ c

    def add(self, o):
        n, d = self.n + o.n, o.mean - self.mean
        self.m += o.m
        self.m += np.outer(d[self.lo:self.hi] * (self.n * o.n / n), d)
        self.mean += d * (o.n / n)
        self.n = n


def keyed_gram(df: DataFrame, keys, x: str, y: str | None = None, weight: str | None = None) -> DataFrame:
    """Rows (keys, i, dx, row, ref) for Z = [x, y] - ref: row 0 holds n and the
    column sums, row i a number without meaning and row i of Zt Z. ``ref`` (in
    row 0) is a point near the mean of the key."""
    keys = list(keys)
    cols = keys + [c for c in (x, y, weight) if c]
    arrow_keys = _arrow_schema(df, keys)
    fields = [df.schema[k] for k in keys] + [
        T.StructField("part", T.StringType()), T.StructField("i", T.IntegerType()), T.StructField("dx", T.IntegerType()),
        T.StructField("row", T.ArrayType(T.DoubleType()))]
    base = df.select(*cols)
    width = F.size(x) + (F.size(y) if y else F.lit(0))
    d, many = base.agg(F.max(width), F.approx_count_distinct(F.xxhash64(*keys)) if keys else F.lit(1)).first()
    d, many = int(d or 1), int(many or 1)
    stripes = -(-d * d * 8 // STRIPE)
    if stripes > 1:
        base = durable(base)
    sort = many * (d * d * 8 // stripes) > BESIDE
    if sort:
        base = base.repartitionByRange(*keys, F.monotonically_increasing_id()).sortWithinPartitions(*keys)

    def rows_of(key, part, i, dx, values):
        """A batch from the rows of a 2-D array."""
        n, w = values.shape
        arrays = [pa.array([v] * n, type=t) for v, (_, t) in zip(key, arrow_keys, strict=True)]
        arrays += [pa.array([part] * n, pa.string()), pa.array(i, pa.int32()), pa.array(np.full(n, dx), pa.int32()),
                   pa.ListArray.from_arrays(pa.array(np.arange(0, n * w + 1, w), pa.int32()), pa.array(values.ravel()))]
        return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    def fold(stripe):
        def emit(key, dx, c, part):
            if stripe == 0:
                yield rows_of(key, part, [0], dx, np.concatenate([[c.n], c.mean])[None])
            step = max(1, NUMBERS // (c.m.shape[1] + 1))
            for lo in range(0, len(c.m), step):
                m = c.m[lo:lo + step]
                yield rows_of(key, part, np.arange(c.lo + lo, c.lo + lo + len(m)) + 1, dx, np.hstack([np.zeros((len(m), 1)), m]))

        def run(batches):
            acc, made, task = {}, 0, TaskContext.get().partitionId()
            for b in batches:
                if b.num_rows == 0:
                    continue
                # keys may have vectors of different lengths: one matrix per key
                for k, idx in key_groups(b, keys).items():
                    whole = b if idx is None else b.take(pa.array(idx))
                    if sort and k not in acc:
                        for key, (dx, c) in acc.items():
                            yield from emit(key, dx, c, f"{task:09d}-{made:09d}")
                            made += 1
                        acc = {}
                    wide = max(1, (len(whole.column(x)[0]) if whole.column(x)[0].is_valid else 1))
                    for at in range(0, whole.num_rows, max(1, NUMBERS // wide)):
                        part = whole.slice(at, max(1, NUMBERS // wide))
                        xs = matrix(part.column(x))
                        z = np.hstack([xs, matrix(part.column(y))]) if y else xs
                        w = part.column(weight).to_numpy(zero_copy_only=False).astype(float) if weight else None
                        if w is not None and not w.sum() > 0:
                            continue
                        c = Centred(z, w, stripe * z.shape[1] // stripes, (stripe + 1) * z.shape[1] // stripes)
                        if k in acc:
                            acc[k][1].add(c)
                        else:
                            acc[k] = (xs.shape[1], c)
            for key, (dx, c) in acc.items():
                yield from emit(key, dx, c, f"{task:09d}-{made:09d}")
                made += 1
        return run

    partials = None
    for s in range(stripes):
        one = base.mapInArrow(fold(s), T.StructType(fields))
        partials = one if partials is None else partials.union(one)
    partials = durable(partials)
    by = ["_all", *keys]
    means = partials.filter("i = 0").withColumn("_all", F.lit(1))
    ref = means.groupBy(*by).agg(F.min_by("row", "part").alias("_ref"))

    def move(batches):
        """Sums and products of each partial's mean about the reference."""
        for b in batches:
            for r in range(b.num_rows):
                key = tuple(b.column(k)[r].as_py() for k in keys)
                row, at = np.asarray(b.column("row")[r].values, float), np.asarray(b.column("_ref")[r].values, float)
                n, delta, dx = row[0], row[1:] - at[1:], b.column("dx")[r].as_py()
                yield rows_of(key, None, [0], dx, np.concatenate([[n], n * delta])[None])
                step = max(1, NUMBERS // (len(delta) + 1))
                for lo in range(0, len(delta) if delta.any() else 0, step):
                    m = np.outer(n * delta[lo:lo + step], delta)
                    yield rows_of(key, None, np.arange(lo, lo + len(m)) + 1, dx, np.hstack([np.zeros((len(m), 1)), m]))

    moved = join_same_key(means, ref, by).select(*keys, "part", "i", "dx", "row", "_ref").mapInArrow(move, T.StructType(fields))
    summed = partials.filter("i > 0").union(moved).withColumn("_all", F.lit(1)).groupBy(*by, "i").agg(
        F.max("dx").alias("dx"), Summarizer.metrics("sum").summary(array_to_vector("row")).alias("_s"))
    out = join_same_key(summed, ref, by, "left")
    return out.select(*keys, "i", "dx", vector_to_array(F.col("_s.sum")).alias("row"),
                      F.when(F.col("i") == 0, F.slice("_ref", F.lit(2), F.greatest(F.size("_ref") - 1, F.lit(0)))).alias("ref"))


def assemble(pdf):
    """(n, dx, mean, centred matrix) from the gram rows of one key."""
    pdf = pdf.sort_values("i")
    g = np.vstack(pdf["row"].to_numpy())
    n = g[0, 0]
    s = g[0, 1:]
    return n, int(pdf["dx"].iloc[0]), np.asarray(pdf["ref"].iloc[0], float) + s / n, g[1:, 1:] - np.outer(s, s) / n
