"""Exact nearest neighbours through a metric index.

Every group of rows gets pivots (rows far apart, from a bounded sample). A row
belongs to the cell of its nearest pivot; the rows of a cell, in order of their
distance to it, are cut into rings, and a ring of at most ``size`` rows is a
block. Of every block the least and greatest distance to each pivot is known,
so by the triangle inequality no row of it is nearer to a row of another block
than the largest gap between their two ranges.

A block first finds neighbours inside itself; the worst k-th of them is the
block's reach. Two blocks then meet only if their gap is within the reach of one
of them, cells first, then blocks; a pair of blocks meets once for both sides.
Blocks travel in bundles of neighbouring ones, so that a row is sent once for a
bundle of rows it may have to meet and not once for each of its blocks.
On clustered data few pairs meet; where distances say nothing (many independent
dimensions) all of them do, and the result is the same.

Distances are squared Euclidean, rounded to 9 digits so that equal rows tie by
id. Rows of one group have vectors of one length.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import durable, join_same_key
from .blocks import MOST_ROWS, NUMBERS, beside, pair_blocks
from .gram import matrix
from .ordered import scan

PIVOTS = 64
#: sampled rows per pivot
PER_PIVOT = 32
#: distances worked out at once
SCORES = 500_000


def squared(a, b):
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.round(np.maximum(d, 0.0), 9)


def _apart(a, b, r, c):
    """The rounded distances of the named rows of a and b, from the differences of their components."""
    out = np.empty(len(r))
    step = max(1, SCORES // max(1, a.shape[1]))
    for lo in range(0, len(r), step):
        out[lo:lo + step] = ((a[r[lo:lo + step]] - b[c[lo:lo + step]]) ** 2).sum(1)
    return np.round(out, 9)


def best(a, b, ids_a, ids_b, k: int, reach=None):
    """Row, column, distance of the k nearest rows of b (in order of id) to each
    row of a, itself left out, and none beyond ``reach``.

    One product of matrices gives all distances nearly; rows of b that may be
    among the k by them are then measured exactly. Ids are compared for those alone."""
    rows, cols, dist = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    if len(a) == 0 or len(b) == 0:
        return rows[0], cols[0], dist[0]
    reach = np.full(len(a), np.inf) if reach is None else reach
    codes = pd.factorize(np.concatenate([ids_a, ids_b]))[0]
    code_a, code_b = codes[:len(a)], codes[len(a):]
    same = int(np.bincount(code_b, minlength=codes.max() + 1)[code_a].max())  # rows of b that a row must leave out
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    slack = 2e-9 + 1e-15 * (a.shape[1] + 8) * (aa + bb[np.isfinite(bb)].max(initial=0.0))
    left, right = np.hstack([-2 * a, np.ones((len(a), 1))]), np.hstack([b, bb[:, None]]).T
    step, last = max(1, SCORES // len(b)), k - 1 + same
    for lo in range(0, len(a), step):
        d = left[lo:lo + step] @ right  # less the square of a's own row
        own, limit = aa[lo:lo + step], reach[lo:lo + step] - aa[lo:lo + step] + slack[lo:lo + step]
        at = np.flatnonzero(d <= limit[:, None])
        if len(at) > 4 * (last + 1) * len(own) and last < d.shape[1]:  # all that may tie with the k-th stay until the stable sort
            worst = np.partition(d, last, axis=1)[:, last] + 2 * slack[lo:lo + step]
            at = np.flatnonzero(d <= np.minimum(limit, worst)[:, None])
        r, c = np.divmod(at, d.shape[1])
        other = code_a[r + lo] != code_b[c]
        r, c = r[other], c[other]
        e = _apart(a[lo:lo + step], b, r, c)
        near = np.isfinite(e) & (e <= reach[lo:lo + step][r])
        r, c, e = r[near], c[near], e[near]
        order = np.lexsort((c, e, r))
        r, c, e = r[order], c[order], e[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        rows.append(r[place < k] + lo)
        cols.append(c[place < k])
        dist.append(e[place < k])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dist)


def _lists(values: np.ndarray):
    n, w = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * w + 1, w) if w else np.zeros(n + 1), pa.int32()), pa.array(values.ravel()))


def pivots(rows: DataFrame, by, ids: str, size: int) -> DataFrame:
    """(by, pivots): one for each ``size`` rows, ``PIVOTS`` at most, each the
    sampled row furthest from those before it."""
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    share = F.least(F.lit(1.0), F.lit(float(PIVOTS * PER_PIVOT)) / F.col("_n")) * float(1 << 31)
    drawn = join_same_key(rows, n, by).filter(F.pmod(F.xxhash64(ids), F.lit(1 << 31)) < share).select(*by, ids, "vec", "_n")

    def learn(t: pa.Table) -> pa.Table:
        t = t.sort_by(ids)
        x = matrix(t.column("vec"))
        want = int(min(PIVOTS, -(-t.column("_n")[0].as_py() // size)))
        at, far = [0], ((x - x[0]) ** 2).sum(1)
        while len(at) < want and far.max() > 0:
            at.append(int(far.argmax()))
            far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(1))
        return pa.table({c: t.column(c).slice(0, 1) for c in by} | {"pivots": pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), _lists(x[at]))})

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    return drawn.groupBy(*by).applyInArrow(learn, f"{kinds}, pivots array<array<double>>")


def _points(table: pa.Table) -> np.ndarray:
    return np.vstack([np.asarray(p.values, float) for p in table.column("pivots")[0]])


def blocks(rows: DataFrame, by, ids: str, size: int, k: int) -> DataFrame:
    """The rows (by, id, vec) with cell, ring, their neighbours inside the block
    (near) and the distance of the k-th of them (reach, null if there are fewer);
    the first row of a block also has its ranges (stat)."""
    found = durable(pivots(rows, by, ids, size))
    names = [*by, ids, "vec"]
    rows = rows.select(*names)
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])

    def cells(part: pa.Table, table: pa.Table) -> pa.Table:
        cols = [part.column(i) for i in range(len(names))]
        if part.num_rows == 0 or table.num_rows == 0:  # a group always has a sampled row, unless its sample came out empty
            return pa.table([*cols, pa.array(np.zeros(part.num_rows), pa.int32()), pa.array(np.zeros(part.num_rows))], names=schema.names)
        d = squared(matrix(part.column("vec")), _points(table))
        near = d.argmin(1)
        return pa.table([*cols, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], names=schema.names)

    placed = beside(rows, found, by, "vec", cells, schema).withColumn("_one", F.lit(1))
    ringed = scan(placed, [*by, "cell"], ["far", ids], {"_one": "_pos"}).withColumn("ring", F.floor(F.col("_pos") / size).cast("long"))
    ringed = durable(ringed.select(*names, "cell", "ring"))
    stat = "struct<lo:array<double>,hi:array<double>,most:double,reach:double>"
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ringed.schema.fields)
    pair = T.StructType([T.StructField("neighbour", rows.schema[ids].dataType), T.StructField("d2", T.DoubleType())])

    def inside(t: pa.Table, table: pa.Table) -> pa.Table:
        t = t.select([*names, "cell", "ring"]).sort_by(ids)
        x, who = matrix(t.column("vec")), t.column(ids).to_numpy()
        r, c, d = best(x, x, who, who, k)
        at = np.searchsorted(r, np.arange(len(x) + 1))
        full = np.diff(at) == k
        reach = np.full(len(x), np.nan)
        reach[full] = d[at[1:][full] - 1]
        near = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([t.column(ids).combine_chunks().take(pa.array(c)), pa.array(d)], names=["neighbour", "d2"]))
        if len(x) == 0:
            stats = []
        else:
            points = _points(table) if table.num_rows else x[:1]
            to = np.sqrt(squared(x, points))
            stats = [{"lo": to.min(0).tolist(), "hi": to.max(0).tolist(), "most": float((x * x).sum(1).max()), "reach": float(reach.max()) if full.all() else None}]
        stats += [None] * (len(x) - 1)
        kind = pa.struct([("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("most", pa.float64()), ("reach", pa.float64())])
        return pa.table([*t.columns, near, pa.array(reach, pa.float64(), from_pandas=True), pa.array(stats, kind)], names=[*t.column_names, "near", "reach", "stat"])

    which = ringed.select(*by, "cell", "ring").distinct()
    tables = join_same_key(which, found, by)
    tables = tables.select(*[F.col(c).alias(c) for c in tables.columns])  # columns of its own beside those of ringed
    key = [*by, "cell", "ring"]
    return durable(ringed.groupBy(*key).cogroup(tables.groupBy(*key)).applyInArrow(
        inside, f"{kinds}, near array<{pair.simpleString()}>, reach double, stat {stat}"))


def block_name():
    return F.col("cell").cast("long") * F.lit(1 << 32) + F.col("ring")


def bundles(made: DataFrame, by, size: int) -> DataFrame:
    """(by, block, bundle): runs of a group's blocks, as many in one as a task may
    hold, but no more than leave every task some pairs of bundles."""
    tasks = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = made.filter("stat is not null").select(*by, block_name().alias("block"), F.size("vec").alias("_d"))
    many = listed.withColumn("_all", F.lit(1)).groupBy("_all", *by).agg(F.count(F.lit(1)).alias("_b"), F.max("_d").alias("_d"))
    whole = many.groupBy("_all").agg(F.sqrt(F.sum(F.col("_b").cast("double") * F.col("_b"))).alias("_norm"))
    held = F.least(F.lit(max(1, MOST_ROWS // size)).cast("double"), F.floor(F.lit(float(NUMBERS) / size) / F.greatest(F.lit(1), F.col("_d"))).cast("double"))
    each = F.greatest(F.lit(1.0), F.least(held, F.floor(F.col("_norm") / math.sqrt(4 * tasks))))
    each = many.join(F.broadcast(whole), "_all").select(*by, each.alias("_each"))  # ``whole`` is one row
    place = F.row_number().over(Window.partitionBy(*by).orderBy("block")) - 1  # one row a block
    return join_same_key(listed.drop("_d").withColumn("_at", place), each, by).select(*by, "block", F.floor(F.col("_at") / F.col("_each")).cast("long").alias("bundle"))


def open_pairs(made: DataFrame, by) -> DataFrame:
    """(by, _bi, _bj): blocks whose gap is within the reach of one of them. A
    block is named cell * 2^32 + ring."""
    stats = durable(made.filter("stat is not null").select(*by, "cell", block_name().alias("block"), "stat.*").withColumn("reach", F.coalesce("reach", F.lit(float("inf")))))
    edge = stats.select(*by, "cell", F.posexplode(F.arrays_zip("lo", "hi")).alias("p", "z"), "reach", "most").groupBy(*by, "cell", "p").agg(
        F.min("z.lo").alias("lo"), F.max("z.hi").alias("hi"), F.max("reach").alias("reach"), F.max("most").alias("most"))
    whole = edge.groupBy(*by, "cell").agg(  # at most PIVOTS cells of PIVOTS ranges in a group
        F.array_sort(F.collect_list(F.struct("p", "lo", "hi"))).alias("_z"), F.max("reach").alias("reach"), F.max("most").alias("most")).select(
        *by, "cell", F.transform("_z", lambda z: z["lo"]).alias("lo"), F.transform("_z", lambda z: z["hi"]).alias("hi"), "reach", "most")

    def sides(t, suffix):
        return t.select(*by, *[F.col(c).alias(f"{c}{suffix}") for c in t.columns if c not in by])

    def within():
        """The two ranges come as near as the reach of one side, rounding allowed for."""
        gap = F.aggregate(F.arrays_zip("lo1", "hi1", "lo2", "hi2"), F.lit(0.0), lambda m, z: F.greatest(m, z["lo1"] - z["hi2"], z["lo2"] - z["hi1"]))
        slack = 2 * F.sqrt(1e-9 + 1e-12 * F.greatest("most1", "most2"))
        return gap <= F.sqrt(F.greatest("reach1", "reach2")) + slack

    pairs = join_same_key(sides(whole, "1"), sides(whole, "2"), by).filter("cell1 <= cell2").filter(within()).select(*by, "cell1", "cell2")
    one = join_same_key(pairs, sides(stats, "1"), [*by, "cell1"])
    two = join_same_key(one, sides(stats, "2"), [*by, "cell2"]).filter("cell1 < cell2 or block1 < block2").filter(within())
    return two.select(*by, F.col("block1").alias("_bi"), F.col("block2").alias("_bj"))


def _found_schema(rows: DataFrame, by, ids: str) -> str:
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*by, ids])
    return f"{kinds}, neighbour {rows.schema[ids].dataType.simpleString()}, d2 double"


def _alone(t: pa.Table, by, ids: str, k: int) -> pa.Table:
    t = t.sort_by(ids)
    x, who = matrix(t.column("vec")), t.column(ids).to_numpy()
    r, c, d = best(x, x, who, who, k)
    return pa.table({n: t.column(n).take(pa.array(r)) for n in [*by, ids]} | {"neighbour": t.column(ids).take(pa.array(c)), "d2": pa.array(d)})


def nearest(rows: DataFrame, by, ids: str, k: int, size=2048) -> DataFrame:
    """(by, id, neighbour, d2): the k nearest other rows of each row's group, all
    if there are fewer. ``rows`` has by, id, vec."""
    by = list(by)
    rows = durable(rows.select(*by, ids, "vec"))
    most = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if (most or 0) <= size:  # every group is one block
        return rows.withColumn("_all", F.lit(1)).groupBy("_all", *by).applyInArrow(lambda t: _alone(t, by, ids, k), _found_schema(rows, by, ids))
    made = blocks(rows, by, ids, size, k)
    bundled = durable(bundles(made, by, size))

    def side(c):
        return bundled.select(*by, F.col("block").alias(f"_b{c}"), F.col("bundle").alias(f"_bundle{c}"))

    pairs = join_same_key(join_same_key(open_pairs(made, by), side("i"), [*by, "_bi"]), side("j"), [*by, "_bj"])
    least, most = F.least("_bundlei", "_bundlej"), F.greatest("_bundlei", "_bundlej")
    chosen = durable(pairs.select(*by, least.alias("_bi"), most.alias("_bj")).distinct())
    pair = T.StructType([T.StructField("d2", T.DoubleType()), T.StructField("neighbour", rows.schema[ids].dataType)])

    def cut(t: pa.Table):
        """The blocks of a bundle: rows in order of id, vectors, ids, reach, and the ranges of the block."""
        names = t.column("_name").to_numpy()
        for name in np.unique(names):
            b = t.take(pa.array(np.flatnonzero(names == name))).sort_by(ids)
            reach = b.column("reach").to_numpy(zero_copy_only=False).astype(float)
            stat = next(v for v in b.column("stat").to_pylist() if v is not None)
            yield {"name": name, "rows": b, "x": matrix(b.column("vec")), "ids": b.column(ids).to_numpy(), "reach": np.where(np.isnan(reach), np.inf, reach),
                   "lo": np.array(stat["lo"]), "hi": np.array(stat["hi"]), "most": stat["most"], "found": []}

    def nearer(a: dict, b: dict) -> None:
        """What the rows of block a find in block b; the k-th nearest found so far is the reach of what follows."""
        gap = max(0.0, (a["lo"] - b["hi"]).max(), (b["lo"] - a["hi"]).max())
        gap -= 2 * math.sqrt(1e-9 + 1e-12 * max(a["most"], b["most"]))
        mine = np.flatnonzero(np.sqrt(a["reach"]) >= gap)
        r, c, d = best(a["x"][mine], b["x"], a["ids"][mine], b["ids"], k, a["reach"][mine])
        if len(r) == 0:
            return
        a["found"].append((mine[r], b["ids"][c], d))
        if len(a["found"]) > 1:
            r, who, d = (np.concatenate(z) for z in zip(*a["found"], strict=True))
            order = np.lexsort((pd.factorize(who, sort=True)[0], d, r))
            r, who, d = r[order], who[order], d[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            a["found"] = [(r[place < k], who[place < k], d[place < k])]
        r, _, d = a["found"][0]
        full = np.flatnonzero(np.bincount(r, minlength=len(a["x"])) >= k)
        a["reach"][full] = np.minimum(a["reach"][full], d[np.searchsorted(r, full, "right") - 1])

    def packed(a: dict) -> pa.Table:
        r, who, d = a["found"][0] if a["found"] else (np.zeros(0, np.int64), a["ids"][:0], np.zeros(0))
        at = np.unique(r)
        ends = np.concatenate([np.searchsorted(r, at), [len(r)]])
        kind = a["rows"].schema.field(ids).type
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(d), pa.array(who, kind)], names=["d2", "neighbour"]))
        return pa.table({c: a["rows"].column(c).take(pa.array(at)) for c in [*by, ids]} | {"near": lists})

    def work(left: pa.Table, right: pa.Table | None) -> pa.Table:
        one = list(cut(left))
        two = one if right is None else list(cut(right))
        for i, a in enumerate(one):
            for b in two[i + 1:] if right is None else two:  # a block has met itself
                nearer(a, b)
                nearer(b, a)
        done = [packed(a) for a in (one if right is None else one + two)]
        none = {c: left.column(c).slice(0, 0) for c in [*by, ids]}
        return pa.concat_tables(done) if done else pa.table(none | {"near": pa.array([], pa.list_(pa.struct([("d2", pa.float64()), ("neighbour", left.schema.field(ids).type)])))})

    named = made.select(*by, ids, "vec", "reach", "stat", block_name().alias("_name"))
    named = join_same_key(named, bundled.select(*by, F.col("block").alias("_name"), F.col("bundle").alias("_block")), [*by, "_name"])
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*by, ids])
    met = pair_blocks(named, by, work, f"{kinds}, near array<{pair.simpleString()}>", chosen)
    own = made.select(*by, ids, F.transform("near", lambda n: F.struct(n["d2"].alias("d2"), n["neighbour"].alias("neighbour"))).alias("near"))
    # a list for each bundle a row has met, its k best in each
    all_ = own.union(met).withColumn("_all", F.lit(1)).groupBy("_all", *by, ids).agg(F.flatten(F.collect_list("near")).alias("near"))
    return all_.select(*by, ids, F.explode(F.slice(F.sort_array("near"), 1, k)).alias("_n")).select(*by, ids, "_n.neighbour", "_n.d2")
