"""Prefix trie of conversations by ROLLUP over positional turn-id columns.

A turn's id is the digest of its role and text (and its number of words). A
conversation is cut into blocks of ``width`` turns, one row per block with the
ids in columns t1..tW. ``GROUP BY block, prior, ROLLUP(t1, ..., tW)`` then
aggregates the prefixes of every length in one pass, ``grouping_id`` telling
the length; ``prior`` names the node that the conversation had reached before
the block, so the blocks of long conversations continue the trie where it
stood, all in the same pass.

``prior`` and the key of a node are sums of two 64-bit hashes of (position,
turn id) over the prefix, kept as whole numbers. Sums can be taken by range
scans, so one conversation with most of the turns is numbered, keyed and
summed in as many tasks as it has ranges. Two different prefixes of one length
share a key with a chance of 2^-120 a pair.

A second ROLLUP sums what the nodes below a node hold: a node's own values are
booked on its smallest member, whose block row carries them to all prefixes.
A parent with very many children is joined by broadcast (at most
``HOT_PARENTS`` rows, by the bound it is chosen with), the others by key.

Defined results: a null role or text is empty; a null turn comes first, rows
of one turn are ordered by turn id, equal ones count as turns of their own;
rows without conv_id belong to no conversation; an empty table has no node.
Only the four named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import scan
from ..session import durable

WIDTH = 8
#: parents joined by broadcast; each has over 1 / HOT_PARENTS of all nodes as children
HOT_PARENTS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def _lane(seed: int, position: Column, turn_id: Column) -> Column:
    return F.when(turn_id.isNull(), F.lit(0).cast("decimal(38,0)")).otherwise(F.xxhash64(F.lit(seed), position.cast("long"), turn_id).cast("decimal(38,0)"))


def _key(a, b) -> Column:
    return F.unhex(F.md5(F.concat_ws("|", a.cast("string"), b.cast("string"))))


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), turn_id of every turn, in order of turn."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.lpad(F.hex(F.regexp_count(text, F.lit(WORD)).cast("long")), 8, "0")
    turn_id = F.concat(F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))), F.unhex(words))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), turn_id.alias("turn_id"), F.lit(1).alias("_one"))
    return scan(rows.filter("conv_id is not null"), ["conv_id"], ["turn", "turn_id"], {"_one": "pos"}).select("conv_id", "pos", "turn_id")


def turn_words(turn_id: Column) -> Column:
    return F.coalesce(F.conv(F.hex(F.substring(turn_id, 17, 4)), 16, 10).cast("long"), F.lit(0).cast("long"))


def with_shared_heads(numbered: DataFrame, donor: Column, head: Column, most: int) -> DataFrame:
    """Every conversation's first ``head`` turns (``most`` at most) replaced by
    those of conversation ``donor``, as far as it has them; numbered anew."""
    convs = numbered.filter("pos = 0").select("conv_id").withColumns({"_donor": donor, "_head": head})
    heads = numbered.filter(F.col("pos") < most).select(F.col("conv_id").alias("_from"), "pos", "turn_id")
    given = convs.join(heads, (F.col("_donor") == F.col("_from")) & (F.col("pos") < F.col("_head"))).select("conv_id", "pos", "turn_id")
    rows = numbered.filter(F.col("pos") >= head).union(given).withColumn("_one", F.lit(1))
    return scan(rows, ["conv_id"], ["pos"], {"_one": "_pos"}).select("conv_id", F.col("_pos").alias("pos"), "turn_id")


def _rolled(blocks: DataFrame, sums: str, width: int) -> DataFrame:
    """One row per prefix: k turns of a block, after its prior node."""
    t = ", ".join(f"t{j}" for j in range(1, width + 1))
    rolled = blocks.sparkSession.sql(
        f"select block, prior_a, prior_b, {t}, {width} - bit_count(grouping_id()) as k, {sums} from {{blocks}} group by block, prior_a, prior_b, rollup({t})",
        blocks=blocks)
    last = F.get(F.array(*[f"t{j}" for j in range(1, width + 1)]), F.col("k") - 1)
    whole = rolled.withColumn("last", F.when(F.col("k") > 0, last)).filter("last is not null or (k = 0 and block = 0)")
    lanes = {}
    for lane, seed in (("a", 1), ("b", 2)):
        total = F.col(f"prior_{lane}")
        for j in range(1, width + 1):  # columns beyond k are null in a rolled row
            total = total + _lane(seed, F.col("block") * width + (j - 1), F.col(f"t{j}"))
        lanes[lane] = total
        lanes[f"up_{lane}"] = total - _lane(seed, F.col("block") * width + F.col("k") - 1, F.col("last"))
    return whole.withColumns({"key": _key(lanes["a"], lanes["b"]), "parent_key": F.when(F.col("last").isNotNull(), _key(lanes["up_a"], lanes["up_b"]))})


def block_rows(numbered: DataFrame, convs: DataFrame, width=WIDTH) -> DataFrame:
    """conv_id, block, prior_a, prior_b, end (key of the conversation's last
    node), t1..tW; a conversation without turns has one row of nulls."""
    at = F.col("pos") % width
    cut = numbered.withColumns({"_a": _lane(1, F.col("pos"), F.col("turn_id")), "_b": _lane(2, F.col("pos"), F.col("turn_id"))}).groupBy(
        "conv_id", F.floor(F.col("pos") / width).cast("long").alias("block")).agg(
        F.sum("_a").cast("decimal(38,0)").alias("_a"), F.sum("_b").cast("decimal(38,0)").alias("_b"),
        *[F.max(F.when(at == j - 1, F.col("turn_id"))).alias(f"t{j}") for j in range(1, width + 1)])
    bare = convs.join(numbered.filter("pos = 0").select("conv_id"), "conv_id", "left_anti")
    none = F.lit(None).cast("binary")
    zero = F.lit(0).cast("decimal(38,0)")
    cut = cut.union(bare.select("conv_id", F.lit(0).cast("long"), zero, zero, *[none] * width))
    keyed = scan(cut, ["conv_id"], ["block"], {"_a": "prior_a", "_b": "prior_b"}, {"_a": "_all_a", "_b": "_all_b"})
    return keyed.select("conv_id", "block", F.col("prior_a").cast("decimal(38,0)").alias("prior_a"), F.col("prior_b").cast("decimal(38,0)").alias("prior_b"),
                        _key(F.col("_all_a"), F.col("_all_b")).alias("end"), *[f"t{j}" for j in range(1, width + 1)])


def with_parents(nodes: DataFrame) -> DataFrame:
    """Adds parent_conv_id. The parents that hold over 1 / HOT_PARENTS of all
    nodes are that many at most and travel with the tasks."""
    hot = F.col("n_children") > max(1000, nodes.count() // HOT_PARENTS)
    parents = nodes.filter("n_children > 0").select(F.col("key").alias("_key"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    met = nodes.join(F.broadcast(parents.filter(hot).drop("n_children")), F.col("parent_key") == F.col("_key"), "left").drop("_key")
    done = F.col("parent_conv_id").isNotNull() | F.col("parent_key").isNull()
    rest = met.filter(~done).drop("parent_conv_id").join(parents.filter(~hot).drop("n_children"), F.col("parent_key") == F.col("_key"), "left").drop("_key")
    return met.filter(done).unionByName(rest)


def list_digests(rows: DataFrame, key: str, number: str) -> DataFrame:
    """key, digest: SHA-256 of the key's numbers, ascending, comma-joined. Ranges
    of (key, number) are joined to pieces first; a task then hashes the pieces
    of a key in order, holding one at a time (SHA-256 has no parallel form)."""
    def join(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            codes = b.column(0).dictionary_encode().indices.to_numpy()
            at = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])
            lists = pa.ListArray.from_arrays(pa.array(np.append(at, b.num_rows), pa.int32()), pc.cast(b.column(1), pa.string()))
            first = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(first), b.column(1).take(first), pc.binary_join(lists, ",")], names=["key", "first", "piece"])

    def digest(batches):
        now, state = None, None
        for b in batches:
            keys, out = [], []
            for k, piece in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k == now:
                    state.update(b"," + piece.encode())
                    continue
                if state is not None:
                    keys.append(now)
                    out.append(state.hexdigest())
                now, state = k, hashlib.sha256(piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], names=["key", "digest"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "digest"])

    rows = rows.select(F.col(key).alias("key"), F.col(number).cast("long").alias("number"))
    parts = rows.repartitionByRange("key", "number").sortWithinPartitions("key", "number").mapInArrow(join, "key binary, first long, piece string")
    return parts.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digest, "key binary, digest string")


def trie(numbered: DataFrame, convs: DataFrame, width=WIDTH) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``numbered`` has conv_id, pos from 0 without gaps, turn_id; ``convs`` each
    conv_id once, those without turns included."""
    blocks = durable(block_rows(numbered, convs, width))
    found = _rolled(blocks, "min(conv_id) as conv_id, count(*) as n_convs", width)
    nodes = durable(found.select((F.col("block") * width + F.col("k")).alias("depth"), "block", "k", "conv_id", "n_convs", "key", "parent_key",
                                 turn_words(F.col("last")).alias("words")))
    children = nodes.filter("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = durable(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))

    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("words")
    at = range(width + 1)
    own = nodes.groupBy("conv_id", "block").agg(
        *[F.sum(F.when(F.col("k") == j, v).otherwise(0)).alias(f"{n}{j}") for n, v in (("l", leaf), ("s", saved)) for j in at])
    values = blocks.join(own, ["conv_id", "block"], "left").na.fill(0, [f"{n}{j}" for n in "ls" for j in at])
    plus = lambda names: sum((F.col(c) for c in names), F.lit(0).cast("long"))
    values = values.withColumns({n: plus([f"{n}{j}" for j in at]) for n in "ls"})
    below = scan(values, ["conv_id"], ["block"], ends={"l": "_l_to", "s": "_s_to"}, totals={"l": "_l_all", "s": "_s_all"})
    later = {n: F.col(f"_{n}_all") - F.col(f"_{n}_to") for n in "ls"}
    suffix = below.select("block", "prior_a", "prior_b", *[f"t{j}" for j in at if j],
                          *[(later[n] + plus([f"{n}{i}" for i in at if i >= j])).alias(f"{n}{j}") for n in "ls" for j in at])
    sums = ", ".join(f"sum({n}{j}) as {n}{j}" for n in "ls" for j in at)
    rolled = _rolled(suffix.filter("l0 > 0 or s0 > 0"), sums, width)
    pick = lambda n: F.get(F.array(*[f"{n}{j}" for j in at]), F.col("k"))
    totals = rolled.select("key", pick("l").alias("n_leaves"), pick("s").alias("saved_tokens"))
    ends = list_digests(blocks.filter("block = 0"), "end", "conv_id").withColumnRenamed("digest", "ends_sha256")
    full = with_parents(nodes).join(totals, "key").join(ends, "key", "left")
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                       F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
