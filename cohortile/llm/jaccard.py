"""Exact Jaccard join of word-shingle sets with token-combination prefixes.

Texts with equal sets form one class; the join runs between classes and is
exact: every pair at or above the threshold ends in one component.

Prefixes. Tokens (64-bit shingle hashes) have one global order: first the
sampled part of the token space, by how many classes hold them, then the rest.
Two similar sets miss at most n/5 of each other's tokens, so a prefix whose
tokens weigh n/5 + 1 shares something: a rare token weighs one and is indexed
alone; of frequent tokens, split into sub-classes by hash, c in one sub-class
weigh c - 1, and every pair of them is indexed. Prefixes are extended until
they weigh enough. A token that no other class holds weighs one and needs no
index entry, so most texts send none.

Candidates. In a bucket (the classes with one indexed combination) sizes and
parity bitmaps are compared; a bitmap differs in at most as many bits as the
sets do in tokens, so nothing similar is lost. Round one takes the closest
partner of every class, verifies it on the whole sets and joins components.
Round two verifies every remaining pair of a bucket whose classes are still in
different components. So a group of thousands of near copies costs about one
verification each, not one per pair, and no pair list of a group is ever written.

Skew. Equal texts collapse before anything else. Token counts are summed per
piece. A bucket above ``BLOCK`` rows is cut into blocks by hash; round two deals
its pairs of blocks to different tasks.

Defined cases: null, empty or wordless text has an empty set, no link, and is
its own component. A text of fewer words than the width is one shingle. A null
id takes no part and has component null. Repeated rows fall in one class.
Hash collisions (2^-64 a pair) are the only inexactness.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, durable
from .components import components
from .suffix import NAMES, PACKET, SCHEMA, array, batch_of, packet
from .text import ALL, M1, M2, M3, ODD, flat, give_back, mix, neutral, pieces, shingles, short_batches, word_hashes

WIDTH = 5
#: share of the token space that is counted and ordered by frequency
SAMPLED = np.uint64(int(0.35 * (1 << 64)))
#: tokens in more classes than this are indexed in pairs
RARE = 32
BLOCK = 2048
BITS = 512
STEP = 1.2501


def misses(n: int) -> int:
    """Tokens of a set of n that a similar set (0.8) may lack."""
    return n // 5


def band(n: int) -> int:
    """Similar sets lie in the same band or in neighbouring ones."""
    return int(math.log(n) / math.log(STEP) + 1e-9)


def subclasses(b: int) -> int:
    return max(1, int(STEP ** b / 20))


def parity(tokens: np.ndarray) -> np.ndarray:
    """Bitmap with bit (token mod BITS) flipped for every token."""
    return np.packbits(np.bincount((tokens & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1)


def set_key(tokens: np.ndarray) -> int:
    return int(mix(np.array([(mix(tokens + M1)).sum(dtype=np.uint64) ^ np.uint64(len(tokens) * int(M2) & ALL)], np.uint64)).view(np.int64)[0])


def token_sets(column, width=WIDTH):
    """The sorted distinct shingle hashes of every text."""
    h, at = word_hashes(*flat(column))
    s, at = shingles(h, at, width)
    return [np.unique(s[at[i]:at[i + 1]]) for i in range(len(at) - 1)]


def sketch(width):
    """Piece rows: ids, set sizes and keys of all texts; sampled tokens and bitmaps of the distinct sets."""
    def run(batches):
        for b in pieces(batches):
            ids = np.asarray(b.column("doc_id")).astype(np.int64)
            sets = token_sets(b.column("text"), width)
            n = np.array([len(s) for s in sets], np.int64)
            keys = np.array([set_key(s) if len(s) else 0 for s in sets], np.int64)
            _, first = np.unique(keys, return_index=True)
            first = [i for i in first if n[i] > 3]
            low, rest, maps = [], [], []
            for i in first:
                s, size = sets[i], int(n[i])
                cut = int(np.searchsorted(s, SAMPLED))
                low.append(s[:cut])
                short = cut - subclasses(band(size) + 1) < misses(size) + 1
                rest.append(s[cut:] if short else s[:0])
                maps.append(parity(s))
            pack = lambda x, t: np.concatenate([*x, np.zeros(0, t)]).astype(t).tobytes()
            chunk = int(mix(np.array([(mix(ids.view(np.uint64)) + keys.view(np.uint64) * M3).sum(dtype=np.uint64)], np.uint64)).view(np.int64)[0])
            yield pa.RecordBatch.from_pydict({
                "chunk": [chunk], "ids": [ids.tobytes()], "sizes": [n.tobytes()], "keys": [keys.tobytes()],
                "nodes": [keys[first].tobytes()], "node_sizes": [n[first].tobytes()],
                "low": [pack(low, np.uint64)], "low_n": [np.array([len(x) for x in low], np.int64).tobytes()],
                "rest": [pack(rest, np.uint64)], "rest_n": [np.array([len(x) for x in rest], np.int64).tobytes()], "maps": [pack(maps, np.uint8)]})
    return run


SKETCH = ("chunk long, ids binary, sizes binary, keys binary, nodes binary, node_sizes binary, "
          "low binary, low_n binary, rest binary, rest_n binary, maps binary")


def members(batches):
    """doc_id, n_shingles, node from the piece rows."""
    for b in batches:
        for ids, n, keys in zip(*(b.column(c).to_pylist() for c in ("ids", "sizes", "keys")), strict=True):
            yield pa.RecordBatch.from_pydict({"doc_id": np.frombuffer(ids, np.int64), "n_shingles": np.frombuffer(n, np.int64), "node": np.frombuffer(keys, np.int64)})


def ask_counts(shards):
    """The distinct sampled tokens of a piece and how many of its sets hold them, to their shards."""
    def run(batches):
        for b in batches:
            for chunk, low in zip(b.column("chunk").to_pylist(), b.column("low").to_pylist(), strict=True):
                tok, count = np.unique(np.frombuffer(low, np.uint64), return_counts=True)
                shard = ((tok >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                cut = np.searchsorted(shard[order], np.arange(shards + 1))
                rows = []
                for s in np.flatnonzero(np.diff(cut)):
                    pick = order[cut[s]:cut[s + 1]]
                    rows.append(packet(s, 0, chunk, tok[pick], np.minimum(count[pick], 65535).astype(np.uint16)))
                if rows:
                    yield batch_of(rows)
    return run


def answer_counts(t: pa.Table) -> pa.Table:
    """In a shard: the tokens of each piece that several sets hold, with their number."""
    tokens, count = array(t, "a", np.uint64), array(t, "b", np.uint16)
    source = np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])
    key = np.concatenate(tokens)
    _, back = np.unique(key, return_inverse=True)
    total = np.bincount(back, np.concatenate(count)).astype(np.uint32)[back]
    yes = np.flatnonzero(total > 1)
    cut = np.searchsorted(source[yes], np.arange(len(tokens) + 1))
    chunks, out = t.column("chunk").to_pylist(), []
    for i in np.flatnonzero(np.diff(cut)):
        pick = yes[cut[i]:cut[i + 1]]
        out.append(packet(0, 0, chunks[i], key[pick], total[pick]))
    return pa.Table.from_batches([batch_of(out)])


def signatures(tokens: np.ndarray, df: np.ndarray, rest: np.ndarray, n: int, most=RARE) -> np.ndarray:
    """Indexed combinations of one set: single rare tokens, pairs of frequent ones."""
    need = misses(n) + 1 - int((df == 1).sum())
    none = np.zeros(0, np.uint64)
    if need <= 0:
        return none
    order = np.lexsort((tokens, df))
    tokens, df = tokens[order], df[order]
    rare = tokens[(df > 1) & (df <= most)][:need]
    out, need = [mix(rare ^ M1)], need - len(rare)
    if need > 0:
        frequent = tokens[df > most]
        for b in (band(n), band(n) + 1):
            sub = (frequent >> np.uint64(8)) % np.uint64(subclasses(b))
            fresh = np.zeros(len(sub), bool)
            fresh[np.unique(sub, return_index=True)[1]] = True
            weight = np.cumsum(~fresh)
            end = int(np.searchsorted(weight, need)) + 1
            pick = np.lexsort((frequent[:end], sub[:end]))
            t, s = frequent[:end][pick], sub[:end][pick]
            for d in range(1, len(t)):
                same = s[:-d] == s[d:]
                if not same.any():
                    break
                out.append(mix(mix(t[:-d][same] * ODD + t[d:][same]) + np.uint64((b + 1) * int(M3) & ALL)))
            lack = need - (int(weight[-1]) if len(weight) else 0)
            if lack > 0:
                out.append(mix(rest[:lack] ^ M1))
    return np.unique(np.concatenate(out))


def index_sets(t: pa.Table, most: int) -> pa.Table:
    """In a piece: node, size, bitmap and signatures of every set that has a signature."""
    own, got = t.filter(pc.equal(t["kind"], 1)), t.filter(pc.equal(t["kind"], 0))
    nodes, sizes = array(own, "nodes", np.int64)[0], array(own, "node_sizes", np.int64)[0]
    low, low_n = array(own, "low", np.uint64)[0], array(own, "low_n", np.int64)[0]
    rest, rest_n = array(own, "rest", np.uint64)[0], array(own, "rest_n", np.int64)[0]
    maps = array(own, "maps", np.uint8)[0].reshape(-1, BITS // 8)
    key = np.concatenate([np.zeros(0, np.uint64), *array(got, "a", np.uint64)])
    df = np.concatenate([np.zeros(0, np.uint32), *array(got, "b", np.uint32)])
    order = np.argsort(key)
    key, df = key[order], df[order]
    count = np.ones(len(low), np.int64)
    if len(key):
        spot = np.minimum(np.searchsorted(key, low), len(key) - 1)
        count = np.where(key[spot] == low, df[spot], 1)
    at, more = np.concatenate([[0], np.cumsum(low_n)]), np.concatenate([[0], np.cumsum(rest_n)])
    rows = []
    for i in range(len(nodes)):
        s = signatures(low[at[i]:at[i + 1]], count[at[i]:at[i + 1]], rest[more[i]:more[i + 1]], int(sizes[i]), most)
        if len(s):
            rows.append((nodes[i], sizes[i], maps[i].tobytes(), s.view(np.int64)))
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.table({"node": pa.array(cols[0], pa.int64()), "n": pa.array(cols[1], pa.int64()), "map": pa.array(cols[2], pa.binary()), "sigs": pa.array(cols[3], pa.list_(pa.int64()))})


def near(n1, n2, m1, m2):
    """Bits that may differ at most minus bits that differ, as the bitmaps tell; negative: not similar."""
    differ = np.bitwise_count(m1 ^ m2).sum(-1).astype(np.int64)
    return (n1 + n2) // 9 - differ, (5 * np.minimum(n1, n2) >= 4 * np.maximum(n1, n2))


def bucket_pairs(closest: bool):
    """Candidate pairs inside the buckets of a sorted partition.

    closest: for each row only the nearest earlier row of its bucket (round
    one). Otherwise every pair whose components differ, and in a pair of
    blocks only pairs across (round two).
    """
    def compare(i, j, c):
        slack, fit = near(c["n"][i], c["n"][j], c["map"][i], c["map"][j])
        ok = fit & (slack >= 0) & (c["node"][i] != c["node"][j])
        if not closest:
            ok &= (c["component"][i] != c["component"][j]) & ((c["first"][i] == c["second"][i]) | (c["block"][i] != c["block"][j]))
        return i[ok], j[ok], slack[ok]

    def pairs(c, cuts):
        size = np.diff(cuts)
        group = np.repeat(np.arange(len(size)), size)
        small = np.repeat(size <= 16, size)
        for d in range(1, 16):
            i = np.arange(len(group) - d) if d < len(group) else np.zeros(0, np.int64)
            i = i[(group[i] == group[i + d]) & small[i]]
            if not len(i):
                break
            yield compare(i, i + d, c)
        for g in np.flatnonzero(size > 16):
            for lo in range(cuts[g], cuts[g + 1], 256):
                hi = min(lo + 256, cuts[g + 1])
                for at in range(cuts[g], hi, 1024):
                    to = min(at + 1024, hi)
                    i, j = np.meshgrid(np.arange(at, to), np.arange(lo, hi), indexing="ij")
                    keep = i < j
                    yield compare(i[keep], j[keep], c)

    def out(c, cuts):
        found = list(pairs(c, cuts))
        if not found:
            return None
        i, j, slack = (np.concatenate(x) for x in zip(*found, strict=True))
        if closest:
            order = np.lexsort((i, -slack, j))
            keep = order[np.concatenate([[True], j[order][1:] != j[order][:-1]])] if len(order) else order
            i, j, slack = i[keep], j[keep], slack[keep]
        a, b = c["node"][i], c["node"][j]
        return pa.RecordBatch.from_pydict({"a": np.maximum(a, b), "b": np.minimum(a, b), "slack": slack})

    def run(batches):
        # a bucket may cross batches: its rows wait until the next one begins
        names = ["sig", "first", "second", "block", "node", "n", "component"]
        held = None
        for t in batches:
            c = {x: np.asarray(t.column(x)).astype(np.int64) for x in names}
            c["map"] = np.frombuffer(b"".join(t.column("map").to_pylist()), np.uint64).reshape(t.num_rows, -1)
            held = c if held is None else {k: np.concatenate([held[k], v]) for k, v in c.items()}
            key = np.stack([held["sig"], held["first"], held["second"]])
            cuts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1])
            if len(cuts) > 1:
                done = out({k: v[:cuts[-1]] for k, v in held.items()}, cuts)
                held = {k: v[cuts[-1]:] for k, v in held.items()}
                if done is not None:
                    yield done
        if held is not None:
            done = out(held, np.array([0, len(held["sig"])]))
            if done is not None:
                yield done
        give_back()
    return run


def candidate_pairs(rows: DataFrame, closest: bool) -> DataFrame:
    keys = ["sig", "first", "second"]
    rows = rows.select(*keys, "block", "node", "n", "component", "map")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(bucket_pairs(closest), "a long, b long, slack long")


def verified(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, shared of the pairs with 100 * intersection >= 80 * union."""
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    both = edges.select("a", "b").join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("x", "y")))
    return both.filter(100 * F.col("shared") >= 80 * (F.size("x") + F.size("y") - F.col("shared"))).select("a", "b", "shared")


def sets_of(docs: DataFrame, wanted: DataFrame, width=WIDTH) -> DataFrame:
    """node, tokens of the wanted (doc_id, node)."""
    def run(batches):
        for b in pieces(batches):
            sets, nodes = token_sets(b.column("text"), width), b.column("node").to_pylist()
            keep = [i for i, s in enumerate(sets) if len(s) and set_key(s) == nodes[i]]
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in keep], pa.int64()), pa.array([sets[i].view(np.int64) for i in keep], pa.list_(pa.int64()))],
                                             names=["node", "tokens"])
    return docs.join(wanted, "doc_id").select("text", "node").mapInArrow(run, "node long, tokens array<long>").dropDuplicates(["node"])


def join(docs: DataFrame, width=WIDTH, rare=RARE, block=BLOCK) -> tuple[DataFrame, DataFrame]:
    """(classes, links). classes: doc_id, n_shingles, node (the class of equal
    sets), component_id; one row per row. links: verified links (a, b, shared)
    between classes that span the components. Tokens of more than ``rare``
    classes are indexed in pairs; buckets above ``block`` rows are cut."""
    docs = short_batches(docs).select(F.col("doc_id").cast("long"), "text")
    known = docs.filter("doc_id is not null")
    shards = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sketches = durable(known.mapInArrow(sketch(width), SKETCH))
    rows = durable(sketches.select("ids", "sizes", "keys").mapInArrow(members, "doc_id long, n_shingles long, node long"))

    counted = sketches.select("chunk", "low").mapInArrow(ask_counts(shards), PACKET).groupBy("route").applyInArrow(answer_counts, PACKET)
    own = [x.split()[0] for x in SKETCH.split(", ") if x.split()[0] not in ("chunk", "ids", "sizes", "keys")]
    both = counted.select("chunk", "kind", "a", "b").unionByName(sketches.select("chunk", F.lit(1).alias("kind"), *own), allowMissingColumns=True)
    index = durable(both.groupBy("chunk").applyInArrow(lambda t: index_sets(t, rare), "node long, n long, map binary, sigs array<long>").dropDuplicates(["node"]))

    discard(sketches)

    # buckets hold ids only; sizes and bitmaps join where pairs are compared
    entries = index.select(F.explode("sigs").alias("sig"), "node")
    sizes = entries.groupBy("sig").agg(F.count("*").alias("rows")).filter("rows > 1")
    entries = entries.join(sizes, "sig").withColumn("blocks", F.ceil(F.col("rows") / block).cast("int"))
    entries = durable(entries.select("sig", "node", "blocks", F.pmod(F.xxhash64("node", "sig"), F.col("blocks")).cast("int").alias("block")))
    maps = index.select("node", "n", "map")

    first = entries.select("sig", "node", "block", F.col("block").alias("first"), F.col("block").alias("second"), F.col("node").alias("component")).join(maps, "node")
    closest = durable(candidate_pairs(first, True).groupBy("a").agg(F.max_by("b", "slack").alias("b")))
    least = rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    wanted = least.join(entries.select("node").distinct(), "node", "left_semi")
    sets = durable(sets_of(known, wanted, width))
    links = durable(verified(closest, sets))
    parts = components(links)

    placed = entries.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("sig")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = placed.join(mixed, "sig", "left_semi").withColumn("other", other)
    dealt = dealt.select("sig", "node", "block", "component", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second")).join(maps, "node")
    second = candidate_pairs(dealt, False).select("a", "b").distinct()
    more = durable(verified(second, sets))
    links = links.unionByName(more)
    whole = components(links)
    discard(closest, sets, index, entries)

    labels = least.join(whole, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = labels.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = durable(labels.select("node", "component").join(names, "component").select("node", "component_id"))
    empty = F.col("n_shingles") == 0
    # each empty set is alone; its rows do not meet in one partition
    linked = rows.filter(~empty).join(named, "node").select("doc_id", "n_shingles", "node", "component_id")
    alone = rows.filter(empty).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("node"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).unionByName(unnamed(docs, width)), links


def unnamed(docs: DataFrame, width) -> DataFrame:
    """The rows without an id."""
    def run(batches):
        for b in pieces(batches):
            yield pa.RecordBatch.from_pydict({"n_shingles": pa.array([len(s) for s in token_sets(b.column("text"), width)], pa.int64())})
    return docs.filter("doc_id is null").select("text").mapInArrow(run, "n_shingles long").select(
        F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("node"), F.lit(None).cast("long").alias("component_id"))


def one_of_each(docs: DataFrame, width=WIDTH) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, each
    text once; rows without an id stay."""
    classes, _ = join(docs, width)
    keep = classes.filter("doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct()
    plain = neutral(docs)
    known = plain.filter("doc_id is not null").join(keep, F.col("doc_id") == F.col("_id"), "left_semi")
    known = known.withColumn("_print", F.xxhash64("text")).dropDuplicates(["doc_id", "_print"]).drop("_print")
    return known.unionByName(plain.filter("doc_id is null")).toDF(*docs.columns)
