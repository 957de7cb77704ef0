"""Source mixing, conversation trie and hard negatives against plain Python."""

import hashlib
import math
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortile.llm import mixing, negatives, prefixes


@pytest.fixture(params=[True, False], ids=["merged", "many"])
def ranges(request, spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, str(request.param).lower())
    yield
    spark.conf.unset(key)


# --- mixing ---------------------------------------------------------------------------
def brute_mix(rows, weights=(3, 1, 2), share=Fraction(3, 2), epochs=2, seed=11):
    """[(doc_id, size, source_size, target, taken)] of (doc_id, text, source)."""
    size = [len([w for w in mixing_words(t)]) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, target, open_ = min(share, epochs) * sum(size), {}, set(names)
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level >= epochs * total[s]]
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: Fraction(epochs * total[s]) for s in over}
        open_ -= set(over)
    line = []
    for rank, s in enumerate(names):
        words = 0
        queue = []
        for copy in range(1, epochs + 1):
            at = [(int(hashlib.md5("|".join(str(x) for x in (r[0], copy, seed) if x is not None).encode()).hexdigest()[:15], 16), r[0] is not None, r[0] or 0, size[i], i)
                  for i, r in enumerate(rows) if r[2] == s]
            queue += [(copy, *a) for a in sorted(at)]
        for q in queue:
            words += q[4]
            line.append((words / float(target[s]) if target[s] else -1.0, rank, *q))
    left, taken = int(budget), defaultdict(int)
    for x in sorted(line):
        got = min(x[-2], left)
        taken[x[-1]] += got
        left -= got
    return sorted(((r[0], size[i], total[r[2]], round(float(target[r[2]]), 6), taken[i]) for i, r in enumerate(rows)), key=str)


def mixing_words(text):
    import re
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def mixed(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "_row": F.lit(1), "target": F.lit(2), "_rank": F.lit(0)})
    out = mixing.mix(df, **kw)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"]
    return df, sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in out.collect()), key=str)


def corpus(n=300, seed=3):
    rng = random.Random(seed)
    return [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 20, 300]))), rng.choice(["a", "b", "b", "b", "b", "c", "d", None, "é"])) for i in range(n)]


def test_mix_equals_brute_force(spark, ranges):
    rows = [*corpus(), (None, "one two", "a"), (7, "same id", "z"), (7, "same id", "z"), (400, None, "empty"), (401, "", "empty")]
    _, got = mixed(spark, rows)
    assert got == brute_mix(rows)
    assert sum(r[4] for r in got) == 3 * sum(r[1] for r in got) // 2
    assert all(r[4] <= 2 * r[1] for r in got)
    _, other = mixed(spark, list(reversed(rows)))
    assert other == got  # another order of rows, the same mix


def test_mix_other_parameters_and_caps(spark):
    rows = corpus(120, 5)
    _, got = mixed(spark, rows, weights=(1, 50), share=2.5, epochs=3)
    assert got == brute_mix(rows, (1, 50), Fraction(5, 2), 3)
    _, all_of_it = mixed(spark, rows, share=9, epochs=2)  # more than there is: everything twice
    assert all(r[4] == 2 * r[1] and r[3] == 2 * r[2] for r in all_of_it)


def test_mix_sources_come_near_their_targets(spark):
    rows = [(i, "w " * (10 + i % 7), f"s{i % 5}" if i % 3 else "hot") for i in range(3000)]
    _, got = mixed(spark, rows)
    source = {i: s for i, _, s in rows}
    taken, target = defaultdict(int), {}
    for i, _, _, t, k in got:
        taken[source[i]] += k
        target[source[i]] = t
    assert all(abs(taken[s] - target[s]) <= 2 * 17 for s in target)


def test_mix_of_nothing_and_of_no_words(spark):
    assert mixed(spark, [])[1] == []
    assert mixed(spark, [(1, None, None), (2, " \n", "a")])[1] == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_mixed_texts_hold_the_taken_words(spark):
    rows = [(i, f"  a{i} b\n c{i} " + "d " * (i % 5), "ab"[i % 2]) for i in range(41)]
    df, got = mixed(spark, rows)
    plan = mixing.mix(df)
    texts = defaultdict(list)
    for r in mixing.mixed_texts(df.withColumn("_mix_id", F.lit(0)).withColumn("taken", F.lit(0)), plan).collect():
        texts[r.doc_id].append((r.copy_no, r.text))
    whole = {i: t for i, t, _ in rows}
    for i, size, _, _, taken in got:
        parts = [t for _, t in sorted(texts.get(i, []))]
        assert sum(len(mixing_words(t)) for t in parts) == taken
        assert all(t == whole[i] for t in parts[:taken // size]) and all(whole[i].startswith(t) for t in parts)


# --- trie -----------------------------------------------------------------------------
def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest() + format(len(mixing_words(text)), "08x")
            convs[c].append((turn is not None, turn or 0, digest, role, text))
    plain = {c: [t[3:] for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = plain.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = defaultdict(int), defaultdict(int)
    for k in sorted(members, key=len, reverse=True):
        leaves[k] += not kids[k]
        saved[k] += (len(members[k]) - 1) * (len(mixing_words(k[-1][1])) if k else 0)
        if k:
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k],
                   hashlib.sha256(",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(k))).encode()).hexdigest())
                  for k, m in members.items())


def nodes(spark, rows, width):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"pos": F.lit("x"), "block": F.lit(1), "t1": F.lit(2), "_one": F.lit(5)})
    turns = prefixes.numbered_turns(df)
    rebuilt = prefixes.with_shared_heads(turns, F.col("conv_id") - F.col("conv_id") % 20, F.crc32(F.col("conv_id").cast("string")) % 4, 3)
    out = prefixes.trie(rebuilt, turns.filter("pos = 0").select("conv_id"), width)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in out.collect())


def talk(seed=2):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-25, 90), 1000]:
        if c % 41:
            rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["", "a b", "c d e", "f"])) for t in range(rng.choice([1, 2, 3, 5, 9]))]
    rows += [(501, t, "user", f"long {t % 3} talk") for t in range(37)] + [(502, t, "user", f"long {t % 3} talk") for t in range(30)]
    rows += [(503, None, None, None), (503, None, "user", "x"), (503, 1, "user", None), (503, 1, "user", None), (503, 1, "", "y")]
    rows += [(None, 1, "user", "lost")]
    rows += [(c, t, "user", "same words here") for c in range(2000, 2060) for t in range(4)]  # a hot conversation
    return rows


@pytest.mark.parametrize("width", [3, 8])
def test_trie_equals_brute_force(spark, ranges, width):
    assert nodes(spark, talk(), width) == brute_trie(talk())


def test_trie_with_parents_by_broadcast_and_by_key(spark, monkeypatch):
    keys = {}
    for hot in (10**9, 1):
        monkeypatch.setattr(prefixes, "HOT_PARENTS", hot)
        keys[hot] = nodes(spark, talk(4), 4)
    assert keys[1] == keys[10**9] == brute_trie(talk(4))


def test_trie_of_nothing(spark):
    assert nodes(spark, [], 8) == [] and nodes(spark, [(None, 1, "user", "x")], 8) == []


def test_trie_splits_one_very_long_conversation(spark):
    """No task of the numbering holds most of one conversation."""
    df = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), (F.col("id") % 7).cast("string").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = prefixes.numbered_turns(df)
        sizes = [r["count"] for r in turns.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()]
        assert max(sizes) < 12_000 and turns.agg(F.max("pos")).first()[0] == 19_999
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# --- hard negatives -------------------------------------------------------------------
def brute_negatives(rows, anchors=lambda i: i % 100 == 0):
    good = []
    for i, label, x in rows:
        if i is not None and label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            limit = math.floor(2**27 / math.sqrt(max(len(x), 1)))
            good.append((i, label, [int(max(-limit, min(limit, math.floor(256 * c)))) for c in x]))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for i, label, x in good:
        if not anchors(i):
            continue
        positives = sorted((-dot(x, v), j) for j, b, v in good if b == label and j != i)[:5]
        others = sorted((-dot(x, v), j) for j, b, v in good if b != label)
        for s, p in positives:
            fit = [(j, -n) for n, j in others if 30 * -s <= 100 * -n <= 90 * -s][:10]
            out += [(i, p, r, j, -s, n) for r, (j, n) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"row": F.lit(1), "v": F.lit("x"), "cell": F.lit(3), "nth": F.lit(0)})
    out = negatives.mine(negatives.quantised(df), F.col("id") % 100 == 0, **kw)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def clouds(n=900, dim=10, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, dim))
    return [(i, int(i % 3), [float(c) for c in middle[i % 12] + rng.normal(scale=0.2, size=dim)]) for i in range(n)]


@pytest.mark.parametrize("codes", [None, 1, 6])
def test_negatives_equal_brute_force(spark, codes):
    rows = clouds()
    assert mined(spark, rows, codes=codes) == brute_negatives(rows)


def test_negatives_with_ties_repeats_and_bad_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "CHUNK", 50)
    monkeypatch.setattr(negatives, "BLOCK", 100)
    rows = clouds(400) + [(1000 + i, i % 2, [1.0] * 10) for i in range(300)]  # a hot vector
    rows += [(None, 1, [1.0] * 10), (2100, None, [1.0] * 10), (2200, 1, None), (2300, 1, [1.0, None]), (2400, 1, [float("nan")] * 10), (2500, 1, [float("inf")] * 10),
             (2600, 1, [1.0, 2.0]), (2700, 1, []), (2701, 0, []), (300, 0, [0.5] * 10), (300, 0, [0.5] * 10), (2800, 2, [1e300] * 10), (2801, 1, [-1e300, 1e300])]
    assert mined(spark, rows) == brute_negatives(rows)


def test_negatives_of_nothing(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1.0])]) == [] and mined(spark, [(0, 1, [1.0, 1.0]), (1, 1, [1.0, 1.0])]) == []


def test_heap_yields_all_cells_in_order_of_their_bound():
    rng = np.random.default_rng(0)
    one, two = rng.normal(size=7), rng.normal(size=5)
    got = list(negatives.cells_in_order(one, two))
    assert [b for b, _, _ in got] == sorted((a + b for a in one for b in two), reverse=True)
    assert len({(i, j) for _, i, j in got}) == 35


def test_walk_opens_few_cells_on_clustered_data(spark):
    """Tight clusters: the certified walks leave most cells closed."""
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(40, 8)) * 3
    x = [[float(c) for c in middle[i % 40] + rng.normal(scale=0.02, size=8)] for i in range(4000)]
    rows = negatives.quantised(spark.createDataFrame([(i, i % 5, v) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>"))
    books = negatives.fit(rows, 20, 8, 4000)
    coded = negatives.index(rows, books, 8).toPandas()
    sizes, radii = np.zeros((20, 20), np.int64), [np.zeros(20), np.zeros(20)]
    for r in coded.itertuples():
        sizes[r.c1, r.c2] += 1
        radii[0][r.c1], radii[1][r.c2] = max(radii[0][r.c1], r.d1), max(radii[1][r.c2], r.d2)
    q = np.floor(256 * np.array(x)).astype(np.int64)
    least = [float(np.sort(q[i] @ q.T)[-9]) for i in range(0, 4000, 100)]
    who = spark.createDataFrame([(i, [int(c) for c in q[100 * i]], v) for i, v in enumerate(least)], "row long, v array<long>, least double")
    opened = negatives.visits(who, books, radii, sizes, 8, floor="least").count()
    assert opened < 40 * (sizes > 0).sum() / 4
