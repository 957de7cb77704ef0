"""Text kernel, Jaccard join, suffix dedup and decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cohortile.llm import components, decontam, jaccard, suffix
from cohortile.llm import text as T

SCHEMA = "doc_id long, text string, lang string, n_bytes int, print string, node string, token string, sig int, chunk int, copy int"
VOCABULARY = ["alpha", "beta", "Gamma", "delta", "Éps", "zeta", "eta", "theta", "iota", "kappa", "λ", "mu", "nu", "x", "12"]


def table(spark, rows):
    """doc_id and text, with columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", 1, "p", "n", "t", 1, 1, 1) for i, t in rows], SCHEMA)


def edge_rows(seed=4):
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice(VOCABULARY) + str(r.randrange(60)) for _ in range(n))
    base = [text(n) for n in (3, 5, 8, 40, 60, 120, 400, 2500)]
    rows = [(0, None), (1, ""), (2, "  \t\n "), (3, "one"), (4, "One"), (5, "a b c d"), (6, "a b c d")]
    i = 10
    for b in base:
        w = b.split(" ")
        for edits in (0, 0, 1, 2, 5, 9):
            v = list(w)
            for _ in range(min(edits, len(v) - 1)):
                v[r.randrange(len(v))] = f"edit{r.randrange(10 ** 6)}"
            rows.append((i, " ".join(v)))
            i += r.choice((1, 3))
    shared = text(30)
    rows += [(i + k, text(r.randrange(5, 90)) + " " + shared + " " + text(r.randrange(5, 60))) for k in range(12)]
    r.shuffle(rows)
    return rows + [rows[5], (None, base[4]), (None, None), (rows[9][0], rows[9][1])]


def py_shingles(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = re.findall("[^\x20\x09-\x0D]+", low)
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def py_components(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    sets = [(i, py_shingles(t)) for i, t in rows if i is not None]
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_words_and_shingles():
    texts = ["Hello  World a b c d", None, "", "x y", "Ä ö\tü HELLO world a b c d", " lead", "a b c d e"]
    data, offs = T.flat(pa.array(texts))
    h, at = T.word_hashes(data, offs)
    assert np.diff(at).tolist() == [len(re.findall("[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert h[0] == h[at[4] + 3] and h[1] == h[at[4] + 4]
    s, to = T.shingles(h, at, 5)
    assert np.diff(to).tolist() == [2, 0, 0, 1, 5, 1, 1] and s[0] == s[to[4] + 3]
    assert [b.num_rows for b in T.pieces([pa.record_batch({"text": pa.array(texts)})], limit=8)][0] == 1


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 360)] + [(5, 5)]
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        if a != b:
            group = {x for x in root if root[x] in (root.get(a, a), root.get(b, b))} | {a, b}
            for x in group:
                root[x] = min(root.get(y, y) for y in group)
    assert got == root
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("rare,block", [(32, 2048), (1, 4)])
def test_jaccard_join(spark, rare, block):
    rows = edge_rows()
    classes, links = jaccard.join(table(spark, rows).repartition(5), rare=rare, block=block)
    got = classes.collect()
    want = py_components(rows)
    assert len(got) == len(rows)
    assert sorted((x["doc_id"] if x["doc_id"] is not None else -1, x["n_shingles"]) for x in got) == sorted((i if i is not None else -1, len(py_shingles(t))) for i, t in rows)
    assert {x["doc_id"]: x["component_id"] for x in got if x["doc_id"] is not None} == want
    assert all(x["component_id"] is None for x in got if x["doc_id"] is None)
    assert links.columns == ["a", "b", "shared"]
    empty, _ = jaccard.join(table(spark, []))
    assert empty.count() == 0


def test_one_of_each(spark):
    rows = edge_rows()
    want = py_components(rows)
    kept = jaccard.one_of_each(table(spark, rows))
    assert kept.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    assert sorted(x["doc_id"] for x in kept.filter("doc_id is not null").collect()) == sorted(i for i, c in want.items() if i == c)
    assert kept.filter("doc_id is null").count() == 2


def test_prefix_weight():
    """Any set of four tokens or more has signatures unless its own tokens suffice."""
    r = np.random.default_rng(2)
    for n in (4, 5, 7, 11, 40, 300):
        tokens = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        for df in (2, 1000):
            assert len(jaccard.signatures(tokens, np.full(len(tokens), df), tokens[:0], n))
        assert len(jaccard.signatures(tokens, np.ones(len(tokens)), tokens[:0], n)) == 0


def py_removed(rows, width):
    first = {}
    key = lambda i: 1 << 63 if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - width + 1):
            w = b[k:k + width]
            first[w] = min(first.get(w, 1 << 63), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if first[b[k:k + width]] < key(i):
                gone[k:k + width] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((-1 if i is None else i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_dedup(spark):
    rows = edge_rows(7) + [(900, "aaaa" * 60), (901, "b" + "aaaa" * 40), (902, "x" * 50), (903, "x" * 49), (904, "é" * 80), (905, "yé" + "é" * 30)]
    for batch in (1 << 16, 100):
        out = suffix.remove(table(spark, rows).repartition(4), batch=batch)
        got = sorted((-1 if x["doc_id"] is None else x["doc_id"], x["n_bytes"], x["n_removed"], len(x["starts"]), x["kept_sha256"]) for x in out.collect())
        assert got == py_removed(rows, 50)
    assert suffix.remove(table(spark, [])).count() == 0
    kept = suffix.without_repeats(table(spark, rows))
    assert kept.count() == len(rows) and kept.schema == table(spark, []).schema
    assert kept.filter("text is null").count() == sum(t is None for _, t in rows)


def test_family_levels_are_geometric():
    r = np.random.default_rng(3)
    family, seen = suffix.Family(), {}
    for batch in range(40):
        one = r.integers(0, 3000, 200)
        windows = np.stack([one % 7, one // 7 % 50, one // 350, np.zeros(200, int)], 1).astype(np.uint8)  # zero bytes inside and at the end
        ids = np.sort(r.integers(batch * 5, batch * 5 + 5, 200))
        found = family.scan(windows, ids)
        for w, i in zip(one.tolist(), ids.tolist(), strict=True):
            seen[w] = min(seen.get(w, i), i)
        assert found.tolist() == [seen[w] < i for w, i in zip(one.tolist(), ids.tolist(), strict=True)]
    assert all((x[1:] > x[:-1]).all() for x, _ in family.levels)  # in byte order, each suffix once
    sizes = [len(x[0]) for x in family.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False)) and len(sizes) <= 12


def py_words(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_decontamination(spark):
    r = random.Random(8)
    text = lambda n: " ".join(r.choice(["The", "of", "é", "rat", "Über", "42", "cat"]) + r.choice(["", str(r.randrange(30))]) for _ in range(n))
    items = [(0, text(40)), (1, text(13)), (2, text(7)), (3, "solo"), (4, "two words"), (5, None), (6, ""), (7, text(20)), (8, "..."), (None, text(15)), (1, "again " + text(14))]
    docs = [(k, text(r.randrange(1, 60))) for k in range(20)]
    docs += [(30 + k, text(20) + " " + " ".join((t or "").split()[:w]) + "! " + text(9)) for k, ((_, t), w) in enumerate((x, w) for x in items for w in (6, 13, 99))]
    docs += [(90, None), (91, ""), (92, "Solo"), (93, "solo, Two. Words"), (94, items[0][1]), (94, items[0][1]), (None, items[7][1]), (95, (items[2][1] + " ") * 700)]
    windows = {}
    for i, t in items:
        w = py_words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k:k + 13]), set()).update([str(i)] if i is not None else [])
    want = []
    for i, t in docs:
        w, hit, names = py_words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in windows:
                    hit |= set(range(k, k + size))
                    names |= windows[tuple(w[k:k + size])]
        want.append((-1 if i is None else i, len(w), len(hit), ",".join(sorted(names))))
    bench = spark.createDataFrame([(i, t, 1, "w") for i, t in items], "item_id long, text string, size int, words string")
    for rows in (500_000, 0):
        out = decontam.contamination(table(spark, docs), bench, broadcast_rows=rows).collect()
        assert sorted((-1 if x["doc_id"] is None else x["doc_id"], x["n_words"], x["n_hit"], ",".join(x["items"])) for x in out) == sorted(want)
    none = decontam.contamination(table(spark, docs), bench.limit(0)).collect()
    assert len(none) == len(docs) and all(x["n_hit"] == 0 for x in none)
    assert decontam.contamination(table(spark, []), bench).count() == 0
    clean = decontam.clean(table(spark, docs), bench)
    assert clean.count() == sum(not (h and 20 * h >= n) for _, n, h, _ in want) and clean.schema == table(spark, []).schema


def test_decontamination_is_native(spark):
    plan = decontam.contamination(table(spark, [(1, "a")]), spark.createDataFrame([(1, "a b")], "item_id long, text string"))
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", shown)
