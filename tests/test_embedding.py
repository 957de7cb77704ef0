import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortile.operators import clustering as K
from cohortile.operators import features as E
from cohortile.operators import similarity as S
from cohortile.operators.bootstrap import draw_weights
from cohortile.plans.blocks import cut_blocks
from cohortile.plans.draws import hash_rank, order_hash
from cohortile.plans.gram import keyed_gram


def tiles(spark, x, y):
    rows = [("A", "s", i, i, 0, [float(v) for v in r]) for i, r in enumerate(x)] + [("B", "s", i, i, 0, [float(v) for v in r]) for i, r in enumerate(y)]
    return spark.createDataFrame(rows, "model string, slide_id string, tile_idx int, x int, y int, features array<double>")


def test_similarity_of_rotated_copies(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 4)) * [4, 2, 1, 0.5]
    q, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    r = S.pairwise_similarity(tiles(spark, x, x @ q + 3), ["A", "B"], ["all"], None, k=5).first()
    assert r.n == 80
    assert r.cka == pytest.approx(1) and r.svcca == pytest.approx(1) and r.knn == pytest.approx(1)
    assert r.procrustes == pytest.approx(0, abs=1e-6) and r.r2_x2y > 0.99 and r.r2_y2x > 0.99


def test_similarity_against_numpy(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 5)), rng.normal(size=(60, 3))
    y[:, 0] += x[:, 0]
    r = S.pairwise_similarity(tiles(spark, x, y), ["A", "B"], ["all"], None, k=4).first()
    xc, yc = x - x.mean(0), y - y.mean(0)
    fro = np.linalg.norm
    assert r.cka == pytest.approx(fro(xc.T @ yc) ** 2 / (fro(xc.T @ xc) * fro(yc.T @ yc)))
    ux, _, uy = np.linalg.svd(xc, full_matrices=False)[0], 0, np.linalg.svd(yc, full_matrices=False)[0]
    assert r.svcca == pytest.approx(np.linalg.svd(ux.T @ uy)[1].mean())
    _, _, vx = np.linalg.svd(xc, full_matrices=False)
    _, _, vy = np.linalg.svd(yc, full_matrices=False)
    xp, yp = (xc @ vx.T)[:, :3], yc @ vy.T
    u, _, vt = np.linalg.svd(xp.T @ yp)
    assert r.procrustes == pytest.approx(fro(xp @ (u @ vt) - yp) / fro(yp))
    w = np.linalg.solve(xc.T @ xc + np.eye(5), xc.T @ yc)
    assert r.r2_x2y == pytest.approx(1 - ((yc - xc @ w) ** 2).sum() / (yc**2).sum())

    def near(z):
        d = ((z[:, None] - z[None]) ** 2).sum(2)
        np.fill_diagonal(d, np.inf)
        return [set(np.argsort(row)[:4]) for row in d]
    jac = [len(a & b) / len(a | b) for a, b in zip(near(x), near(y))]
    assert r.knn == pytest.approx(np.mean(jac))


def test_blocks_do_not_change_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(70, 3)).round(2)
    x[:25] = x[0]  # a third of the rows are copies
    p = spark.createDataFrame([(1, f"{i:03d}", [float(v) for v in r], [float(v) for v in r[::-1]]) for i, r in enumerate(x)],
                              "k int, id string, fx array<double>, fy array<double>")
    a = S.nearest_in_spaces(p, ["k"], "id", ["fx", "fy"], 6, size=1000).toPandas()
    b = S.nearest_in_spaces(p, ["k"], "id", ["fx", "fy"], 6, size=16).toPandas()
    cols = ["id", "space", "neighbour", "d2"]
    key = lambda d: d.sort_values(cols, ignore_index=True)[cols]
    pd.testing.assert_frame_equal(key(a), key(b))
    assert len(a) == 70 * 2 * 6


def test_neighbours_equal_brute_force_and_few_blocks_meet(spark):
    """Clusters far apart: the same neighbours, and under a tenth of the pairs of blocks opened."""
    from cohortile.plans import neighbours as N
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(30, 6)) * 20)[np.arange(3000) % 30] + rng.normal(scale=0.3, size=(3000, 6))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, vec array<double>").withColumn("g", F.lit("a"))
    got = {}
    for r in N.nearest(df, ["g"], "id", 7, size=50).collect():
        got.setdefault(r.id, []).append((r.d2, r.neighbour))
    d = np.round(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T, 0), 9)
    np.fill_diagonal(d, np.inf)
    for i in range(0, 3000, 7):
        want = np.lexsort((np.arange(3000), d[i]))[:7]
        assert [n for _, n in sorted(got[i])] == want.tolist()
    made = N.blocks(df, ["g"], "id", 50, 7)
    n = made.filter("stat is not null").count()
    opened = N.open_pairs(made, ["g"]).count()
    assert n >= 60 and opened < n * (n - 1) / 2 / 10


def test_neighbours_travel_in_bundles(spark):
    """Distances that say nothing: all blocks meet, but a row is sent for a few bundles, not for every block."""
    from cohortile.plans import neighbours as N
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(size=(1990, 12)), np.repeat(rng.normal(size=(2, 12)), 5, axis=0)])  # two rows five times each
    df = spark.createDataFrame([("g", f"id{i}", [float(v) for v in r]) for i, r in enumerate(x)], "g string, id string, vec array<double>")
    made = N.blocks(df, ["g"], "id", 40, 6)
    bundled = N.bundles(made, ["g"], 40).collect()
    assert len(bundled) >= 50 and len({r.bundle for r in bundled}) <= len(bundled) / 4
    got = {}
    for r in N.nearest(df, ["g"], "id", 6, size=40).collect():
        got.setdefault(r.id, []).append((r.d2, r.neighbour))
    ids = np.array([f"id{i}" for i in range(2000)])
    d = np.round(((x[:, None] - x[None]) ** 2).sum(2), 9)
    np.fill_diagonal(d, np.inf)
    for i in [*range(0, 1990, 9), *range(1990, 2000)]:
        assert [n for _, n in sorted(got[ids[i]])] == ids[np.lexsort((ids, d[i]))[:6]].tolist()


def test_neighbours_of_small_and_null_groups(spark):
    from cohortile.plans import neighbours as N
    rows = [(None, 1, [0.0]), (None, 2, [1.0]), ("b", 3, [5.0]), ("c", 4, [1.0]), ("c", 5, [1.0]), ("c", 6, [1.0])]
    df = spark.createDataFrame(rows, "g string, id int, vec array<double>")
    got = sorted((r.g or "", r.id, r.neighbour, r.d2) for r in N.nearest(df, ["g"], "id", 2, size=2).collect())
    assert got == [("", 1, 2, 1.0), ("", 2, 1, 1.0), ("c", 4, 5, 0.0), ("c", 4, 6, 0.0), ("c", 5, 4, 0.0), ("c", 5, 6, 0.0), ("c", 6, 4, 0.0), ("c", 6, 5, 0.0)]
    assert N.nearest(df.limit(0), ["g"], "id", 2).count() == 0


def brute_silhouette(x, lab):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i in range(len(x)):
        own = lab == lab[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == k].mean() for k in set(lab) if k != lab[i])
        out.append((b - a) / max(a, b))
    return np.mean(out)


def test_silhouette(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (30, 3)), rng.normal(2, 1, (30, 3)), [[9, 9, 9]]])
    lab = np.array([0] * 30 + [1] * 30 + [2])
    rows = [("k", i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, lab))]
    df = spark.createDataFrame(rows, "k string, id int, f array<double>, lab int")
    for size in (1000, 9):
        assert K.silhouette(df, ["k"], "id", "f", "lab", rows=size).first().silhouette == pytest.approx(brute_silhouette(x, lab))
    assert K.silhouette(df.filter("lab = 0"), ["k"], "id", "f", "lab").first().silhouette is None
    w = df.withColumn("w", (F.col("id") % 3 + 1).cast("int"))
    rep = np.repeat(np.arange(61), np.arange(61) % 3 + 1)
    assert K.silhouette(w, ["k"], "id", "f", "lab", weight="w").first().silhouette == pytest.approx(brute_silhouette(x[rep], lab[rep]))
    g = K.silhouette_grouped(df.withColumn("t", F.when(F.col("lab") == 0, "MUS").when(F.col("lab") == 1, "TUM").otherwise("ADI")), ["k"], "id", "f", "t")
    assert g.first().silhouette == pytest.approx(brute_silhouette(x[:60], lab[:60]))


def test_centroid_measures(spark):
    rng = np.random.default_rng(4)
    x, lab = rng.normal(size=(40, 3)), np.arange(40) % 4
    df = spark.createDataFrame([("k", [float(v) for v in r], int(c)) for r, c in zip(x, lab)], "k string, f array<double>, lab int")
    c = np.array([x[lab == k].mean(0) for k in range(4)])
    s = np.array([np.linalg.norm(x[lab == k] - c[k], axis=1).mean() for k in range(4)])
    assert {r.lab: round(r.compactness, 9) for r in K.compactness(df, ["k"], "f", "lab").collect()} == {k: round(v, 9) for k, v in enumerate(s)}
    db = np.mean([max((s[i] + s[j]) / np.linalg.norm(c[i] - c[j]) for j in range(4) if j != i) for i in range(4)])
    assert K.davies_bouldin(df, ["k"], "f", "lab").first().davies_bouldin == pytest.approx(db)
    wide = K.compactness_wide(K.compactness(df, ["k"], "f", "lab"), ["k"], "lab", [0, 9]).first()
    assert wide["0_compactness"] == pytest.approx(s[0]) and wide["9_compactness"] is None


def test_pca_and_weighted_gram(spark):
    rng = np.random.default_rng(5)
    x, w = rng.normal(size=(50, 4)), rng.integers(1, 4, 50)
    df = spark.createDataFrame([("k", i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, w))], "k string, id int, f array<double>, w int").repartition(5)
    z = np.vstack(K.pca_project(df, ["k"], "f", 2, weight="w").orderBy("id").toPandas()["pcs"])
    rep = np.repeat(x, w, axis=0)
    _, _, v = np.linalg.svd(rep - rep.mean(0), full_matrices=False)
    want = (x - rep.mean(0)) @ v[:2].T
    assert np.allclose(np.abs(z), np.abs(want))
    assert keyed_gram(df, ["k"], "f", weight="w").filter("i = 0").first().row[0] == w.sum()


def test_gram_keeps_digits_under_a_large_mean(spark, monkeypatch):
    from cohortile.plans import gram as G
    rng = np.random.default_rng(10)
    x = 1e6 + rng.normal(size=(400, 12))
    df = spark.createDataFrame([(f"k{i % 2}", [float(v) for v in r]) for i, r in enumerate(x)], "k string, f array<double>").repartition(6)
    for stripe, beside_ in ((G.STRIPE, G.BESIDE), (12 * 8 * 3, 1)):  # one stripe; four stripes and rows sorted by key
        monkeypatch.setattr(G, "STRIPE", stripe)
        monkeypatch.setattr(G, "BESIDE", beside_)
        rows = G.keyed_gram(df, ["k"], "f").toPandas()
        for k, pdf in rows.groupby("k"):
            n, dx, mean, c = G.assemble(pdf)
            part = x[int(k[1])::2]
            assert (n, dx) == (200, 12) and np.allclose(mean, part.mean(0), rtol=0, atol=1e-8)
            assert np.allclose(c, np.cov(part.T) * 199, rtol=1e-6, atol=1e-6)


def test_components_of_many_keys_stay_off_the_driver(spark):
    rng = np.random.default_rng(11)
    df = spark.createDataFrame([(i % 40, i, [float(v) for v in rng.normal(size=3)]) for i in range(800)], "k int, id int, f array<double>")
    fitted = K.pca_fit(df, ["k"], "f", 2)
    assert fitted.columns == ["k", "mean", "components"] and fitted.count() == 40
    z = K.pca_project(df, ["k"], "f", 3).toPandas()
    raw = df.toPandas()
    for k, pdf in z.groupby("k"):
        p, x = np.vstack(pdf.sort_values("id")["pcs"]), np.vstack(raw[raw.k == k].sort_values("id")["f"])
        assert np.allclose(((p[:, None] - p[None]) ** 2).sum(2), ((x[:, None] - x[None]) ** 2).sum(2))  # all components: a rotation


def test_site_bias_and_consensus(spark):
    rng = np.random.default_rng(6)
    rows = [(m, f"s{i % 12}", "t", i, 0, i, int(i % 2), [float(v) for v in rng.normal(i % 2, 1, 4)]) for i in range(120) for m in ("A", "B")]
    df = spark.createDataFrame(rows, "model string, slide_id string, tissue string, x int, y int, tile_idx int, site int, features array<double>")
    b = K.institution_bias(df, 0.5, 5, n_iter=4, pca=2)
    got = b.collect()
    assert len(got) == 8 and all(r.n_labels == 2 and r.davies_bouldin > 0 for r in got)
    assert K.min_slides_filter(df, ["model"], "site", 7).count() == 0
    items = df.withColumn("item", F.concat_ws("|", "model", "x"))
    a = K.repeated_kmeans(items, "item", "features", [2], n_runs=4)
    lab = {}
    for r in a.collect():
        lab.setdefault(r.item, {})[r.run] = r.cluster
    ids = sorted(lab)
    tot = {}
    for i, p in enumerate(ids):
        for q in ids[i + 1:]:
            both = set(lab[p]) & set(lab[q])
            m = sum(lab[p][r] == lab[q][r] for r in both) / len(both) if both else 0.0
            k = tuple(sorted((p[0], q[0])))
            tot.setdefault(k, []).append(m)
    got = {(r.model1, r.model2): r.consensus for r in K.consensus_summary(a, items, "item", rows=50).collect()}
    missing = 240 - len(ids)
    assert missing == 0 and got == pytest.approx({k: np.mean(v) for k, v in tot.items()})


def test_cluster_sampling(spark):
    counts = spark.createDataFrame([("a", 0, 50), ("a", 1, 30), ("a", 2, 20), ("b", 0, 97), ("b", 1, 1), ("b", 2, 1), ("b", 3, 1), ("c", 0, 33), ("c", 1, 33), ("c", 2, 34)], "g string, c int, n int")
    quota = {}
    for r in K.cluster_quota(counts, "g", "c", 0.1).orderBy("g", "c").collect():
        quota.setdefault(r.g, []).append(r.quota)
    # one row is moved per cluster, so b keeps one row too many
    assert quota == {"a": [5, 3, 2], "b": [8, 1, 1, 1], "c": [4, 3, 3]}
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(f"s{i % 2}", i, [float(v) for v in rng.normal(size=2)]) for i in range(80)], "slide_id string, tile_idx int, features array<double>")
    got = K.local_cluster_sample(df, 4, 0.25)
    n = {r.slide_id: r["count"] for r in got.groupBy("slide_id").count().collect()}
    assert set(n) == {"s0", "s1"} and all(9 <= v <= 11 for v in n.values())
    assigned, cents = K.keyed_kmeans(got, [], "tile_idx", "features", 3)
    assert assigned.count() == got.count() and cents.count() == 3


def brute_kmeans(rows, k, seed):
    """rows: [(id, vector)]; the same rule in plain numpy."""
    import hashlib
    start = sorted(rows, key=lambda r: (hashlib.md5(f"{r[0]}|{seed}".encode()).hexdigest(), r[0]))[:k]
    x, c = np.array([v for _, v in rows]), np.array([v for _, v in start])
    while True:
        lab = np.round(((x[:, None] - c[None]) ** 2).sum(2), 9).argmin(1)
        new = np.array([x[lab == j].mean(0) if (lab == j).any() else c[j] for j in range(len(c))])
        if np.allclose(new, c, rtol=0, atol=0):
            return {i: int(a) for (i, _), a in zip(rows, lab)}
        c = new


@pytest.mark.parametrize("numbers", [10**6, 40])
def test_keyed_kmeans_equals_brute_force(spark, monkeypatch, numbers):
    """Keys settled by one task and keys of many parts; k per key; a key smaller than k; a null key."""
    monkeypatch.setattr(K, "packed_parts", lambda r, keys, ids, f, n=numbers, real=K.packed_parts: real(r, keys, ids, f, n))
    rng = np.random.default_rng(13)
    data = [(g, k, i, [float(v) for v in rng.normal(size=3).round(3)]) for g, k, n in (("a", 4, 150), ("b", 2, 60), ("tiny", 5, 3), (None, 3, 40)) for i in range(n)]
    df = spark.createDataFrame(data, "g string, k int, id int, f array<double>")
    assigned, cents = K.keyed_kmeans(df, ["g", "k"], "id", "f", "k", 7)
    got = {}
    for r in assigned.collect():
        got.setdefault((r.g, r.k), {})[r.id] = r.cluster
    for g, k in {(d[0], d[1]) for d in data}:
        assert got[g, k] == brute_kmeans([(d[2], d[3]) for d in data if d[0] == g], k, 7)
    assert {(r.g, r["count"]) for r in cents.groupBy("g").count().collect()} == {("a", 4), ("b", 2), ("tiny", 3), (None, 3)}
    assert K.keyed_kmeans(df.limit(0), ["g", "k"], "id", "f", "k", 7)[0].count() == 0


@pytest.mark.parametrize("most", [None, 9])
def test_greedy_rounds_equal_the_sequential_rule(spark, most):
    """Random correlations of 60 features, tied p-values, two keys: one task, rounds of joins and the plain loop agree."""
    rng = np.random.default_rng(12)
    pv, cr, want = [], [], {}
    for key in ("a", None):
        c = np.abs(rng.uniform(-1, 1, (60, 60))) ** 0.5
        c = np.triu(c, 1) + np.triu(c, 1).T + np.eye(60)
        c[7], c[:, 7] = np.nan, np.nan
        p = rng.integers(0, 25, 60) / 25.0
        pv += [(key, i, float(p[i])) for i in range(60) if i != 3]
        cr += [(key, i, [None if np.isnan(v) else float(v) for v in c[i]]) for i in range(60)]
        for t in (0.0, 0.5, 0.9, 1.0):
            alive, got = [i for i in sorted(range(60), key=lambda i: (p[i], i)) if i != 3], []
            while alive and (most is None or len(got) < most):
                got.append(alive[0])
                alive = [j for j in alive[1:] if not c[got[-1], j] > t]
            want[key, t] = set(got)
    pvals, corr = spark.createDataFrame(pv, "k string, feature int, p_value double"), spark.createDataFrame(cr, "k string, feature int, corr array<double>")
    for task_edges in (10**6, 1000, 0):
        got = {}
        for r in E.greedy_uncorrelated(pvals, corr, ["k"], [0.0, 0.5, 0.9, 1.0], most, task_edges).collect():
            got.setdefault((r.k, r.threshold), set()).add(r.feature)
        assert got == want, task_edges
    own = pvals.withColumn("t", F.lit(0.5))
    got = {}
    for r in E.greedy_uncorrelated(own, corr.withColumn("t", F.lit(0.5)), ["k", "t"], "t", most).collect():
        got.setdefault(r.k, set()).add(r.feature)
    assert got == {k: want[k, 0.5] for k in ("a", None)}


def feature_table(spark, n=60):
    rng = np.random.default_rng(8)
    a, b, c = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    cls = np.where(np.arange(n) % 2 == 0, 1, -1)
    a = a + cls
    x = np.column_stack([a, 2 * a, -a, b, np.full(n, 3.0), c])
    rows = [("k", i, [float(v) for v in r], int(k)) for i, (r, k) in enumerate(zip(x, cls))]
    rows[5] = ("k", 5, [*rows[5][2][:5], None], rows[5][3])
    return x, cls, spark.createDataFrame(rows, "k string, id int, f array<double>, cls int")


def test_feature_selection(spark):
    x, cls, df = feature_table(spark)
    counts = E.value_counts(df, ["k"], "f", "cls")
    assert sorted(r.feature for r in E.column_filter(counts, ["k"]).collect()) == [0, 1, 2, 3]
    t = {r.feature: r.statistic for r in E.t_statistics(df.filter("id <> 5"), ["k"], "f", "cls").collect()}
    keep = np.arange(60) != 5
    p, q = x[keep & (cls == 1), 3], x[keep & (cls == -1), 3]
    sp = np.sqrt(((len(p) - 1) * p.var(ddof=1) + (len(q) - 1) * q.var(ddof=1)) / (len(p) + len(q) - 2))
    assert t[3] == pytest.approx((p.mean() - q.mean()) / (sp * np.sqrt(1 / len(p) + 1 / len(q)))) and t[4] is None
    for method in ("spearman", "pearson"):
        gap = {r.feature for r in E.select_features(df, ["k"], "id", "f", "cls", [1.0], method).collect()}
        assert gap == ({0, 1, 2, 3, 4} if method == "spearman" else {0, 1, 2, 3})  # 5 has a null; the constant 4 has no t
        nan = df.withColumn("f", F.transform("f", lambda v, i: F.when((i == 1) & (F.col("id") == 7), F.lit(float("nan"))).otherwise(v)))
        assert {r.feature for r in E.select_features(nan, ["k"], "id", "f", "cls", [1.0], method).collect()} - {4} == {0, 2, 3}
        sel = E.select_features(df.withColumn("f", F.transform("f", lambda v: F.coalesce(v, F.lit(0.0)))), ["k"], "id", "f", "cls", [0.6, 1.0], method, quality_filter=True)
        got = {}
        for r in sel.collect():
            got.setdefault(r.threshold, []).append(r.feature)
        assert len(set(got[0.6]) & {0, 1, 2}) == 1 and 3 in got[0.6] and 4 not in got[0.6]
        assert len(got[1.0]) == 5  # nothing is strictly above 1
    corr = {r.feature: r["corr"] for r in E.abs_correlation(df.filter("id <> 5"), ["k"], "id", "f", "pearson").collect()}
    assert corr[0][1] == pytest.approx(1) and corr[0][4] is None
    assert corr[0][3] == pytest.approx(abs(np.corrcoef(x[keep, 0], x[keep, 3])[0, 1]))
    for wrong in ({"thresholds": [1.5]}, {"thresholds": [0.5], "method": "kendall"}):
        with pytest.raises(ValueError):
            E.select_features(df, ["k"], "id", "f", "cls", **wrong)
    with pytest.raises(Exception, match="class labels must be"):
        E.check_classes(df.withColumn("cls", F.lit(0)), "cls").collect()


def test_two_stage_prune(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 3))
    rows = []
    for i in range(60):
        cls = 1 if i % 2 else -1
        v = [float(z) for z in base[i] + cls]
        rows.append(("A", f"s{i % 2}", i, i, 0, v))
        rows.append(("B", f"s{i % 2}", i, i, 0, [v[0] * 2, float(rng.normal())]))
    t = spark.createDataFrame(rows, "model string, slide_id string, tile_idx int, x int, y int, features array<double>")
    labels = spark.createDataFrame([("s0", -1), ("s1", 1)], "slide_id string, class int")
    src, report, _ = E.two_stage_prune(t, labels, [0.9])
    got = {(r.model, r.feature_index) for r in src.collect()}
    assert len(got & {("A", 0), ("B", 0)}) == 1 and ("B", 1) in got
    rep = {r.model: (r.removed_stage1, r.removed_stage2) for r in report.collect()}
    assert sum(a + b for a, b in rep.values()) == 5 - len(got)
    out = E.apply_pruning(t, src)
    assert out.count() == 60 and out.select(F.size("features")).distinct().first()[0] == len(got)


def test_importance(spark):
    src = spark.createDataFrame([("d1", .6, 0, "a", 1), ("d1", .6, 1, "b", 0), ("d2", .6, 0, "a", 1), ("d2", .6, 1, "b", 3)],
                                "disease string, threshold double, pos int, model string, feature_index int")
    idx = E.unified_feature_index(src, ["b", "a"], {"a": 10})
    assert {r.model: (r.dim, r.offset) for r in idx.collect()} == {"b": (4, 0), "a": (10, 4)}
    uni = E.unified_sources(src, idx)
    assert [r.idx for r in E.common_features(uni, 2).collect()] == [5]
    val = spark.createDataFrame([("d1", .6, "s1", [1.0, -2.0]), ("d1", .6, "s1", [3.0, 0.0]), ("d1", .6, "s2", [-6.0, 0.0])],
                                "disease string, threshold double, slide_id string, values array<double>")
    imp = {(r.disease, r.idx): r.importance for r in E.mean_abs_attribution(val, uni).collect()}
    assert imp[("d1", 5)] == 4.0 and imp[("d1", 0)] == 0.5 and imp[("d2", 3)] == 0.0
    g = {r.pos: r.importance for r in E.global_importance(val, ["disease"]).collect()}
    assert g == pytest.approx({0: 10 / 3, 1: 2 / 3})
    wide = spark.createDataFrame([("0.2", 1, 3), ("OG Features", 4, 4)], "Threshold string, a int, b int")
    assert {r.model: (r.model_pct, r.total_pct) for r in E.pruning_percentages(wide, ["a", "b"]).collect()} == {"a": (25.0, 50.0), "b": (75.0, 50.0)}
    with pytest.raises(Exception, match="is missing"):
        E.pruning_percentages(wide.filter("Threshold = '0.2'"), ["a", "b"]).collect()


def test_draws_share_distances(spark):
    """One pass over all draws gives the silhouette of every draw worked out alone."""
    rng = np.random.default_rng(11)
    rows = [("A" if i % 3 else None, i, f"l{i % 4}", [float(v) for v in rng.normal(i % 4, 2, 3)],
             [(j, int(w)) for j, w in enumerate(rng.integers(0, 3, 5)) if w and (j < 4 or i % 4 < 2)]) for i in range(150)]
    df = spark.createDataFrame(rows, "g string, id int, lab string, f array<double>, draws array<struct<iter:int,weight:int>>")
    one = df.select("g", "id", "lab", "f", F.explode("draws").alias("d")).select("g", "id", "lab", "f", "d.iter", "d.weight").fillna("none", ["g"])
    want = {(r.g, r.iter): r.silhouette for r in K.silhouette(one, ["g", "iter"], "id", "f", "lab", "weight").collect()}
    for rows_ in (1024, 20):  # one block, several blocks
        got = {(r.g or "none", r.iter): r.silhouette for r in K.silhouette_draws(df, ["g"], "id", "f", "lab", "draws", 5, rows=rows_).collect()}
        assert len(want) == 10 and got == pytest.approx(want)


@pytest.mark.parametrize("most", [10**6, 15])
def test_draws_with_components_travel_as_rows(spark, monkeypatch, most):
    """Components of every draw: metrics as worked out draw by draw, and no table of one row per row and draw."""
    monkeypatch.setattr(K, "silhouette_projected", lambda *a, real=K.silhouette_projected: real(*a, most=most))
    monkeypatch.setattr(K, "TILE", 16)
    written = []
    monkeypatch.setattr(K, "durable", lambda df, real=K.durable: written.append(real(df)) or written[-1])
    rng = np.random.default_rng(17)
    rows = [(m, "t" if i % 3 else None, f"i{i}", int(i % 4) if i < 170 else 7, [float(v) for v in rng.normal(i % 4, 2, 5)]) for m in ("A", "B") for i in range(171)]
    df = spark.createDataFrame(rows, "model string, tissue string, id string, site int, f array<double>").fillna("u", ["tissue"])
    got = {(r.model, r.tissue, r.iter): r for r in K.bootstrap_cluster_metrics(df, ["model", "tissue"], "id", "f", "site", 6, 0.5, 3, within=["tissue"]).collect()}
    assert len(got) == 24 and max(t.count() for t in written) <= len(rows)
    drawn = {}
    for r in draw_weights(df, "id", 6, 0.5, 42, ["tissue"]).collect():
        for d in r.draws:
            drawn.setdefault((r.tissue, d.iter), []).extend([r.id] * d.weight)
    known = {(r.model, r.id): r for r in df.collect()}
    for (model, tissue, it), r in got.items():
        picked = [known[model, i] for i in drawn[tissue, it]]
        x, lab = np.array([p.f for p in picked]), np.array([p.site for p in picked])
        c = x - x.mean(0)
        z = c @ np.linalg.eigh(c.T @ c)[1][:, ::-1][:, :3]
        own = sorted(set(lab))
        cent = np.array([z[lab == k].mean(0) for k in own])
        tight = np.array([np.sqrt(((z[lab == k] - m) ** 2).sum(1)).mean() for k, m in zip(own, cent, strict=True)])
        assert r.n_rows == len(z) and r.n_labels == len(own) and r.silhouette == pytest.approx(brute_silhouette(z, lab))
        assert r.compactness == pytest.approx({str(k): v for k, v in zip(own, tight, strict=True)})
        far = np.sqrt(((cent[:, None] - cent[None]) ** 2).sum(2)) + np.diag([np.inf] * len(own))
        assert r.davies_bouldin == pytest.approx(((tight[:, None] + tight[None]) / far).max(1).mean())


def test_sums_of_draws_travel_once(spark, monkeypatch):
    """A key of 153,846 rows (615,384 vectors have four) is one block: its sums are sent once; a larger key is cut."""
    monkeypatch.setattr(K, "_score_draws", lambda met, sizes, *a: sizes)
    key = F.when(F.col("id") < 153_846, "a").otherwise("b").alias("model")
    df = spark.range(153_846 + 300_000).select(key, "id", (F.col("id") % 5).alias("site"), F.array_repeat(F.lit(1.0).cast("float"), 32).alias("f"), F.array(F.lit(1), F.lit(1)).alias("w"))
    fitted = spark.createDataFrame([], "model string, iter int, mean array<double>, components array<array<double>>")
    sizes = K.silhouette_projected(df, ["model"], "id", "f", "site", "w", 2, fitted)
    assert {r.model: r.last for r in sizes.groupBy("model").agg(F.max("_block").alias("last")).collect()} == {"a": 0, "b": 1}


def test_centroids_of_draws_are_added_up_first(spark, monkeypatch):
    """Centroids of draws equal those of the drawn rows; a task passes on a row per key, label and draw, not per drawn row."""
    rng = np.random.default_rng(19)
    rows = [(None if i % 5 == 0 else "a", i % 3 or None, [float(v) for v in 1e6 + rng.normal(size=3)], [int(v) for v in rng.poisson(0.5, 4)]) for i in range(400)]
    df = spark.createDataFrame(rows, "model string, site int, f array<double>, w array<int>").coalesce(2)
    passed = []
    monkeypatch.setattr(K, "centroids", lambda d, *a, real=K.centroids: passed.append(d.count()) or real(d, *a))
    got = {(r.model, r.site, r.iter): r for r in K.draw_centroids(df, ["model"], "f", "site", "w").collect()}
    want = {}
    for model, site, f, w in rows:
        for it, v in enumerate(w):
            want.setdefault((model, site, it), []).extend([f] * v)
    assert passed[0] <= 2 * len(got) == 48 and got.keys() == want.keys()
    for k, r in got.items():
        assert r.n == len(want[k]) and r.centroid == pytest.approx(np.mean(want[k], 0), abs=1e-8, rel=0)


def test_many_groups_are_not_cut_small(spark):
    """A row is sent once per block: groups that keep all tasks busy together stay whole."""
    df = spark.range(40 * 200).select((F.col("id") % 40).alias("g"), "id", F.array(F.lit(1.0)).alias("f"))
    assert cut_blocks(df, ["g"], "id", "f", rows=10).agg(F.max("_blocks")).first()[0] == 1
    assert cut_blocks(df.withColumn("g", F.lit(0)), ["g"], "id", "f", rows=10).agg(F.max("_blocks")).first()[0] > 1
    assert cut_blocks(df, ["g"], "id", "f", rows=10, most=50).agg(F.min("_blocks")).first()[0] == 4


def test_runs_share_rows(spark):
    """Subsamples of one table: the rows of smallest hash in every run, clustered as if each run were a table of its own."""
    rng = np.random.default_rng(12)
    df = spark.createDataFrame([(f"i{i}", [float(v) for v in rng.normal(3 * (i % 3), 1, 2)]) for i in range(90)], "item string, f array<double>")
    runs = df.withColumn("run", F.explode(F.array(*[F.lit(r) for r in range(3)]))).withColumn("_h", order_hash("item", "run", 0))
    drawn = hash_rank(runs, ["run"], "_h", ["item"], "_pos").filter("_pos < 72").withColumn("k", F.explode(F.array(F.lit(2), F.lit(3)))).drop("_h", "_pos")
    alone, _ = K.keyed_kmeans(drawn, ["k", "run"], "item", "f", "k", 0)
    want = {(r.k, r.run, r.item): r.cluster for r in alone.collect()}
    got = {(r.k, r.run, r.item): r.cluster for r in K.repeated_kmeans(df, "item", "f", [2, 3], n_runs=3).collect()}
    assert len(got) == 2 * 3 * 72 and got == want
    models = df.select("item", F.when(F.substring("item", -1, 1) < "5", "A").otherwise("B").alias("model"))
    a = spark.createDataFrame([(*k, c) for k, c in want.items()], "k int, run int, item string, cluster int")
    keys = ["k", "model1", "model2"]
    one, two = (K.consensus_summary(a, models, "item", ["k"], rows=20, pattern_runs=n).orderBy(*keys).collect() for n in (20, 0))
    assert len(one) == 6 and [r[:3] + r[4:] for r in one] == [r[:3] + r[4:] for r in two]
    assert [r.consensus for r in one] == pytest.approx([r.consensus for r in two], abs=1e-7)


def test_few_runs_need_no_pairs(spark):
    a = spark.range(200).select(F.col("id").cast("string").alias("item"), F.lit(0).alias("run"), (F.col("id") % 2).cast("int").alias("cluster"))
    out = K.consensus_summary(a, a.select("item", F.lit("A").alias("model")), "item")
    assert "FlatMapCoGroupsInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.first().consensus == pytest.approx(2 * 100 * 99 / (200 * 199))


def test_listed_runs_meet_in_tiles(spark, monkeypatch):
    """Runs as one list a row give what a row per run gives, and pairs in tiles and parts of the runs what pairs one by one give."""
    rng = np.random.default_rng(21)
    df = spark.createDataFrame([(f"i{i}", "AB"[i % 2], [float(v) for v in rng.normal(i % 3, 1, 2)]) for i in range(60)], "item string, model string, f array<double>")
    long = K.repeated_kmeans(df, "item", "f", [2, 3], n_runs=21)
    lists = K.repeated_kmeans(df, "item", "f", [2, 3], n_runs=21, listed=True)
    want = {}
    for r in long.collect():
        want.setdefault((r.k, r.item), {})[r.run] = r.cluster
    assert {(r.k, r.item): {i: c - 1 for i, c in enumerate(r.clusters) if c} for r in lists.collect()} == want
    keys = ["k", "model1", "model2"]
    one, two = (K.consensus_summary(a, df, "item", ["k"], rows=30).orderBy(*keys) for a in (long, lists))
    assert "map_from_entries" not in one._jdf.queryExecution().toString()  # searched once a run, for every run
    one, two, model = one.collect(), two.collect(), {r.item: r.model for r in df.collect()}
    pairs = {}
    for k, p in want:
        for j, q in want:
            if j == k and p < q:
                both = [c == want[k, q][r] for r, c in want[k, p].items() if r in want[k, q]]
                pairs.setdefault((k, *sorted((model[p], model[q]))), []).append(sum(both) / max(1, len(both)))
    assert one == two and {(r.k, r.model1, r.model2): r.consensus for r in two} == pytest.approx({k: np.mean(v) for k, v in pairs.items()}, abs=1e-6)
    assert {(r.k, r.model1, r.model2): r.pairs for r in two} == {k: len(v) for k, v in pairs.items()}
    for runs, k in ((1, 2), (100, 4), (255, 3), (600, 3)):
        monkeypatch.setattr(K, "SHARES", 16), monkeypatch.setattr(K, "HELD", 1)
        a, b = (rng.integers(0, k + 1, (n, runs)).astype(np.uint8) for n in (75, 41))
        a[3], b[:2] = 0, k
        ma, mb = np.eye(3, dtype="f4")[rng.integers(0, 3, 75)], np.eye(2, dtype="f4")[rng.integers(0, 2, 41)]
        share = lambda x, y: ((x[:, None] == y[None]) & (x[:, None] > 0)).sum(2) / np.maximum(((x[:, None] > 0) & (y[None] > 0)).sum(2), 1)
        assert K._shared(a, b, ma, mb, k) == pytest.approx(ma.T @ share(a, b) @ mb, rel=1e-6)
        own = share(a, a)
        np.fill_diagonal(own, 0)
        assert K._shared(a, None, ma, ma, k) == pytest.approx(ma.T @ own @ ma, rel=1e-6)


def test_nearest_of_all_runs_keeps_ties():
    """The nearest centroids of many runs are those of each run alone, the first on ties up to the ninth digit."""
    rng = np.random.default_rng(22)
    x = np.vstack([rng.integers(0, 3, (300, 2)).astype(float), rng.normal(size=(300, 2)), 1e6 + rng.normal(size=(50, 2))])
    c = np.stack([np.round(rng.normal(1, 1, (4, 2))), rng.normal(size=(4, 2)), np.ones((4, 2)), np.array([[0, 0], [2, 0], [0, 2], [2 + 1e-11, 2]])], 1)
    hot = K._nearest_of(x, c)
    assert (hot.sum(1) == 1).all()
    for run in range(c.shape[1]):
        assert (hot[:, :, run].argmax(1) == K._near(x, c[:, run])[0]).all()


def test_draws_meet_their_key_in_one_task(spark):
    """Sums of a row are sent once per part of its key, not once per block; blocks and parts give the silhouettes of each draw alone."""
    rng = np.random.default_rng(23)
    rows = [("A" if i % 3 else None, f"t{i}", None if i % 11 == 0 else f"l{i % 4}", [float(v) for v in rng.normal(i % 4, 2, 2)],
             [(j, int(w)) for j, w in enumerate(np.r_[rng.poisson(0.7, 4), 300 * (i == 5)]) if w]) for i in range(180)]
    df = spark.createDataFrame(rows, "g string, id string, lab string, f array<double>, draws array<struct<iter:int,weight:int>>")
    alone = df.withColumn("lab", F.coalesce("lab", F.lit("none"))).select("g", "id", "lab", "f", F.explode("draws").alias("d")).select("g", "id", "lab", "f", "d.iter", "d.weight").fillna("none", ["g"])
    want = {}
    for (g, it), p in alone.toPandas().groupby(["g", "iter"]):
        x, w, lab = np.vstack(p["f"]), p["weight"].to_numpy(float), p["lab"].to_numpy()
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        d[p["id"].to_numpy()[:, None] == p["id"].to_numpy()[None]] = 0
        n = {v: w[lab == v].sum() for v in set(lab)}
        s = []
        for i in range(len(p)):
            a = (d[i] * w)[lab == lab[i]].sum() / max(1, n[lab[i]] - 1)
            b = min([(d[i] * w)[lab == v].sum() / m for v, m in n.items() if v != lab[i]], default=np.inf)
            s.append(0.0 if n[lab[i]] <= 1 or np.isinf(b) else (b - a) / max(a, b))
        want[g, it] = (np.array(s) * w).sum() / w.sum()
    for kw in ({}, {"rows": 20, "most": 20}, {"rows": 20, "most": 20, "bundle": 100}):
        got = K.silhouette_draws(df, ["g"], "id", "f", "lab", "draws", 5, **kw)
        assert {(r.g or "none", r.iter): r.silhouette for r in got.filter("silhouette is not null").collect()} == pytest.approx(want)


def test_bias_metrics_are_worked_out_once(spark, tmp_path):
    """The tests between models read the metrics of all draws from a table."""
    seen = spark.sparkContext.accumulator(0)

    def count(v):
        seen.add(1)
        return v
    rows = [(m, "t", i, float(i + (m == "B")), 1.0, {"a": float(i)}) for m in "AB" for i in range(6)]
    df = spark.createDataFrame(rows, "model string, tissue string, iter int, silhouette double, davies_bouldin double, compactness map<string,double>")
    out = K.bias_comparison(df.withColumn("silhouette", F.udf(count, "double")("silhouette"))).collect()
    assert len(out) == 3 and seen.value == len(rows)
