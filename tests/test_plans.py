import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortile.functions import pvalues as P
from cohortile.plans.draws import hash_rank, hash_take, order_hash
from cohortile.plans.ordered import average_ranks, exact_percentiles, running_sums, scan


@pytest.fixture(params=["merged", "many"])
def ranges(request, spark):
    """Small ranges merged into one by adaptive execution, or all left apart."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, request.param == "merged")
    yield request.param
    spark.conf.unset(key)


def skewed(spark):
    """Two thirds of the rows under one key, one third of those one value."""
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 else "cold", float(5 if i % 9 == 1 else rng.integers(0, 400))) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "k string, v double")


def test_ranks_and_percentiles_agree_with_numpy(spark, ranges):
    rows, df = skewed(spark)
    ranks = {(r.k, r.v): (r.rank, r.size) for r in average_ranks(df, ["k"], "v", size="size").collect()}
    pct = {r.k: r.pct for r in exact_percentiles(df, ["k"], "v", [0.025, 0.5, 0.9]).collect()}
    for k in ("hot", "cold"):
        v = np.array([b for a, b in rows if a == k])
        order = np.sort(v)
        for x in np.unique(v):
            lo, hi = np.searchsorted(order, x, "left"), np.searchsorted(order, x, "right")
            assert ranks[(k, x)] == ((lo + 1 + hi) / 2, len(v))
        assert pct[k] == pytest.approx(np.percentile(v, [2.5, 50, 90]))


def test_running_sums_and_totals(spark, ranges):
    df = spark.createDataFrame([("a", 1, 2), ("a", 2, 3), ("b", 9, 4)], "k string, v int, c int")
    got = {(r.k, r.v): (r.below, r.all) for r in running_sums(df, ["k"], "v", {"c": "below"}, {"c": "all"}).collect()}
    assert got == {("a", 1): (0, 5), ("a", 2): (2, 5), ("b", 9): (0, 4)}


def test_scan_of_a_hot_group_uses_every_range(spark, ranges):
    n = 5000
    df = spark.range(n).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") * 7919 % n).alias("v"), F.lit(2).alias("c"))
    out = scan(df, ["k"], ["v"], {"c": "below"}, {"c": "all"}, {"c": "to"})
    got = {r.v: (r.below, r.all, r.to) for r in out.filter("k = 'hot'").collect()}
    assert [got[v] for v in sorted(got)] == [(2 * i, 9000, 2 * i + 2) for i in range(4500)]
    assert out.filter("k != 'hot' and (below != 0 or `all` != 2)").count() == 0
    plain = scan(df, [], ["v"], {"c": "below"})  # no key: one order over all rows
    assert {(r.v, r.below) for r in plain.collect()} == {(i, 2 * i) for i in range(n)}
    if ranges == "many":
        parts = df.repartitionByRange("k", "v").withColumn("p", F.spark_partition_id()).filter("k = 'hot'").groupBy("p").count().collect()
        assert len(parts) > 1 and max(r["count"] for r in parts) < n / 2


def test_scan_of_an_empty_table(spark, ranges):
    assert scan(spark.range(0).select(F.lit("a").alias("k"), "id", F.lit(1).alias("c")), ["k"], ["id"], {"c": "n"}).collect() == []


def test_null_keys_are_a_group(spark, ranges):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 5)], "k string, v int")
    assert sorted(r["rank"] for r in average_ranks(df, ["k"], "v").collect()) == [1, 1, 2]
    assert hash_take(df, ["k"], ["v"], ["v"], 1).count() == 2


def test_hash_rank_is_dense_and_ignores_partitioning(spark):
    df = spark.range(2000).select((F.col("id") % 3 == 0).cast("int").alias("k"), "id")
    def ranks(d):
        return {(r.k, r.id): r["rank"] for r in hash_rank(d.withColumn("h", order_hash("id", 7)), ["k"], "h", ["id"]).collect()}
    a, b = ranks(df.repartition(1)), ranks(df.repartition(13))
    assert a == b
    for k in (0, 1):
        got = sorted(v for (kk, _), v in a.items() if kk == k)
        assert got == list(range(len(got)))
    for cut in (3, 500):  # 65536 runs; runs for the larger group only
        rows = hash_rank(df.withColumn("h", order_hash("id", 7)), ["k"], "h", ["id"], size="n", run_rows=cut).collect()
        assert {(r.k, r.id): r["rank"] for r in rows} == a
        assert {(r.k, r.n) for r in rows} == {(0, 1333), (1, 667)}


def test_hash_take_sizes(spark):
    df = spark.range(1000).select((F.col("id") % 4).alias("k"), "id")
    got = hash_take(df, ["k"], ["id", 1], ["id"], lambda n: F.greatest(F.lit(1), F.floor(n * 0.1)))
    assert [r["count"] for r in got.groupBy("k").count().collect()] == [25] * 4
    assert hash_take(df, [], ["id", 1], ["id"], 17).distinct().count() == 17


def test_first_by_hash_equals_the_full_order(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("k"), "id")
    whole = {}
    for r in hash_rank(df.withColumn("h", order_hash("id", 5)), ["k"], "h", ["id"]).collect():
        whole.setdefault(r.k, []).append((r["rank"], r.id))
    for n in (7, 1500, 5000):  # by window; by a bound on the hash; more than there are
        got = {}
        for r in hash_take(df, ["k"], ["id", 5], ["id"], n).collect():
            got.setdefault(r.k, set()).add(r.id)
        assert got == {k: {i for _, i in sorted(v)[:n]} for k, v in whole.items()}
    plans = [hash_take(df, k, ["id", 5], ["id"], 100)._jdf.queryExecution().executedPlan().toString() for k in ([], ["k"])]
    assert "TakeOrderedAndProject" in plans[0] and "WindowGroupLimit" in plans[1]
    everyone = sorted(i for v in whole.values() for _, i in v)
    assert {r.id for r in hash_take(df, [], ["id", 5], ["id"], 100).collect()} == {r.id for r in df.orderBy(order_hash("id", 5), "id").limit(100).collect()} <= set(everyone)
    assert hash_take(df.limit(0), [], ["id", 5], ["id"], 2000).count() == 0


def test_pvalues():
    assert P.t_two_sided(2.0, 10) == pytest.approx(0.0733880348, abs=1e-9)
    for t, nu in ((0.5, 49), (1.7, 3), (3.2, 120.5)):  # against the integrated density
        x = np.linspace(0, t, 200001)
        c = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi)
        inside = 2 * np.trapezoid(c * (1 + x * x / nu) ** (-(nu + 1) / 2), x)
        assert P.t_two_sided(t, nu) == pytest.approx(1 - inside, abs=1e-9)
    assert P.z_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-9)
    assert P.signed_rank_exact(0, 5) == pytest.approx(0.0625)
    assert P.signed_rank_exact(8, 10) == pytest.approx(0.048828125)
    assert P.rank_sum_exact(0, 3, 3) == pytest.approx(0.1)
    assert P.rank_sum_exact(9, 3, 3) == pytest.approx(0.1)
    assert P.rank_sum_exact(4, 4, 4) == pytest.approx(0.342857142857)
