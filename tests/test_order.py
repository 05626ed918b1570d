import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from texteval.operators import distribution as ds
from texteval.operators import order


def test_position_in_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot", x) for x in rng.sample(range(-500_000, 5_000_000), 3000)]
    rows += [(f"g{i % 7}", i * 1000) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, x long")
    got = order.with_position(df, ["k"], ["x"], order.integer_bucket(F.col("x")), "pos", total="n").collect()
    for k in {r.k for r in got}:
        xs = sorted(x for g, x in rows if g == k)
        assert {(r.x, r.pos, r.n) for r in got if r.k == k} == {(x, i + 1, len(xs)) for i, x in enumerate(xs)}


def test_prefix_sum_of_everything(spark):
    df = spark.range(1000).withColumn("w", F.col("id") % 5)
    got = order.prefix_sum(df, [], ["id"], order.integer_bucket(F.col("id"), 64), F.col("w"), "s").collect()
    assert all(r.s == sum(i % 5 for i in range(r.id)) for r in got)


def test_double_bucket_follows_the_order(spark):
    values = sorted([0.0, -0.0, 1e-300, -1e-300, 1e300, -1e300, *np.random.default_rng(0).normal(0, 5, 500)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    buckets = [r.b for r in df.select("v", order.double_bucket(F.col("v")).alias("b")).orderBy("v").collect()]
    assert buckets == sorted(buckets)


@pytest.mark.parametrize("n", [0, 1, 10, 299, 300, 1000])
def test_sample_has_exactly_n(spark, n):
    df = spark.range(300)
    got = [r.id for r in order.first_in_random_order(df, n, 42, "id").collect()]
    assert len(got) == len(set(got)) == min(n, 300)
    again = [r.id for r in order.first_in_random_order(df.repartition(7), n, 42, "id").collect()]
    assert sorted(got) == sorted(again)


def test_quantiles_agree_with_numpy(spark):
    rng = np.random.default_rng(3)
    groups = {
        "a": rng.normal(0, 1, 501), "b": np.round(rng.random(400), 1), "c": np.array([2.5]),
        "d": np.full(50, -1.0), "e": np.r_[rng.normal(0, 1e-6, 50), 1e6, -1e6],
    }
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, value double")
    ps = {"p0": 0.0, "q1": 0.25, "med": 0.5, "p99": 0.99, "p100": 1.0}
    for r in ds.group_quantiles(df, ["g"], ps).collect():
        for name, p in ps.items():
            assert r[name] == pytest.approx(np.quantile(groups[r.g], p), abs=1e-12, rel=1e-12)
