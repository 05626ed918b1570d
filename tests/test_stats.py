import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from texteval.functions import special
from texteval.operators import joins, stats, summary, windows

CELL = ["dataset", "metric"]


def paired(spark, matrix):
    rows = [("d", "m", i, f"m{j}", j, float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "dataset string, metric string, item_id long, model string, ord long, value double")


def ranks(row):
    return [sum(x < v for x in row) + (sum(x == v for x in row) + 1) / 2 for v in row]


def test_tail_probabilities():
    assert special._chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert special._chi2_tail(9.487729036781154, 4) == pytest.approx(0.05, abs=1e-12)
    assert special._chi2_tail(0.5, 7) + 0 == pytest.approx(0.9994464804, abs=1e-6)
    assert special._f_tail(4.0, 1, 1e9) == pytest.approx(special._chi2_tail(4.0, 1), abs=1e-6)
    assert special._f_tail(3.0, 2, 10) == pytest.approx((1 + 2 * 3.0 / 10) ** -5, abs=1e-12)
    # table values of the studentised range with infinite degrees of freedom
    for k, q in ((2, 2.772), (3, 3.314), (5, 3.858), (9, 4.387)):
        assert special._range_tail(q, k) == pytest.approx(0.05, abs=2e-4)


def test_normal_quantile(spark):
    ps = [1e-9, 0.001, 0.02, 0.025, 0.3, 0.5, 0.9, 0.975, 0.999999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    for r in df.select("p", special.normal_quantile(F.col("p")).alias("z")).collect():
        assert 0.5 * math.erfc(-r.z / math.sqrt(2)) == pytest.approx(r.p, rel=1e-7)


def test_friedman_against_ranks(spark):
    rng = np.random.default_rng(0)
    m = np.round(rng.random((40, 4)) + [0, 0.1, 0.2, 0.2], 1)
    r = np.array([ranks(list(x)) for x in m])
    n, k = r.shape
    ties = sum(c**3 - c for row in m for c in np.unique(row, return_counts=True)[1])
    want = (12 / (n * k * (k + 1)) * (r.sum(0) ** 2).sum() - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1)))
    got = stats.friedman(paired(spark, m), CELL).first()
    assert got.chi2 == pytest.approx(want, abs=1e-6) and (got.n, got.k) == (40, 4)
    assert got.p == pytest.approx(special._chi2_tail(want, 3), abs=1e-6)


def test_friedman_all_tied_and_too_few(spark):
    assert stats.friedman(paired(spark, [[1, 1, 1]] * 20), CELL).first().chi2 is None
    assert stats.friedman(paired(spark, [[1, 2, 3]] * 9), CELL).count() == 0


def test_friedman_uses_all_items_unless_asked(spark):
    m = np.random.default_rng(1).random((700, 3))
    assert stats.friedman(paired(spark, m), CELL).first().n == 700
    assert stats.friedman(paired(spark, m), CELL, items=500).first().n == 500


def test_anova_is_steady_under_a_shift(spark):
    m = np.random.default_rng(2).integers(0, 9, (40, 3)) / 8
    near, far = (stats.anova(paired(spark, m + shift), CELL).first() for shift in (0, 1e8))
    assert near.F == pytest.approx(far.F, rel=1e-4) and far.F > 0


def test_anova(spark):
    m = np.random.default_rng(2).normal(0, 1, (30, 3)) + [0, 0.5, 1]
    grand = m.mean()
    f = (30 * ((m.mean(0) - grand) ** 2).sum() / 2) / (((m - m.mean(0)) ** 2).sum() / 87)
    got = stats.anova(paired(spark, m), CELL).first()
    assert got.F == pytest.approx(f, abs=1e-4) and (got.df_between, got.df_within) == (2, 87)
    assert got.p == pytest.approx(special._f_tail(f, 2, 87), abs=1e-4)


def plain_wilcoxon(a, b, ties):
    d = np.round(a - b, 10)
    d = d[d != 0]
    m = len(d)
    if len(a) < 10 or m < (1 if ties else 2):
        return 0.0
    r = np.array(ranks(list(np.abs(d))))
    t = min(r[d > 0].sum(), r[d < 0].sum())
    tie = sum(c**3 - c for c in np.unique(np.abs(d), return_counts=True)[1]) / 2 if ties else 0
    sigma = math.sqrt((m * (m + 1) * (2 * m + 1) - tie) / 24)
    return min(abs(t - m * (m + 1) / 4) / sigma / math.sqrt(len(a)), 1.0)


@pytest.mark.parametrize("ties", [True, False])
@pytest.mark.parametrize("n", [9, 12, 200])
def test_wilcoxon(spark, ties, n):
    m = np.round(np.random.default_rng(n).random((n, 3)) + [0, 0.1, 0], 1)
    pairs = joins.model_pairs(paired(spark, m), CELL)
    for r in stats.wilcoxon_r(pairs, CELL, ties=ties).collect():
        i, j = int(r.model_a[1:]), int(r.model_b[1:])
        assert i < j and r.r == pytest.approx(plain_wilcoxon(m[:, i], m[:, j], ties), abs=1e-6)


def test_posthoc_labels(spark):
    m = np.random.default_rng(4).random((60, 3)) + [0, 0, 2]
    rows = {(r.model_a, r.model_b): r for r in stats.posthoc(paired(spark, m), CELL).collect()}
    assert len(rows) == 3
    assert rows["m0", "m2"].significant and rows["m0", "m2"].stars == "***" and rows["m0", "m2"].effect == "grande"
    assert not rows["m0", "m1"].significant and rows["m0", "m1"].stars == "n.s."


def test_groups_of_equal_models(spark):
    r = spark.createDataFrame([("d", "m", f"m{i}", i, 10, x) for i, x in enumerate([1.0, 1.2, 1.9, 2.2, 4.0])],
                              "dataset string, metric string, model string, ord long, n long, mean_rank double")
    close = {("m0", "m1"), ("m1", "m2"), ("m2", "m3"), ("m1", "m3"), ("m0", "m2")}
    pairs = spark.createDataFrame([("d", "m", f"m{i}", f"m{j}", 0.5 if (f"m{i}", f"m{j}") in close else 0.01)
                                   for i in range(5) for j in range(i + 1, 5)],
                                  "dataset string, metric string, model_a string, model_b string, p_adj double")
    got = {x.models for x in stats.cd_groups(r, pairs, CELL).collect()}
    assert got == {"m0 | m1 | m2", "m1 | m2 | m3"}


@pytest.mark.parametrize("decimals", [4, 1])
def test_bootstrap_agrees_with_resampling(spark, decimals):
    # one decimal: values repeat often, so their weights are large
    x = np.round(np.random.default_rng(8).gamma(2, 0.2, 600), decimals)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("few", 1.0)] * 5, "g string, value double")
    rows = stats.bootstrap_ci(df, ["g"], replicates=3000).collect()
    assert [r.g for r in rows] == ["a"]
    rng = np.random.RandomState(42)
    means = [x[rng.randint(0, len(x), len(x))].mean() for _ in range(3000)]
    low, high = np.percentile(means, [2.5, 97.5])
    width = high - low
    assert rows[0].ci_low == pytest.approx(low, abs=0.08 * width)
    assert rows[0].ci_high == pytest.approx(high, abs=0.08 * width)
    assert rows[0].mean == pytest.approx(x.mean(), abs=1e-6)


def test_pairing_modes(spark):
    rows = [("d", "m", i, "a", 0, float(i)) for i in range(5)] + [("d", "m", i, "b", 1, float(i)) for i in (1, 3, 7)]
    df = spark.createDataFrame(rows, "dataset string, metric string, item_id long, model string, ord long, value double")
    by_item = {(r.model, r.item_id) for r in windows.pair_models(df, CELL).collect()}
    assert by_item == {(m, i) for m in "ab" for i in (1, 3)}
    placed = {(r.model, r.item_id, r.value) for r in windows.pair_models(df, CELL, "positional").collect()}
    assert placed == {("a", 1, 0.0), ("a", 2, 1.0), ("a", 3, 2.0), ("b", 1, 1.0), ("b", 2, 3.0), ("b", 3, 7.0)}


def test_qq_writes_out_hot_values(spark):
    df = spark.createDataFrame([("g", 1.0)] * 9000 + [("g", 2.0)] * 10 + [("s", 1.0)] * 9, "g string, value double")
    got = windows.qq_points(df, ["g"], run=100).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 9011)) and {r.g for r in got} == {"g"}


def test_flat_groups(spark):
    df = spark.createDataFrame([("g", i, 1.0) for i in range(20)] + [("g", 20, 5.0)], "g string, item_id long, value double")
    assert windows.iqr_filter(df, ["g"]).count() == 20
    assert windows.iqr_filter(df, ["g"], variant="violin").count() == 21
    box = windows.box_stats(df, ["g"]).first()
    assert (box.outliers, box.whisker_low, box.whisker_high) == (1, 1.0, 1.0)
    assert [r.value for r in windows.outlier_sample(df, ["g"]).collect()] == [5.0]


@pytest.mark.parametrize("start, step", [(1e6, 0.01), (1e9, 0.125)])
def test_deviation_of_large_values(spark, start, step):
    rows = [("g", start + i * step) for i in range(3)]
    got = summary.summary(spark.createDataFrame(rows, "grp string, value double"), ["grp"]).first()
    assert got["std"] == pytest.approx(step, rel=1e-4)


def test_small_values_are_ranked_unrounded(spark):
    rows = [("g", "A", 1, "lower", 4.4e-7)] * 3 + [("g", "B", 2, "lower", 1.1e-7)] * 3
    df = spark.createDataFrame(rows, "grp string, model string, ord long, better string, value double")
    made = summary.summary(df, ["grp", "model", "ord", "better"])
    assert [r.model for r in summary.leaderboard(made, ["grp"]).orderBy("position").collect()] == ["B", "A"]
    assert summary.best_model(made, ["grp"]).first().best_mean == pytest.approx(1.1e-7)


def test_bootstrap_of_small_values_null_groups_and_reruns(spark):
    x = np.random.default_rng(3).random(40) * 1e-9
    df = spark.createDataFrame([(None, float(v)) for v in x], "g string, value double")
    first, again = (stats.bootstrap_ci(df, ["g"], replicates=500).collect() for _ in range(2))
    assert first == again and first[0].g is None and first[0].n == 40
    assert first[0].ci_low < x.mean() < first[0].ci_high and first[0].ci_width > 1e-11


@pytest.mark.parametrize("leaf_values", [500, 4])
def test_each_replicate_draws_all_rows(spark, monkeypatch, leaf_values):
    """Multinomial draws: n in each replicate, and the mean and variance that resampling has."""
    monkeypatch.setattr(stats, "LEAF_VALUES", leaf_values)
    rng = np.random.default_rng(5)
    x = np.round(rng.gamma(2, 3, 200), 1)
    rows = [("a", float(v)) for v in x] + [(None, float(k)) for k in range(12)] + [("one", 2.5)] * 30 + [("few", 1.0)] * 9
    df = spark.createDataFrame(rows, "g string, value double")
    got = stats.bootstrap_sums(df, ["g"], replicates=2000).toPandas()
    assert set(got["g"]) == {"a", None, "one"} and len(got) == 6000
    assert (got["drawn"] == got["n"]).all()
    assert (got[got["g"] == "one"]["total"] == 75).all()
    means = got[got["g"] == "a"]["total"] / 200
    assert means.mean() == pytest.approx(x.mean(), abs=4 * x.std() / (200 * 2000) ** 0.5)
    assert means.var() == pytest.approx(x.var() / 200, rel=0.15)
    null = got[got["g"].isna()]["total"] / 12
    assert null.var() == pytest.approx(np.arange(12).var() / 12, rel=0.15)


def test_split_draws_share_everything():
    draws = np.array([0, 1, 7, 100_000])
    counts = np.array([3, 1, 1, 10, 5])
    parts = list(stats._split_draws(draws, counts, -5, 9))
    assert len(parts) == 5 and (sum(parts) == draws).all()
    assert parts[3][3] / 100_000 == pytest.approx(0.5, abs=0.01)
