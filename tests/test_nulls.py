"""Null group keys, repeated rows and null orders keep their rows."""

import pytest
from pyspark.sql import functions as F

from texteval.operators import joins, stats, windows
from texteval.operators.splits import paired_subsample

MODELS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def paired(spark):
    """20 items and 3 models in a named cell, and the same values in a null one."""
    rows = [(cell, i, m, k, float((i * 7 + k * 5) % 11 + k)) for cell in ("d", None) for i in range(20) for k, m in enumerate(MODELS)]
    return spark.createDataFrame(rows, "dataset string, item_id long, model string, ord long, value double").cache()


def both(df):
    """Rows of the named cell and of the null one, without the cell."""
    rows = [r.asDict() for r in df.collect()]
    cells = {d: sorted((tuple((k, v) for k, v in r.items() if k != "dataset") for r in rows if r["dataset"] == d), key=str) for d in ("d", None)}
    assert cells["d"]
    return cells["d"], cells[None]


@pytest.mark.parametrize("run", [
    lambda p: stats.friedman(p, ["dataset"]), lambda p: stats.friedman(p, ["dataset"], items=20), lambda p: stats.posthoc(p, ["dataset"]),
    lambda p: stats.wilcoxon_r(joins.model_pairs(p, ["dataset"]), ["dataset"]), lambda p: stats.anova(p, ["dataset"]),
    lambda p: stats.bootstrap_ci(p, ["dataset", "model"], 1).select("dataset", "model", "n", "mean"),
    lambda p: stats.cd_groups(windows.mean_ranks(p, ["dataset"], True), stats.nemenyi(p, ["dataset"]), ["dataset"]),
    lambda p: windows.pair_models(p, ["dataset"]), lambda p: windows.pair_models(p, ["dataset"], "positional"),
    lambda p: windows.box_stats(p, ["dataset", "model"]), lambda p: windows.iqr_filter(p, ["dataset", "model"]),
    lambda p: windows.kde(p, ["dataset", "model"], 9), lambda p: paired_subsample(p, ["dataset"], 20),
    lambda p: windows.outlier_sample(p.withColumn("value", F.when(F.col("item_id") == 3, 99.0).otherwise(F.col("value"))), ["dataset", "model"]).drop("item_id"),
])
def test_a_null_cell_is_a_cell(paired, run):
    named, null = both(run(paired))
    assert null == named


def test_null_keys_of_repairs_and_intervals(spark):
    results = spark.createDataFrame([(None, 1, "Error: x", 1.0), ("m", 1, "Error: x", 1.0)], "model string, seq long, generated string, seconds double")
    fixed = spark.createDataFrame([(None, 1, "ok", 2.0)], "model string, seq long, generated string, seconds double")
    got = {r.model: r.generated for r in joins.apply_repairs(results, fixed, ["model", "seq"]).collect()}
    assert got == {None: "ok", "m": "Error: x"}
    cis = spark.createDataFrame([(None, "a", 1, 0.0, 1.0), (None, "b", 2, 0.5, 2.0)], "dataset string, model string, ord long, ci_low double, ci_high double")
    assert joins.ci_overlaps(cis, ["dataset"]).count() == 1


def test_a_repeated_item_is_no_other_model(spark):
    rows = [(1, "a", 1.0), (1, "a", 2.0), (1, "b", 1.0), (2, "a", 1.0), (2, "b", 1.0), (2, "c", 1.0)]
    long = spark.createDataFrame([("d", *r) for r in rows], "dataset string, item_id long, model string, value double")
    assert {r.item_id for r in windows.pair_models(long, ["dataset"]).collect()} == {2}


def test_dedupe_keeps_one_row_for_each_text(spark):
    rows = [(7, "x"), (7, "y"), (3, "y"), (None, "z"), (9, "w"), (9, "w"), (None, "x"), (5, None), (6, None)]
    df = spark.createDataFrame(rows, "seq long, text string")
    got = sorted((tuple(r) for r in joins.dedupe_prefix(df, "text", "seq").collect()), key=str)
    assert got == sorted([(7, "x"), (3, "y"), (None, "z"), (9, "w"), (5, None)], key=str)
    tied = spark.createDataFrame([(1, "abc"), (1, "abd"), (2, "abb")], "seq long, text string")
    assert [tuple(r) for r in joins.dedupe_prefix(tied, "text", "seq", 2).collect()] == [(1, "abc")]
    assert joins.dedupe_prefix(df.limit(0), "text", "seq").count() == 0
