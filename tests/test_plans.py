"""Plans that hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from texteval.operators import bounds, filters
from texteval.plans import inputs

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "jn2_resume_pending", "jn7_ci_overlaps", "spl1_group_split", "met6_greedy_cosine_f1", "prm5_run_matrix",
    "win5_box_stats", "win8_kde", "sta5_posthoc", "sta6_cd_groups", "str3_request_metrics",
])
def test_no_cross_product(spark, name):
    text = plan(queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_is_pruned_and_filtered(spark):
    df = inputs.table(spark, SF, "events").filter(F.col("value") <= 1).select("event_id", "value")
    text = plan(filters.range_policy(df.withColumnRenamed("value", "BLEU"), policy="drop_over_1"))
    assert "LessThanOrEqual(value,1.0)" in text
    assert re.search(r"ReadSchema: struct<event_id:bigint,value:double>", text)


def test_registry_is_broadcast_by_size(spark):
    groups = inputs.experiment_groups(spark)
    assert bounds.estimated_bytes(groups) < bounds.REGISTRY_BYTES
    rows = spark.range(10).withColumn("k", F.col("id"))
    assert "broadcast" in bounds.per_group(rows, groups)._jdf.queryExecution().logical().toString().lower()
    large = spark.range(10_000_000)
    assert "broadcast" not in bounds.per_group(rows, large)._jdf.queryExecution().logical().toString().lower()


def test_vectors_are_never_dealt_by_item_alone(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan(queries()["met6_greedy_cosine_f1"](spark, SF)).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [(a, b) for a, b in zip(lines, lines[1:]) if re.search(r"Exchange hashpartitioning\(item_id#\d+L?, \d+\)", a)]
    assert moved and not any("rows#" in below or "vec#" in below or "__unit" in below for _, below in moved)
    pairs = [b for a, b in zip(lines, lines[1:]) if re.search(r"Exchange hashpartitioning\(item_id#\d+L?, __[ab]#", a)]
    assert len(pairs) >= 2
