"""Aggregations, leaderboards and report tables over long metric tables.

A long table is (grp, dataset, metric, model, ord, item_id, value, better).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from texteval.functions.numbers import significant, steady_round
from texteval.operators.bounds import per_group
from texteval.operators.distribution import moments, near_ranks, quantile_aggs, value_counts
from texteval.operators.order import null_safe_join

ALPHA = 0.05


def summary(
    long: DataFrame, keys: list[str], digits: int = 9, weight: str | None = None, median: bool = True, deviation: bool = True,
    registry: DataFrame | None = None,
) -> DataFrame:
    """Mean, median, sample deviation, range and count per group, to ``digits`` significant digits.

    Costs a row are tiny, so a fixed number of decimals would make them tie in a ranking. Rows leave their task as
    counts of values (``weight``: they are such counts already). What is not asked for, the median or the
    deviation, is not looked for.
    """
    values = value_counts(long, keys, weight=weight)
    sums = moments(values, keys, registry, deviation)
    if median:
        middle = near_ranks(values, keys, [0.5], registry).groupBy(*keys).agg(*quantile_aggs({"median": 0.5}))
        sums = null_safe_join(sums, per_group(middle, registry), keys)
    n = F.col("n")
    std = F.when(n > 1, F.sqrt(F.col("spread") / (n - 1))) if deviation else None
    return sums.select(
        *keys,
        significant("mean", digits).alias("mean"),
        *([significant("median", digits).alias("median")] if median else []),
        *([significant(std, digits).alias("std")] if deviation else []),
        significant("lo", digits).alias("min"),
        significant("hi", digits).alias("max"),
        "n",
    )


def _signed(col: str, better: str = "better") -> Column:
    return F.when(F.col(better) == "higher", -F.col(col)).otherwise(F.col(col))


def leaderboard(stats: DataFrame, cell: list[str], by: str = "mean") -> DataFrame:
    """Position per cell; equal values keep registry order."""
    order = Window.partitionBy(*cell).orderBy(_signed(by), "ord")
    return stats.withColumn("position", F.row_number().over(order).cast("long"))


def ranking_stability(stats: DataFrame, cell: list[str]) -> DataFrame:
    """Positions by mean and by median, and whether a cell's order depends on the choice."""
    by_mean = Window.partitionBy(*cell).orderBy(_signed("mean"), "ord")
    # the other order starts from the first one, so it breaks ties by it
    by_median = Window.partitionBy(*cell).orderBy(_signed("median"), "by_mean")
    placed = stats.withColumn("by_mean", F.row_number().over(by_mean).cast("long"))
    placed = placed.withColumn("by_median", F.row_number().over(by_median).cast("long"))
    moved = F.max((F.col("by_mean") != F.col("by_median")).cast("int")).over(Window.partitionBy(*cell)) == 1
    return placed.select(*cell, "model", "by_mean", "by_median", moved.alias("order_changes"))


def totals(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Total cost, CO2 and time with the number of rows."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), *[steady_round(F.sum(c), 6).alias(f"total_{c}") for c in columns]
    )


def best_model(stats: DataFrame, cell: list[str]) -> DataFrame:
    """Name and mean of the best model per cell; equal means go to the first in the registry."""
    pick = F.struct(_signed("mean").alias("score"), "ord", "model", "mean")
    return stats.groupBy(*cell).agg(F.min(pick).alias("b")).select(
        *cell, F.col("b.model").alias("best_model"), F.col("b.mean").alias("best_mean")
    )


def test_rollup(tests: DataFrame, pairs: DataFrame, by: list[str], alpha: float = ALPHA) -> DataFrame:
    """Tests and pairs, significant or not, per group and in total."""
    significant = F.col("p") < alpha
    t = tests.rollup(*by).agg(
        F.count(F.lit(1)).alias("tests"),
        F.count_if(significant).alias("tests_significant"),
        F.count_if(~significant).alias("tests_not_significant"),
    )
    p = pairs.rollup(*by).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(significant).alias("pairs_significant"),
        *[
            F.count_if(significant & (F.col("effect") == e)).alias(f"significant_{name}")
            for name, e in (("large", "grande"), ("medium", "mediano"), ("small", "pequeño"), ("none", "nulo"))
        ],
    )
    t = t.withColumns({c: F.coalesce(c, F.lit("(total)")) for c in by})
    p = p.withColumns({c: F.coalesce(c, F.lit("(total)")) for c in by})
    return t.join(p, by, "full").fillna(0)


def by_category(long: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and count per model category (base, fine-tuned, ...)."""
    return long.groupBy(*keys, "category").agg(
        F.countDistinct("model").alias("models"),
        F.count("value").alias("n"),
        steady_round(F.avg("value"), 6).alias("mean"),
    )


def inventory(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows, models and data sets loaded."""
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        distinct("model").alias("models"),
        distinct("dataset").alias("datasets"),
    )


def length_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows and mean length of each text column."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"), *[steady_round(F.avg(F.length(c)), 4).alias(f"mean_len_{c}") for c in cols]
    )


def training_summary(log: DataFrame, by: list[str]) -> DataFrame:
    """Per run: epochs, last losses and their gap, best epoch by validation loss."""
    best = F.struct("loss_lm_val", "epoch")
    last = F.struct("epoch", "loss_lm_train", "loss_lm_val")
    return (
        log.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("epochs"), F.min(best).alias("b"), F.max(last).alias("l"))
        .select(
            *by, "epochs",
            F.col("l.loss_lm_train").alias("last_train"),
            F.col("l.loss_lm_val").alias("last_val"),
            steady_round(F.col("l.loss_lm_val") - F.col("l.loss_lm_train"), 4).alias("gap"),
            F.col("b.epoch").alias("best_epoch"),
            F.col("b.loss_lm_val").alias("best_val"),
        )
    )


def best_so_far(log: DataFrame, by: list[str]) -> DataFrame:
    """Marks the epochs that would save a checkpoint: strictly better than all before.

    A run has tens of epochs, so its window is small.
    """
    before = Window.partitionBy(*by).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    floor = F.min("loss_lm_val").over(before)
    return log.withColumn("is_best", floor.isNull() | (F.col("loss_lm_val") < floor))
