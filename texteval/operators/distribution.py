"""Value tables: the exact distribution of a measure per group.

Scores are rounded to four digits, times to four, cost to eight, so a group has
far fewer distinct values than rows. Counting values map side first makes every
order statistic a small job; the bucketed running count keeps it safe when the
values are not rounded.

Quantiles are found by narrowing: a histogram per group tells in which buckets the wanted ranks lie, a second one
cuts those buckets finely, and only what is left there is put in order. The value table itself is never sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from texteval.operators.bounds import per_group
from texteval.operators.order import double_bucket, null_safe_join, prefix_sum

#: Parts of a bucket in the second histogram.
PARTS = 4096


def value_counts(df: DataFrame, keys: list[str], value: str = "value", weight: str | None = None, **extra: Column) -> DataFrame:
    """(keys, value, cnt, extra...) for non-null values.

    With ``weight`` the rows are counted already: that column says how many rows each stands for.
    """
    if weight is not None:
        return df.filter(F.col(value).isNotNull()).select(*keys, value, F.col(weight).cast("long").alias("cnt"))
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("cnt"), *[c.alias(n) for n, c in extra.items()])
    )


def ranked_values(df: DataFrame, keys: list[str], value: str = "value", **extra: Column) -> DataFrame:
    """Value counts plus ``below`` (rows with a smaller value) and ``n`` (rows)."""
    counts = value_counts(df, keys, value, **extra)
    return prefix_sum(
        counts, keys, [value], double_bucket(F.col(value)), F.col("cnt"), "below", total="n"
    )


def quantile_aggs(ps: dict[str, float], value: str = "value") -> list[Column]:
    """Aggregates over a ranked value table: linearly interpolated quantiles."""
    out = []
    first, after = F.col("below"), F.col("below") + F.col("cnt")
    for name, p in ps.items():
        at = F.lit(float(p)) * (F.col("n") - 1)
        low, high = _ranks(p, F.col("n"))
        v_low = F.max(F.when((first <= low) & (low < after), F.col(value)))
        v_high = F.max(F.when((first <= high) & (high < after), F.col(value)))
        share = F.max(at - low)
        out.append((v_low + (v_high - v_low) * share).alias(name))
    return out


def _ranks(p: float, n: Column) -> tuple[Column, Column]:
    low = F.floor(F.lit(float(p)) * (n - 1))
    return low, F.least(low + 1, n - 1)


def moments(values: DataFrame, keys: list[str], registry: DataFrame | None = None, spread: bool = True) -> DataFrame:
    """(keys, n, mean, lo, hi[, spread]) of a value table; ``spread`` is the sum of squares about the mean.

    Squares are taken about the mean, not of the values, which would cancel; the means go to the values, one row a group.
    """
    v, cnt = F.col("value"), F.col("cnt")
    sums = values.groupBy(*keys).agg(
        F.sum(cnt).alias("n"), (F.sum(v * cnt) / F.sum(cnt)).alias("mean"), F.min(v).alias("lo"), F.max(v).alias("hi")
    )
    if not spread:
        return sums
    off = v - F.col("mean")
    return null_safe_join(values, per_group(sums, registry), keys).groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("n", "mean", "lo", "hi")], F.sum(off * off * cnt).alias("spread")
    )


def _holding(hist: DataFrame, keys: list[str], within: list[str], bucket: str, ps: list[float], base: Column, total: Column) -> DataFrame:
    """Buckets of a histogram that hold a wanted rank, with the rows below them and the group's rows."""
    group = Window.partitionBy(*keys, *within)
    before = group.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    placed = hist.withColumn("__all", total if within else F.sum("n").over(group))
    placed = placed.withColumn("__below", base + F.coalesce(F.sum("n").over(before), F.lit(0)))
    end = F.col("__below") + F.col("n")
    wanted = F.lit(False)
    for p in ps:
        for rank in _ranks(p, F.col("__all")):
            wanted = wanted | ((F.col("__below") <= rank) & (rank < end))
    return placed.filter(wanted).select(*keys, *within, bucket, "lo", "hi", "__below", "__all")


def near_ranks(values: DataFrame, keys: list[str], ps: list[float], registry: DataFrame | None = None) -> DataFrame:
    """(keys, value, cnt, below, n) of a value table, but only values around the ranks that the quantiles ``ps`` need."""
    zero = F.lit(0)
    coarse = values.withColumn("__b", double_bucket(F.col("value")))
    first = coarse.groupBy(*keys, "__b").agg(F.sum("cnt").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    slots = per_group(_holding(first, keys, [], "__b", ps, zero, zero), registry)
    inside = null_safe_join(coarse, slots, [*keys, "__b"])
    wide = F.col("hi") - F.col("lo")
    part = F.when(wide > 0, F.least(F.floor((F.col("value") - F.col("lo")) / wide * PARTS), F.lit(PARTS - 1))).otherwise(zero)
    fine = inside.select(*keys, "__b", "value", "cnt", "__below", "__all", part.cast("long").alias("__c"))
    second = fine.groupBy(*keys, "__b", "__below", "__all", "__c").agg(
        F.sum("cnt").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")
    ).withColumnsRenamed({"__below": "__base", "__all": "__total"})
    narrow = per_group(_holding(second, keys, ["__b"], "__c", ps, F.col("__base"), F.col("__total")), registry)
    rows = null_safe_join(fine.drop("__below", "__all"), narrow.drop("lo", "hi"), [*keys, "__b", "__c"])
    before = Window.partitionBy(*keys, "__b", "__c").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("__below") + F.coalesce(F.sum("cnt").over(before), zero)
    return rows.select(*keys, "value", "cnt", below.alias("below"), F.col("__all").alias("n"))


def group_quantiles(
    df: DataFrame, keys: list[str], ps: dict[str, float], value: str = "value", weight: str | None = None,
    registry: DataFrame | None = None,
) -> DataFrame:
    """Exact quantiles and ``n`` per group, one row per group."""
    values = value_counts(df, keys, value, weight).withColumnRenamed(value, "value")
    return near_ranks(values, keys, list(ps.values()), registry).groupBy(*keys).agg(*quantile_aggs(ps), F.max("n").alias("n"))
