"""Positions and running sums inside groups of any size.

A plain ``row_number() over (partition by key order by x)`` sends a whole group
to one task. Here the ordered axis of a group is first cut into buckets by a
fixed, monotone function of the order column. Bucket totals are aggregated map
side, their running sum gives each bucket its offset, and rows are then ordered
only inside their own (group, bucket). A group that holds a third of the data is
spread over as many tasks as it has buckets.

A null group key is a group of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET = "__bucket"
_WEIGHT = "__weight"
_OFFSET = "__offset"
_TOTAL = "__total"


def integer_bucket(col: Column, span: int = 65536) -> Column:
    """Buckets for an integer order column: ``span`` consecutive values each."""
    return F.floor(col.cast("double") / F.lit(float(span))).cast("long")


def digest_bucket(col: Column) -> Column:
    """Buckets for a hex digest: its first four digits, 65 536 even buckets."""
    return F.conv(F.substring(col, 1, 4), 16, 10).cast("long")


def double_bucket(col: Column, per_unit: int = 64) -> Column:
    """Buckets for a double: log scale away from zero, about 1.6 % wide.

    ``ln`` is monotone, so bucket order agrees with value order.
    """
    base = 60000
    magnitude = F.floor(F.log(F.abs(col)) * F.lit(float(per_unit))).cast("long") + F.lit(base)
    return (
        F.when(col > 0, magnitude)
        .when(col < 0, -magnitude)
        .otherwise(F.lit(0).cast("long"))
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the keys come from the left side."""
    named = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = reduce(lambda x, y: x & y, [left[k].eqNullSafe(named[f"__right_{k}"]) for k in keys])
    return left.join(named, same, how).drop(*[f"__right_{k}" for k in keys])


def prefix_sum(
    df: DataFrame,
    keys: list[str],
    order: list[str | Column],
    bucket: Column,
    weight: Column,
    name: str,
    total: str | None = None,
) -> DataFrame:
    """Sum of ``weight`` over the rows that come before this one in its group.

    ``order`` must be total inside a group and agree with ``bucket``.
    """
    rows = df.withColumn(_BUCKET, bucket).withColumn(_WEIGHT, weight)
    per_bucket = rows.groupBy(*keys, _BUCKET).agg(F.sum(_WEIGHT).alias(_TOTAL))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = group.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    offsets = per_bucket.select(
        *keys,
        _BUCKET,
        F.coalesce(F.sum(_TOTAL).over(before), zero).alias(_OFFSET),
        *([F.sum(_TOTAL).over(group).alias(total)] if total else []),
    )
    inside = (
        Window.partitionBy(*keys, _BUCKET)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        null_safe_join(rows, offsets, [*keys, _BUCKET])
        .withColumn(name, F.col(_OFFSET) + F.coalesce(F.sum(_WEIGHT).over(inside), zero))
        .drop(_BUCKET, _WEIGHT, _OFFSET)
    )


def with_position(
    df: DataFrame,
    keys: list[str],
    order: list[str | Column],
    bucket: Column,
    name: str = "position",
    total: str | None = None,
) -> DataFrame:
    """1-based position of each row in its group."""
    placed = prefix_sum(df, keys, order, bucket, F.lit(1).cast("long"), name, total)
    return placed.withColumn(name, F.col(name) + 1)


def random_order(seed: int, *cols: str | Column) -> Column:
    """A repeatable shuffle key: md5 of ``seed|col|...``."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))


def first_in_random_order(
    df: DataFrame, n: int, seed: int, key: str, keys: list[str] | None = None
) -> DataFrame:
    """Exactly the first ``n`` rows per group in the shuffled order of ``key``.

    Buckets that lie wholly past the cut are dropped before any row is ordered.
    """
    keys = keys or []
    rows = df.withColumn("__digest", random_order(seed, key))
    rows = rows.withColumn(_BUCKET, digest_bucket(F.col("__digest")))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = group.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    wanted = (
        rows.groupBy(*keys, _BUCKET)
        .agg(F.count(F.lit(1)).alias(_TOTAL))
        .withColumn(_OFFSET, F.coalesce(F.sum(_TOTAL).over(before), F.lit(0)))
        .filter(F.col(_OFFSET) < n)
        .drop(_TOTAL)
    )
    inside = Window.partitionBy(*keys, _BUCKET).orderBy("__digest", key)
    return (
        null_safe_join(rows, wanted, [*keys, _BUCKET])
        .withColumn("__position", F.col(_OFFSET) + F.row_number().over(inside))
        .filter(F.col("__position") <= n)
        .drop("__position", "__digest", _BUCKET, _OFFSET)
    )
