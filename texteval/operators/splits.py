"""Leakage-free splits and repeatable samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from texteval.operators.order import (
    null_safe_join,
    digest_bucket,
    first_in_random_order,
    random_order,
    with_position,
)


def _split_sizes(n: Column, train: float, val: float) -> tuple[Column, Column]:
    """Groups for train and val in a stratum of ``n`` groups.

    From three groups on, every split gets one; two give train and val one each.
    """
    want_train = F.greatest(F.lit(1), F.floor(n * F.lit(train)))
    want_val = F.greatest(F.lit(1), F.floor(n * F.lit(val)))
    spare = F.when(n - want_train - want_val < 1, F.lit(1)).otherwise(F.lit(0))
    n_train = F.when(n >= 3, want_train - spare).otherwise(F.lit(1))
    n_val = F.when(n >= 3, want_val).when(n == 2, F.lit(1)).otherwise(F.lit(0))
    return n_train, n_val


def group_split(
    df: DataFrame,
    id_col: str,
    stratum: list[str],
    group_cols: list[str],
    train: float = 0.70,
    val: float = 0.15,
    seed: int = 42,
) -> DataFrame:
    """(id, groups, split): whole groups go to one split, balanced inside each stratum.

    ``group_cols`` starts with or contains the stratum columns. Groups are
    shuffled by a digest of seed and group, so a rerun gives the same split.
    """
    if train + val >= 1:
        raise ValueError("train and val must leave room for test")
    groups = df.select(*group_cols).distinct().withColumn("__digest", random_order(seed, *group_cols))
    placed = with_position(
        groups, stratum, ["__digest", *group_cols], digest_bucket(F.col("__digest")), "__position", total="__n"
    )
    n_train, n_val = _split_sizes(F.col("__n"), train, val)
    split = (
        F.when(F.col("__position") <= n_train, F.lit("train"))
        .when(F.col("__position") <= n_train + n_val, F.lit("val"))
        .otherwise(F.lit("test"))
    )
    chosen = placed.select(*group_cols, split.alias("split"))
    return null_safe_join(df.select(id_col, *group_cols), chosen, group_cols)


def split_summary(assigned: DataFrame, group_cols: list[str]) -> DataFrame:
    """Groups and rows per split with their shares."""
    per_group = assigned.groupBy("split", *group_cols).agg(F.count(F.lit(1)).alias("rows"))
    per_split = per_group.groupBy("split").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("rows").alias("rows")
    )
    everything = Window.partitionBy(F.lit(0))  # three rows
    return per_split.withColumns(
        {
            "groups_pct": F.round(F.col("groups") * 100.0 / F.sum("groups").over(everything), 1),
            "rows_pct": F.round(F.col("rows") * 100.0 / F.sum("rows").over(everything), 1),
        }
    )


def split_overlaps(assigned: DataFrame, id_col: str, group_cols: list[str]) -> DataFrame:
    """Ids and groups that occur in two splits, per pair of splits; all zero when sound."""

    def both(cols: list[str], what: str) -> DataFrame:
        seen = assigned.groupBy(*cols).agg(F.collect_set("split").alias("s"))
        pairs = [("train", "val"), ("train", "test"), ("val", "test")]
        return seen.agg(
            *[
                F.count_if(F.array_contains("s", a) & F.array_contains("s", b)).alias(f"{a}_{b}")
                for a, b in pairs
            ]
        ).select(F.lit(what).alias("kind"), "*")

    return both([id_col], "ids").unionByName(both(group_cols, "groups"))


def random_split(
    df: DataFrame, id_col: str, train: float = 0.70, val: float = 0.15, seed: int = 42
) -> DataFrame:
    """Row-level split with exact sizes; similar rows may land on both sides."""
    rows = df.withColumn("__digest", random_order(seed, id_col))
    placed = with_position(
        rows, [], ["__digest", id_col], digest_bucket(F.col("__digest")), "__position", total="__n"
    )
    n_train = F.floor(F.col("__n") * F.lit(train))
    n_val = F.floor(F.col("__n") * F.lit(val))
    split = (
        F.when(F.col("__position") <= n_train, F.lit("train"))
        .when(F.col("__position") <= n_train + n_val, F.lit("val"))
        .otherwise(F.lit("test"))
    )
    return placed.withColumn("split", split).drop("__digest", "__position", "__n")


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """``n`` rows drawn without replacement, or all rows if there are fewer."""
    return first_in_random_order(df, n, seed, key)


def paired_subsample(
    paired: DataFrame, cell: list[str], n: int = 500, seed: int = 42, item: str = "item_id"
) -> DataFrame:
    """At most ``n`` items per cell, the same ones for every model."""
    items = paired.select(*cell, item).distinct()
    return null_safe_join(paired, first_in_random_order(items, n, seed, item, cell), [*cell, item], "left_semi")
