"""Writers for result, metric and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texteval.sources.runs import METRIC_COLUMNS


def ordered_columns(df: DataFrame, first: list[str] | None = None) -> DataFrame:
    """Known columns in their fixed order, any others after them."""
    first = [c for c in (first or METRIC_COLUMNS) if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: tuple[str, ...] = (),
    columns: list[str] | None = None,
    mode: str = "overwrite",
) -> None:
    """Write Parquet, CSV or JSON, partitioned by e.g. data set and model."""
    writer = ordered_columns(df, columns).write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)


def split_manifest(
    assigned: DataFrame, group_cols: list[str], seed: int, train: float, val: float
) -> DataFrame:
    """One row: seed, ratios, and counts of groups and rows per split.

    The ids themselves stay a table (id, split): see ``write_split``.
    """
    groups = (
        assigned.groupBy(*group_cols, "split").agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("split").agg(F.count(F.lit(1)).alias("groups"), F.sum("rows").alias("rows"))
    )

    def of(split: str | None, what: str):
        value = F.col(what) if split is None else F.when(F.col("split") == split, F.col(what))
        return F.coalesce(F.sum(value), F.lit(0)).cast("long")

    names = [None, "train", "val", "test"]
    return groups.agg(
        F.lit(seed).cast("long").alias("seed"),
        F.lit(train).alias("train_ratio"),
        F.lit(val).alias("val_ratio"),
        F.round(F.lit(1.0 - train - val), 10).alias("test_ratio"),
        *[of(s, "groups").alias(f"n_groups_{s or 'total'}") for s in names],
        *[of(s, "rows").alias(f"n_rows_{s or 'total'}") for s in names],
    )


def write_split(assigned: DataFrame, path: str, id_col: str = "id") -> None:
    """The ids of each split, sorted within files, one folder per split."""
    (
        assigned.select(id_col, "split")
        .repartitionByRange("split", id_col)
        .sortWithinPartitions("split", id_col)
        .write.mode("overwrite").partitionBy("split").parquet(path)
    )
