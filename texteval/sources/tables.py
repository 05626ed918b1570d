"""Tables on disk and small tables made on the driver."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Read Parquet; a table with fewer splits than cores is spread by ``key``.

    Scoring texts is work per row, so a single small file should not become a
    single task. A table of many splits is left as it is.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if key is not None and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, key)
    return df


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table the planner knows the size of, so that it is broadcast by size."""
    names = [part.split()[0] for part in schema.split(",")]
    return spark.createDataFrame(pd.DataFrame(rows, columns=names), schema)
