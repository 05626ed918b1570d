"""Which sides of a join are small, and how that is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A registry may describe this much before its per-group tables are shuffled instead.
REGISTRY_BYTES = 1 << 20


def estimated_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate; exact for a table made on the driver."""
    plan = getattr(df, "_jdf", None)
    if plan is None:
        return None
    return int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))


def per_group(df: DataFrame, registry: DataFrame | None) -> DataFrame:
    """``df`` has one row per group of the registry: broadcast it if the registry is small.

    Without a registry, or with a large one, the join stays a shuffle join that
    adaptive execution may still change.
    """
    if registry is None:
        return df
    size = estimated_bytes(registry)
    return F.broadcast(df) if size is not None and size <= REGISTRY_BYTES else df
