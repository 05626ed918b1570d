"""Joins and set operations over items, results and model pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texteval.functions.text import is_error, signature
from texteval.operators.order import null_safe_join, integer_bucket, with_position


def rows_in_split(df: DataFrame, assigned: DataFrame, splits: list[str], id_col: str = "id") -> DataFrame:
    """Rows whose id belongs to one of the splits."""
    ids = assigned.filter(F.col("split").isin(splits)).select(id_col)
    return df.join(ids, id_col, "left_semi")


def _numbered(df: DataFrame, run: list[str], seq: str, sig: str) -> DataFrame:
    """Number the rows that share a signature; one signature may be very common."""
    return with_position(df, [*run, sig], [seq], integer_bucket(F.col(seq)), "occurrence")


def resume_plan(
    items: DataFrame, results: DataFrame, run: list[str] | None = None, seq: str = "seq"
) -> tuple[DataFrame, DataFrame]:
    """(done, pending): each saved success pays for one item with the same texts.

    The k-th item with a signature is done when there is a k-th saved success
    with it. Errors pay for nothing, so their items are run again. The shuffles
    of the match carry signatures and positions; a text moves only with its row.
    """
    run = run or []
    sig = signature(F.col("input"), F.col("reference"))
    todo = _numbered(items.withColumn("sig", sig), run, seq, "sig")
    saved = _numbered(results.filter(~_failed()).withColumn("sig", sig), run, seq, "sig")
    key = [*run, "sig", "occurrence"]
    done = null_safe_join(todo, saved.select(*key, "generated", "seconds"), key).drop("sig", "occurrence")
    pending = null_safe_join(todo, saved.select(*key), key, "left_anti").drop("sig", "occurrence")
    return done, pending


def _failed():
    """A saved row without a generation counts as an error."""
    return F.coalesce(is_error(F.col("generated")), F.lit(True))


def compact_results(df: DataFrame, items: DataFrame, run: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """Successes first, up to the run's number of items; unresolved errors fill what is left.

    ``items`` has one row per item and run. An error is resolved when its run has a success with the
    same texts; a row without a generation is an error.
    """
    run = run or []
    marked = df.withColumns(
        {"sig": signature(F.col("input"), F.col("reference")), "failed": _failed()}
    )
    good = marked.filter(~F.col("failed"))
    key = [*run, "sig"]
    open_errors = null_safe_join(marked.filter("failed"), good.select(*key), key, "left_anti")
    kept = good.unionByName(open_errors)
    # successes come before errors: their buckets sort lower
    bucket = integer_bucket(F.col(seq)) + F.when(F.col("failed"), F.lit(1 << 48)).otherwise(F.lit(0))
    placed = with_position(kept, run, ["failed", seq], bucket, "rank")
    totals = items.groupBy(*run).agg(F.count(F.lit(1)).alias("__items")) if run else items.agg(F.count(F.lit(1)).alias("__items"))
    key_of = placed.withColumn("__all", F.lit(0)) if not run else placed
    totals = totals if run else totals.withColumn("__all", F.lit(0))
    counted = null_safe_join(key_of, totals, run or ["__all"])
    return counted.filter(F.col("rank") <= F.col("__items")).drop("sig", "failed", "__items", "__all")


def apply_repairs(results: DataFrame, repairs: DataFrame, key: list[str]) -> DataFrame:
    """Repaired text and time replace those of the failed row with the same key."""
    fixed = repairs.select(*key, F.col("generated").alias("__text"), F.col("seconds").alias("__seconds"))
    joined = null_safe_join(results, fixed, key, "left")
    use = is_error(F.col("generated")) & F.col("__text").isNotNull()
    return joined.withColumns(
        {
            "repaired": use,
            "seconds": F.when(use, F.col("__seconds")).otherwise(F.col("seconds")),
            "generated": F.when(use, F.col("__text")).otherwise(F.col("generated")),
        }
    ).drop("__text", "__seconds")


def with_rates(df: DataFrame, rates: DataFrame, default: dict[str, float], key: str = "model") -> DataFrame:
    """Price and energy columns per model; unknown models get the default.

    A registry has one row per model, so the planner broadcasts it by size.
    """
    return df.join(rates, key, "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(float(v))) for c, v in default.items()}
    )


def model_pairs(paired: DataFrame, cell: list[str], item: str = "item_id") -> DataFrame:
    """All unordered model pairs of an item, in registry order.

    One shuffle gathers an item's values (one per model of the registry); the
    pairs of that short list are then made in place.
    """
    per_item = paired.groupBy(*cell, item).agg(
        F.array_sort(F.collect_list(F.struct("ord", "model", "value"))).alias("v")
    )
    first = per_item.select(*cell, item, "v", F.posexplode("v").alias("at", "a"))
    return first.select(
        *cell, item, "a",
        F.explode(F.slice("v", F.col("at") + 2, F.size("v"))).alias("b"),
    ).select(
        *cell, item,
        F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b"),
        F.col("a.value").alias("value_a"), F.col("b.value").alias("value_b"),
    )


def ci_overlaps(cis: DataFrame, cell: list[str]) -> DataFrame:
    """Model pairs of a cell whose intervals overlap; ``cis`` has one row per model."""
    a, b = cis.alias("a"), cis.alias("b")
    same_cell = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in cell]
    meet = [
        F.col("a.ord") < F.col("b.ord"),
        F.col("a.ci_low") <= F.col("b.ci_high"),
        F.col("b.ci_low") <= F.col("a.ci_high"),
    ]
    condition: Column = reduce(lambda x, y: x & y, [*same_cell, *meet])
    return a.join(b, condition).select(
        *[F.col(f"a.{c}").alias(c) for c in cell],
        F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b"),
    )


def union_splits(*dfs: DataFrame) -> DataFrame:
    """Concatenate runs or splits by column name, keeping duplicates."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), dfs)


def dedupe_prefix(df: DataFrame, col: str, order: str, n: int | None = None) -> DataFrame:
    """The first row for each text; with ``n``, for each ``n``-character beginning.

    Rows without an order come last; rows that tie in it are told apart by the text, then by a hash of the other columns. One row
    stays for each text, null being one. The winner is a map-side minimum, so a very common
    beginning costs one partial row per task.
    """
    prefix = F.md5((F.col(col) if n is None else F.substring(col, 1, n)).cast("binary"))
    columns = [F.col(f"`{c}`") for c in df.columns]
    hashed = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]
    place = F.struct(F.col(order).isNull().alias("a"), F.col(order).alias("b"), F.col(col).alias("c"), F.xxhash64(*hashed).alias("d"))
    first = df.groupBy(prefix.alias("__prefix")).agg(F.min_by(F.struct(*columns), place).alias("__row"))
    return first.select("__row.*")
