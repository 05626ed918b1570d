"""Pairing, ranks, cumulative curves and distribution shapes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from texteval.functions.numbers import steady_round
from texteval.functions.special import normal_quantile
from texteval.operators.bounds import per_group
from texteval.operators.distribution import group_quantiles, moments, ranked_values, value_counts
from texteval.operators.order import digest_bucket, integer_bucket, null_safe_join, prefix_sum, random_order, with_position

# Fences, zones and sizes of the distribution displays.
WHISKER = 1.5
OUTLIER_ZONE = (0.2, 2.5)
OUTLIER_ZONE_WIDE = (0.0, 4.0)
OUTLIERS_SHOWN = 4
EXTREME_FACTOR = 3.0
KDE_POINTS = 200
KDE_MARGIN = 0.08
CHECKPOINTS = 12
MIN_QQ_ROWS = 10


def pair_models(
    long: DataFrame, cell: list[str], mode: str = "by_item", item: str = "item_id",
    registry: DataFrame | None = None,
) -> DataFrame:
    """Rows of the items every model of the cell has.

    ``by_item`` keeps complete items, a repeated row of one model not standing for another. ``positional`` renumbers each model's
    non-null rows in item order and cuts to the shortest model.
    """
    rows = long.filter(F.col("value").isNotNull())
    per_model = rows.groupBy(*cell, "model").agg(F.count(F.lit(1)).alias("n"))
    size = per_model.groupBy(*cell).agg(
        F.count(F.lit(1)).cast("long").alias("__models"), F.min("n").alias("__shortest")
    )
    if mode == "by_item":
        complete = (
            null_safe_join(
                rows.groupBy(*cell, item).agg(F.size(F.collect_set("model")).alias("__have")), per_group(size, registry), cell
            )
            .filter(F.col("__have") == F.col("__models"))
            .select(*cell, item)
        )
        return null_safe_join(rows, complete, [*cell, item], "left_semi")
    if mode != "positional":
        raise ValueError(f"unknown pairing {mode!r}")
    placed = with_position(rows, [*cell, "model"], [item], integer_bucket(F.col(item)), "__position")
    return (
        null_safe_join(placed, per_group(size.drop("__models"), registry), cell)
        .filter(F.col("__position") <= F.col("__shortest"))
        .withColumn(item, F.col("__position"))
        .drop("__position", "__shortest")
    )


def item_ranks(paired: DataFrame, cell: list[str], ascending: bool = False, item: str = "item_id") -> DataFrame:
    """Rank of each model inside its item; ties share the mean rank. Items have one row per model."""
    value = F.asc("value") if ascending else F.desc("value")
    inside = Window.partitionBy(*cell, item).orderBy(value)
    ties = Window.partitionBy(*cell, item, "value")
    return paired.withColumn("tied", F.count(F.lit(1)).over(ties)).withColumn(
        "rank", F.rank().over(inside) + (F.col("tied") - 1) / F.lit(2.0)
    )


def mean_ranks(paired: DataFrame, cell: list[str], ascending: bool = False, item: str = "item_id") -> DataFrame:
    """Mean within-item rank per model."""
    return item_ranks(paired, cell, ascending, item).groupBy(*cell, "model").agg(
        F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n"), F.avg("rank").alias("mean_rank")
    )


def cumulative_time(df: DataFrame, keys: list[str], seq: str = "item_id", time: str = "Time_seconds") -> DataFrame:
    """Row number and running time per run, in file order."""
    rows = df.filter(F.col(time).isNotNull()).select(*keys, seq, time)
    bucket = integer_bucket(F.col(seq))
    placed = with_position(rows, keys, [seq], bucket, "processed", total="n")
    summed = prefix_sum(placed, keys, [seq], bucket, F.col(time), "__before")
    return summed.withColumn("elapsed", steady_round(F.col("__before") + F.col(time), 4)).drop("__before")


def log_checkpoints(curve: DataFrame, keys: list[str], points: int = CHECKPOINTS) -> DataFrame:
    """Log-spaced points of a cumulative curve; all of a curve of ten rows or fewer.

    Each row decides by itself whether its index is one of the points.
    """
    last = F.col("n") - 1
    step = F.sequence(F.lit(0), F.lit(points - 1))

    def spot(k: Column) -> Column:
        # the small shift keeps exact powers from falling to the integer below
        return F.when(k == points - 1, last.cast("long")).otherwise(
            F.floor(F.pow(last.cast("double"), k / F.lit(float(points - 1))) + F.lit(1e-9)).cast("long")
        )

    marked = F.array_contains(F.transform(step, spot), F.col("processed") - 1)
    return curve.filter((F.col("n") <= 10) | marked)


def _fences(factor: float) -> tuple[Column, Column]:
    return F.col("q1") - factor * F.col("iqr"), F.col("q3") + factor * F.col("iqr")


def _quartiles(values: DataFrame, keys: list[str], registry: DataFrame | None, **more: float) -> DataFrame:
    """Quartiles per group of a value table (keys, value, cnt)."""
    ps = {"q1": 0.25, "median": 0.5, "q3": 0.75, **more}
    return group_quantiles(values, keys, ps, weight="cnt", registry=registry).withColumn("iqr", F.col("q3") - F.col("q1"))


def box_stats(long: DataFrame, keys: list[str], registry: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """Quartiles, whiskers at the last data inside 1.5 iqr, and outlier counts; ``weight`` as in ``value_counts``."""
    values = value_counts(long, keys, weight=weight)
    q = _quartiles(values, keys, registry)
    low, high = _fences(WHISKER)
    counts = null_safe_join(values, per_group(q, registry), keys)
    whiskers = counts.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("n", "q1", "median", "q3", "iqr")],
        F.min(F.when(F.col("value") >= low, F.col("value"))).alias("whisker_low"),
        F.max(F.when(F.col("value") <= high, F.col("value"))).alias("whisker_high"),
        F.sum(F.when((F.col("value") < low) | (F.col("value") > high), F.col("cnt")).otherwise(0)).alias("outliers"),
    )
    return whiskers.withColumns(
        {
            "whisker_low": F.coalesce("whisker_low", "q1"),
            "whisker_high": F.coalesce("whisker_high", "q3"),
            **{c: steady_round(c, 6) for c in ("q1", "median", "q3", "iqr")},
        }
    )


def outlier_sample(
    long: DataFrame, keys: list[str], item: str = "item_id", k: int = OUTLIERS_SHOWN, seed: int = 42,
    registry: DataFrame | None = None,
) -> DataFrame:
    """Up to ``k`` outliers per group for display.

    They come from a zone just past the fence; from a wider zone when that has
    fewer than ``k``; from all outliers when that is empty or the iqr is zero.
    """
    q = _quartiles(value_counts(long, keys), keys, registry).drop("median", "n")
    low, high = _fences(WHISKER)
    past = F.greatest(low - F.col("value"), F.col("value") - high)
    out = null_safe_join(long.filter(F.col("value").isNotNull()), per_group(q, registry), keys).withColumn("__past", past).filter(past > 0)
    iqr = F.col("iqr")

    def within(zone: tuple[float, float]) -> Column:
        # distance past the fence; the far edge is measured from the fence too
        return (iqr > 0) & (F.col("__past") > zone[0] * iqr) & (F.col("__past") <= zone[1] * iqr)

    out = out.withColumns({"__near": within(OUTLIER_ZONE), "__wide": within(OUTLIER_ZONE_WIDE)})
    sizes = out.groupBy(*keys).agg(
        F.count_if("__near").alias("__nears"), F.count_if("__wide").alias("__wides")
    )
    use = (
        F.when(F.col("__nears") >= k, F.col("__near"))
        .when(F.col("__wides") > 0, F.col("__wide"))
        .otherwise(F.lit(True))
    )
    shown = null_safe_join(out, per_group(sizes, registry), keys).filter(use)
    first = Window.partitionBy(*keys).orderBy(random_order(seed, item), item)
    return (
        shown.withColumn("__at", F.row_number().over(first))
        .filter(F.col("__at") <= k)
        .select(*long.columns)
    )


def iqr_filter(
    long: DataFrame, keys: list[str], factor: float = EXTREME_FACTOR, variant: str = "density",
    registry: DataFrame | None = None, weight: str | None = None,
) -> DataFrame:
    """Drop values far outside the quartiles unless too few would be left; ``weight`` as in ``value_counts``.

    ``density``: a zero iqr falls back to the 1st and 99th percentile, and a
    group keeps everything if those agree or fewer than 5 rows remain.
    ``violin``: a zero iqr keeps everything, as do fewer than 10 rows.
    """
    if variant not in ("density", "violin"):
        raise ValueError(f"unknown variant {variant!r}")
    values = value_counts(long, keys, weight=weight)
    q = _quartiles(values, keys, registry, p01=0.01, p99=0.99)
    low, high = _fences(factor)
    flat = F.col("iqr") <= 0
    if variant == "density":
        least = 5
        low = F.when(~flat, low).when(F.col("p01") < F.col("p99"), F.col("p01"))
        high = F.when(~flat, high).when(F.col("p01") < F.col("p99"), F.col("p99"))
    else:
        least = 10
        low, high = F.when(~flat, low), F.when(~flat, high)
    bounds = q.select(*keys, low.alias("__low"), high.alias("__high"))
    inside = (F.col("value") >= F.col("__low")) & (F.col("value") <= F.col("__high"))
    left = (
        null_safe_join(values, per_group(bounds, registry), keys).groupBy(*keys)
        .agg(
            F.first("__low").alias("__low"),
            F.first("__high").alias("__high"),
            F.sum(F.when(inside, F.col("cnt")).otherwise(0)).alias("__left"),
        )
    )
    keep = F.col("__low").isNull() | (F.col("__left") < least) | inside
    return null_safe_join(long.filter(F.col("value").isNotNull()), per_group(left, registry), keys).filter(keep).select(*long.columns)


def kde(
    long: DataFrame, keys: list[str], points: int = KDE_POINTS, margin: float = KDE_MARGIN,
    registry: DataFrame | None = None, weight: str | None = None,
) -> DataFrame:
    """Gaussian density curve per group with Scott's bandwidth; ``weight`` as in ``value_counts``.

    Each task adds the distinct values it has into one curve per group, so no
    value becomes ``points`` rows. Groups without spread have no curve.
    """
    values = value_counts(long, keys, weight=weight)
    shape = moments(values, keys, registry).filter((F.col("n") > 1) & (F.col("hi") > F.col("lo")))
    shape = shape.withColumn("sd", F.sqrt(F.col("spread") / (F.col("n") - 1))).drop("spread", "mean")
    shape = shape.withColumns(
        {
            "bandwidth": F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)),
            "start": F.col("lo") - margin * (F.col("hi") - F.col("lo")),
            "step": (F.col("hi") - F.col("lo")) * (1 + 2 * margin) / (points - 1),
        }
    )
    shape = shape.withColumn("__group", F.to_json(F.struct(*keys)))
    rows = null_safe_join(values, per_group(shape, registry), keys).select(
        "__group", "value", F.col("cnt").cast("double"), "bandwidth", "start", "step"
    )
    grid = np.arange(points, dtype=float)

    def masses(batches):
        """One partial curve per group and task."""
        held: dict[str, np.ndarray] = {}

        def flush():
            made = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array([m.tolist() for m in held.values()], pa.list_(pa.float64()))],
                ["__group", "masses"],
            )
            held.clear()
            return made

        for batch in batches:
            group = batch.column(0).dictionary_encode()
            codes = np.asarray(group.indices)
            value, cnt, bandwidth, start, step = (np.asarray(batch.column(i)) for i in range(1, 6))
            for code, name in enumerate(group.dictionary.to_pylist()):
                own = np.flatnonzero(codes == code)
                x = start[own[0]] + grid * step[own[0]]
                for some in np.array_split(own, -(-len(own) // 4096)):
                    z = (x - value[some, None]) / bandwidth[own[0]]
                    held[name] = held.get(name, 0.0) + cnt[some] @ np.exp(-0.5 * z * z)
            if len(held) > 2000:
                yield flush()
        if held:
            yield flush()

    partial = rows.mapInArrow(masses, "__group string, masses array<double>")
    curve = partial.select("__group", F.posexplode("masses").alias("point", "mass")).groupBy("__group", "point").agg(
        F.sum("mass").alias("mass")
    )
    x = F.col("start") + F.col("point") * F.col("step")
    density = F.col("mass") / (F.col("n") * F.col("bandwidth") * math.sqrt(2 * math.pi))
    return curve.join(shape, "__group").select(
        *keys, F.col("point").cast("long").alias("point"), steady_round(x, 6).alias("x"), steady_round(density, 6).alias("density")
    )


def qq_points(long: DataFrame, keys: list[str], run: int = 4096) -> DataFrame:
    """(normal quantile, value) per row, by Filliben's medians; none below ten rows.

    A value that occurs very often is written out in runs of ``run`` ranks, which
    are spread over the cluster before they become rows.
    """
    ranked = ranked_values(long, keys).filter(F.col("n") >= MIN_QQ_ROWS)
    runs = ranked.select(
        *keys, "value", "n", "below", "cnt",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("cnt") - 1) / F.lit(float(run))))).alias("__run"),
    ).repartition(*keys, "value", "__run")
    first = F.col("below") + F.col("__run") * run + 1
    last = F.least(first + run - 1, F.col("below") + F.col("cnt"))
    rows = runs.select(*keys, "value", "n", F.explode(F.sequence(first, last)).alias("rank"))
    n, i = F.col("n").cast("double"), F.col("rank")
    top = F.pow(F.lit(0.5), 1 / n)
    median = F.when(i == 1, 1 - top).when(i == F.col("n"), top).otherwise((i - 0.3175) / (n + 0.365))
    return rows.withColumn("quantile", normal_quantile(median))


def qq_fit(points: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares line through the points and its correlation."""
    return points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        steady_round(F.regr_slope("value", "quantile"), 5).alias("slope"),
        steady_round(F.regr_intercept("value", "quantile"), 5).alias("intercept"),
        steady_round(F.corr("value", "quantile"), 5).alias("r"),
    )
