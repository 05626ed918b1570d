"""Paired comparison of models.

``paired`` is (cell..., item_id, model, ord, value) with every model present for
every item. Rows are only ever grouped by item or counted by value; the tests
themselves are formulas over one small row per model, pair or cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from texteval.functions.numbers import significant, steady_round
from texteval.functions.labels import effect_class, p_stars
from texteval.functions.special import chi2_sf, f_sf, studentized_range_sf
from texteval.operators.distribution import ranked_values, value_counts
from texteval.operators.joins import model_pairs
from texteval.operators.order import null_safe_join
from texteval.operators.splits import paired_subsample
from texteval.operators.windows import item_ranks, mean_ranks

# Level, sizes and seed of the tests.
ALPHA = 0.05
MIN_ROWS = 10
BOOTSTRAP_REPLICATES = 10_000
SEED = 42
#: Groups whose replicates a task holds at once.
HELD_GROUPS = 256
#: Distinct values that one leaf of the resampling tree has on average.
LEAF_VALUES = 500


def friedman(
    paired: DataFrame, cell: list[str], items: int | None = None, seed: int = SEED, item: str = "item_id"
) -> DataFrame:
    """Tie-corrected Friedman chi-square per cell, on all items, or on a sample of ``items`` of them.

    Null when every rank is tied. Cells need two models and ten items.
    """
    used = paired if items is None else paired_subsample(paired, cell, items, seed, item)
    per_model = item_ranks(used, cell, ascending=True, item=item).groupBy(*cell, "model").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum("rank").alias("rank_sum"),
        # each row of a tie of t adds t^2 - 1, so a tie adds t^3 - t
        F.sum((F.col("tied") * F.col("tied") - 1).cast("double")).alias("ties"),
    )
    sums = per_model.groupBy(*cell).agg(
        F.count(F.lit(1)).cast("double").alias("k"),
        F.max("n").alias("n"),
        F.sum(F.col("rank_sum") * F.col("rank_sum")).alias("squares"),
        F.sum("ties").alias("ties"),
    ).filter((F.col("k") >= 2) & (F.col("n") >= MIN_ROWS))
    k, n = F.col("k"), F.col("n")
    plain = F.lit(12.0) / (n * k * (k + 1)) * F.col("squares") - 3 * n * (k + 1)
    correction = 1 - F.col("ties") / (n * k * (k * k - 1))
    stat = F.when(correction > 1e-12, plain / correction)
    return sums.withColumn("chi2", steady_round(stat, 6)).select(
        *cell,
        k.cast("long").alias("k"),
        n.cast("long").alias("n"),
        "chi2",
        F.when(F.col("chi2").isNotNull(), chi2_sf("chi2", k - 1)).alias("p"),
    )


def anova(paired: DataFrame, cell: list[str]) -> DataFrame:
    """One-way F test between the models of a cell."""
    per_model = paired.groupBy(*cell, "model").agg(
        F.count("value").cast("double").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")
    )
    within_cell = Window.partitionBy(*cell)
    middle = F.sum(F.col("n") * F.col("m")).over(within_cell) / F.sum("n").over(within_cell)
    grand = per_model.withColumn("off", F.col("m") - middle).groupBy(*cell).agg(
        F.count(F.lit(1)).cast("double").alias("k"),
        F.sum("n").alias("total"),
        F.sum(F.col("n") * F.col("off") * F.col("off")).alias("between"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
    ).filter(F.col("k") >= 2)
    f = (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("total") - F.col("k")))
    return (
        grand.withColumns({"F": steady_round(F.when(F.col("within") > 0, f), 5), "df_between": F.col("k") - 1, "df_within": F.col("total") - F.col("k")})
        .withColumn("p", F.when(F.col("F").isNotNull(), f_sf("F", "df_between", "df_within")))
        .select(*cell, F.col("df_between").cast("long"), F.col("df_within").cast("long"), "F", "p")
    )


def nemenyi(paired: DataFrame, cell: list[str], item: str = "item_id") -> DataFrame:
    """Rank distance of each model pair in studentised-range units, with p."""
    ranks = mean_ranks(paired, cell, ascending=True, item=item)
    return nemenyi_from_ranks(ranks, cell)


def nemenyi_from_ranks(ranks: DataFrame, cell: list[str]) -> DataFrame:
    """Nemenyi from (cell, model, ord, n, mean_rank): one row per model of the registry."""
    listed = ranks.groupBy(*cell).agg(
        F.array_sort(F.collect_list(F.struct("ord", "model", "mean_rank"))).alias("v"),
        F.max("n").cast("double").alias("n"),
    )
    first = listed.select(*cell, "n", "v", F.posexplode("v").alias("at", "a"))
    pairs = first.select(*cell, "n", F.size("v").cast("double").alias("k"), "a",
                         F.explode(F.slice("v", F.col("at") + 2, F.size("v"))).alias("b"))
    k, n = F.col("k"), F.col("n")
    distance = F.abs(F.col("a.mean_rank") - F.col("b.mean_rank"))
    q = distance / F.sqrt(k * (k + 1) / (6 * n)) * F.sqrt(F.lit(2.0))
    return pairs.select(
        *cell,
        F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b"),
        n.cast("long").alias("n"), k.cast("long").alias("k"),
        steady_round(q, 6).alias("q"),
    ).withColumn("p_adj", studentized_range_sf("q", F.col("k").cast("double")))


def wilcoxon_r(pairs: DataFrame, cell: list[str], ties: bool = True, digits: int = 10) -> DataFrame:
    """Signed-rank effect size per model pair.

    ``pairs`` is (cell, item, model_a, model_b, value_a, value_b). Differences
    are rounded to ``digits`` so that equal ones tie. Absolute differences are
    counted by value before they are ranked. The size divides by the root of all
    rows, zeros included, and is at most 1; below ten rows it is 0.
    """
    keys = [*cell, "model_a", "model_b"]
    d = pairs.withColumn("d", F.round(F.col("value_a") - F.col("value_b"), digits))
    rows = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        steady_round(F.avg("value_a") - F.avg("value_b"), 6).alias("mean_diff"),
    )
    size = d.filter(F.col("d") != 0).withColumn("value", F.abs("d"))
    ranked = ranked_values(size, keys, "value", up=F.sum((F.col("d") > 0).cast("long")))
    cnt = F.col("cnt").cast("double")
    rank = F.col("below") + (cnt + 1) / 2
    sums = ranked.groupBy(*keys).agg(
        F.max("n").cast("double").alias("m"),
        F.sum(rank * F.col("up")).alias("w_up"),
        F.sum(rank * (F.col("cnt") - F.col("up"))).alias("w_down"),
        F.sum(cnt * cnt * cnt - cnt).alias("tied"),
    )
    m = F.col("m")
    mu = m * (m + 1) / 4
    corrected = m * (m + 1) * (2 * m + 1) - (F.col("tied") / 2 if ties else F.lit(0.0))
    sigma = F.sqrt(corrected / 24)
    z = F.abs(F.least("w_up", "w_down") - mu) / sigma
    usable = (F.col("n") >= MIN_ROWS) & (F.col("m") >= (1 if ties else 2)) & (sigma > 0)
    r = F.when(usable, F.least(z / F.sqrt(F.col("n").cast("double")), F.lit(1.0))).otherwise(F.lit(0.0))
    return null_safe_join(rows, sums, keys, "left").select(
        *keys, "n", "mean_diff", F.coalesce(m.cast("long"), F.lit(0)).alias("n_nonzero"), steady_round(r, 6).alias("r")
    ).withColumn("effect", effect_class(F.col("r")))


def posthoc(paired: DataFrame, cell: list[str], alpha: float = ALPHA, item: str = "item_id") -> DataFrame:
    """Per model pair: mean difference, adjusted p, effect size and labels."""
    keys = [*cell, "model_a", "model_b"]
    ranks = nemenyi(paired, cell, item).select(*keys, "q", "p_adj")
    sizes = wilcoxon_r(model_pairs(paired, cell, item), cell)
    return null_safe_join(sizes, ranks, keys).select(
        *keys, "n", "mean_diff", "q", "p_adj",
        (F.col("p_adj") < alpha).alias("significant"),
        "r", "effect", p_stars(F.col("p_adj")).alias("stars"),
    )


def cd_groups(ranks: DataFrame, pairs: DataFrame, cell: list[str], alpha: float = ALPHA, p: str = "p_adj") -> DataFrame:
    """Longest runs of neighbouring models whose end points do not differ.

    p falls with rank distance, so a run whose ends agree agrees throughout.
    Both inputs have at most one row per model (pair) of the registry.
    """
    placed = ranks.withColumn(
        "place", F.row_number().over(Window.partitionBy(*cell).orderBy("mean_rank", "ord"))
    ).select(*cell, "model", "place")
    a = placed.withColumnsRenamed({"model": "model_a", "place": "pa"})
    b = placed.withColumnsRenamed({"model": "model_b", "place": "pb"})
    spans = (
        null_safe_join(null_safe_join(pairs.filter(F.col(p) >= alpha), a, [*cell, "model_a"]), b, [*cell, "model_b"])
        .select(*cell, F.least("pa", "pb").alias("first"), F.greatest("pa", "pb").alias("last"))
    )
    reach = spans.groupBy(*cell, "first").agg(F.max("last").alias("last"))
    earlier = Window.partitionBy(*cell).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    longest = (
        reach.withColumn("__covered", F.coalesce(F.max("last").over(earlier), F.lit(0)))
        .filter(F.col("last") > F.col("__covered"))
        .drop("__covered")
    )
    members = null_safe_join(longest, placed, cell).filter(F.col("place").between(F.col("first"), F.col("last")))
    return members.groupBy(*cell, "first", "last").agg(
        F.count(F.lit(1)).alias("size"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("place", "model"))), lambda m: m["model"]), " | "
        ).alias("models"),
    ).select(*cell, F.col("first").cast("long"), F.col("last").cast("long"), "size", "models")


def _split_draws(draws: np.ndarray, counts: np.ndarray, group: int, node: int, place: int = 1) -> Iterator[np.ndarray]:
    """Draws of each count, in order: halves of the counts share what their node got, by a binomial draw."""
    if len(counts) == 1:
        yield draws
        return
    half = len(counts) // 2
    left = _left_draws(draws, int(counts[:half].sum()), int(counts.sum()), group, node, place)
    yield from _split_draws(left, counts[:half], group, node, 2 * place)
    yield from _split_draws(draws - left, counts[half:], group, node, 2 * place + 1)


def _left_draws(draws: np.ndarray, left: int, both: int, group: int, node: int, place: int = 0) -> np.ndarray:
    """The part of the draws that goes left, from a generator that only the group and the place in the tree choose."""
    key = np.array([group & (2**64 - 1), (node << 24) + place & (2**64 - 1)], dtype=np.uint64)
    return np.random.Generator(np.random.Philox(key=key)).binomial(draws, left / both)


def bootstrap_sums(long: DataFrame, keys: list[str], replicates: int = BOOTSTRAP_REPLICATES, seed: int = SEED) -> DataFrame:
    """(keys..., n, replicate, drawn, total): rows drawn and their sum in each replicate of each group of ten rows or more.

    A replicate draws exactly n rows, so the draws of the distinct values are multinomial. They are made in a tree:
    values are dealt to leaves of about ``LEAF_VALUES`` by a hash, and each node shares its draws between its
    halves by a binomial draw. A leaf finds its own draws on its way down from the root, with the same numbers as
    its neighbours, so no group is in one task, and a lost task draws the same again. A task adds up its draws,
    and hands over one sum per group and replicate.
    """
    counts = value_counts(long, keys)
    size = counts.groupBy(*keys).agg(F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("__values"))
    leaves = F.greatest(F.ceil(F.log2(F.col("__values") / F.lit(float(LEAF_VALUES)))), F.lit(0)).cast("int")
    size = size.filter(F.col("n") >= MIN_ROWS).withColumn("__depth", leaves).drop("__values")
    dealt = null_safe_join(counts, size, keys).withColumn(
        "__leaf", F.expr(f"pmod(xxhash64(value, {int(seed)}), shiftleft(1L, __depth))")
    )
    leaf = dealt.groupBy(*keys, "n", "__depth", "__leaf").agg(
        F.array_sort(F.collect_list(F.struct("value", "cnt"))).alias("values"), F.sum("cnt").alias("__cnt")
    )
    # nodes by level, the root's being 0; a leaf needs the counts of the nodes it passes and of their left halves
    level = F.explode(F.sequence(F.lit(0), F.col("__depth"))).alias("__level")
    ways = leaf.select(*keys, "n", "__depth", "__leaf", "__cnt", level)
    node = F.expr("shiftright(__leaf, __depth - __level)")  # leaves are numbered from the left
    nodes = ways.groupBy(*keys, "__level", node.alias("__node")).agg(F.sum("__cnt").alias("__both"))
    halves = nodes.select(
        *keys, (F.col("__level") - 1).alias("__level"), F.shiftright("__node", 1).alias("__node"),
        F.when(F.col("__node") % 2 == 0, F.col("__both")).otherwise(0).alias("__left"),
    ).groupBy(*keys, "__level", "__node").agg(F.sum("__left").alias("__left"))
    passed = null_safe_join(nodes, halves, [*keys, "__level", "__node"])
    steps = null_safe_join(
        ways.filter("__level < __depth").withColumn("__node", node), passed, [*keys, "__level", "__node"]
    )
    path = steps.groupBy(*keys, "__leaf").agg(F.array_sort(F.collect_list(F.struct(
        F.col("__level").alias("level"), F.col("__node").alias("node"), F.col("__left").alias("left"), F.col("__both").alias("both"),
        F.expr("shiftright(__leaf, __depth - __level - 1) % 2 = 1").alias("right"),
    ))).alias("path"))
    rows = null_safe_join(leaf, path, [*keys, "__leaf"], "left").select(
        F.struct(*keys).alias("group"), F.xxhash64(F.lit(seed), *keys).alias("key"), "n", F.col("__depth").alias("depth"),
        F.col("__leaf").alias("leaf"), F.coalesce("path", F.array().cast(path.schema["path"].dataType)).alias("path"), "values",
    )

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, sums = None, {}

        def handed_over() -> pa.RecordBatch:
            groups = pa.array([dict(zip([*keys, "n"], g)) for g in sums], kind)
            drawn, total = (pa.array([list(s[k]) for s in sums.values()], pa.list_(pa.float64())) for k in (0, 1))
            sums.clear()
            return pa.RecordBatch.from_arrays([groups, drawn, total], ["group", "drawn", "total"])

        for batch in batches:
            group_type = batch.schema.field("group").type
            kind = pa.struct([*(group_type.field(i) for i in range(group_type.num_fields)), pa.field("n", pa.int64())])
            for group, key, n, depth, leaf, path, values in zip(*(column.to_pylist() for column in batch.columns)):
                draws = np.full(replicates, n, dtype=np.int64)
                for step in path:
                    left = _left_draws(draws, step["left"], step["both"], key, (1 << step["level"]) + step["node"])
                    draws = draws - left if step["right"] else left
                added = sums.setdefault((*group.values(), n), np.zeros((2, replicates)))
                x, cnt = (np.array([v[c] for v in values]) for c in ("value", "cnt"))
                for value, weights in zip(x, _split_draws(draws, cnt, key, (1 << depth) + leaf)):
                    added[0] += weights
                    added[1] += weights * value
                if len(sums) >= HELD_GROUPS:
                    yield handed_over()
        if sums:
            yield handed_over()

    kind = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in rows.schema["group"].dataType.fields)
    parts = rows.mapInArrow(draw, f"`group` struct<{kind}, n: bigint>, drawn array<double>, total array<double>")
    sums = parts.select("group", F.posexplode(F.arrays_zip("drawn", "total")).alias("replicate", "s"))
    return sums.groupBy("group", "replicate").agg(
        F.sum("s.drawn").cast("long").alias("drawn"), F.sum("s.total").alias("total")
    ).select("group.*", "replicate", "drawn", "total")


def bootstrap_ci(
    long: DataFrame,
    keys: list[str],
    replicates: int = BOOTSTRAP_REPLICATES,
    alpha: float = ALPHA,
    seed: int = SEED,
) -> DataFrame:
    """Percentile interval of the mean per group, by ``bootstrap_sums``; groups below ten rows are skipped."""
    counts = value_counts(long, keys)
    size = counts.groupBy(*keys).agg(
        F.sum("cnt").alias("n"), (F.sum(F.col("value") * F.col("cnt")) / F.sum("cnt")).alias("mean")
    ).filter(F.col("n") >= MIN_ROWS)
    means = bootstrap_sums(long, keys, replicates, seed).select(*keys, (F.col("total") / F.col("n")).alias("value"))
    # at most one row per replicate, a fixed number
    bounds = means.groupBy(*keys).agg(
        F.percentile("value", F.lit(alpha / 2)).alias("ci_low"),
        F.percentile("value", F.lit(1 - alpha / 2)).alias("ci_high"),
    )
    return null_safe_join(size, bounds, keys).select(
        *keys, "n", *[significant(c).alias(c) for c in ("mean", "ci_low", "ci_high")],
        significant(F.col("ci_high") - F.col("ci_low")).alias("ci_width"),
    )
