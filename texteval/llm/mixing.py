"""Mixing sources to target weights by entropy balancing.

Each source s gets a share of all words. Documents of a source are taken at the
rates r = min(3, exp(lambda_s * size / scale)) that stay closest to 1 in relative entropy
while their words add up to the target: the dual in lambda_s is convex, and Newton
steps (kept inside a bracket) solve it for all sources at once. The rates are then
rounded into whole copies.

Sizes and sources are counted once into a histogram (source, size, documents);
Newton and rounding work on the histogram, so a source that holds a third of all
documents is no heavier than its distinct sizes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from texteval.llm.shared import settle
from texteval.operators.order import with_position

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target): shares of all words by weight, capped at ``most`` times a source's words.

    The excess of capped sources goes to the others by weight, which ends where
    each target is min(cap, weight * level) for one level; sorted by cap / weight, the level
    follows from running sums. One row per source, so the windows hold sources only.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.get(cycle, (rank % len(weights)).cast("int")))
    per = per.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    every = Window.partitionBy(F.lit(0))
    rising = every.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(every)
    per = per.withColumn(
        "level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    )
    per = per.withColumn("open", F.col("cap") >= F.col("weight") * F.col("level"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(every)["level"]
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * level))
    return per.select("source", "source_size", target.alias("target"))


def tilts(cells: DataFrame, targets: DataFrame, most: int = MOST_COPIES, steps: int = 25) -> DataFrame:
    """(source, tilt, scale): the dual solution of each source, by Newton steps inside a bracket.

    ``scale`` is the source's largest size. Sources without words, and sources whose target is
    their cap, keep the tilt at the upper end of the bracket: every rate is ``most``.
    """
    state = targets.join(cells.groupBy("source").agg(F.max("size").alias("scale")), cells["source"].eqNullSafe(targets["source"])).select(
        targets["source"], "target", F.col("scale").cast("double"), F.lit(0.0).alias("tilt"),
        # at exp(lo * x) the smallest words vanish, at exp(hi * x) the smallest document is at the cap
        F.lit(-1e6).alias("lo"), (F.log(F.lit(float(most))) * F.col("scale") * 1.000001).alias("hi"), F.lit(False).alias("done"),
    )
    state = settle(state)
    for _ in range(steps):
        x = F.col("size") / F.col("scale")
        rate = F.least(F.lit(float(most)), F.exp(F.least(F.lit(50.0), F.col("tilt") * x)))
        slope = F.when(rate < most, rate * F.col("size") * x).otherwise(0.0)
        at = state.withColumnRenamed("source", "s")
        sums = (
            cells.join(at, cells["source"].eqNullSafe(at["s"]))
            .groupBy("s", "target", "scale", "tilt", "lo", "hi", "done")
            .agg(F.sum(F.col("n") * rate * F.col("size")).alias("got"), F.sum(F.col("n") * slope).alias("slope"))
        )
        low = F.when(F.col("got") <= F.col("target"), F.col("tilt")).otherwise(F.col("lo"))
        high = F.when(F.col("got") >= F.col("target"), F.col("tilt")).otherwise(F.col("hi"))
        newton = F.col("tilt") + (F.col("target") - F.col("got")) / F.when(F.col("slope") > 0, F.col("slope"))
        inside = (newton > F.col("lo")) & (newton < F.col("hi"))
        following = F.when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        close = F.col("done") | (F.abs(F.col("got") - F.col("target")) <= 1e-6 * F.col("target") + 1e-9)
        state = settle(
            sums.withColumn("lo", low).withColumn("hi", high).select(
                F.col("s").alias("source"), "target", "scale",
                F.when(close, F.col("tilt")).otherwise(following).alias("tilt"), "lo", "hi", close.alias("done"),
            )
        )
        if state.filter("not done").isEmpty():
            break
    return state.select("source", "tilt", "scale")


def _round_cells(most: int):
    def by_source(cells: pd.DataFrame) -> pd.DataFrame:
        # large sizes first, so that what rounding leaves over is made up by small documents
        cells = cells.sort_values("size", ascending=False, kind="stable")
        due, copies = 0.0, []
        for size, n, rate in zip(cells["size"], cells["n"], cells["rate"]):
            due += n * rate * size
            take = min(most * n, max(0, round(due / size)))
            copies.append(take)
            due -= take * size
        return cells.assign(copies=copies)[["source", "size", "copies"]]

    return by_source


def row_key() -> Column:
    """A hash that orders the rows of one source and size and finds a row again; equal texts of two sources differ in it."""
    return F.xxhash64("doc_id", "text", F.lit(11), "source", F.col("source").isNull())


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, row_key for every row of ``docs`` (doc_id, text, source).

    Null text has size 0 and is taken 0 times, as any text without a word; a null source is the
    last source; null and repeated doc_ids are rows like others; an empty table gives none.
    The order of rows of one (source, size) is a hash of doc_id, text and source, so reruns agree.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sizes = settle(docs.select("doc_id", "source", size.alias("size"), row_key().alias("__order")))
    targets = settle(source_targets(sizes, weights, most))
    cells = settle(sizes.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    solved = tilts(cells, targets, most).withColumnRenamed("source", "s")
    exponent = F.least(F.lit(50.0), F.col("tilt") * F.col("size") / F.col("scale"))
    rates = cells.join(solved, cells["source"].eqNullSafe(solved["s"])).select(
        "source", "size", "n", F.least(F.lit(float(most)), F.exp(exponent)).alias("rate")
    )
    rounded = rates.groupBy("source").applyInPandas(_round_cells(most), "source string, size long, copies long")
    rounded = rounded.join(cells.withColumnsRenamed({"source": "s", "size": "z"}), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    plan = settle(rounded.select(F.col("s"), F.col("z"), "copies", "n"))
    # copies of a cell: each document gets the whole part, the first ones in hash order one more
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-"))
    ranked = with_position(
        sizes.withColumn("__source", key), ["__source", "size"], ["__order", "doc_id"],
        F.shiftright("__order", 55), "__rank",
    ).drop("__source")
    whole, extra = F.floor(F.col("copies") / F.col("n")), F.col("copies") % F.col("n")
    copies = F.coalesce(whole + (F.col("__rank") <= extra).cast("long"), F.lit(0)).cast("long")
    taken = ranked.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left")
    taken = taken.select("doc_id", "source", "size", copies.alias("copies"), F.col("__order").alias("row_key"))
    per = targets.withColumnRenamed("source", "s")
    return taken.join(per, taken["source"].eqNullSafe(per["s"])).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "row_key"
    )


def take(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, columns as they are."""
    plan = mix(docs, weights, most).groupBy(F.col("doc_id").alias("__doc"), F.col("row_key").alias("__key")).agg(
        F.sort_array(F.collect_list("copies"), asc=False).alias("__copies")
    )
    plan = plan.filter(F.element_at("__copies", 1) > 0)
    keyed = docs.withColumn("__row", row_key())
    found = keyed.join(plan, keyed["doc_id"].eqNullSafe(plan["__doc"]) & (keyed["__row"] == plan["__key"]))
    # rows that repeat doc_id, text and source share the list of copies, one entry each, by a hash of all columns
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    nth = F.row_number().over(Window.partitionBy("__doc", "__key").orderBy(whole))
    often = found.withColumn("__nth", nth).withColumn("__times", F.get("__copies", F.col("__nth") - 1)).filter("__times > 0")
    return often.withColumn("__time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).select(*docs.columns)
