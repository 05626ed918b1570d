"""Batch generation through an injected client.

``client_factory()`` is called once per partition and returns
``client(messages, temperature) -> text``; it may raise.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from texteval.functions.numbers import steady_round
from texteval.functions.text import (
    EMPTY_ANSWER,
    EMPTY_GENERATION,
    ERROR_PREFIX,
    flatten_lines,
    is_error,
    strip,
    strip_think,
)
from texteval.operators.joins import apply_repairs
from texteval.operators.prompts import attempt_list, message_list, model_family

Client = Callable[[list, float], str]


def _call(client: Client, messages: list, temperature: float, retries: int, backoff: tuple, sleep) -> tuple:
    """(text or None, last error, attempts made) with exponential waits between attempts."""
    wait, longest = backoff
    error = None
    for attempt in range(1, retries + 1):
        try:
            text = client(messages, temperature)
            if text and text.strip():
                return text, None, attempt
            error = None
        except Exception as problem:  # the client's errors are data
            error = str(problem)
        if attempt < retries:
            limited = error is not None and ("429" in error or "rate" in error.lower())
            sleep(min(wait * 2, longest) if limited else wait)
            wait = min(wait * 2, longest)
    return None, error, retries


def _add_columns(df: DataFrame) -> T.StructType:
    extra = [
        T.StructField("raw", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("attempts", T.LongType()),
        T.StructField("seconds", T.DoubleType()),
    ]
    return T.StructType([*df.schema.fields, *extra])


def generate(
    df: DataFrame,
    client_factory: Callable[[], Client],
    retries: int = 5,
    backoff: tuple[float, float] = (2.0, 60.0),
    temperature: float = 0.1,
    empty_policy: str = "error",
    partitions: int | None = None,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Add ``generated``, ``error``, ``attempts`` and ``seconds`` to rows with ``messages``.

    A row never fails the job: an exception becomes ``Error: <200 characters>``.
    ``partitions`` sets how many clients run at once. Write the result before
    using it twice, or the calls are made twice.
    """
    if partitions:
        df = df.repartition(partitions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = client_factory()
        for batch in batches:
            texts, errors, attempts, seconds = [], [], [], []
            for messages in batch["messages"]:
                turns = [(m["role"], m["content"]) for m in messages]
                start = time.perf_counter()
                text, error, made = _call(client, turns, temperature, retries, backoff, sleep)
                texts.append(text)
                errors.append(None if error is None else error[:200])
                attempts.append(made)
                seconds.append(round(time.perf_counter() - start, 4))
            yield batch.assign(raw=texts, error=errors, attempts=attempts, seconds=seconds)

    made = df.mapInPandas(run, schema=_add_columns(df))
    empty = F.lit(EMPTY_GENERATION if empty_policy == "mark" else EMPTY_ANSWER)
    text = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit(ERROR_PREFIX + " "), F.col("error")))
        .when(F.col("raw").isNull(), empty)
        .otherwise(strip(flatten_lines(strip_think(F.col("raw")))))
    )
    return made.withColumn("generated", text).drop("raw")


def repair(
    results: DataFrame,
    client_factory: Callable[[], Client],
    system: str,
    key: list[str],
    sleep: Callable[[float], None] = time.sleep,
    model: str = "model",
) -> DataFrame:
    """Try failed rows again with escalating prompts; successes replace the error.

    The attempts of a row are made one after the other in one task, and stop at
    the first answer.
    """
    failed = results.filter(is_error(F.col("generated"))).select(*key, "input", model)
    family = model_family(F.col(model))

    def step(a):
        turns = message_list(a["system"], a["user"], family)
        return F.struct(a["attempt"].alias("attempt"), a["temperature"].alias("temperature"), turns.alias("messages"))

    plans = failed.select(*key, F.transform(attempt_list(system), step).alias("plan"))
    schema = T.StructType(
        [plans.schema[k] for k in key]
        + [
            T.StructField("raw", T.StringType()),
            T.StructField("attempt", T.LongType()),
            T.StructField("seconds", T.DoubleType()),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = client_factory()
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                for step in row.plan:
                    start = time.perf_counter()
                    turns = [(m["role"], m["content"]) for m in step["messages"]]
                    text, _, _ = _call(client, turns, step["temperature"], 1, (0.0, 0.0), sleep)
                    if text is not None:
                        took = round(time.perf_counter() - start, 4)
                        out.append((*[getattr(row, k) for k in key], text, step["attempt"], took))
                        break
                    sleep(1.0)
            yield pd.DataFrame(out, columns=schema.names)

    answers = plans.mapInPandas(run, schema=schema).withColumn(
        "generated", strip(flatten_lines(strip_think(F.col("raw"))))
    )
    return apply_repairs(results, answers.filter(~is_error(F.col("generated"))), key)


def run_summary(rows: DataFrame, by: list[str], scores: list[str]) -> DataFrame:
    """Per run: times, valid and all rows, mean scores, total cost and CO2.

    Time counts every row; scores, cost and CO2 count valid ones.
    """
    ok = ~is_error(F.col("generated"))
    return rows.groupBy(*by).agg(
        steady_round(F.sum("seconds"), 4).alias("total_seconds"),
        steady_round(F.avg("seconds"), 4).alias("mean_seconds"),
        F.count_if(ok).alias("valid_rows"),
        F.count(F.lit(1)).alias("rows"),
        *[steady_round(F.avg(F.when(ok, F.col(s))), 4).alias(f"mean_{s}") for s in scores],
        steady_round(F.sum(F.when(ok, F.col("Coste_USD"))), 6).alias("total_cost"),
        steady_round(F.sum(F.when(ok, F.col("CO2_gramos"))), 4).alias("total_co2"),
    )
