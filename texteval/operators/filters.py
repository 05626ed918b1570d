"""Row filters and the wide-to-long shape of metric tables."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from texteval.functions.text import is_error, is_footer
from texteval.operators.bounds import per_group
from texteval.sources.runs import METRIC_COLUMNS

# Science and technology keywords of the corpus filter.
STEM_KEYWORDS = [
    "computer", "software", "programming", "algorithm", "database",
    "operating system", "linux", "windows", "python", "java", "javascript",
    "compiler", "processor", "cpu", "gpu", "memory", "server", "cloud",
    "artificial intelligence", "machine learning", "neural network",
    "deep learning", "data structure", "binary", "boolean", "encryption",
    "cybersecurity", "firewall", "malware", "virus", "hacking",
    "network", "protocol", "internet", "wifi", "bluetooth", "ethernet",
    "router", "switch", "bandwidth", "frequency", "signal", "antenna",
    "satellite", "telecommunication", "5g", "4g", "lte", "wireless",
    "fiber optic", "tcp", "udp", "http", "dns", "ip address",
    "modulation", "spectrum", "radio", "broadcast", "transmission",
    "cellular", "mobile network", "base station",
    "circuit", "transistor", "diode", "resistor", "capacitor",
    "semiconductor", "microchip", "integrated circuit", "voltage",
    "current", "amplifier", "sensor", "arduino", "raspberry pi",
    "led", "lcd", "display", "battery", "power supply",
    "engineer", "engineering", "technology", "technical", "patent",
    "invention", "inventor", "laboratory", "experiment", "prototype",
    "manufacture", "industrial", "automation", "robot", "robotics",
    "mathematics", "equation", "theorem", "calculus", "algebra",
    "geometry", "statistics", "probability", "matrix", "vector",
    "physics", "quantum", "electromagnetic", "wavelength", "photon",
    "laser", "optics", "thermodynamic", "energy", "force",
    "biomedical", "nanotechnology", "aerospace", "mechanical",
    "electrical", "chemical engineering", "material science",
    "ieee", "iso", "ietf", "w3c", "ansi", "etsi",
    "standard", "specification", "protocol",
    "google", "microsoft", "apple", "intel", "amd", "nvidia",
    "cisco", "ibm", "samsung", "qualcomm", "huawei", "ericsson",
    "tesla", "spacex", "nasa", "esa",
]
# Metrics with a score in [0, 1], and the label and direction of each metric.
SCORE_COLUMNS = ["ROUGE_L", "METEOR", "BERTScore", "BLEU"]
METRICS = [
    ("ROUGE_L", "ROUGE-L", "higher"), ("METEOR", "METEOR", "higher"),
    ("BERTScore", "BERTScore", "higher"), ("BLEU", "BLEU", "higher"),
    ("Time_seconds", "Tiempo (Segundos)", "lower"), ("Coste_USD", "Coste (USD)", "lower"),
    ("CO2_gramos", "CO₂ (Gramos)", "lower"),
    ("Tokens_Input", "Tokens de Entrada", "lower"), ("Tokens_Output", "Tokens de Salida", "lower"),
]


def keyword_filter(
    df: DataFrame, cols: list[str], keywords: list[str] | None = None, mode: str = "substring"
) -> DataFrame:
    """Rows whose joined columns hold any keyword, ignoring case; rows with an empty column go.

    ``substring`` also matches inside words ("led" in "called"); ``word`` does not.
    """
    words = list(dict.fromkeys(k.lower() for k in (STEM_KEYWORDS if keywords is None else keywords)))
    pattern = "|".join(re.escape(w).replace("\\ ", " ") for w in words)
    if mode == "word":
        pattern = rf"(?:^|[^\p{{L}}\p{{N}}])(?:{pattern})(?:$|[^\p{{L}}\p{{N}}])"
    elif mode != "substring":
        raise ValueError(f"unknown mode {mode!r}")

    # one automaton for all keywords reads a text once; Java's regex tries them one by one
    @F.arrow_udf(T.BooleanType())
    def found(texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts, pattern)

    for c in cols:
        df = df.filter(F.length(c) > 0)
    return df.filter(found(F.lower(F.concat_ws(" ", *cols))))


def length_band(df: DataFrame, bands: dict[str, tuple[int, int]]) -> DataFrame:
    """Rows with every text strictly between its bounds."""
    for c, (low, high) in bands.items():
        df = df.filter((F.length(c) > low) & (F.length(c) < high))
    return df


def valid_rows(df: DataFrame, generated: str = "generated", first: str = "input") -> DataFrame:
    """Rows with a generation: neither an error nor a footer."""
    return df.filter(~is_error(F.col(generated)) & ~is_footer(F.col(first)))


def range_policy(df: DataFrame, cols: list[str] | None = None, policy: str = "drop_row_unit") -> DataFrame:
    """Out-of-range scores: drop the row, blank the cell, or leave them."""
    cols = [c for c in (cols or SCORE_COLUMNS) if c in df.columns]
    if policy == "none":
        return df
    if policy == "null_over_100":
        return df.withColumns({c: F.when(F.col(c) <= 100, F.col(c)) for c in cols})
    for c in cols:
        if policy == "drop_row_unit":
            df = df.filter(F.col(c).isNull() | ((F.col(c) >= 0) & (F.col(c) <= 1)))
        elif policy == "drop_over_1":
            df = df.filter(F.col(c).isNull() | (F.col(c) <= 1))
        else:
            raise ValueError(f"unknown policy {policy!r}")
    return df


def melt_metrics(df: DataFrame, ids: list[str], columns: list[str] | None = None) -> DataFrame:
    """Long form (ids, metric, value); null values are left out."""
    columns = [c for c in (columns or METRIC_COLUMNS) if c in df.columns]
    doubles = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return doubles.unpivot(ids, columns, "metric", "value").filter(F.col("value").isNotNull())


def describe_metrics(df: DataFrame) -> DataFrame:
    """Label and direction (higher or lower is better) of each metric; best added after aggregating."""
    label = F.create_map(*[F.lit(x) for m, text, _ in METRICS for x in (m, text)])
    better = F.create_map(*[F.lit(x) for m, _, way in METRICS for x in (m, way)])
    return df.withColumns(
        {
            "label": F.coalesce(F.element_at(label, F.col("metric")), F.col("metric")),
            "better": F.coalesce(F.element_at(better, F.col("metric")), F.lit("higher")),
        }
    )


def select_group(
    long: DataFrame, groups: DataFrame, min_models: int = 2, min_rows: int = 10, weight: str | None = None
) -> DataFrame:
    """Rows of the models and data sets in an experiment group; ``weight`` says how many rows each stands for.

    ``groups`` is the small table (grp, dataset, model, category, ord). A cell
    (grp, dataset, metric) stays when it has enough models and its smallest
    model has enough rows. Only counts are shuffled when the groups are few.
    """
    cell = ["grp", "dataset", "metric"]
    rows = long.join(groups, ["dataset", "model"])
    per_model = rows.groupBy(*cell, "model").agg(
        (F.count("value") if weight is None else F.sum(weight)).alias("n")
    )
    wanted = (
        per_model.groupBy(*cell)
        .agg(F.count(F.lit(1)).alias("models"), F.min("n").alias("n"))
        .filter((F.col("models") >= min_models) & (F.col("n") >= min_rows))
        .select(*cell)
    )
    return rows.join(per_group(wanted, groups), cell, "left_semi")


def missing_metrics(existing: DataFrame, results: DataFrame, required: list[str] | None = None) -> DataFrame:
    """One row per metric column still to be computed, with the reason.

    All of them when the stored table does not have one row per result.
    """
    required = required or METRIC_COLUMNS
    absent = [c for c in required if c not in existing.columns]
    counts = (
        existing.agg(F.count(F.lit(1)).alias("n"), F.lit("stored").alias("side"))
        .unionByName(results.agg(F.count(F.lit(1)).alias("n"), F.lit("valid").alias("side")))
        .agg(
            F.max(F.when(F.col("side") == "stored", F.col("n"))).alias("stored_rows"),
            F.max(F.when(F.col("side") == "valid", F.col("n"))).alias("result_rows"),
        )
    )
    stale = F.col("stored_rows") != F.col("result_rows")
    todo = F.when(stale, _texts(required)).otherwise(_texts(absent))
    return counts.select(
        "stored_rows", "result_rows",
        F.when(stale, F.lit("row count differs")).otherwise(F.lit("column absent")).alias("reason"),
        F.explode(todo).alias("metric"),
    )


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")
