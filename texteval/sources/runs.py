"""Run names and per-row metric files.

The model and data set of a run are read off its file name. Names, prefixes and
suffixes are data: pass other ones for other runs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from texteval.operators.order import with_position
from texteval.sources.tables import small_table

# Public data sets as file-name prefix and suffix, longest prefix first.
DATASET_PREFIXES = [("webnlg_", "WebNLG"), ("totto_", "ToTTo"), ("kelm_stem_", "KELM"), ("kelm_", "KELM")]
DATASET_SUFFIXES = [("_WebNLG", "WebNLG"), ("_ToTTo", "ToTTo"), ("_KELM", "KELM")]
# Model names as written in files (lower case) and as shown.
MODEL_NAMES = {
    "deepseek": "DeepSeek", "llama_70b": "Llama 70B", "qwen_72b": "Qwen 72B",
    "gemma_9b": "Gemma 9B", "llama_3b": "Llama 3B", "qwen_7b": "Qwen 7B",
    "gemma_3_1b": "Gemma 3 1B", "llama_1b": "Llama 1B",
    "qwen3_1.7b": "Qwen3 1.7B", "qwen3_1_7b": "Qwen3 1.7B", "gan": "GAN",
    "gemma_3_1b_ft": "Gemma 3 1B FT", "llama_1b_ft": "Llama 1B FT",
    "qwen3_1.7b_ft": "Qwen3 1.7B FT", "qwen3_1_7b_ft": "Qwen3 1.7B FT",
}
# Model ids of hosted runs, which end the file name.
HOSTED_MODELS = [
    ("deepseek-chat", "DeepSeek"),
    ("llama-3.3-70b-instruct", "Llama 70B"), ("llama-3_3-70b-instruct", "Llama 70B"),
    ("qwen-2.5-72b-instruct", "Qwen 72B"), ("qwen-2_5-72b-instruct", "Qwen 72B"),
    ("gemma-2-9b-it", "Gemma 9B"),
    ("llama-3.2-3b-instruct", "Llama 3B"), ("llama-3_2-3b-instruct", "Llama 3B"),
    ("qwen-2.5-7b-instruct", "Qwen 7B"), ("qwen-2_5-7b-instruct", "Qwen 7B"),
]
HOSTED_DATASETS = {"webnlg": "WebNLG", "totto": "ToTTo", "kelm_stem": "KELM", "kelm": "KELM"}
# Held-out runs of the domain corpus and the label of unknown names.
HELD_OUT_MARK = "_valtest"
UNKNOWN_DATASET = "unknown"
# What a name of the domain corpus, or of a public data set, contains.
DOMAIN_MENTIONS = ["ft_valtest", "gan_valtest"]
MENTIONS = [("webnlg", "WebNLG"), ("totto", "ToTTo"), ("kelm", "KELM")]
# US dollars per input and output token, and estimated energy per token, of each model.
PUBLIC_RATES = [
    ("DeepSeek", 0.0000008, 0.000002, 0.0000005),
    ("Llama 70B", 0.00000059, 0.00000079, 0.0000008),
    ("Qwen 72B", 0.00000059, 0.00000079, 0.0000008),
    ("Gemma 9B", 0.0000002, 0.0000002, 0.0000002),
    ("Llama 3B", 0.00000006, 0.00000006, 0.00000008),
    ("Qwen 7B", 0.0000002, 0.0000002, 0.0000002),
    ("Gemma 3 1B", 0.00000003, 0.00000003, 0.00000003),
    ("Gemma 3 1B FT", 0.00000003, 0.00000003, 0.00000003),
    ("Llama 1B", 0.00000001, 0.00000002, 0.00000003),
    ("Llama 1B FT", 0.00000001, 0.00000002, 0.00000003),
    ("Qwen3 1.7B", 0.00000005, 0.00000010, 0.00000004),
    ("Qwen3 1.7B FT", 0.00000005, 0.00000010, 0.00000004),
    ("GAN", 0.0, 0.0, 0.00000001),
]
METRIC_PREFIX = "metricas_por_fila_"
RESULT_PREFIX = "results_"
METRIC_COLUMNS = [
    "ROUGE_L", "METEOR", "BLEU", "BERTScore", "Time_seconds",
    "Tokens_Input", "Tokens_Output", "Coste_USD", "CO2_gramos",
]


@dataclass(frozen=True)
class RunNames:
    """The rules that turn a run name into model and data set.

    ``domain`` is the user's own corpus: its file prefix and its label.
    """

    domain_prefix: str = "qa_"
    domain_label: str = "QA"
    prefixes: list = field(default_factory=lambda: list(DATASET_PREFIXES))
    suffixes: list = field(default_factory=lambda: list(DATASET_SUFFIXES))
    models: dict = field(default_factory=lambda: dict(MODEL_NAMES))
    hosted: list = field(default_factory=lambda: list(HOSTED_MODELS))


def run_stem(file_name: Column) -> Column:
    """File name without folder, prefix and extension."""
    name = F.regexp_replace(file_name, r"^.*/", "")
    name = F.regexp_replace(name, r"\.csv$", "")
    return F.regexp_replace(name, f"^({METRIC_PREFIX}|{RESULT_PREFIX})", "")


def _model_label(raw: Column, models: dict) -> Column:
    entries = [F.lit(x) for pair in models.items() for x in pair]
    return F.coalesce(
        F.element_at(F.create_map(*entries), F.lower(raw)), F.replace(raw, F.lit("_"), F.lit(" "))
    )


def parse_run_name(stem: Column, names: RunNames = RunNames()) -> Column:
    """struct(model, dataset); the first rule that fits decides."""
    low = F.lower(stem)

    def found(raw: Column, dataset: Column) -> Column:
        return F.struct(_model_label(raw, names.models).alias("model"), dataset.alias("dataset"))

    rules = []
    for suffix, model in sorted(names.hosted, key=lambda h: -len(h[0])):
        rest = F.lower(stem.substr(F.lit(1), F.length(stem) - len(suffix) - 1))
        entries = [F.lit(x) for pair in HOSTED_DATASETS.items() for x in pair]
        dataset = F.coalesce(F.element_at(F.create_map(*entries), rest), rest)
        rules.append(
            (F.endswith(stem, F.lit("_" + suffix)),
             F.struct(F.lit(model).alias("model"), dataset.alias("dataset")))
        )
    rules.append(
        (F.contains(low, F.lit(HELD_OUT_MARK)),
         found(F.replace(stem, F.lit(HELD_OUT_MARK), F.lit("")), F.lit(names.domain_label)))
    )
    for prefix, label in [(names.domain_prefix, names.domain_label), *names.prefixes]:
        rules.append(
            (F.startswith(low, F.lit(prefix)),
             found(stem.substr(F.lit(len(prefix) + 1), F.length(stem)), F.lit(label)))
        )
    for suffix, label in names.suffixes:
        rules.append(
            (F.endswith(stem, F.lit(suffix)),
             found(stem.substr(F.lit(1), F.length(stem) - len(suffix)), F.lit(label)))
        )
    out = None
    for test, value in rules:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(
        F.struct(
            F.replace(stem, F.lit("_"), F.lit(" ")).alias("model"), F.lit(UNKNOWN_DATASET).alias("dataset")
        )
    )


def mentioned_dataset(stem: Column, names: RunNames = RunNames()) -> Column:
    """The data set that a run name mentions anywhere, in any case; null counts as unknown.

    Marks of the domain corpus come before those of public data sets, which come in the order of ``MENTIONS``. For
    names that follow no pattern of ``parse_run_name``.
    """
    low = F.coalesce(F.lower(stem), F.lit(""))
    domain = [names.domain_prefix.strip("_").lower(), *DOMAIN_MENTIONS]
    label = F.lit(UNKNOWN_DATASET)
    for mark, dataset in reversed([*((mark, names.domain_label) for mark in domain), *MENTIONS]):
        label = F.when(F.contains(low, F.lit(mark)), F.lit(dataset)).otherwise(label)
    return label


def public_rates(spark: SparkSession) -> DataFrame:
    """(model, price_in, price_out, kwh_per_token) of the known models, a small table for ``cost_and_co2``."""
    return small_table(spark, PUBLIC_RATES, "model string, price_in double, price_out double, kwh_per_token double")


def tag_runs(df: DataFrame, stem: str, registry: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(tagged rows, unmapped run names with their row counts).

    ``registry`` is a small table (pattern, model, dataset); without it the name
    rules decide and names of an unknown data set count as unmapped.
    """
    if registry is None:
        tagged = df.withColumn("__run", parse_run_name(F.col(stem))).select("*", "__run.*").drop("__run")
        known = F.col("dataset") != UNKNOWN_DATASET
    else:
        # the registry has a row per run; the planner broadcasts it when it is small
        tagged = df.join(registry.withColumnRenamed("pattern", stem), stem, "left")
        known = F.col("model").isNotNull()
    missing = tagged.filter(~known).groupBy(stem).agg(F.count(F.lit(1)).alias("rows"))
    return tagged.filter(known), missing


def numeric_metrics(df: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(metric rows as doubles, footer rows): a footer's first column holds no number."""
    columns = columns or METRIC_COLUMNS
    first = columns[0]
    footer = F.col(first).isNotNull() & F.col(first).try_cast("double").isNull()
    rows = df.filter(~footer).withColumns({c: F.col(c).try_cast("double") for c in columns if c in df.columns})
    return rows, df.filter(footer)


def load_metrics(
    spark: SparkSession,
    path: str,
    registry: DataFrame | None = None,
    layouts: dict[tuple, list[str]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Read every metric file under ``path``: (tagged rows, unmapped names).

    ``item_id`` is the position of a row in its file. Columns are matched by
    name, so a file may lack some; ``layouts`` (header to files) saves the scan
    that finds the headers.
    """
    out = None
    # one read per header layout, not per file
    for columns, files in (layouts or metric_layouts(spark, path)).items():
        schema = ", ".join(f"`{c}` string" for c in columns)
        part = spark.read.option("header", True).schema(schema).csv(files).select(
            "*",
            run_stem(F.col("_metadata.file_name")).alias("run"),
            F.col("_metadata.file_path").alias("__path"),
            F.col("_metadata.file_block_start").alias("__start"),
            F.monotonically_increasing_id().alias("__line"),
        )
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no {METRIC_PREFIX}*.csv under {path}")
    present = [c for c in METRIC_COLUMNS if c in out.columns]
    rows, _ = numeric_metrics(out, present)
    # a block of a file is read by one task, so it bounds what a task has to order; two folders may hold one name
    rows = with_position(rows, ["__path"], ["__start", "__line"], F.col("__start"), "item_id")
    return tag_runs(rows.drop("__path", "__start", "__line"), "run", registry)


def metric_layouts(spark: SparkSession, path: str) -> dict[tuple, list[str]]:
    """Metric files by their header; only header lines reach the driver, one per file."""
    heads = (
        spark.read.text(f"{path.rstrip('/')}/{METRIC_PREFIX}*.csv")
        .filter(F.col("value").rlike(f"^({'|'.join(METRIC_COLUMNS)})(,|$)"))
        .select(F.col("value"), F.col("_metadata.file_path").alias("file"))
        .distinct()
    )
    out: dict[tuple, list[str]] = {}
    for row in heads.collect():
        out.setdefault(tuple(row["value"].strip().split(",")), []).append(row["file"])
    return out
