"""Result files of generation runs, read leniently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from texteval.functions.text import is_footer, strip
from texteval.operators.order import with_position

# The header of a result file.
RESULT_HEADER = ["Structured_Data", "Human_Reference", "LLM_Generated", "Time_per_row_seconds"]
CSV_FIELD = r'("(?:[^"]|"")*"|[^,]*)(?:,|$)'


def csv_fields(line: Column) -> Column:
    """Fields of one CSV line: quotes removed, doubled quotes undone."""
    # a line's last match is the empty one after its last field
    found = F.regexp_extract_all(line, F.lit(CSV_FIELD), F.lit(1))
    fields = F.when(F.endswith(line, F.lit(",")), found).otherwise(
        F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(1)))
    )

    def unquote(field: Column) -> Column:
        inner = F.regexp_replace(field, '^"|"$', "")
        return F.when(F.startswith(field, F.lit('"')), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(field)

    return F.transform(fields, unquote)


def parse_fields(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add ``fields``: trailing semicolons dropped, wholly quoted lines split again."""
    fields = csv_fields(F.regexp_replace(line, ";+$", ""))
    out = lines.withColumn("fields", fields)
    only = F.get("fields", 0)
    nested = (F.size("fields") == 1) & F.contains(only, F.lit(","))
    return out.withColumn("fields", F.when(nested, csv_fields(only)).otherwise(F.col("fields")))


def split_results(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, footers) from parsed fields.

    With more than four fields the middle ones belong to the generated text. A
    line with fewer than four fields is no result.
    """
    n = F.size("fields")
    footers = parsed.filter(is_footer(F.get("fields", 0))).select(
        *[c for c in parsed.columns if c != "fields"],
        F.get("fields", 0).alias("label"),
        F.nullif(F.coalesce(F.get("fields", 2), F.lit("")), F.lit("")).alias("text_value"),
        F.nullif(F.coalesce(F.get("fields", 3), F.lit("")), F.lit("")).alias("time_value"),
    )
    rows = parsed.filter(~is_footer(F.get("fields", 0)) & (n >= 4)).select(
        *[c for c in parsed.columns if c != "fields"],
        F.get("fields", 0).alias("input"),
        F.get("fields", 1).alias("reference"),
        F.array_join(F.slice("fields", 3, n - 3), ",").alias("generated"),
        strip(F.regexp_replace(F.element_at("fields", -1), '[";]', "")).alias("seconds"),
    )
    return rows, footers


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Read result files; ``file`` and ``seq`` (position in the file) identify a row."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__line"),
        F.col("value").alias("line"),
    )
    header = F.startswith(F.replace(F.col("line"), F.lit('"'), F.lit("")), F.lit(RESULT_HEADER[0] + ","))
    # a block of a file is read by one task, so it bounds what a task has to order
    lines = with_position(
        lines.filter(~header), ["file"], ["__start", "__line"], F.col("__start"), "seq"
    ).drop("__start", "__line")
    rows, footers = split_results(parse_fields(lines))
    return rows.drop("line"), footers.drop("line")
