"""Nested table and triple items flattened to (input, reference) text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from texteval.functions.text import ellipsis, flatten_lines


def _cell(table: Column, at: Column) -> Column:
    """The value at zero-based (row, column), null when out of range."""
    row, col = F.get(at, 0), F.get(at, 1)
    return F.get(F.get(table, row), col)["value"]


def _first_sentence(df: DataFrame) -> Column:
    """Both annotation shapes: a struct of an array, or an array of structs."""
    kind = df.schema["sentence_annotations"].dataType
    if isinstance(kind, T.StructType):
        return F.get(F.col("sentence_annotations.final_sentence"), 0)
    return F.get(F.col("sentence_annotations"), 0)["final_sentence"]


def flatten_tables(df: DataFrame) -> DataFrame:
    """Title, section and highlighted values as one line; rows without a reference are dropped."""
    cells = F.transform("highlighted_cells", lambda at: _cell(F.col("table"), at))
    shown = F.array_join(F.filter(cells, lambda v: v.isNotNull()), " | ")
    text = F.concat(
        F.lit("Title: "), F.coalesce("table_page_title", F.lit("")),
        F.lit(" | Section: "), F.coalesce("table_section_title", F.lit("")),
        F.lit(" | Highlighted Data: "), shown,
    )
    return (
        df.withColumns({"input": text, "reference": _first_sentence(df)})
        .drop("table", "highlighted_cells", "sentence_annotations", "table_page_title", "table_section_title")
        .filter(F.col("reference").isNotNull())
    )


def flatten_triples(df: DataFrame) -> DataFrame:
    """First triple set joined by `` | `` and the first lexicalisation."""
    triples = F.get(F.col("modified_triple_sets.mtriple_set"), 0)
    return df.withColumns(
        {"input": F.array_join(triples, " | "), "reference": F.get(F.col("lex.text"), 0)}
    ).drop("modified_triple_sets", "lex")


def normalise_pairs(df: DataFrame, max_chars: int | None = None, cr: str = "") -> DataFrame:
    """One-line texts; with ``max_chars``, a longer input is cut and marked with ``...``."""
    line = flatten_lines(F.col("input"), cr)
    return df.withColumns(
        {
            "input": line if max_chars is None else ellipsis(line, max_chars),
            "reference": flatten_lines(F.col("reference"), cr),
        }
    )
