"""Question-and-answer corpora."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from texteval.functions.text import strip

# The column names of the corpus file.
QA_SCHEMA = "id long, asignatura string, tema string, subtema string, pregunta string, respuesta string"
QA_NAMES = {
    "asignatura": "subject",
    "tema": "topic",
    "subtema": "subtopic",
    "pregunta": "question",
    "respuesta": "answer",
}


def clean_qa(df: DataFrame, subject: str | None = None, limit: int | None = None) -> DataFrame:
    """Trim question and answer, drop rows that lack either."""
    if subject is not None:
        df = df.filter(F.col("subject") == subject)
    df = df.withColumns({c: strip(F.col(c)) for c in ("question", "answer")})
    df = df.filter((F.length("question") > 0) & (F.length("answer") > 0))
    if limit is not None:
        df = df.orderBy("id", "question", "answer").limit(limit)
    return df


def _cut_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of file blocks to records: ``whole`` ones, and parts of those that a block boundary cuts.

    A line begins a record if the quotes before it in its file are even in number; ``odd`` says whether those before its block
    are odd. The first record of a file is its header and is left out.
    """
    block, place, inside, kind = None, 0, False, "whole"
    lines: list[str] = []
    made: list[tuple] = []

    def end(part: str) -> None:
        nonlocal place
        if place or block[1] or part == "rest":
            made.append((*block, place, part, "\n".join(lines)))
        place += 1
        lines.clear()

    for batch in batches:
        for value, path, start, odd in zip(*(c.to_pylist() for c in batch.columns)):
            if (path, start) != block:
                if lines:
                    end("open" if kind == "whole" else "inner")
                block, place, inside = (path, start), 0, odd
                kind = "rest" if odd else "whole"
            elif not lines:
                kind = "whole"
            lines.append(value)
            inside ^= value.count('"') % 2 == 1
            if not inside:
                end(kind)
        yield _table(made)
        made.clear()
    if lines:
        end("open" if kind == "whole" else "inner")
        yield _table(made)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = ("path", "start", "place", "part", "text"), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], list(names))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(text): the records of CSV files with a header, read in parallel also where quoted fields hold line breaks.

    A first pass counts the quotes of each block of a file, as it is split for reading; their sums tell each block
    whether it begins inside quotes, so its task can cut it alone. Only the parts of records that lie over a boundary, at most two a
    block, meet in a shuffle. Blank lines between records are none.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("path", "start").agg(F.sum(quotes).alias("quotes"))
    odd = blocks.select("path", "start", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("odd"))
    # one row for each split of the files
    cut = lines.join(F.broadcast(odd), ["path", "start"]).select("value", "path", "start", "odd").mapInArrow(
        _cut_records, "path string, start long, place long, part string, text string"
    )
    parts = cut.filter("part <> 'whole'")
    order = Window.partitionBy("path").orderBy("start", "place")
    joined = (
        parts.withColumn("record", F.sum((F.col("part") == "open").cast("int")).over(order))
        .groupBy("path", "record")
        .agg(F.array_sort(F.collect_list(F.struct("start", "place", "text"))).alias("parts"))
        .select(F.array_join("parts.text", "\n").alias("text"))
    )
    whole = cut.filter("part = 'whole'").select("text").unionByName(joined)
    return whole.select(F.regexp_replace("text", "\r$", "").alias("text")).filter(F.trim("text") != "")


def read_qa(
    spark: SparkSession, path: str, subject: str | None = None, limit: int | None = None
) -> DataFrame:
    """Read corpus files; quoted fields may hold line breaks, and a large file is still read by many tasks."""
    fields = F.from_csv("text", QA_SCHEMA, {"escape": '"'}).alias("row")
    raw = csv_records(spark, path).select(fields).select("row.*")
    return clean_qa(raw.withColumnsRenamed(QA_NAMES), subject, limit)
