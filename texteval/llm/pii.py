"""Personal data by pattern, and terms that give it away by co-occurrence.

Patterns find e-mail addresses, IP addresses, card and phone numbers: the protected entities. For
each term that occurs in documents of an entity, the corpus tells how much of the entity's information the term
carries: pointwise mutual information of term and entity, divided by the entity's own
information, 1 if the term never occurs without it. Terms above a threshold, seen with the
entity in different texts, are generalised wherever they occur; close to 1 they are removed.

Everything is SQL functions: matches come from ``regexp_extract_all``, their places from
the lengths of what ``split`` leaves between them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texteval.llm.shared import settle

#: Order in which spans of one start are listed; ``term`` are the spans that co-occurrence adds.
KINDS = ("email", "ip", "card", "phone", "term")

# A match begins at the start of its run or where the last match ended, which keeps the leftmost
# match and makes long runs linear; possessive repeats can't overflow the stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for its pattern to be tried.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_DIGITS = "regexp_replace({m}, '[^0-9]', '')"
_LUHN = (
    "aggregate(sequence(1, length({d})), 0, (s, i) -> s + case when i % 2 = 1 then int(substring(reverse({d}), i, 1)) "
    "else int(substring('0246813579', int(substring(reverse({d}), i, 1)) + 1, 1)) end) % 10 = 0"
)
VALID = {
    "email": "true",
    "ip": "forall(split({m}, '[.]'), p -> length(ltrim('0', p)) <= 2 or (length(ltrim('0', p)) = 3 and ltrim('0', p) <= '255'))",
    "card": f"length({_DIGITS}) <= 19 and {_LUHN.replace('{d}', _DIGITS)}",
    "phone": f"length({_DIGITS}) between 10 and 15",
}
TERM = r"\p{L}[\p{L}\p{N}'-]+"
#: Terms in more than one of so many documents are few: at most as many times a document's distinct terms.
COMMON = 1000
DISCLOSURE = 0.9
REMOVAL = 0.999
#: Bytes that a table joined with the texts may have so that it is broadcast and the texts stay where they are: a table's contents, and row numbers alone.
LIGHT = 16 << 20
LIGHT_ROWS = 128 << 20
_SPAN = "struct<start: bigint, kind: int, end: bigint, value: string>"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


# In the SQL below x['0'] is the text before a match, x['1'] the match, acc.at where the text before begins.
_START = "(acc.at + length(x['0']))"


def places(text: str, pattern: str, made: str, kind: str, wanted: str = "true") -> str:
    """SQL: ``made``, of type ``kind``, for each leftmost match in order that is ``wanted``."""
    pieces, matches = f"split({text}, {_quoted(pattern)}, -1)", f"regexp_extract_all({text}, {_quoted(pattern)}, 0)"
    return (
        f"aggregate(arrays_zip(slice({pieces}, 1, size({matches})), {matches}), "
        f"struct(0L as at, cast(array() as array<{kind}>) as out), (acc, x) -> struct("
        f"acc.at + length(x['0']) + length(x['1']) as at, "
        f"case when {wanted} then concat(acc.out, array({made})) else acc.out end as out), acc -> acc.out)"
    )


def _spans(text: str, kind: str) -> str:
    made = f"struct({_START} as start, {KINDS.index(kind)} as kind, {_START} + length(x['1']) as end, x['1'] as value)"
    every = places(text, PATTERNS[kind], made, _SPAN)
    hint = f"contains({text}, '{HINTS[kind]}')" if HINTS[kind] else f"{text} rlike '[0-9][ -]?[0-9]'"
    valid = VALID[kind].replace("{m}", "f.value")
    return f"case when {hint} then filter({every}, f -> {valid}) else cast(array() as array<{_SPAN}>) end"


def _own() -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all("free", F.lit(TERM), 0), F.lower))


def _beside(df: DataFrame, value: str | None, most: int) -> DataFrame:
    """A settled table (row, ``value``) to join texts with: broadcast if its size, which is counted, is at most ``most``."""
    each = F.lit(8) if value is None else F.length(F.col(value).cast("string")) + 8
    return F.broadcast(df) if (df.agg(F.sum(each)).first()[0] or 0) <= most else df


def entities(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, a row number, the pattern spans of each text, its entities, a hash of it, and the text with blanks for the spans.

    Null text has no spans. Settled.
    """
    rows = docs.select(*keys, F.coalesce("text", F.lit("")).alias("__text"))
    for kind in PATTERNS:
        rows = rows.withColumn(f"__{kind}", F.expr(_spans("__text", kind)))
    rows = rows.withColumn("base", F.array_sort(F.concat(*[f"__{kind}" for kind in PATTERNS])))
    own = (
        "array_distinct(transform(base, e -> struct(e.kind as kind, "
        "case when e.kind = 0 then lower(e.value) when e.kind = 1 then e.value else regexp_replace(e.value, '[^0-9]', '') end as entity)))"
    )
    free = (
        "case when size(base) = 0 then __text else aggregate(base, struct('' as out, 0L as at), (acc, s) -> case when s.end > acc.at then "
        "struct(concat(acc.out, substring(__text, int(acc.at) + 1, int(greatest(s.start - acc.at, 0L))), "
        "repeat(' ', int(s.end - greatest(s.start, acc.at)))) as out, s.end as at) else acc end, "
        "acc -> concat(acc.out, substring(__text, int(acc.at) + 1))) end"
    )
    return settle(rows.select(
        *keys, F.monotonically_increasing_id().alias("row"), "base", F.expr(own).alias("entities"),
        F.xxhash64("__text").alias("copy"), F.expr(free).alias("free"),
    ))


def disclosing_terms(found: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """(kind, entity, term, disclosure) of the terms to sanitise.

    Counts are documents, over the whole corpus, and terms those outside the patterns' spans; a pair counts if it
    occurs in two documents of different text, so that copies of one text are no evidence.
    """
    rows = found.count()
    # a term of one document is in no pair
    with_term = settle(
        found.select(F.explode(_own()).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).filter("n_term > 1")
    )
    holders = found.filter(F.size("entities") > 0)
    with_entity = settle(
        holders.select("copy", F.inline("entities")).groupBy("kind", "entity")
        .agg(F.count(F.lit(1)).alias("n_entity"), (F.min("copy") != F.max("copy")).alias("varied"))
        .filter("n_entity > 1 and varied").drop("varied")
    )
    held = settle(
        holders.select("row", F.inline("entities")).join(with_entity, ["kind", "entity"])
        .groupBy("row").agg(F.collect_list(F.struct("kind", "entity", "n_entity")).alias("held"))
    )

    # a term of n documents discloses at most log(rows / n) / log(rows / n_entity): pairs that can't reach it are not made
    def information(n: str) -> Column:
        return F.log(F.lit(float(rows)) / F.col(n))

    common = F.broadcast(with_term.filter(F.col("n_term") * COMMON > rows).withColumnRenamed("n_term", "n_common"))
    reaches = F.col("n_common").isNull() | (information("n_common") + 1e-9 >= information("n_entity") * disclosure)
    # terms too common for the most frequent entity are left out before any row moves
    most = with_entity.agg(F.max("n_entity")).first()[0]
    least = disclosure * math.log(rows / most) if most else 0.0
    own = (
        holders.select("row", "copy", F.explode(_own()).alias("term")).join(common, "term", "left")
        .filter(F.col("n_common").isNull() | (information("n_common") + 2e-9 >= least))
    )
    together = settle(
        own.join(_beside(held, "held", LIGHT), "row").select("copy", "term", "n_common", F.inline("held")).filter(reaches)
        .groupBy("kind", "entity", "term")
        .agg(F.count(F.lit(1)).alias("both"), F.max("n_entity").alias("n_entity"), (F.min("copy") != F.max("copy")).alias("varied"))
        .filter("both > 1 and varied").drop("varied")
    )
    informs = F.log(F.col("both") * rows / (F.col("n_entity") * F.col("n_term")))
    return (
        together.join(with_term, "term")
        .withColumn("disclosure", F.try_divide(informs, information("n_entity")))
        .filter(F.col("disclosure") >= disclosure)
        .select("kind", "entity", "term", "disclosure")
    )


def _listed(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, s -> concat(array({names})[s.kind], ':', s.start, ':', s.end)), ',')"


def scan(docs: DataFrame, keys: list[str], disclosure: float = DISCLOSURE, removal: float = REMOVAL) -> DataFrame:
    """``keys`` of each row of ``docs`` (and text), counts and spans of its personal data.

    n_email .. n_phone count the pattern spans and base_sha256 digests them; spans lists these and the
    spans of disclosing terms; ``found`` has them as structs with the mark that ``sanitise`` puts in
    their place. Null text is empty; repeated rows are rows of their own; an empty table gives no rows.
    """
    found = entities(docs, keys)
    marks = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    flagged = settle(disclosing_terms(found, disclosure).groupBy("term").agg(F.max("disclosure").alias("d")))
    # a flagged term is marked wherever it occurs, in documents without the entity too
    hits = settle(
        found.select("row", F.explode(_own()).alias("term")).join(flagged, "term")
        .groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "d"))).alias("hits"))
    )
    made = (
        f"struct({_START} as start, {len(KINDS) - 1} as kind, {_START} + length(x['1']) as end, "
        f"case when hits[lower(x['1'])] >= {removal} then '' else '[TERM]' end as mark)"
    )
    spans = places("free", TERM, made, "struct<start: bigint, kind: int, end: bigint, mark: string>", "map_contains_key(hits, lower(x['1']))")
    # few rows have hits, so their numbers go ahead and the other texts stay where they are
    few = _beside(hits.select("row"), None, LIGHT_ROWS)
    added = (
        found.select("row", "free").join(few, "row", "left_semi").join(_beside(hits, "hits", LIGHT), "row")
        .select("row", F.expr(spans).alias("terms"))
    )
    every = found.drop("free").join(added, "row", "left").withColumn(
        "found",
        F.expr(
            f"array_sort(concat(transform(base, b -> struct(b.start as start, b.kind as kind, b.end as end, array({marks})[b.kind] as mark)), "
            "coalesce(terms, cast(array() as array<struct<start: bigint, kind: int, end: bigint, mark: string>>))))"
        ),
    )
    counts = [F.expr(f"cast(size(filter(base, b -> b.kind = {k})) as bigint)").alias(f"n_{kind}") for k, kind in enumerate(PATTERNS)]
    return every.select(
        *keys, *counts, F.sha2(F.expr(_listed("base")), 256).alias("base_sha256"),
        F.expr(_listed("found")).alias("spans"), "found",
    )


def sanitise(text: str = "text", found: str = "found") -> str:
    """SQL: the text with each span replaced by its mark; overlapping spans are one, with the first mark."""
    return (
        f"aggregate({found}, struct('' as out, 0L as at), (acc, s) -> case when s.start >= acc.at then "
        f"struct(concat(acc.out, substring({text}, int(acc.at) + 1, int(s.start - acc.at)), s.mark) as out, s.end as at) "
        f"else struct(acc.out as out, greatest(acc.at, s.end) as at) end, acc -> concat(acc.out, substring({text}, int(acc.at) + 1)))"
    )
