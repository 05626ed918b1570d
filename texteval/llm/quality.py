"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document: the ledger holds the measurements and one failure bit per
rule. A policy is a version and a mask of the rules it applies, so a new policy, its
verdicts and its ablations need the ledger only, never the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texteval.llm.shared import WORD

SPAN = 5

#: Rules in the order of their bits: name and when a document fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "symbols": "10 * n_symbols > 3 * n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
    "few_letters": "4 * n_letters < word_chars",
}
BASE_RULES = ("few_words", "repeated_windows")
#: Policies by version: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {"v1": tuple(RULES), "base": BASE_RULES}


def mask_of(rules: tuple[str, ...]) -> int:
    return sum(1 << k for k, name in enumerate(RULES) if name in rules)


def _repeat_words(words: str, n: int) -> list[tuple[str, str]]:
    """Columns that end in the number of words covered by n-word windows that occur twice.

    A window's key is its hash, shifted up, with its position below; sorted keys
    put equal windows side by side, where their words are compared. Each repeated window covers the words up to the next one.
    """
    parts = ", ".join(f"__h[i + {k}]" for k in range(n))
    equal = "shiftright({0}, __bits) = shiftright(x, __bits) and slice({1}, cast({0} & __low as int) + 1, {2}) = slice({1}, cast(x & __low as int) + 1, {2})"
    before, after = (equal.format(f"get(__keys, j {s} 1)", words, n) for s in "-+")
    return [
        ("__h", f"transform({words}, w -> xxhash64(w))"),
        ("__bits", f"length(bin(size({words})))"),
        ("__low", "shiftleft(1L, __bits) - 1L"),
        ("__keys", f"case when size({words}) >= {n} then sort_array(transform(sequence(0, size({words}) - {n}), "
                   f"i -> shiftleft(xxhash64({parts}), __bits) | cast(i as long))) else cast(array() as array<long>) end"),
        ("__at", f"sort_array(transform(filter(__keys, (x, j) -> coalesce({before}, false) or coalesce({after}, false)), x -> x & __low))"),
        ("n_repeat_words", f"aggregate(transform(__at, (p, j) -> least({n}L, coalesce(get(__at, j + 1), p + {n}L) - p)), 0L, (a, b) -> a + b)"),
    ]


def measure(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The ledger of ``docs`` (keys and text): measurements and ``fail_bits``.

    Null text has no words, so it fails few_words only. Repeated rows are measured alike, other
    columns are left out, and an empty table gives an empty ledger.
    """
    spans = docs.select(
        *keys, F.coalesce("text", F.lit("")).alias("__text"),
    ).select(*keys, "__text", F.regexp_extract_all("__text", F.lit(WORD), 0).alias("__words"))
    for name, sql in _repeat_words("__words", SPAN):
        spans = spans.withColumn(name, F.expr(sql))
    lines = spans.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda line: line.rlike(WORD)))
    measured = lines.select(
        *keys,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("__lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("__text", r"\P{L}+", "")).cast("long").alias("n_letters"),
    )
    failed = [F.when(F.expr(when), F.lit(1 << k)).otherwise(F.lit(0)) for k, when in enumerate(RULES.values())]
    bits = failed[0]
    for more in failed[1:]:
        bits = bits.bitwiseOR(more)
    return measured.withColumn("fail_bits", bits.cast("long"))


def fails(policy: str) -> Column:
    """Whether a ledger row fails a rule of the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask_of(POLICIES[policy]))) != 0


def judge(ledger: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with base_failed, kept under a policy, and the policy's version."""
    base = F.col("fail_bits").bitwiseAND(F.lit(mask_of(BASE_RULES))) != 0
    return ledger.withColumns(
        {"base_failed": base, "kept": ~base & ~fails(policy), "policy": F.lit(policy)}
    )


def ablations(ledger: DataFrame) -> DataFrame:
    """Per policy and rule: documents that fail the rule, and those that only this rule rejects.

    Rows are counted by bit pattern first, at most 2 ** rules patterns; all policies and rules are
    read off the patterns by bitwise tests.
    """
    patterns = ledger.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    masks = ", ".join(f"struct('{v}' as policy, {mask_of(rules)}L as mask)" for v, rules in POLICIES.items())
    rules = ", ".join(f"struct('{name}' as rule, {1 << k}L as bit)" for k, name in enumerate(RULES))
    each = patterns.selectExpr("*", f"inline(array({masks}))").selectExpr("*", f"inline(array({rules}))")
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return (
        each.filter(F.col("mask").bitwiseAND(F.col("bit")) != 0)
        .groupBy("policy", "rule")
        .agg(
            F.sum(F.when(hit.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_fail"),
            F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(hit == 0, F.col("n")).otherwise(0)).alias("n_kept"),
        )
    )
