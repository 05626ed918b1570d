"""Chat prompts as columns: messages, tuning text, repair attempts, context windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from texteval.functions.text import ellipsis, flatten_lines, strip

# Prompt pieces the runs share.
DATA_PREFIX = "Data: "
NO_THINK = "\n/no_think"
SYSTEM_GAP = "\n\n"
REFORMULATED = (
    "Data: The following is structured data. Please describe it in one sentence: "
)
PLAIN_RULE = "Output ONLY the final English sentence"
FIRM_RULE = (
    "You MUST output exactly one English sentence. Never output an empty response.\n"
    "Output ONLY the final English sentence"
)
REPAIR_TEMPERATURES = (0.3, 0.5, 0.7)
PLAIN_TEMPLATE = ("Sistema: ", "\nUsuario: ", "\nAsistente: ")
CONTEXT_MESSAGES = 10


def model_family(model: Column) -> Column:
    """``merged`` has no system role, ``thinking`` needs its reasoning switched off."""
    low = F.lower(model)
    thinking = (
        F.contains(low, F.lit("qwen3")) | F.contains(low, F.lit("qwen-3"))
        | F.contains(low, F.lit("qwen-1.7b")) | F.contains(low, F.lit("qwen-1_7b"))
        | F.contains(low, F.lit("qwen-0.6b"))
    )
    return (
        F.when(F.contains(low, F.lit("gemma")), F.lit("merged"))
        .when(thinking, F.lit("thinking"))
        .otherwise(F.lit("plain"))
    )


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def message_list(system: Column, user: Column, family: Column, mark_thinking: bool = True) -> Column:
    """array<struct<role, content>> in the form the family expects."""
    asked = F.when(family == "thinking", F.concat(user, F.lit(NO_THINK))).otherwise(user) if mark_thinking else user
    merged = F.array(_message("user", F.concat(system, F.lit(SYSTEM_GAP), user)))
    return F.when(family == "merged", merged).otherwise(
        F.array(_message("system", system), _message("user", asked))
    )


def chat_messages(
    df: DataFrame, system: str, user: str = "input", model: str = "model", prefix: str = ""
) -> DataFrame:
    """Add ``messages`` for each row's model."""
    content = F.concat(F.lit(prefix), F.col(user)) if prefix else F.col(user)
    return df.withColumn("messages", message_list(F.lit(system), content, model_family(F.col(model))))


def render(messages: Column) -> Column:
    """Messages as text, one ``role: content`` block each."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def sft_export(
    df: DataFrame,
    assigned: DataFrame,
    system: str,
    model: str,
    template: Column | None = None,
    splits: tuple[str, ...] = ("train", "val"),
    id_col: str = "id",
) -> DataFrame:
    """(id, split, messages, text) for supervised tuning; blank rows are dropped.

    ``template`` renders the ``messages`` column; the fallback is a plain
    system/user/assistant layout.
    """
    question, answer = strip(F.col("question")), strip(F.col("answer"))
    rows = df.filter((F.length(question) > 0) & (F.length(answer) > 0))
    rows = rows.join(assigned.filter(F.col("split").isin(*splits)).select(id_col, "split"), id_col)
    turns = message_list(F.lit(system), question, model_family(F.lit(model)), mark_thinking=False)
    rows = rows.withColumn("messages", F.concat(turns, F.array(_message("assistant", answer))))
    s, u, a = PLAIN_TEMPLATE
    plain = F.concat(F.lit(s + system + u), question, F.lit(a), answer)
    return rows.select(id_col, "split", "messages", (plain if template is None else template).alias("text"))


def attempt_list(
    system: str,
    user_prefix: str = DATA_PREFIX,
    last_prefix: str = REFORMULATED,
    firm_system: str | None = None,
    max_chars: int | None = None,
) -> Column:
    """array<struct<attempt, temperature, system, user>> for the row's ``input``."""
    firm = firm_system if firm_system is not None else system.replace(PLAIN_RULE, FIRM_RULE)
    text = F.col("input")
    data = flatten_lines(text if max_chars is None else ellipsis(text, max_chars))
    prefixes = (user_prefix, user_prefix, last_prefix)
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("attempt"),
                F.lit(t).alias("temperature"),
                F.lit(firm).alias("system"),
                F.concat(F.lit(p), data).alias("user"),
            )
            for i, (t, p) in enumerate(zip(REPAIR_TEMPERATURES, prefixes), 1)
        ]
    )


def repair_attempts(failed: DataFrame, system: str, **options) -> DataFrame:
    """Three attempts per failed row: warmer each time, the last one reworded."""
    return failed.select("*", F.inline(attempt_list(system, **options)))


def context_window(messages: DataFrame, conv: str, order: str, n: int = CONTEXT_MESSAGES) -> DataFrame:
    """The last ``n`` messages of each conversation without its system turns.

    ``row_number() <= n`` is cut down in every task before the shuffle.
    """
    latest = Window.partitionBy(conv).orderBy(F.desc(order))
    return (
        messages.withColumn("__back", F.row_number().over(latest))
        .filter(F.col("__back") <= n)
        .filter(F.col("role") != "system")
        .drop("__back")
    )


def last_user_turn(messages: DataFrame, conv: str, order: str) -> DataFrame:
    """The last user message per conversation; the last of any role if there is none."""
    pick = F.struct((F.col("role") == "user").alias("user"), F.col(order).alias("at"))
    best = messages.groupBy(conv).agg(F.max(pick).alias("p")).select(conv, F.col("p.at").alias(order))
    return messages.join(best, [conv, order], "left_semi")


def run_matrix(datasets: DataFrame, models: list[str], dataset: str = "dataset") -> DataFrame:
    """One row per data set and model; ``models`` is the registry's short list."""
    names = datasets.select(dataset).distinct()
    return names.select(dataset, F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
