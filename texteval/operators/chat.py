"""Chat history: conversations (id, title, updated_at, ...) and messages (id, conv_id, role, content, ts)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texteval.functions.text import ellipsis, strip

# Conversations kept and title length.
MAX_CONVERSATIONS = 20
TITLE_CHARS = 45


def list_conversations(conversations: DataFrame) -> DataFrame:
    """Newest first."""
    return conversations.orderBy(F.desc("updated_at"), "id")


def messages_of(messages: DataFrame, conv_id) -> DataFrame:
    """Messages of one conversation in time order."""
    return messages.filter(F.col("conv_id") == conv_id).orderBy("ts", "id")


def retain_latest(
    conversations: DataFrame, messages: DataFrame, keep: int = MAX_CONVERSATIONS
) -> tuple[DataFrame, DataFrame]:
    """The most recently updated conversations and their messages."""
    kept = conversations.orderBy(F.desc("updated_at"), "id").limit(keep)
    return kept, messages.join(kept.select(F.col("id").alias("conv_id")), "conv_id", "left_semi")


def upsert_latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key, the one with the highest version; versions of a key differ.

    The winner is found by a map-side ``max``, so a key that is rewritten very
    often costs one partial row per task.
    """
    latest = df.groupBy(key).agg(F.max(version).alias(version))
    return df.join(latest, [key, version], "left_semi")


def delete_conversations(
    conversations: DataFrame, messages: DataFrame, gone: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Without the conversations whose id is in ``gone`` and without their messages."""
    ids = gone.select("id").distinct()
    return (
        conversations.join(ids, "id", "left_anti"),
        messages.join(ids.withColumnRenamed("id", "conv_id"), "conv_id", "left_anti"),
    )


def titles(messages: DataFrame, chars: int = TITLE_CHARS) -> DataFrame:
    """Title per conversation: the start of its first user message."""
    first = (
        messages.filter((F.col("role") == "user") & (F.length(strip(F.col("content"))) > 0))
        .groupBy("conv_id").agg(F.min(F.struct("ts", "id")).alias("m"))
        .select("conv_id", F.col("m.id").alias("id"))
    )
    return messages.join(first, ["conv_id", "id"]).select(
        "conv_id", ellipsis(strip(F.col("content")), chars).alias("title")
    )
