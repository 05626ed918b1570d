"""Special ids and padding for token-id sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Reserved token ids.
PAD_ID, BOS_ID, EOS_ID, UNK_ID, SEP_ID = 0, 1, 2, 3, 4


def _one(token_id: int) -> Column:
    return F.array(F.lit(token_id))


def frame_sequences(df: DataFrame, source: str, target: str, max_len: int) -> DataFrame:
    """Encoder input ``BOS+s+SEP``, decoder input ``BOS+t`` and target ``t+EOS``."""
    s = F.slice(F.col(source), 1, max_len - 2)
    t = F.slice(F.col(target), 1, max_len - 2)
    return df.withColumns(
        {
            "enc_ids": F.concat(_one(BOS_ID), s, _one(SEP_ID)),
            "dec_in": F.concat(_one(BOS_ID), t),
            "dec_out": F.concat(t, _one(EOS_ID)),
        }
    )


def pad_batch(df: DataFrame, batch: str, cols: list[str], max_len: int) -> DataFrame:
    """Pad each column to the longest row of its batch, at most ``max_len``."""
    over = Window.partitionBy(batch)
    widths = {f"__w_{c}": F.least(F.max(F.size(c)).over(over), F.lit(max_len)) for c in cols}
    out = df.withColumns(widths)
    for c in cols:
        width = F.col(f"__w_{c}")
        kept = F.slice(F.col(c), 1, max_len)
        fill = F.array_repeat(F.lit(PAD_ID), F.greatest(width - F.size(kept), F.lit(0)))
        out = out.withColumn(c, F.concat(kept, fill))
    return out.drop(*widths)
