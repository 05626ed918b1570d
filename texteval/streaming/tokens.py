"""Token streams of chat requests: (request_id, seq, ts, token[, last])."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from texteval.functions.text import ellipsis, strip, strip_think

# Reasoning tags, silence limit, labels.
OPEN_TAG, CLOSE_TAG = "<think>", "</think>"
SILENCE_SECONDS = 60
PROMPT_CHARS = 60
BACKENDS = {"device": "local (Android)", "desktop": "llama-server (local)", "server": "remote server"}
NO_BACKEND = "unknown"


def _held(text: str, tag: str) -> int:
    """Length of the longest end of ``text`` that may be the start of ``tag``."""
    return next((n for n in range(min(len(tag) - 1, len(text)), 0, -1) if tag.startswith(text[-n:])), 0)


def filter_step(buffer: str, inside: bool, token: str) -> tuple[str, bool, str]:
    """Feed one token: (new buffer, inside a block, text to show now)."""
    text, shown = buffer + token, ""
    while True:
        tag = CLOSE_TAG if inside else OPEN_TAG
        at = text.find(tag)
        if at < 0:
            keep = _held(text, tag)
            if not inside:
                shown += text[: len(text) - keep]
            return text[len(text) - keep :], inside, shown
        if not inside:
            shown += text[:at]
        text = text[at + len(tag) :]
        inside = not inside


def filter_think_stream(stream: DataFrame, silence_seconds: int | None = SILENCE_SECONDS) -> DataFrame:
    """Visible text chunks of each request as they arrive, reasoning removed.

    A finished request has a row, also if nothing of it is visible.

    State per request is what may still become a tag and whether a block is
    open, a few characters. Tokens of a request must reach a trigger in order of
    ``seq`` across triggers; inside one trigger they are sorted. A row with
    ``last`` true, or silence, flushes the rest; an unclosed block is dropped.
    Pass no silence limit to replay a stored stream: a limit by the clock keeps
    the query alive, so it never ends by itself.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, inside, seq = state.get if state.exists else ("", False, -1)
        if state.hasTimedOut:
            state.remove()
            rest = "" if inside else buffer
            yield pd.DataFrame({"request_id": [key[0]], "seq": [seq], "visible": [rest], "timed_out": [True]})
            return
        rows = pd.concat(list(batches)).sort_values("seq")
        out, finished = [], False
        for n, token, last in zip(rows["seq"], rows["token"], rows["last"]):
            seq = int(n)
            buffer, inside, shown = filter_step(buffer, inside, token or "")
            if last:
                shown += "" if inside else buffer
                finished = True
            if shown or last:
                out.append((key[0], seq, shown, False))
        if finished:
            state.remove()
        else:
            state.update((buffer, inside, seq))
            if silence_seconds is not None:
                state.setTimeoutDuration(silence_seconds * 1000)
        yield pd.DataFrame(out, columns=["request_id", "seq", "visible", "timed_out"])

    kind = stream.schema["request_id"].dataType.simpleString()
    return stream.groupBy("request_id").applyInPandasWithState(
        step,
        f"request_id {kind}, seq long, visible string, timed_out boolean",
        "buffer string, inside boolean, seq long",
        "append",
        GroupStateTimeout.NoTimeout if silence_seconds is None else GroupStateTimeout.ProcessingTimeTimeout,
    )


def land(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all there is now into ``folder`` and read its rows.

    The state and the read positions are kept beside the rows, so running it again goes on where it stopped. A batch that
    runs twice, after a failure, replaces its own rows. No batch gives no rows.
    """
    spark, rows = stream.sparkSession, f"{folder}/rows"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{rows}/batch={number}")

    query = (
        stream.writeStream.foreachBatch(write).outputMode("append")
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    where = spark._jvm.org.apache.hadoop.fs.Path(rows)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(rows).select(*stream.columns)


def visible_text(chunks: DataFrame) -> DataFrame:
    """Whole visible text per request from the chunks of ``filter_think_stream``."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "visible")))
    text = F.array_join(F.transform(ordered, lambda t: t["visible"]), "")
    return chunks.groupBy("request_id").agg(strip(text).alias("visible"))


def filter_think_batch(tokens: DataFrame) -> DataFrame:
    """Visible text per request; an answer has at most as many tokens as the model's limit."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "token")))
    text = F.array_join(F.transform(ordered, lambda t: t["token"]), "")
    return tokens.groupBy("request_id").agg(strip_think(text, None).alias("visible"))


def longest_silence(tokens: DataFrame) -> DataFrame:
    """Longest wait between tokens per request, in seconds."""
    order = Window.partitionBy("request_id").orderBy("seq")
    wait = _millis("ts") - _millis(F.lag("ts").over(order))
    return tokens.withColumn("__wait", wait).groupBy("request_id").agg(
        F.coalesce(F.max("__wait") / 1000.0, F.lit(0.0)).alias("longest_silence")
    )


def needs_retry(tokens: DataFrame, silence_seconds: int = SILENCE_SECONDS) -> DataFrame:
    """Requests to repeat without reasoning: nothing visible, or silent for too long."""
    joined = filter_think_batch(tokens).join(longest_silence(tokens), "request_id")
    late, blank = F.col("longest_silence") > silence_seconds, F.col("visible") == ""
    return joined.select(
        "request_id", blank.alias("blank"), late.alias("timed_out"), (blank | late).alias("retry")
    )


def request_outcomes(
    requests: DataFrame, tokens: DataFrame, as_of: Column, silence_seconds: int = SILENCE_SECONDS
) -> DataFrame:
    """How each request ended: (request_id, blank, timed_out, retry), one row for every request.

    A request is given up at the first silence that is longer than the limit: before its first token, between two
    tokens, or after the last one if none is marked ``last`` by ``as_of``. What comes later does not count.
    Blank means nothing visible until then. A request that is still running has no verdict yet: nulls.
    ``requests`` is (request_id, started_at), neither null; tokens of unknown requests are ignored.
    """
    listed = tokens.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("seq", "ts", "token", "last"))).alias("t"))
    rows = requests.select("request_id", "started_at").join(listed, "request_id", "left")
    limit = silence_seconds * 1_000_000
    times = F.concat(F.array(F.unix_micros("started_at")), F.coalesce(F.transform("t", lambda t: F.unix_micros(t["ts"])), F.array().cast("array<long>")))
    waits = F.transform(F.slice("times", 2, F.size("times") - 1), lambda t, i: t - F.get("times", i) > limit)
    # the place of the first wait that is too long, from 1; 0 if there is none
    rows = rows.withColumn("times", times).withColumn("given_up", F.array_position(waits, True))
    kept = F.when(F.col("given_up") > 0, F.slice("t", F.lit(1), (F.col("given_up") - 1).cast("int"))).otherwise(F.col("t"))
    text = F.coalesce(F.array_join(F.transform(kept, lambda t: F.coalesce(t["token"], F.lit(""))), ""), F.lit(""))
    finished = (F.col("given_up") == 0) & F.coalesce(F.exists("t", lambda t: t["last"]), F.lit(False))
    silent = ~finished & ((F.col("given_up") > 0) | (F.unix_micros(as_of) - F.element_at("times", -1) > limit))
    known = finished | silent
    rows = rows.select("request_id", strip_think(text, None).alias("visible"), silent.alias("timed_out"), known.alias("known"))
    return rows.select(
        "request_id",
        F.when(F.col("known"), F.col("visible") == "").alias("blank"),
        F.when(F.col("known"), F.col("timed_out")).alias("timed_out"),
        F.when(F.col("known"), (F.col("visible") == "") | F.col("timed_out")).alias("retry"),
    )


def request_outcomes_stream(
    requests: DataFrame, tokens: DataFrame, silence_seconds: int = SILENCE_SECONDS, late: str = "0 seconds",
    kept_seconds: int = 3600,
) -> DataFrame:
    """``request_outcomes`` as the events arrive: one row for each request, when it has ended.

    Starts and tokens are one stream. The state of a request is what may still become a tag, whether anything
    was visible, and the time of its last event; a timer in event time ends it when the watermark passes the silence limit, so
    requests without tokens and silence after the last one are found. An ended request is remembered for
    ``kept_seconds``, so that its late tokens don't begin a new one. Rows without a request_id only move the time on.
    """
    starts = requests.select(
        "request_id", F.lit(-1).cast("long").alias("seq"), F.col("started_at").alias("ts"),
        F.lit("").alias("token"), F.lit(False).alias("last"),
    )
    events = starts.unionByName(tokens.select("request_id", "seq", "ts", "token", "last")).filter("ts is not null")
    # rows without a request are many groups, not one
    salt = F.when(F.col("request_id").isNull(), F.pmod(F.xxhash64("ts"), F.lit(1024))).otherwise(F.lit(0))
    events = events.withColumns({"ms": F.unix_millis("ts"), "salt": salt}).withWatermark("ts", late)
    limit = silence_seconds * 1000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["request_id", "blank", "timed_out", "retry"]
        if pd.isna(key[0]):
            for _ in batches:
                pass
            return
        buffer, inside, shown, seen, ended = state.get if state.exists else ("", False, False, -1, False)
        out = []

        def end(silent: bool) -> None:
            blank = not shown and (inside or not buffer.strip())
            out.append((key[0], blank, silent, blank or silent))

        if state.hasTimedOut:
            if ended:
                state.remove()
                return
            end(True)
            ended = True
        else:
            rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
            for now, token, last in zip(rows["ms"].tolist(), rows["token"], rows["last"]):
                if ended:
                    break
                if seen >= 0 and now - seen > limit:
                    end(True)
                    ended = True
                    break
                seen = now
                buffer, inside, text = filter_step(buffer, inside, token or "")
                shown = shown or bool(text.strip())
                if last:
                    end(False)
                    ended = True
        state.update((buffer, inside, shown, seen, ended))
        due = max(seen + (kept_seconds * 1000 if ended else limit), state.getCurrentWatermarkMs() + 1)
        state.setTimeoutTimestamp(due)
        yield pd.DataFrame(out, columns=columns)

    kind = tokens.schema["request_id"].dataType.simpleString()
    return events.groupBy("request_id", "salt").applyInPandasWithState(
        step,
        f"request_id {kind}, blank boolean, timed_out boolean, retry boolean",
        "buffer string, inside boolean, shown boolean, seen long, ended boolean",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def _millis(ts: str | Column) -> Column:
    return F.unix_micros(ts) / 1000.0


def request_metrics(tokens: DataFrame, requests: DataFrame) -> DataFrame:
    """Token count, time to the first token, total time and tokens per second.

    ``requests`` is (request_id, started_at, ended_at, prompt, backend). A request
    without tokens counts its total time as time to the first token.
    """
    return _measured(requests.join(token_counts(tokens), "request_id", "left"))


def _measured(joined: DataFrame) -> DataFrame:
    total = _millis("ended_at") - _millis("started_at")
    first = F.coalesce(_millis("first_token") - _millis("started_at"), total)
    made = F.coalesce("tokens", F.lit(0))
    labels = F.create_map(*[F.lit(x) for pair in BACKENDS.items() for x in pair])
    return joined.select(
        "request_id",
        F.col("started_at").alias("timestamp"),
        ellipsis(F.col("prompt"), PROMPT_CHARS).alias("prompt"),
        made.alias("tokens"),
        F.round(first, 3).alias("first_token_ms"),
        F.round(total, 3).alias("total_ms"),
        F.round(F.when(total > 0, made / (total / 1000.0)).otherwise(F.lit(0.0)), 4).alias("tokens_per_second"),
        F.coalesce(F.element_at(labels, F.col("backend")), F.lit(NO_BACKEND)).alias("backend"),
    )


def request_metrics_stream(
    tokens: DataFrame, requests: DataFrame, longest: str = "10 minutes", late: str = "0 seconds"
) -> DataFrame:
    """``request_metrics`` of two streams, a row when no more tokens of the request can come.

    Tokens join their request within ``longest`` of its start, so both sides leave the state once the watermark is past;
    a request without tokens comes out of the outer join then. Tokens behind the watermark don't count, nor do tokens
    before the start. Only rows with a request_id move the watermark: the optimizer drops the others before it.
    """
    sent = requests.withWatermark("started_at", late)
    came = tokens.select(F.col("request_id").alias("__of"), "ts").withWatermark("ts", late)
    within = f"request_id = __of AND ts >= started_at AND ts <= started_at + INTERVAL {longest}"
    counted = (
        sent.join(came, F.expr(within), "left_outer")
        .groupBy("request_id", "started_at", "ended_at", "prompt", "backend")
        .agg(F.count("ts").alias("tokens"), F.min("ts").alias("first_token"))
    )
    return _measured(counted)


def token_counts(tokens: DataFrame) -> DataFrame:
    """Tokens and first arrival per request; also the streaming aggregate."""
    return tokens.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("tokens"), F.min("ts").alias("first_token"), F.max("ts").alias("last_token")
    )


def token_rate_stream(stream: DataFrame, late: str = "1 minute", every: str = "1 minute") -> DataFrame:
    """Tokens per request and minute, final once the watermark has passed."""
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.window("ts", every), "request_id")
        .agg(F.count(F.lit(1)).alias("tokens"), F.min("ts").alias("first_token"))
        .select("request_id", F.col("window.start").alias("minute"), "tokens", "first_token")
    )
