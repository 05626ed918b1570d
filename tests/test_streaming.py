import os
import random

import pytest
from pyspark.sql import functions as F

from texteval.operators import chat
from texteval.plans import inputs
from texteval.streaming import tokens as tk

SF = "/root/testdata/sf0.001"


def feed(tokens):
    buffer, inside, out = "", False, ""
    for t in tokens:
        buffer, inside, shown = tk.filter_step(buffer, inside, t)
        assert len(buffer) < len(tk.CLOSE_TAG)
        out += shown
    return out + ("" if inside else buffer)


@pytest.mark.parametrize("text,want", [("a<think>b</think>c", "ac"), ("a < b <th", "a < b <th"), ("x<think>never", "x"),
                                       ("<think>1</think><think>2</think>z", "z"), ("<thin<think>q</think>k>", "<thin" + "k>")])
def test_any_chunking_gives_the_same_text(text, want):
    rng = random.Random(1)
    for _ in range(30):
        cuts = sorted(rng.sample(range(len(text) + 1), rng.randint(0, len(text))))
        assert feed([text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]) == want


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    return spark.table(name)


def test_stream_equals_batch(spark, tmp_path):
    batch = inputs.token_stream(spark, SF)
    # two files, read one per trigger: a request's early tokens come first
    early = F.col("seq") < 4
    batch.filter(early).coalesce(1).write.parquet(str(tmp_path / "t"))
    batch.filter(~early).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    out = run(spark, tk.filter_think_stream(stream, silence_seconds=None), "visible_chunks")
    got = {}
    for r in out.orderBy("request_id", "seq").collect():
        got[r.request_id] = got.get(r.request_id, "") + r.visible
    want = {r.request_id: r.visible for r in tk.filter_think_batch(batch).collect()}
    assert len(want) == 34
    assert {k: got.get(k, "").strip() for k in want} == want


def test_token_rate_stream(spark, tmp_path):
    batch = inputs.token_stream(spark, SF)
    batch.write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "t"))
    out = run(spark, tk.token_rate_stream(stream), "token_rates")
    latest = batch.agg(F.max("ts")).first()[0]
    want = batch.groupBy("request_id", F.window("ts", "1 minute").alias("w")).count()
    want = want.filter(F.col("w.end") <= F.lit(latest) - F.expr("interval 1 minute"))
    got = {(r.request_id, r.minute): r.tokens for r in out.collect()}
    assert got == {(r.request_id, r.w.start): r["count"] for r in want.collect()}


def test_request_without_tokens(spark):
    tokens = inputs.token_stream(spark, SF).limit(0)
    rows = tk.request_metrics(tokens, inputs.requests(spark, SF)).collect()
    assert rows and all(r.tokens == 0 and r.first_token_ms == r.total_ms for r in rows)


def test_retention_with_few_conversations(spark):
    convs, msgs = inputs.conversations(spark, SF), inputs.messages(spark, SF)
    kept, left = chat.retain_latest(convs, msgs, 3)
    assert kept.count() == 3 and left.select("conv_id").distinct().count() == 3
    newest = [r.id for r in chat.list_conversations(convs).take(3)]
    assert {r.id for r in kept.collect()} == set(newest)


def parts(spark, folder, *dfs):
    """A stream of tables, one per trigger in this order."""
    for i, df in enumerate(dfs):
        path = folder / f"part{i}"
        df.coalesce(1).write.parquet(str(path))
        for f in path.glob("*.parquet"):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(dfs[0].schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "part*"))


def test_a_restarted_stream_goes_on(spark, tmp_path):
    batch = inputs.token_stream(spark, SF)
    early = F.col("seq") < 4
    folder = tmp_path / "in"
    batch.filter(early).coalesce(1).write.parquet(str(folder))

    def landed():
        stream = spark.readStream.schema(batch.schema).parquet(str(folder))
        return tk.land(tk.filter_think_stream(stream, silence_seconds=None), str(tmp_path / "out"))

    first = landed().count()
    assert landed().count() == first
    batch.filter(~early).coalesce(1).write.mode("append").parquet(str(folder))
    got = {r.request_id: r.visible for r in tk.visible_text(landed()).collect()}
    assert got == {r.request_id: r.visible for r in tk.filter_think_batch(batch).collect()}
    # a batch that runs again replaces its rows
    newest = max((tmp_path / "out" / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    newest.unlink()
    (newest.parent / f".{newest.name}.crc").unlink(missing_ok=True)
    assert {r.request_id: r.visible for r in tk.visible_text(landed()).collect()} == got
    assert tk.land(tk.filter_think_stream(parts(spark, tmp_path / "none", batch.limit(0)), None), str(tmp_path / "out2")).count() == 0


T0 = 1_704_067_200


def token_rows(spark, rows):
    df = spark.createDataFrame(rows, "request_id long, seq long, at double, token string, last boolean")
    return df.withColumn("ts", F.timestamp_millis(F.round((F.col("at") + T0) * 1000).cast("long"))).drop("at")


def request_rows(spark, rows):
    df = spark.createDataFrame(rows, "request_id long, at double")
    return df.withColumn("started_at", F.timestamp_millis(F.round((F.col("at") + T0) * 1000).cast("long"))).drop("at")


ASKED = [(1, 0.0), (2, 0.0), (3, 0.0), (4, 1.0), (5, 2.0), (6, 2.0), (7, 3.0), (8, 400.0)]
EARLY = [
    (1, 0, 1.0, "Hi ", False), (1, 1, 2.0, "there", True),          # fine
    (3, 0, 5.0, "<think>x", False), (3, 1, 6.0, "</think> \n", True),  # nothing visible
    (4, 0, 5.0, "a", False),                                        # silent between tokens
    (5, 0, 70.0, "late", True),                                     # silent before the first
    (6, 0, 10.0, "b <th", False),                                   # silent after the last one
    (7, 0, 50.0, "c", False),
]
LATER = [(4, 1, 90.0, "b", True), (7, 1, 105.0, "d", False), (7, 2, 110.0, None, True)]


def test_outcomes_of_every_request(spark, tmp_path):
    requests, early, later = request_rows(spark, ASKED), token_rows(spark, EARLY), token_rows(spark, LATER)
    as_of = F.timestamp_seconds(F.lit(T0 + 420))
    rows = tk.request_outcomes(requests, early.unionByName(later), as_of).collect()
    got = {r.request_id: (r.blank, r.timed_out, r.retry) for r in rows}
    good, silent = (False, False, False), (False, True, True)
    want = {1: good, 2: (True, True, True), 3: (True, False, True), 4: silent, 5: (True, True, True), 6: silent, 7: good}
    assert len(rows) == 8 and got == want | {8: (None, None, None)}
    # the same as events arrive, with a time on which the watermark moves
    tick = token_rows(spark, [(None, 0, 420.0, "", False)])
    stream = parts(spark, tmp_path / "t", early, later, tick)
    asked = parts(spark, tmp_path / "r", requests, requests.limit(0), requests.limit(0))
    rows = tk.land(tk.request_outcomes_stream(asked, stream), str(tmp_path / "out")).collect()
    assert len(rows) == 7 and {r.request_id: (r.blank, r.timed_out, r.retry) for r in rows} == want


def test_metrics_stream_equals_batch_and_drops_late_tokens(spark, tmp_path):
    requests = request_rows(spark, [(1, 0.0), (2, 0.0), (3, 500.0)]).withColumns({
        "ended_at": F.col("started_at") + F.expr("INTERVAL 9 SECONDS"), "prompt": F.lit("p"), "backend": F.lit("device"),
    })
    tokens = token_rows(spark, [(1, 0, 1.0, "a", False), (1, 1, 3.0, "b", True), (3, 0, 501.0, "c", True)])
    late = token_rows(spark, [(1, 2, 4.0, "too late", True)])
    tick = token_rows(spark, [(-1, 0, 9000.0, "", False)])
    clock = requests.limit(1).withColumns({"request_id": F.lit(-1).cast("long"), "started_at": F.timestamp_seconds(F.lit(T0 + 9000))})
    stream = parts(spark, tmp_path / "t", tokens, tick, late)
    asked = parts(spark, tmp_path / "r", requests, clock, requests.limit(0))
    rows = tk.land(tk.request_metrics_stream(stream, asked, "1 minute"), str(tmp_path / "out")).collect()
    assert sorted(rows) == sorted(tk.request_metrics(tokens, requests).collect()) and len(rows) == 3
    assert {r.request_id: r.tokens for r in rows} == {1: 2, 2: 0, 3: 1}
