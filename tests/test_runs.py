import random
import sys
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from texteval.operators import inference, joins, prompts

def by_value(fn):
    """Executors cannot import a test module, so its code travels with the task."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return fn


SYSTEM = "Be brief. Output ONLY the final English sentence."


def results(spark, rows):
    return spark.createDataFrame(rows, "seq long, input string, reference string, generated string, seconds string")


def test_resume_pays_once_per_success(spark):
    rng = random.Random(0)
    texts = [("a", "r"), ("b", "r"), ("hot", "hot")]
    items = [(i, *rng.choices(texts, [1, 1, 8])[0]) for i in range(200)]
    saved = [(i, *rng.choices(texts, [1, 1, 8])[0], "Error: x" if i % 5 == 0 else f"g{i}", "1") for i in range(90)]
    done, pending = joins.resume_plan(
        spark.createDataFrame(items, "seq long, input string, reference string"), results(spark, saved))
    done, pending = done.collect(), pending.collect()
    assert sorted([r.seq for r in done] + [r.seq for r in pending]) == list(range(200))
    have = Counter((s[1], s[2]) for s in saved if not s[3].startswith("Error:"))
    want = Counter((i[1], i[2]) for i in items)
    assert Counter((r.input, r.reference) for r in done) == have & want
    assert len({r.generated for r in done}) == len(done)


def test_resume_ignores_outer_white_space(spark):
    items = spark.createDataFrame([(1, " a ", "r")], "seq long, input string, reference string")
    done, pending = joins.resume_plan(items, results(spark, [(1, "a", "r\n", "g", "1")]))
    assert done.count() == 1 and pending.count() == 0


def test_compaction(spark):
    rows = [(1, "a", "r", "Error: 1", "1"), (2, "b", "r", "Error: 2", "1"), (3, "a", "r", "ok", "1"),
            (4, "c", "r", "ok", "1"), (5, "d", "r", "Error: 3", "1")]
    got = joins.compact_results(results(spark, rows), spark.range(3)).orderBy("rank").collect()
    assert [(r["rank"], r.seq) for r in got] == [(1, 3), (2, 4), (3, 2)]
    assert [r.seq for r in joins.compact_results(results(spark, rows), spark.range(1)).collect()] == [3]


def test_null_keys_and_generations_stay(spark):
    made = [(1, "a", "r", None, "1", "m"), (2, "b", "r", "ok", "1", None), (3, "c", "r", "ok", "1", None), (4, "d", "r", "ok", "1", "m")]
    schema = "seq long, input string, reference string, generated string, seconds string, model string"
    saved = spark.createDataFrame(made, schema)
    items = saved.select("seq", "input", "reference", "model")
    assert joins.compact_results(saved, items, ["model"]).count() == 4
    done, pending = joins.resume_plan(items, saved, ["model"])
    assert sorted(r.seq for r in done.collect()) == [2, 3, 4] and [r.seq for r in pending.collect()] == [1]


def test_repairs_replace_only_errors(spark):
    rows = [(1, "a", "r", "Error: 1", "1"), (2, "b", "r", "fine", "1"), (3, "c", "r", "Error: 2", "1")]
    fixes = spark.createDataFrame([(1, "new", "9"), (2, "new", "9")], "seq long, generated string, seconds string")
    got = {r.seq: (r.generated, r.seconds, r.repaired) for r in joins.apply_repairs(results(spark, rows), fixes, ["seq"]).collect()}
    assert got == {1: ("new", "9", True), 2: ("fine", "1", False), 3: ("Error: 2", "1", False)}


def flaky():
    """Fails a fixed number of times per prompt, within one task."""
    calls = Counter()

    def client(messages, temperature):
        text = messages[-1][1]
        calls[text] += 1
        if "dead" in text:
            raise ValueError("boom " + "x" * 300)
        if "twice" in text and calls[text] < 3:
            raise ValueError("429")
        if "blank" in text:
            return " "
        return "<think>why</think>\nanswer\r\nto " + text

    return client


def test_generate_retries(spark):
    factory = by_value(flaky)
    rows = spark.createDataFrame([(i, t, "m") for i, t in enumerate(["ok", "twice", "dead", "blank"])], "seq long, input string, model string")
    asked = prompts.chat_messages(rows, SYSTEM)
    got = {r.input: r for r in inference.generate(asked, factory, retries=3, sleep=lambda s: None).collect()}
    assert (got["ok"].generated, got["ok"].attempts) == ("answer to ok", 1)
    assert (got["twice"].generated, got["twice"].attempts) == ("answer to twice", 3)
    assert got["dead"].generated == "Error: " + ("boom " + "x" * 300)[:200] and got["dead"].attempts == 3
    assert got["blank"].generated.startswith("Error:")
    marked = inference.generate(asked, factory, retries=2, empty_policy="mark", sleep=lambda s: None)
    assert {r.input: r.generated for r in marked.collect()}["blank"] == "<vacio>"


def test_waits_grow_and_are_bounded():
    waits = []

    def limited(messages, temperature):
        raise RuntimeError("rate limit")

    assert inference._call(limited, [], 0.1, 6, (2.0, 30.0), waits.append)[1:] == ("rate limit", 6)
    assert waits == [4.0, 8.0, 16.0, 30.0, 30.0]


def test_repair_escalates(spark):
    class Picky:
        def __call__(self, messages, temperature):
            assert "You MUST output" in messages[0][1]
            return "fixed" if temperature > 0.6 else ""

    rows = spark.createDataFrame([(1, "a", "Error: x", 1.0, "m"), (2, "b", "fine", 1.0, "m")],
                                 "seq long, input string, generated string, seconds double, model string")
    got = {r.seq: (r.generated, r.repaired) for r in inference.repair(rows, Picky, SYSTEM, ["seq"], sleep=lambda s: None).collect()}
    assert got == {1: ("fixed", True), 2: ("fine", False)}


@pytest.mark.parametrize("model,roles,last", [("Gemma 3 1B", ["user"], SYSTEM + "\n\nq"), ("Qwen3 1.7B", ["system", "user"], "q\n/no_think"),
                                              ("DeepSeek", ["system", "user"], "q")])
def test_message_families(spark, model, roles, last):
    df = spark.createDataFrame([("q", model)], "input string, model string")
    m = prompts.chat_messages(df, SYSTEM).first().messages
    assert [x.role for x in m] == roles and m[-1].content == last


def test_last_user_turn_without_user(spark):
    df = spark.createDataFrame([(1, 1, "system", "s"), (1, 2, "assistant", "a"), (2, 3, "user", "u"), (2, 4, "assistant", "b")],
                               "conv_id long, id long, role string, content string")
    assert {r.conv_id: r.content for r in prompts.last_user_turn(df, "conv_id", "id").collect()} == {1: "a", 2: "u"}
