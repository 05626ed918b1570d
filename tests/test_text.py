import pytest
from pyspark.sql import functions as F

from texteval.functions import labels, sequences
from texteval.functions import text as tx


def apply(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("raw,want", [("<think>a\nb</think> hi ", "hi"), ("hi <think>open", "hi"), ("a<think>x</think>b<think>y", "ab"),
                                      ("<think>all</think>", tx.ONLY_REASONING), ("\u00a0plain\t", "plain")])
def test_strip_think(spark, raw, want):
    assert apply(spark, raw, tx.strip_think) == want


@pytest.mark.parametrize("raw,want", [("<|im_start|>assistant\nhello<|im_end|>", "assistant\nhello"), ("Assistant\n hello", "hello"),
                                      ("<THINK>x</think>ok</think>", "ok"), ("assistantassistant hi", "hi"),
                                      ("<think>why</think>\nASSISTANT: no", ": no"), ("my assistant <|im_end|>said", "my assistant said"),
                                      ("<think>never closed", "never closed"), ("<|im_start|><|im_end|>", ""), (None, None)])
def test_clean_output(spark, raw, want):
    assert apply(spark, raw, tx.clean_output) == want


@pytest.mark.parametrize("raw,want", [("a $$x$$ b", "a \n\\[\nx\n\\]\n b"), ("cost $y$ now", "cost \\(y\\) now"), ("one $ only", "one $ only"),
                                      ("$$\na\n$$", "\\[\na\n\\]"),
                                      ("a $1 b $2 c $3\nd $4", "a \\(1 b \\)2 c $3\nd $4"), ("$$x", "$$\nx"), ("p$$q$$r$$s", "p\n\\[\nq\n\\]\nr\n$$\ns"),
                                      ("$$a $b$ c$$", "\\[\na \\(b\\) c\n\\]"), ("", ""), (None, None)])
def test_normalise_math(spark, raw, want):
    assert apply(spark, raw, tx.normalise_math) == want


def test_normalise_math_of_many_marks_takes_time_in_proportion(spark):
    # each mark once looked at all marks again: a few thousand took hours
    n = 20_000
    assert apply(spark, "$$x$$" * n, tx.normalise_math) == "\\[\nx\n\\]" * n
    assert apply(spark, "$x$ $y\n" * n + "$", tx.normalise_math) == "\\(x\\) $y\n" * n + "$"


@pytest.mark.parametrize("raw,want", [("1.25", 1.25), ('"2.5";', 2.5), ("abc", 1.5), (None, 1.5), ("", 1.5)])
def test_parse_time(spark, raw, want):
    assert apply(spark, raw, tx.parse_time) == want


def test_token_estimates(spark):
    assert apply(spark, "x" * 7, lambda c: tx.approx_tokens(c)) == 1
    assert apply(spark, "xx", lambda c: tx.approx_tokens(c, min_tokens=1)) == 1
    assert apply(spark, "x" * 8, lambda c: tx.approx_tokens(c, "budget")) == 3


def test_ascii_tokens_split_on_accents(spark):
    assert apply(spark, "Él está-aquí", lambda c: tx.tokens(c, "rouge")) == ["l", "est", "aqu"]
    assert apply(spark, "Él está-aquí", lambda c: tx.tokens(c, "unicode")) == ["él", "está", "aquí"]


@pytest.mark.parametrize("p,stars,plain,post", [(0.0, "***", "< 1.0e-300", "< 0.001"), (0.0004, "***", "4.00e-04", "< 0.001"),
                                                (0.03, "*", "0.0300", "0.0300"), (0.05, "n.s.", "0.0500", "0.0500")])
def test_p_labels(spark, p, stars, plain, post):
    r = spark.createDataFrame([(p,)], "p double").select(
        labels.p_stars(F.col("p")), labels.p_label(F.col("p")), labels.p_label(F.col("p"), "posthoc")).first()
    assert tuple(r) == (stars, plain, post)


def test_padding(spark):
    df = spark.createDataFrame([(0, [9] * 10, [8]), (0, [9], [8, 8, 8])], "batch long, s array<int>, t array<int>")
    framed = sequences.frame_sequences(df, "s", "t", 6)
    rows = sequences.pad_batch(framed, "batch", ["enc_ids", "dec_in", "dec_out"], 5).collect()
    assert {tuple(r.enc_ids) for r in rows} == {(1, 9, 9, 9, 9), (1, 9, 4, 0, 0)}
    assert {tuple(r.dec_out) for r in rows} == {(8, 2, 0, 0), (8, 8, 8, 2)}
