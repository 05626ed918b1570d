import random
from collections import Counter
from math import exp, log

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from texteval.functions.porter import stem
from texteval.functions.text import tokens
from texteval.operators import rowmetrics as rm

WORDS = ["the", "cat", "cats", "sat", "on", "a", "mat", "running", "runs", "1.5", "x,y", "end.", "U.S.", "a-b", "3-4", "été"]


def sentences(n, seed=0, longest=30):
    rng = random.Random(seed)
    return [
        (i, " ".join(rng.choices(WORDS, k=rng.randint(0, longest))), " ".join(rng.choices(WORDS, k=rng.randint(0, longest))))
        for i in range(n)
    ]


ROWS = sentences(120) + [(1000, "same text here now", "same text here now"), (1001, "", "x"), (1002, None, "x"),
                         (1003, "a,.5 ..b 5.a &lt;b&gt; <skipped>q-\nr", "A,.5 ... b\x0b5.a z")]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(ROWS, "id long, generated string, reference string").repartition(3)


@pytest.fixture(scope="module")
def split(pairs):
    """Tokens by the Column expressions, per scheme."""
    cols = [tokens(F.col(c), s).alias(f"{c}_{s}") for c in ("generated", "reference") for s in ("rouge", "unicode", "whitespace", "13a")]
    low = [tokens(F.lower(c), "13a").alias(f"{c}_low") for c in ("generated", "reference")]
    return {r.id: r for r in pairs.select("id", *cols, *low).collect()}


@pytest.mark.parametrize("scheme", ["rouge", "unicode", "whitespace", "13a"])
def test_both_tokenisers_agree(split, scheme):
    for c, at in (("generated", 1), ("reference", 2)):
        lists = rm.arrow_tokens(pa.array([r[at] for r in ROWS], pa.string()), scheme).to_pylist()
        for row, got in zip(ROWS, lists):
            assert (got or []) == list(split[row[0]][f"{c}_{scheme}"])


def table_lcs(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[j]))
        prev = row
    return prev[-1]


def f_measure(a, b):
    lcs = table_lcs(a, b)
    if not lcs:
        return 0.0
    p, r = lcs / len(a), lcs / len(b)
    return 2 * p * r / (p + r)


@pytest.mark.parametrize("scheme,stemmed", [("rouge", False), ("unicode", False), ("rouge", True)])
def test_rouge_l(pairs, split, scheme, stemmed):
    form = (lambda w: stem(w) if len(w) > 3 else w) if stemmed else (lambda w: w)
    for r in rm.rouge_l(pairs, scheme=scheme, stem_words=stemmed).collect():
        a, b = ([form(w) for w in split[r.id][f"{c}_{scheme}"]] for c in ("generated", "reference"))
        assert r.ROUGE_L == pytest.approx(f_measure(a, b), abs=5.1e-5)


def test_long_texts_are_compared_whole(spark):
    rng = random.Random(5)
    a = [rng.choice("abcdefgh") for _ in range(1500)]
    b = [rng.choice("abcdefgh") for _ in range(1300)]
    assert rm.common_subsequence(a, b) == table_lcs(a, b)


def plain_bleu(a, b, smooth):
    logs = 0.0
    for n in range(1, 5):
        have = Counter(tuple(a[i : i + n]) for i in range(len(a) - n + 1))
        want = Counter(tuple(b[i : i + n]) for i in range(len(b) - n + 1))
        m, t = sum((have & want).values()), sum(have.values())
        if m == 0 and (not smooth or n == 1):
            return 0.0
        logs += log((m or 0.1) / max(t, 1)) / 4
    return exp(logs) * (exp(1 - len(b) / len(a)) if len(a) < len(b) else 1)


@pytest.mark.parametrize("smoothing,scheme", [(None, "13a"), ("m1", "whitespace")])
def test_bleu(pairs, split, smoothing, scheme):
    for r in rm.bleu(pairs, smoothing=smoothing).collect():
        a, b = (list(split[r.id][f"{c}_{scheme}"]) for c in ("generated", "reference"))
        assert r.BLEU == pytest.approx(plain_bleu(a, b, smoothing), abs=5.1e-5)
        assert 0 <= r.BLEU <= 1


def test_corpus_bleu_is_not_the_mean(spark):
    df = spark.createDataFrame([("m", "a b c d e", "a b c d e"), ("m", "a b x y", "a b c d")], "m string, generated string, reference string")
    r = rm.corpus_bleu(df, ["m"]).first()
    logs = sum(log(x) for x in (7 / 9, 5 / 7, 3 / 5, 2 / 3)) / 4
    assert r.corpus_bleu == pytest.approx(exp(logs), abs=5.1e-5)


def plain_meteor(hyp, ref, forms):
    left_h, left_r, found = list(enumerate(hyp)), list(enumerate(ref)), []
    for form in forms:
        for i in range(len(left_h) - 1, -1, -1):
            for j in range(len(left_r) - 1, -1, -1):
                if form(left_h[i][1]) == form(left_r[j][1]):
                    found.append((left_h.pop(i)[0], left_r.pop(j)[0]))
                    break
    if not found:
        return 0.0
    found.sort()
    chunks = 1 + sum(1 for x, y in zip(found, found[1:]) if y != (x[0] + 1, x[1] + 1))
    p, r = len(found) / len(hyp), len(found) / len(ref)
    return p * r / (0.9 * p + 0.1 * r) * (1 - 0.5 * (chunks / len(found)) ** 3)


def test_meteor(pairs, split):
    classes = {"mat": "rug", "a": "the"}
    plain, syn = (lambda w: w), (lambda w: classes.get(w, w))
    cases = [({"stem_words": False}, [plain]), ({}, [plain, stem]), ({"synonyms": classes}, [plain, stem, syn])]
    for kwargs, forms in cases:
        for r in rm.meteor(pairs, **kwargs).collect():
            a, b = (list(split[r.id][f"{c}_low"]) for c in ("generated", "reference"))
            assert r.METEOR == pytest.approx(plain_meteor(a, b, forms), abs=5.1e-5)


def test_cosine_blocks_give_the_same_result(spark):
    rng = random.Random(2)
    rows = [(i % 3, s, p, [rng.gauss(0, 1) for _ in range(8)]) for s in ("candidate", "reference") for p, i in enumerate(range(90))]
    df = spark.createDataFrame(rows, "item_id long, side string, pos long, vec array<float>")
    whole, cut = (sorted(map(tuple, rm.greedy_cosine_f1(df, block=b).collect())) for b in (1000, 7))
    assert whole == cut and len(whole) == 3


def test_blocks_are_full_where_positions_have_gaps(spark):
    # a block once was so many positions, with a tenth of the tokens where items share a numbering: copies went to ten times the pairs
    rng = random.Random(3)
    rows = [(i % 10, s, i, [rng.gauss(0, 1) for _ in range(4)]) for s in ("candidate", "reference") for i in range(400)]
    df = spark.createDataFrame(rows, "item_id long, side string, pos long, vec array<float>")
    assert rm.block_width(df, "item_id", 20) == pytest.approx(200, rel=0.05)
    assert rm.block_width(df, "item_id", 50) == 50
    whole, cut = (sorted(map(tuple, rm.greedy_cosine_f1(df, block=b).collect())) for b in (1000, 20))
    assert whole == cut and len(whole) == 10


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("dies", "die"), ("agreed", "agre"),
                                       ("hopping", "hop"), ("falling", "fall"), ("relational", "relat"), ("happy", "happi"),
                                       ("generalization", "gener"), ("skies", "sky"), ("enjoy", "enjoy"), ("adoption", "adopt")])
def test_stems(word, want):
    assert stem(word) == want


def test_zero_vector_has_no_cosine(spark):
    made = [(1, "candidate", 0, [0.0, 0.0]), (1, "reference", 0, [1.0, 0.0])]
    got = rm.greedy_cosine_f1(spark.createDataFrame(made, "item_id long, side string, pos long, vec array<double>")).first()
    assert (got.precision, got.recall, got.f1) == (0.0, 0.0, 0.0)


def test_a_batch_is_handled_in_small_parts():
    # a batch of 3 MB was one part, with some forty numbers for each word at once
    texts = pa.array(["a bc " * 2000] * 150)
    parts = list(rm._chunks(texts, texts, "whitespace"))
    assert sum(len(size_p) for _, _, size_p, _ in parts) == 150
    assert max(len(ids) for _, ids, _, _ in parts) <= (1 << 20) // 2
    assert all(size_p.tolist() == size_r.tolist() == [4000] * len(size_p) for _, _, size_p, size_r in parts)
