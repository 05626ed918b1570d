import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from texteval.operators import vocab
from texteval.session import checkpoint_dir

TEXTS = ["low lower lowest newer newest wider new low low", "a.b (x) $1 \\E [q] a.b a.b", "aaaa aaa aa été été"]


def plain_bpe(texts, merges):
    words = Counter(w for t in texts for w in t.split())
    spelt = {w: ["▁", *w] for w in words}
    rules = []
    for _ in range(merges):
        pairs = Counter()
        for w, s in spelt.items():
            for p in zip(s, s[1:]):
                pairs[p] += words[w]
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        rules.append(best)
        for w, s in spelt.items():
            out, i = [], 0
            while i < len(s):
                if tuple(s[i : i + 2]) == best:
                    out.append(s[i] + s[i + 1])
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            spelt[w] = out
    return rules, spelt


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string")


def test_learns_the_rules_one_by_one_would(corpus):
    want, _ = plain_bpe(TEXTS, 18)
    assert vocab.learn_bpe(corpus, ["text"], 18, coverage=1.0) == want
    # short runs, and a head of few words whose proposals are often wrong, must not change the result
    assert vocab.learn_bpe(corpus, ["text"], 8, coverage=1.0, ahead=3) == want[:8]
    assert vocab.learn_bpe(corpus, ["text"], 12, coverage=1.0, head_words=2) == want[:12]


def test_a_poor_head_is_mended_along_the_whole_run(spark, monkeypatch):
    # rounds once began anew from the head after each error: hundreds for a few hundred words outside the head
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(2, 8))) for _ in range(40)) for _ in range(20)]
    rounds, checked = [], vocab._agreed
    monkeypatch.setattr(vocab, "_agreed", lambda *args: rounds.append(1) or checked(*args))
    corpus = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    want, _ = plain_bpe(texts, 60)
    assert vocab.learn_bpe(corpus, ["text"], 60, coverage=1.0, head_words=20) == want
    assert len(rounds) <= 20


def test_a_doubled_symbol_ends_the_batch(spark):
    texts = ["xxxxxxxx pcd qcd"]
    want, _ = plain_bpe(texts, 2)
    got = vocab.learn_bpe(spark.createDataFrame([(0, texts[0])], "id long, text string"), ["text"], 2, coverage=1.0)
    assert got == want


def prose(seed, words=400, letters="abcde"):
    rng = random.Random(seed)
    known = ["".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(60)]
    return [" ".join(rng.choices(known, weights=range(60, 0, -1), k=20)) for _ in range(words // 20)]


@pytest.mark.parametrize("seed,head,ahead", [(0, 10_000, 4096), (1, 25, 40), (2, 8, 7)])
def test_random_words_with_many_ties(spark, seed, head, ahead):
    """Few letters and counts: equal counts, doubled symbols and pairs that come back."""
    texts = prose(seed, letters="ab" if seed == 0 else "abcde")
    want, _ = plain_bpe(texts, 60)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert vocab.learn_bpe(df, ["text"], 60, 1.0, head, ahead) == want


def test_few_rounds_for_far_more_words_than_the_driver_holds(spark, monkeypatch):
    # a run once ended at each pair that the words in the head put in the wrong place
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdefgh", [1 / n for n in range(1, 9)], k=rng.randint(2, 8))) for _ in range(60)) for _ in range(100)]
    rounds, after = [], vocab._after
    monkeypatch.setattr(vocab, "_after", lambda *args: rounds.append(1) or after(*args))
    corpus = spark.createDataFrame([(t,) for t in texts], "text string")
    want, _ = plain_bpe(texts, 400)
    assert vocab.learn_bpe(corpus, ["text"], 400, coverage=1.0, head_words=200) == want
    assert len(rounds) <= 10


@pytest.mark.parametrize("letters", ["ab", "abcdef"])
def test_merging_on_parts_is_merging_one_by_one(letters):
    """Down to a level, on parts cut where rarer pairs stand, and on whole words."""
    rng = random.Random(len(letters))
    for _ in range(30):
        words = Counter("".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(60))
        want, _ = plain_bpe([w for w, n in words.items() for _ in range(n)], 40)
        pairs = Counter()
        for w, n in words.items():
            for p in zip("▁" + w, w):
                pairs[p] += n
        for least in (1, 8, 20):
            parts = Counter()
            for w, n in words.items():
                part = ["▁"]
                for a, b in zip("▁" + w, w):
                    if pairs[a, b] < least:
                        parts[" ".join(part)] += n
                        part = []
                    part.append(b)
                parts[" ".join(part)] += n
            merger = vocab._Merger(pa.array(parts), np.array([*parts.values()]), least, set())
            run = merger.propose(40)
            assert run == want[: len(run)] or not merger.sure
            assert least > 1 or run == want and merger.sure


def test_a_run_on_a_word_is_its_merges_in_order():
    rng = random.Random(8)
    for _ in range(300):
        word = rng.choices("ab", k=rng.randint(1, 14))
        run = [tuple("".join(rng.choices("ab", k=rng.randint(1, 2))) for _ in range(2)) for _ in range(9)]
        want, steps = word, vocab._steps(run)
        for pair in run:
            want = vocab._joined(want, pair)
        assert vocab._merged(word, lambda p, done: next((s for s in steps.get(p, ()) if s > done), None)) == want


def test_turns_find_the_first_better_pair():
    rng = random.Random(5)
    run = [(rng.choice("abcd"), rng.choice("abcd")) for _ in range(37)]
    counts = [rng.randint(1, 6) for _ in run]
    turns = vocab._Turns(run, counts)
    for _ in range(400):
        pair, cnt, start = (rng.choice("abcde"), rng.choice("abcd")), rng.randint(1, 7), rng.randrange(37)
        end = rng.randint(start, 37)
        want = next((t for t in range(start, end) if (-cnt, *pair) < (-counts[t], *run[t])), None)
        assert turns.first_lost(pair, cnt, start, end) == want


def test_vocabulary_of_a_size(spark, tmp_path):
    texts = prose(3)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rules, alphabet = vocab.learn_vocabulary(df, ["text"], 50, 1.0)
    ids = vocab.vocabulary(rules, alphabet)
    assert len(ids) == 50 and sorted(ids.values()) == list(range(50)) and set(alphabet) == set("abcde▁")
    want, _ = plain_bpe(texts, len(rules))
    assert rules == want
    # too small for a merge, and too few pairs for the size
    assert vocab.learn_vocabulary(df, ["text"], 11, 1.0)[0] == []
    small = spark.createDataFrame([("ab ab",), (None,)], "text string")
    assert vocab.learn_vocabulary(small, ["text"], 100, 1.0) == ([("a", "b"), ("▁", "ab")], ["a", "b", "▁"])
    none = spark.createDataFrame([], "text string")
    assert vocab.learn_bpe(none, ["text"], 5) == [] and vocab.learn_vocabulary(none, ["text"], 50) == ([], [])


def test_no_word_table_is_left(spark, corpus):
    root = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = set(root.glob("texteval-*"))
    vocab.learn_bpe(corpus, ["text"], 9, coverage=1.0, head_words=2)
    assert set(root.glob("texteval-*")) == before


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abé▁", max_size=30), st.lists(st.tuples(st.sampled_from(["a", "b", "ab", "é", "aa"]), st.sampled_from(["a", "b", "é", "ab"])), max_size=12))
def test_queue_equals_scan(word, rules):
    """The linked list with a queue against scanning for the earliest rule again and again."""
    rank = {p: i for i, p in reversed(list(enumerate(rules)))}
    parts = list(word)
    while len(parts) > 1:
        best = min(zip(parts, parts[1:]), key=lambda p: rank.get(p, 99))
        if best not in rank:
            break
        parts = vocab._joined(parts, best)
    assert vocab.split_word(word, rank) == parts


def test_ids_and_the_unknown_piece(spark):
    df = spark.createDataFrame([("ab ab ☃☃a", 1), (None, 2), ("", 3)], "text string, n long")
    got = {r.n: r.ids for r in vocab.encode_ids(df, "text", [("a", "b"), ("▁", "ab")], ["▁", "a", "b"]).collect()}
    ids = vocab.vocabulary([("a", "b"), ("▁", "ab")], ["▁", "a", "b"])
    assert got == {1: [ids["▁ab"], ids["▁ab"], ids["▁"], ids["<unk>"], ids["a"]], 2: [], 3: []}


def test_encoding_applies_the_rules(corpus):
    rules, spelt = plain_bpe(TEXTS, 14)
    for r in vocab.encode_bpe(corpus, "text", rules).collect():
        assert r.pieces == [p for w in r.text.split() for p in spelt[w]]


def test_rare_characters_are_unknown(spark):
    df = spark.createDataFrame([("a" * 999 + " ☃",)], "text string")
    words = vocab.word_counts(df, ["text"])
    kept = {r.ch for r in vocab.kept_characters(words, 0.99).collect()}
    assert kept == {"a"}
    assert vocab.spelled(words.filter("word like '%☃'"), ["a", "▁"]).first().symbols == " ▁ <unk> "


def test_reserved_ids_come_first():
    ids = vocab.vocabulary([("a", "b")], ["b", "a"])
    assert list(ids.items())[:6] == [("<pad>", 0), ("<s>", 1), ("</s>", 2), ("<unk>", 3), ("<SEP>", 4), ("ab", 5)]
