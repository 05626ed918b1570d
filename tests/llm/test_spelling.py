"""Spelling variants against all pairs of words, and on odd input."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from texteval.llm import spelling
from texteval.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counted(docs):
    count = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def near_by_deletion(words):
    """Words one edit apart by what is left without one code point: an exact table, no index."""
    left = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            left[w[:i] + w[i + 1:], i].add(w)
    near = collections.defaultdict(set)
    for (rest, _), group in left.items():
        for w in group:
            near[w] |= group - {w}
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    return near


def expected(docs):
    n = counted(docs)
    near, form = near_by_deletion(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(rows)


def collected(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = expected(docs)
    assert collected(QUERIES["op12_index_variants"](spark, SF)) == want and any(r[1] for r in want)


@pytest.mark.parametrize("seed,letters,limits", [(0, "ab", (5_000, 40_000)), (1, "abé", (7, 60)), (2, "aAß÷", (3, 20))])
def test_near_words_equal_all_pairs(spark, seed, letters, limits):
    """Few letters make runs, edits at the middle and both ends, and halves that many words share."""
    rng = random.Random(seed)
    words = sorted({"".join(rng.choices(letters, k=rng.randint(2, 11))) for _ in range(300)} | {"a" * k for k in range(2, 40)})
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    got = [(r.word, r.near, r.near_n) for r in spelling.near_words(df, *limits).collect()]
    want = {(a, b, j) for a in words for j, b in enumerate(words) if one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_index_equals_search(spark):
    index = spelling.SuffixRanks(["banana", "bandana", "cabana", "anan"])
    who, at = index.one_error(["banana", "bagana", "xxnana"], 2)
    assert sorted(zip(who.tolist(), at.tolist())) == [(0, 1), (1, 0)]


def test_roots_follow_long_ways(spark):
    links = [(f"w{i:02}", f"w{i + 1:02}") for i in range(20)] + [("x", "w07"), ("y", "z")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {f"w{i:02}": "w20" for i in range(20)} | {"x": "w20", "y": "z"}
    assert spelling.roots(spark.createDataFrame([], "word string, form string")).count() == 0


def test_odd_rows(spark):
    long = "q" * 3000
    docs = [
        (1, None), (2, ""), (3, "12 .. 34"), (4, "Letter LETTER letter lettér " * 9), (4, "Letter LETTER letter lettér " * 9),
        (None, "letter lettre " * 40), (5, "ÄÖÜßéñ " * 6 + "ÄÖÜßén " * 30), (6, f"{long} {long[1:]} " * 7), (7, "İstanbul Kelvin " * 6),
        (8, "naïve-naïves naïves " * 30), (9, "a×b÷cdef " * 5),
    ]
    df = spark.createDataFrame(docs, SCHEMA)
    for name in ("word", "n", "run", "form"):
        df = df.withColumn(name, F.lit("clash"))
    want = expected(docs)
    assert collected(spelling.variants(df)) == want and long in {r[0] for r in want}
    assert collected(spelling.variants(spark.createDataFrame([], SCHEMA))) == []
    assert collected(spelling.variants(spark.createDataFrame([(1, "too few words here")], SCHEMA))) == []
