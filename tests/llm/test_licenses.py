"""License blocks against a walk over all blocks and templates, and on odd input."""

import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from texteval.llm import licenses
from texteval.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, templates=licenses.TEMPLATES, threshold=licenses.THRESHOLD):
    """(start, template, overlap) of every block and template that meet."""
    words, found = split(text), set()
    for k, (_, notice) in enumerate(templates):
        mine, scale = split(notice), 8
        while scale < len(mine):
            scale *= 2
        mine = set(mine)
        for i in range(0, len(words), scale):
            common = len(mine & set(words[i:i + 2 * scale]))
            if common >= threshold * len(mine):
                found.add((i, k, common))
    return found


def phrases(text):
    words, found = split(text), []
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i:i + len(parts)] == parts]
    return sorted(found)


def check(docs, got):
    for r in got:
        text = docs[r.doc_id]
        base, met = phrases(text), brute(text)
        labels = {licenses.TEMPLATES[k][0] for _, k, _ in met}
        assert r.n_words == len(split(text)) and r.n_base == len(base)
        assert (r.first_word, r.last_word) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in base}))
        assert r.labels == ",".join(sorted(labels | {x for _, x in base}))
        most = max([len(set(split(t[1]))) and c / len(set(split(licenses.TEMPLATES[k][1]))) for _, k, c in met for t in [licenses.TEMPLATES[k]]], default=0.0)
        assert r.score == (1.0 if base else most)


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op11_license_blocks"](spark, SF).collect()
    assert len(got) == len(docs)
    check(docs, got)


@pytest.mark.parametrize("seed", range(3))
def test_blocks_equal_brute_force(spark, seed):
    """Notices with words dropped, doubled, shuffled in and cut by other words, under several thresholds."""
    rng = random.Random(seed)
    noise = ["zeta", "kappa", "the", "of", "license", "software", "any", "version", "é", "漢字", "2"]
    texts = []
    for _ in range(60):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choices(noise, k=rng.randint(0, 70))
            notice = split(rng.choice(licenses.TEMPLATES)[1])
            words += [w for w in notice if rng.random() > rng.choice([0, 0, 0.05, 0.2])]
        texts.append(rng.choice([" ", ", ", "\n"]).join(words).upper() if rng.random() < 0.3 else " ".join(words))
    threshold = [Fraction(9, 10), Fraction(7, 10), Fraction(1, 2)][seed]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    rows = licenses.find_blocks(docs, ["doc_id"], threshold=threshold).collect()
    got = [(r.doc_id, r.start_word, r.template, r.overlap) for r in rows]
    want = {(d, *x) for d, t in enumerate(texts) for x in brute(t, threshold=threshold)}
    assert len(got) == len(set(got)) and set(got) == want
    for r in rows:
        assert r.label == licenses.TEMPLATES[r.template][0] and r.end_word <= len(split(texts[r.doc_id]))


def test_odd_rows(spark):
    odd = {
        1: None, 2: "", 3: " \n.,;", 4: "cc by", 5: "CC-BY/cc  by", 6: "CC\nBY general PUBLIC license all rights reserved",
        7: "word " * 40_000 + "Released under the MIT License." + " word" * 40_000, 8: "all rights", 9: "İcc by K \U0001F600 cc by",
        10: "x" * 300_000, 11: "under the mit license " * 30_000,
    }
    rows = [*odd.items(), (6, odd[6]), (6, odd[6])]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("label", F.lit("clash")).withColumn("tokens", F.lit(1)).withColumn("words", F.lit(2))
    got = licenses.scan(docs, ["doc_id"]).collect()
    assert sorted(r.doc_id for r in got) == sorted(k for k, _ in rows)
    check(odd, [r for r in got if r.doc_id != 11])
    by = {r.doc_id: r for r in got}
    assert by[1].n_words == 0 and by[1].first_word is None and by[1].labels == "" and by[1].score == 0
    assert by[7].labels == "mit" and by[11].labels == "mit" and by[6].n_base == 3
    no_id = spark.createDataFrame([(None, "all rights reserved"), (None, None)], SCHEMA)
    assert sorted(r.n_base for r in licenses.scan(no_id, ["doc_id"]).collect()) == [0, 1]
    empty = spark.createDataFrame([], SCHEMA)
    assert licenses.scan(empty, ["doc_id"]).count() == 0 and licenses.find_blocks(empty, ["doc_id"]).count() == 0


def test_only_builtin_functions(spark):
    plan = QUERIES["op11_license_blocks"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "CartesianProduct" not in plan
