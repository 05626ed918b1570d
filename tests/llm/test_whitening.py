"""Whitening against whole arithmetic and numpy on one machine."""

import math

import numpy as np
from pyspark.sql import functions as F

from texteval.llm import whitening
from texteval.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>"


def expected(vectors, components=32):
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in x])
    covariance = centred.T @ centred / n
    value, vector = np.linalg.eigh(covariance)
    value, vector = value[::-1][:components], vector[:, ::-1][:, :components]
    return n, deviation, centred @ vector / np.sqrt(value), value / np.trace(covariance)


def test_whole_table(spark):
    source = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = QUERIES["op13_block_whitening"](spark, SF).collect()
    ids = sorted(source)
    n, deviation, white, explained = expected([source[i] for i in ids])
    assert len(got) == len(ids) * 32 and {r.n for r in got} == {n}
    at = {i: k for k, i in enumerate(ids)}
    mine = np.zeros_like(white)
    for r in got:
        mine[at[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == deviation[at[r.vec_id]]
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
    sign = np.sign((mine * white).sum(0))
    assert np.abs(mine - white * sign).max() < 1e-8
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    assert np.abs(mine.T @ mine / n - np.eye(32)).max() < 1e-9


def test_many_blocks_equal_one(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)))]
    df = spark.createDataFrame(vectors, SCHEMA).repartition(7).cache()
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", 60)
    got = {(r.vec_id, r.component): r.whitened for r in whitening.whiten(df).collect()}
    n, _, white, _ = expected([[float(np.float32(c)) for c in v] for _, v in vectors])
    mine = np.array([[got[i, k + 1] for k in range(5)] for i in range(n)])
    assert np.abs(np.abs(mine) - np.abs(white)).max() < 1e-8


def test_odd_rows(spark):
    rows = [
        (1, [1.0, 2.0, 0.5]), (2, [0.0, -1.0, 0.25]), (2, [0.0, -1.0, 0.25]), (None, [3.0, 0.0, 0.0]), (5, [1.0, 1.0, 1.0]),
        (6, None), (7, []), (8, [1.0, None, 2.0]), (9, [float("nan"), 0.0, 0.0]), (10, [float("inf"), 0.0, 0.0]),
        (11, [1e20, 0.0, 0.0]), (12, [1.0, 2.0]), (13, [0.0, 0.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("n", "x", "index", "part", "component"):
        df = df.withColumn(name, F.lit("clash"))
    got = whitening.whiten(df).collect()
    kept = [v for _, v in rows if v and len(v) == 3 and all(c is not None and math.isfinite(c) and abs(c) < 1e17 for c in v)]
    n, deviation, _, _ = expected(kept)
    assert len(kept) == 6 and len(got) == 18 and {r.n for r in got} == {6}
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviation)
    assert sorted((r.vec_id or 0) for r in got if r.component == 1) == [0, 1, 2, 2, 5, 13]


def test_no_rows(spark):
    def of(*vectors):
        return whitening.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], SCHEMA)).collect()

    assert of() == [] and of(None, []) == [] and of([1.0, 2.0]) == [] and of([1.0, 2.0], [1.0, 2.0]) == []
    flat = of([1.0, 2.0], [2.0, 2.0], [4.0, 2.0])
    assert {r.component for r in flat} == {1} and flat[0].explained == 1 and len(flat) == 3


def test_large_deviation_is_null(spark):
    got = whitening.whiten(spark.createDataFrame([(1, [1e15]), (2, [-1e15]), (3, [0.0])], SCHEMA)).collect()
    assert {r.vec_id: r.deviation for r in got}[1] is None and len(got) == 3
