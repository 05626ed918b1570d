import pytest
from pyspark.sql import functions as F

from texteval.operators import joins, splits
from texteval.sources import sinks

SIZES = {"s1": (1, (1, 0, 0)), "s2": (2, (1, 1, 0)), "s3": (3, (1, 1, 1)), "s7": (7, (4, 1, 2)), "s20": (20, (14, 3, 3))}


@pytest.fixture(scope="module")
def corpus(spark):
    rows, i = [], 0
    for s, (n, _) in SIZES.items():
        for g in range(n):
            for _ in range(g % 3 + 1):
                rows.append((i, s, f"t{g % 2}", f"u{g}"))
                i += 1
    return spark.createDataFrame(rows, "id long, subject string, topic string, subtopic string")


GROUP = ["subject", "topic", "subtopic"]


def test_group_split_sizes(corpus):
    a = splits.group_split(corpus, "id", ["subject"], GROUP)
    assert a.count() == corpus.count()
    per = a.groupBy("subject").pivot("split", ["train", "val", "test"]).agg(F.countDistinct("topic", "subtopic"))
    assert {r.subject: (r.train or 0, r.val or 0, r.test or 0) for r in per.collect()} == {s: w for s, (_, w) in SIZES.items()}
    assert all(r.train_val == r.train_test == r.val_test == 0 for r in splits.split_overlaps(a, "id", GROUP).collect())


def test_group_split_is_repeatable(corpus):
    a, b = (splits.group_split(c, "id", ["subject"], GROUP).select("id", "split") for c in (corpus, corpus.repartition(9)))
    assert a.exceptAll(b).count() == 0
    other = splits.group_split(corpus, "id", ["subject"], GROUP, seed=1).select("id", "split")
    assert a.exceptAll(other).count() > 0


def test_ratios_must_leave_room(corpus):
    with pytest.raises(ValueError):
        splits.group_split(corpus, "id", ["subject"], GROUP, 0.8, 0.2)


def test_overlaps_are_found(spark):
    bad = spark.createDataFrame([(1, "g", "train"), (1, "g", "val"), (2, "g", "test")], "id long, g string, split string")
    got = {r.kind: (r.train_val, r.train_test, r.val_test) for r in splits.split_overlaps(bad, "id", ["g"]).collect()}
    assert got == {"ids": (1, 0, 0), "groups": (1, 1, 1)}


def test_random_split_has_exact_sizes(spark):
    a = splits.random_split(spark.range(103), "id")
    assert {r.split: r["count"] for r in a.groupBy("split").count().collect()} == {"train": 72, "val": 15, "test": 16}


def test_paired_subsample_keeps_items_whole(spark):
    rows = [("d", "m", i, f"m{j}", float(i)) for i in range(50) for j in range(3)]
    df = spark.createDataFrame(rows, "dataset string, metric string, item_id long, model string, value double")
    got = splits.paired_subsample(df, ["dataset", "metric"], 20)
    assert got.count() == 60 and got.select("item_id").distinct().count() == 20


def test_write_split(corpus, spark, tmp_path):
    a = splits.group_split(corpus, "id", ["subject"], GROUP)
    sinks.write_split(a, str(tmp_path / "split"))
    back = spark.read.parquet(str(tmp_path / "split"))
    assert back.count() == corpus.count()
    assert joins.rows_in_split(corpus, back, ["val", "test"]).count() == back.filter("split != 'train'").count()


def test_blank_groups_get_a_split(spark):
    made = [(i, "s", None if i % 2 else "t", None if i % 3 else f"u{i}") for i in range(24)]
    got = splits.group_split(spark.createDataFrame(made, "id long, subject string, topic string, subtopic string"), "id", ["subject", "topic"], ["subject", "topic", "subtopic"])
    assert got.count() == 24 and got.filter("split is null").count() == 0
    blank = got.filter("topic is null and subtopic is null")
    assert blank.select("split").distinct().count() == 1
