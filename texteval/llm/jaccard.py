"""Jaccard join of documents on word n-grams with MinHash banding.

Every text gets ``trees`` sequences of min-hashes, each as long as ``prefix_depth`` gives: the longest, up to ``deepest``,
at which pairs at the threshold meet in some sequence with the target recall. This is banding in place of an LSH forest:
the length doesn't depend on the data. Documents that share a sequence are then compared on
their whole n-gram sets. Texts with equal words are one class and are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texteval.llm.shared import block_links, components, settle, shared_buckets

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
TREES = 16
DEEPEST = 8
CHUNK = 1000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def prefix_depth(threshold: float, recall: float, trees: int, deepest: int) -> int:
    """The longest prefix at which pairs at the threshold meet with the target recall."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(words: list[bytes], n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the n-grams; fewer words than n are one n-gram, none have none."""
    import xxhash

    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(n, len(words))
    if not n:
        return hashes
    grams = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        grams = grams * _BASE + hashes[k : len(words) - n + 1 + k]
    return np.unique(_mixed(grams))


def _signer(n: int, trees: int, depth: int):
    factors = np.random.default_rng(20).integers(1, 1 << 62, trees * depth, dtype=np.uint64) | np.uint64(1)

    def prefixes(grams: np.ndarray) -> np.ndarray:
        least = np.full(trees * depth, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(grams), 4096):
            np.minimum(least, (grams[at : at + 4096, None] * factors).min(0), out=least)
        key = np.arange(1, trees + 1, dtype=np.uint64)
        for value in least.reshape(trees, depth).T:
            key = _mixed(key * _BASE + value)
        return key.view(np.int64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            copies, keys, sizes = [], [], []
            for text in batch.column(1):
                words = (text.as_py() or b"").split()
                grams = shingles(words, n)
                copies.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                keys.append(prefixes(grams).tolist() if words else [])
                sizes.append(len(grams))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(copies, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int32())],
                ["doc_id", "text_key", "copy_key", "keys", "n_grams"],
            )

    return sign


def _grams_of(n: int):
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shingles(text.as_py().split(), n).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), batch.column(2)], ["id", "payload", "copies"])

    return grams


def _similar(threshold: float):
    # as a fraction, so that pairs exactly at the threshold are decided on integers
    from fractions import Fraction

    ratio = Fraction(threshold).limit_denominator(1000)

    def similar(payloads: list[bytes]) -> np.ndarray:
        sets = [np.frombuffer(g, dtype=np.uint64) for g in payloads]
        sizes = np.array([len(s) for s in sets])
        row = np.repeat(np.arange(len(sets)), sizes)
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        use = (count > 1)[column]
        row, column = row[use], (np.cumsum(count > 1) - 1)[column[use]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((len(sets), len(sets)), dtype=np.float32)
        width = 4096
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [at, at + width])
            held = np.zeros((len(sets), min(width, int(column[b - 1]) - at + 1)), dtype=np.float32)
            held[row[a:b], column[a:b] - at] = 1.0
            both += held @ held.T
        union = sizes[:, None] + sizes[None, :] - both
        return both * ratio.denominator >= union * ratio.numerator

    return similar


def near_duplicates(
    docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL,
    trees: int = TREES, deepest: int = DEEPEST, chunk: int = CHUNK,
) -> DataFrame:
    """(doc_id, text_key, class_id, n_links, kept) for every row of ``docs`` (doc_id, text).

    Two documents are linked if the Jaccard similarity of their sets of n-word
    sequences is at least ``threshold``; texts of fewer words have one sequence, all their words. n_links
    counts the other rows linked with a row; class_id is the smallest doc_id reachable by links;
    kept says that it is the row's own. Texts that are null or without a word link with nothing and
    are kept. Rows that repeat a doc_id count as rows of their own; null doc_ids take part but
    name no class; an empty table gives no rows. text_key is xxhash64 of the text, to find the row again.
    """
    depth = prefix_depth(threshold, recall, trees, deepest)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("text_key"))
    signed = settle(texts.mapInArrow(
        _signer(n, trees, depth), "doc_id long, text_key long, copy_key binary, keys array<long>, n_grams int"
    ))
    worded = signed.filter("copy_key is not null")
    classes = settle(
        worded.groupBy("copy_key").agg(
            F.min(F.struct("doc_id", "text_key", "keys")).alias("least"), F.count(F.lit(1)).alias("copies"),
            F.min("doc_id").alias("first_doc"),
        ).select(
            F.monotonically_increasing_id().alias("id"), "copy_key", "copies", "first_doc",
            F.col("least.doc_id").alias("at_doc"), F.col("least.text_key").alias("at_key"), F.col("least.keys").alias("keys"),
        )
    )
    buckets = shared_buckets(classes.select(F.explode(F.array_distinct("keys")).alias("bucket"), "id"))
    wanted = classes.join(buckets.select("id").distinct(), "id").select("id", "copies", "at_doc", "at_key")
    same = texts["doc_id"].eqNullSafe(wanted["at_doc"]) & (texts["text_key"] == wanted["at_key"])
    found = texts.join(wanted, same).select("id", "text", "copies").mapInArrow(
        _grams_of(n), "id long, payload binary, copies long"
    )
    # a row that occurs twice stands for its class once
    payload = settle(found).dropDuplicates(["id"])
    links = settle(block_links(buckets, payload, chunk, _similar(threshold)))
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    reach = components(links.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = (
        classes.select("id", "copy_key", "copies", "first_doc")
        .join(counts, "id", "left").join(reach, "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
    )
    smallest = named.groupBy("component").agg(F.min("first_doc").alias("class_id"))
    named = named.join(smallest, "component").select(
        "copy_key", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return signed.join(named, "copy_key", "left").select(
        "doc_id", "text_key",
        F.when(F.col("copy_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.col("copy_key").isNull() | F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"),
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, one of each group of near duplicates: the one with the smallest doc_id.

    Rows that repeat doc_id and text are one group and leave one row; rows without a word all stay.
    Rows without a doc_id go if their group has one with, and all stay otherwise.
    """
    found = settle(near_duplicates(docs, **options))
    repeated = F.sum(F.when(F.col("kept") & (F.col("n_links") > 0) & F.col("doc_id").isNotNull(), 1).otherwise(0)) > 1
    marks = (
        found.groupBy(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key"))
        .agg(F.min("kept").alias("__stays"), repeated.alias("__several")).filter("not __stays or __several")
    )
    keyed = docs.withColumn("__text_key", F.xxhash64("text"))
    left = keyed.join(marks, keyed["doc_id"].eqNullSafe(marks["__doc"]) & (keyed["__text_key"] == marks["__key"]), "left")
    left = left.filter("coalesce(__stays, true)")
    # only rows that occur more than once are grouped; both branches read the same regrouping of the texts
    once = left.filter("not coalesce(__several, false)").select(*docs.columns)
    several = left.filter("__several").dropDuplicates(["doc_id", "__text_key"]).select(*docs.columns)
    return once.unionByName(several)
