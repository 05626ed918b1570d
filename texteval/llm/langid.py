"""Language identification with bit-sliced Bloom filters of n-grams.

Training counts character n-grams per language over the whole training corpus. An n-gram is
listed for a language if it makes up at least ``share`` of that language's n-grams (so a
language lists at most 1 / share) and is not ``contrast`` times rarer there than in another language.
One Bloom filter per language has the same positions; the bits of a position, side by side, are
a mask of languages. A look-up ands the masks of an n-gram's positions and so returns all
languages that list it at once. A text's hits per language, corrected for the false
positives that the filter's fill predicts, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texteval.llm.shared import settle

SHARE = 1e-5
CONTRAST = 8.0
PROBES = 3
BITS_PER_GRAM = 16
BATCH_CHARS = 2_000_000
UNDETERMINED = "und"
_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_hashes(text: str) -> np.ndarray:
    """Hashes of runs of four characters of the lower-cased text whose middle two are letters.

    Anything but letters counts as a blank, and the text has one at either end; a run of
    three around a word of one letter stands for that word.
    """
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[points]
    c = np.where(letter, points, 32).astype(np.uint64)
    if len(c) < 3:
        return c[:0]
    h3 = (c[:-2] * _BASE + c[1:-1]) * _BASE + c[2:]
    lone = h3[letter[1:-1] & ~letter[:-2] & ~letter[2:]]
    h4 = (h3[:-1] * _BASE + c[3:])[letter[1:-2] & letter[2:-1]]
    h = np.concatenate([h4, lone])
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            grams, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))],
                ["lang", "gram", "n"],
            )
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            grams = gram_hashes(text.as_py())
            held.setdefault(lang, []).append(grams)
            size += len(grams)
            if size >= BATCH_CHARS:
                yield from flush()
                size = 0
    yield from flush()


class Filters:
    """Bit-sliced Bloom filters: ``masks[word][position]`` has a bit for each of 64 languages."""

    def __init__(self, langs: list[str], totals: list[int], listed: dict[str, np.ndarray]):
        self.langs, self.totals = langs, totals
        largest = max((len(g) for g in listed.values()), default=0)
        size = 1 << max(10, int(BITS_PER_GRAM * largest).bit_length())
        self.low = np.uint64(size - 1)
        self.masks = np.zeros((max(1, -(-len(langs) // 64)), size), dtype=np.uint64)
        for k, lang in enumerate(langs):
            for at in self._positions(listed.get(lang, np.zeros(0, np.uint64))):
                np.bitwise_or.at(self.masks[k // 64], at, np.uint64(1 << (k % 64)))
        filled = [((self.masks[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(langs))]
        self.false_rate = np.array(filled) ** PROBES

    def _positions(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(PROBES):
            yield ((grams >> np.uint64(20 * k)) ^ (grams << np.uint64(7 * k))) & self.low

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Per language, the share of the n-grams it lists, without the expected false positives."""
        found = np.zeros(len(self.langs))
        for w, table in enumerate(self.masks):
            mask = np.full(len(grams), np.iinfo(np.uint64).max, dtype=np.uint64)
            for at in self._positions(grams):
                mask &= table[at]
            for k in range(64 * w, min(64 * w + 64, len(self.langs))):
                found[k] = np.count_nonzero(mask & np.uint64(1 << (k % 64)))
        n = max(1, len(grams))
        return np.clip((found / n - self.false_rate) / (1 - self.false_rate), 0.0, 1.0)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not any(map(str.isalpha, text)) or not self.langs:
            return UNDETERMINED, 0.0
        share = self.hits(gram_hashes(text))
        # ties, and texts without a known n-gram, go to the language with more training n-grams
        best = max(range(len(self.langs)), key=lambda k: (share[k], self.totals[k], self.langs[k]))
        return self.langs[best], float(share[best])


def train(docs: DataFrame, share: float = SHARE, contrast: float = CONTRAST) -> Filters:
    """Filters from the rows of ``docs`` (lang, text) that have both; no such rows give no languages."""
    counts = (
        docs.filter("lang is not null and text is not null").select("lang", "text")
        .mapInArrow(_count, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    counts = settle(counts)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
    # at most 1 / share n-grams of a language pass, so what is collected has a fixed bound per language
    frequent = rates.filter(F.col("rate") >= share)
    top = frequent.groupBy("gram").agg(F.max("rate").alias("top"))
    listed = frequent.join(top, "gram").filter(F.col("rate") * contrast >= F.col("top")).select("lang", "gram")
    by_lang = {r["lang"]: int(r["total"]) for r in totals.collect()}
    langs = sorted(by_lang)
    table = listed.toArrow()
    of, grams = np.asarray(table.column("lang")), np.asarray(table.column("gram")).view(np.uint64)
    return Filters(langs, [by_lang[x] for x in langs], {x: np.sort(grams[of == x]) for x in langs})


def predict(docs: DataFrame, filters: Filters, keys: list[Column]) -> DataFrame:
    """``keys`` (id columns of ``docs``) with lang_pred and score for each row's text.

    score is the share of the text's n-grams that the predicted language lists, corrected, from 0 to 1.
    Null text and text without a letter are ``und`` with score 0, as is any text if no language
    was learned. Repeated rows are predicted alike; an empty table gives no rows.
    """
    known = docs.sparkSession.sparkContext.broadcast(filters)
    rows = docs.select(F.struct(*keys).alias("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [known.value.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())],
                ["key", "lang_pred", "score"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double").select("key.*", "lang_pred", "score")


def keep_known(docs: DataFrame, filters: Filters, least: float) -> DataFrame:
    """The rows of ``docs``, as they are, whose text is in a learned language: score at least ``least``.

    Rows with null text or without a letter go.
    """
    known = docs.sparkSession.sparkContext.broadcast(filters)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [known.value.predict(t.as_py()) for t in batch.column(at)]
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score in made], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
