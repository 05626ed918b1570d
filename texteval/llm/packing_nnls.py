"""Packing documents into fixed windows by non-negative least squares over length combinations.

Documents are tokenised and cut into full windows and one shorter rest each.
The lengths of the rests are a histogram of at most ``window`` numbers, whatever the corpus:
combinations of two and three lengths that fill a window are enumerated, their
repeat counts solved against the histogram by non-negative least squares and rounded down, and
what is left is packed greedily, largest length first. The outcome is a plan:
runs of equal sequences, each using so many pieces of each length. Pieces find
their sequence by their rank among the pieces of their length, so no task sees
more than its own pieces and the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from texteval.llm.shared import settle, slices
from texteval.llm.tokens import TEXT_BYTES, word_ids

WINDOW = 2048
END_ID = 1
_PIECE = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, task int, rank int"


def _pieces(path: str, window: int):
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of, task = word_ids(path), TaskContext.get().partitionId()
        seen = [0] * (window + 1)
        for batch in (some for every in batches for some in slices(every, 1, TEXT_BYTES)):
            rows: list[tuple] = []
            ids, bounds = ids_of.of_texts(batch.column(1), END_ID)
            raw, bounds = memoryview(ids).cast("B"), bounds.tolist()
            for doc_id, low, high in zip(batch.column(0).to_pylist(), bounds, bounds[1:]):
                for at in range(low, high, window):
                    length = min(window, high - at)
                    crc = zlib.crc32(raw[4 * at : 4 * (at + length)])
                    rows.append((doc_id, at - low, length, crc, high - low, task, seen[length]))
                    seen[length] += 1
            if rows:
                names = [part.split() for part in _PIECE.split(", ")]
                kinds = {"long": pa.int64(), "int": pa.int32()}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(col, kinds[kind]) for col, (_, kind) in zip(zip(*rows), names)], [n for n, _ in names]
                )

    return tokenise


def length_combinations(window: int, step: int) -> list[tuple[int, ...]]:
    """Two lengths that fill a window, for every length; three, for lengths on a grid of ``step``."""
    pairs = [(a, window - a) for a in range(window // 2, window)]
    triples = []
    for a in range(step, window, step):
        for b in range(step, a + 1, step):
            c = window - a - b
            if 0 < c <= b:
                triples.append((a, b, c))
    return pairs + triples


def solve_counts(histogram: np.ndarray, combos: list[tuple[int, ...]], rounds: int = 300) -> np.ndarray:
    """Non-negative x that brings ``sum(x * combo)`` close to the histogram in least squares.

    Accelerated projected gradient; a combination is a few ones, so products with
    the matrix are sums over index lists. Missing a long length costs more than a short one,
    as short pieces are easily packed later.
    """
    width = max(map(len, combos))
    # an absent third length points at the unused entry 0 with weight 0
    index = np.array([list(c) + [0] * (width - len(c)) for c in combos])
    worth = np.sqrt(np.arange(len(histogram)) / (len(histogram) - 1))
    worth[0] = 0.0
    target = histogram * worth
    use = worth[index]
    touched = np.zeros(len(histogram))
    np.add.at(touched, index.ravel(), (use**2).ravel())
    pace = 1.0 / max(1e-9, width * touched.max())  # at most the inverse of the largest eigenvalue
    x = np.zeros(len(combos))
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        held = np.zeros(len(histogram))
        np.add.at(held, index.ravel(), (use * y[:, None]).ravel())
        following = np.maximum(0.0, y - pace * ((held - target)[index] * use).sum(1))
        ahead = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = following + (t - 1) / ahead * (following - x), following, ahead
    return x


def plan(histogram: np.ndarray, window: int = WINDOW, step: int = 64) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, lengths) runs that use every piece of the histogram exactly once.

    Repeats of the solved combinations are rounded down to what the histogram still holds, in order
    of their size; the rest is packed greedily: the longest piece left, then again and
    again the longest that fits, the same sequence as often as the counts allow.
    """
    left = histogram.astype(np.int64).copy()
    runs: list[tuple[int, tuple[int, ...]]] = []
    if left[window]:
        runs.append((int(left[window]), (window,)))
        left[window] = 0
    if left.sum():
        combos = length_combinations(window, step)
        counts = solve_counts(left.astype(float), combos)
        for k in np.argsort(-counts, kind="stable").tolist():
            if counts[k] < 1:
                break
            need = {n: combos[k].count(n) for n in combos[k]}
            repeats = min(int(counts[k] + 1e-6), *(int(left[n]) // m for n, m in need.items()))
            if repeats > 0:
                runs.append((repeats, combos[k]))
                for n, m in need.items():
                    left[n] -= repeats * m
    present = [int(n) for n in np.flatnonzero(left)]
    while present:
        lengths, room, taken = [], window, {}
        while True:
            at = int(np.searchsorted(present, room, side="right")) - 1
            while at >= 0 and left[present[at]] <= taken.get(present[at], 0):
                at -= 1
            if at < 0:
                break
            n = present[at]
            lengths.append(n)
            taken[n] = taken.get(n, 0) + 1
            room -= n
        repeats = min(int(left[n]) // m for n, m in taken.items())
        runs.append((repeats, tuple(lengths)))
        for n, m in taken.items():
            left[n] -= repeats * m
        present = [n for n in present if left[n]]
    return runs


def _slots(runs: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank of each slot, repeats' first sequence, and the offset in the sequence."""
    by: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for repeats, lengths in runs:
        offset = 0
        for n in lengths:
            by.setdefault(n, []).append((used.get(n, 0), first, offset))
            used[n] = used.get(n, 0) + repeats
            offset += n
        first += repeats
    return {n: tuple(np.array(col, dtype=np.int64) for col in zip(*rows)) for n, rows in by.items()}


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """One row per piece of every document of ``docs`` (doc_id, text).

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Null and empty texts
    are the end id alone; repeated and null doc_ids are documents like others; an empty table gives no rows.
    Long texts are cut every ``window`` ids. All pieces of a sequence start where the one before
    ends; only sequences of greedily packed rests are not full.
    """
    spark = docs.sparkSession
    pieces = settle(docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, window), _PIECE))
    per_task = settle(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = np.zeros(window + 1)
    for length, n in per_task.groupBy("length").agg(F.sum("n")).collect():  # at most ``window`` rows
        histogram[length] = n
    slots = _slots(plan(histogram, window))
    known = spark.sparkContext.broadcast(slots)  # at most the plan: a few thousand runs of few lengths
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = known.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)) for i in (2, 5))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            values, starts = np.unique(length[order], return_index=True)
            for n, rows in zip(values.tolist(), np.split(order, starts[1:])):
                ranks, firsts, offs = by_length[n]
                at = np.searchsorted(ranks, rank[rows], side="right") - 1
                sequence[rows] = firsts[at] + rank[rows] - ranks[at]
                offset[rows] = offs[at]
            columns = [batch.column(i) for i in range(5)] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(
                columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            )

    ranked = pieces.join(offsets, ["task", "length"]).select(
        "doc_id", "start", F.col("length").cast("long"), "ids_crc32", "doc_tokens", (F.col("rank") + F.col("before")).alias("rank")
    )
    return ranked.mapInArrow(
        place,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
