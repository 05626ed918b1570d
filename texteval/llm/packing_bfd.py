"""Best-fit-decreasing packing into id matrices.

Texts are tokenised, cut losslessly into pieces of at most one window, and packed
in blocks of a bounded number of ids: longest piece first, each into the open row with the least
room that still holds it. A segment tree over capacities finds that row. A block
lives in one task and needs no shuffle, so memory is bounded by the block, not the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from texteval.llm.shared import slices
from texteval.llm.tokens import TEXT_BYTES, word_ids

WINDOW = 2048
END_ID = 1
PAD_ID = 0
BLOCK_IDS = 4_000_000
_ROW = (
    "sequence_id long, n_ids int, doc_ids array<long>, starts array<long>, "
    "cu_seqlens array<int>, position_resets array<int>, ids array<int>"
)


class Capacities:
    """Segment tree over capacities 0..top: the smallest one in use that is large enough."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.count = [0] * (2 * self.leaves)

    def change(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def at_least(self, capacity: int) -> int | None:
        node = capacity + self.leaves
        if self.count[node]:
            return capacity
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit_decreasing(lengths: list[int], window: int) -> list[list[int]]:
    """Rows of piece indices; ties go to the earlier piece and the row opened last."""
    tree, open_rows, rows = Capacities(window), {}, []
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = tree.at_least(lengths[piece])
        if room is None:
            rows.append([])
            row, room = len(rows) - 1, window
        else:
            row = open_rows[room].pop()
            tree.change(room, -1)
        rows[row].append(piece)
        room -= lengths[piece]
        if room:
            open_rows.setdefault(room, []).append(row)
            tree.change(room, 1)
    return rows


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def _matrix(pieces: list[tuple], window: int, first: int) -> pa.RecordBatch:
    lengths = [len(ids) for _, _, ids in pieces]
    rows = best_fit_decreasing(lengths, window)
    order, counts = [p for row in rows for p in row], np.array([len(row) for row in rows])
    bounds, size = np.concatenate([[0], np.cumsum(counts)]), np.array(lengths)[order]
    ends = np.cumsum(size)
    stop = ends - np.repeat(ends[bounds[:-1]] - size[bounds[:-1]], counts)
    start = stop - size
    ids = np.full(len(rows) * window, PAD_ID, dtype=np.int32)
    at = start + np.repeat(np.arange(len(rows)) * window, counts)
    for p, a, n in zip(order, at.tolist(), size.tolist()):
        ids[a : a + n] = pieces[p][2]
    ints, longs = pa.int32(), pa.int64()
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.arange(first, first + len(rows))), pa.array(stop[bounds[1:] - 1].astype(np.int32)),
            _lists(bounds, pa.array([pieces[p][0] for p in order], longs)),
            _lists(bounds, pa.array([pieces[p][1] for p in order], longs)),
            _lists(bounds + np.arange(len(rows) + 1), pa.array(np.insert(stop, bounds[:-1], 0), ints)),
            _lists(bounds, pa.array(start, ints)),
            _lists(np.arange(len(rows) + 1) * window, pa.array(ids)),
        ],
        ["sequence_id", "n_ids", "doc_ids", "starts", "cu_seqlens", "position_resets", "ids"],
    )


def pack_matrix(docs: DataFrame, tokenizer: str, window: int = WINDOW, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Packed rows of all texts of ``docs`` (doc_id, text): one row per window.

    ids has ``window`` entries, padded with 0 from n_ids on; cu_seqlens are the pieces' bounds;
    position ids start again at 0 at each entry of position_resets; doc_ids and starts say which
    ids of which document a piece holds. Each document ends with id 1; null and empty texts are
    that id alone; null and repeated doc_ids are documents like others; an empty table gives no rows.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of, task = word_ids(tokenizer), TaskContext.get().partitionId()
        first, held, pieces = task << 36, 0, []
        for batch in batches:
            for some in slices(batch, 1, TEXT_BYTES):
                every, bounds = ids_of.of_texts(some.column(1), END_ID)
                every, bounds = every.view("<i4"), bounds.tolist()
                for doc_id, low, high in zip(some.column(0).to_pylist(), bounds, bounds[1:]):
                    for at in range(low, high, window):
                        pieces.append((doc_id, at - low, every[at : min(at + window, high)]))
                        held += len(pieces[-1][2])
                        if held >= block_ids:
                            made = _matrix(pieces, window, first)
                            yield made
                            first, held, pieces = first + made.num_rows, 0, []
        if pieces:
            yield _matrix(pieces, window, first)

    return docs.select("doc_id", "text").mapInArrow(packed, _ROW)


def write_packed(docs: DataFrame, path: str, tokenizer: str, window: int = WINDOW) -> None:
    """The packed rows as Parquet files, one per task."""
    pack_matrix(docs, tokenizer, window).write.parquet(path)


def unpack(packed: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every piece: what was packed, for round trips."""
    return packed.selectExpr(
        "inline(transform(doc_ids, (d, i) -> struct(d as doc_id, starts[i] as start, "
        "slice(ids, cu_seqlens[i] + 1, cu_seqlens[i + 1] - cu_seqlens[i]) as ids)))"
    )
