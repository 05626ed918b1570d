"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is its lower-cased words and one end. Words that the training corpus uses most have a
Huffman code; any other word is an escape and its bytes, which have a Huffman code of their own. Each bit is predicted from
three contexts - for code bits the place in the code tree alone, with the word before, with the two words before;
for byte bits two, three and five bytes before - whose hashed slots hold the bits' counts in the
training corpus. A logistic mixer adds the predictors' log odds with weights chosen by a gate (kind of bit
and how much the longer contexts have seen). The weights are fitted to all training texts, each bit predicted from
the counts without itself. Every document starts from these weights
and refines them after each stretch of its words, so scores don't depend on the order of documents.

Sizes that don't grow with the corpus: the dictionary, the slots and the weights. Word counts are
exact and never leave Spark except for the dictionary.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texteval.llm.shared import settle, slices

DICTIONARY = 1 << 18
SLOT_BITS = 21
ORDERS = 3
STRETCH = 64
RATE = 0.002
BATCH_TOKENS = 200_000
#: Documents whose next stretches are mixed at once.
WIDTH = 128
#: Bytes of text split into words at once, and tokens counted at once.
SPLIT_BYTES = 6 << 20
COUNTED_TOKENS = 2_000_000
#: The end of a text, as a word; no word has a blank.
END = b"\n"
_PART = 1 << 16
_GATES = 32
_PRIOR = 0.4
#: Log odds are kept as whole multiples of one part of this.
_ODDS_UNIT = 680
#: The fit of the weights counts bits by log odds in steps of this, so many to either side of 0.
_FIT_STEP = 0.75
_FIT_SIDE = 12
_A, _B, _C, _D = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F))


class Huffman:
    """Paths from the root for symbols 0..n-1: ``step[first[i] : first[i] + length[i]]`` are 2 * node + bit."""

    def __init__(self, counts: list[int]):
        n = len(counts)
        heap = [(max(1, c), i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        above, side, size = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64), n
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            above[i] = above[j] = size
            side[j] = 1
            heapq.heappush(heap, (a + b, size))
            size += 1
        root, at, levels = size - 1, np.arange(n), []
        while (at != root).any():
            up = np.flatnonzero(at != root)
            levels.append((up, 2 * (above[at[up]] - n) + side[at[up]]))
            at[up] = above[at[up]]
        self.nodes = max(1, n - 1)
        self.length = np.zeros(n, np.int64)
        for who, _ in levels:
            self.length[who] += 1
        self.first = np.cumsum(self.length) - self.length
        self.step = np.zeros(self.length.sum(), np.uint32)
        for k, (who, step) in enumerate(levels):  # a level nearer to the root comes earlier in the path
            self.step[self.first[who] + self.length[who] - 1 - k] = step

    def paths(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many bits each of ``symbols`` has, and 2 * node + bit for all of them in a row."""
        lengths = self.length.take(symbols)
        at = np.repeat(self.first.take(symbols) - np.cumsum(lengths) + lengths, lengths)
        at += np.arange(len(at))
        return lengths, self.step.take(at, mode="clip")


class Code:
    """Words by id, the end and the escape among them, and the codes of words and of bytes."""

    def __init__(self, words: list[bytes], counts: list[int], escapes: int):
        self.words, self.counts = words, np.array([*counts, 0], dtype=np.int64)
        self.escape = len(words)
        self.tokens = Huffman([*counts, escapes])
        letters = np.bincount(np.frombuffer(b" ".join([*words, b" "]), np.uint8), minlength=256)
        self.letters = Huffman((letters + 1).tolist())


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, as bytes with A-Z in lower case, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    words = lists.flatten()
    real = pc.greater(pc.binary_length(words), 0)  # blanks at either end leave an empty word there
    owner = np.repeat(np.arange(len(texts)), sizes)[real.to_numpy(zero_copy_only=False)]
    return words.filter(real).view(pa.binary()), np.bincount(owner, minlength=len(texts))


class Stream:
    """Turns words into contexts and bits."""

    def __init__(self, code: Code, slot_bits: int):
        self.code, self.shift = code, np.uint32(32 - slot_bits)
        self.room = np.uint32((1 << slot_bits) - code.tokens.nodes)
        self.words = pa.array(code.words, pa.binary())

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Token ids of all texts in a row, how many each text has, the words to be spelled, and how many each has."""
        words, sizes = split_words(texts)
        found = pc.index_in(words, self.words)
        # each text has one end, the dictionary's last word
        ids = np.full(len(words) + len(sizes), self.code.escape - 1, np.int32)
        ids[np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)] = pc.fill_null(found, self.code.escape).to_numpy()
        ends = np.cumsum(sizes + 1)
        rare = np.searchsorted(np.flatnonzero(ids == self.code.escape), ends)
        return ids, sizes + 1, words.filter(pc.is_null(found)), np.diff(rare, prepend=0)

    def slots(self, ids, before, before2, who, spelled: list[bytes], spelled_who):
        """(slots per order, bits, kinds, whose) of tokens and of the words to be spelled; without ``who`` nobody's."""
        lengths, step = self.code.tokens.paths(ids)
        raw = np.frombuffer(b" ".join([*spelled, b""]) if spelled else b"", np.uint8)
        letter_lengths, letter_step = self.code.letters.paths(raw)
        n_tokens = len(step)
        s = [np.empty(n_tokens + len(letter_step), np.intp) for _ in range(ORDERS)]
        y = np.empty(len(s[0]), np.uint8)
        kind = np.zeros(len(y), np.intp)
        kind[n_tokens:] = 16
        one = (before + 2).astype(np.uint32) * _B
        two = (one ^ (before2 + 2).astype(np.uint32) * _D) * _C
        node = step >> np.uint32(1)
        np.bitwise_and(step, np.uint32(1), out=y[:n_tokens], casting="unsafe")
        s[0][:n_tokens] = node
        node *= _A
        for k, context in enumerate((one, two), 1):
            place = np.repeat(context, lengths)
            place += node
            self._slot(place, s[k][:n_tokens])
        whose = None if who is None else np.empty(len(y), np.intp)
        if who is not None:
            whose[:n_tokens] = np.repeat(who, lengths)
        if len(raw):
            sizes = np.array([len(w) + 1 for w in spelled])
            place = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            prev = [np.where(place >= k, np.roll(raw, k), 32).astype(np.uint32) for k in (1, 2, 3, 4, 5)]
            node = letter_step >> np.uint32(1)
            two = prev[0] * _A + prev[1] * _B
            three = two + prev[2] * _D
            contexts = (two * _C, three * _C, (three + prev[3] * _C + prev[4] * np.uint32(0x1B873593)) * _A + np.uint32(12345))
            hashed = [(np.repeat(c, letter_lengths) + node) * _B + np.uint32(77) for c in contexts]
            s[0][n_tokens:] = (hashed[0] * _D >> np.uint32(4)) % self.room + np.uint32(self.code.tokens.nodes)
            for k in range(1, ORDERS):
                self._slot(hashed[k], s[k][n_tokens:])
            np.bitwise_and(letter_step, np.uint32(1), out=y[n_tokens:], casting="unsafe")
            if who is not None:
                whose[n_tokens:] = np.repeat(np.repeat(spelled_who, sizes), letter_lengths)
        return s, y, kind, whose

    def _slot(self, hashed: np.ndarray, out: np.ndarray) -> None:
        mixed = hashed >> np.uint32(15)
        mixed ^= hashed
        mixed *= _D
        np.right_shift(mixed, self.shift, out=out)


class Document(NamedTuple):
    """A document's token ids and its words to be spelled."""

    ids: np.ndarray
    spelled: list[bytes]


class Group:
    """Documents, longest first, whose ids stand in one array with two blanks before each."""

    def __init__(self, stream: Stream, docs: list[Document]):
        self.escape, blanks = stream.code.escape, np.full(2, -1)
        self.sizes = np.array([len(d.ids) for d in docs])
        self.starts = np.cumsum(self.sizes + 2) - self.sizes
        self.ids = np.concatenate([part for d in docs for part in (blanks, d.ids)])
        self.spelled = [word for d in docs for word in d.spelled]
        self.rank = np.cumsum(self.ids == self.escape) - 1

    def stretches(self, step: int, width: int):
        """(first, end, arguments of ``Stream.slots``) for each next ``step`` tokens of ``width`` documents that have as many."""
        for start in range(0, int(self.sizes[0]), step):
            active = int(np.searchsorted(-self.sizes, -start))
            for low in range(0, active, width):
                high = min(active, low + width)
                sizes = np.minimum(self.sizes[low:high] - start, step)
                who = np.repeat(np.arange(high - low), sizes)
                at = np.repeat(self.starts[low:high] + start - np.cumsum(sizes) + sizes, sizes)
                at += np.arange(len(at))
                ids = self.ids.take(at)
                odd = np.flatnonzero(ids == self.escape)
                spelled = [self.spelled[i] for i in self.rank.take(at.take(odd)).tolist()]
                yield low, high, (ids, self.ids.take(at - 1), self.ids.take(at - 2), who, spelled, who.take(odd))


def _groups(batches: Iterator[pa.RecordBatch], most: int = BATCH_TOKENS):
    """Lists of (batch, row, document) of about ``most`` tokens, longest documents first, from rows with ids and spelled first."""
    held, size = [], 0
    for batch in batches:
        for some in slices(batch, 0, SPLIT_BYTES):
            ids, spelled = some.column(0), pc.binary_join(some.column(1), b" ").to_pylist()  # no word has a blank
            for i, words in enumerate(spelled):
                held.append((some, i, Document(np.frombuffer(ids[i].as_buffer(), np.int32), words.split())))
                size += len(held[-1][2].ids)
                if size >= most:
                    yield sorted(held, key=lambda h: -len(h[2].ids))
                    held, size = [], 0
    if held:
        yield sorted(held, key=lambda h: -len(h[2].ids))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, ends = [], 0, 0

    def counted() -> pa.RecordBatch:
        seen = pc.value_counts(pa.chunked_array(held, pa.binary()))
        return pa.RecordBatch.from_arrays([seen.field(0), seen.field(1)], ["word", "n"])

    for batch in batches:
        ends += len(batch)
        for some in slices(batch, 0, SPLIT_BYTES):
            held.append(split_words(some.column(0))[0])
            size += len(held[-1])
            if size >= COUNTED_TOKENS:
                yield counted()
                held, size = [], 0
    if size:
        yield counted()
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], ["word", "n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of all tokens of the training texts, the end included."""
    counted = texts.select("text").mapInArrow(_count_words, "word binary, n long")
    return settle(counted.groupBy("word").agg(F.sum("n").alias("n")))


def build_code(counts: DataFrame, tokens: int, size: int) -> Code:
    """The code of the most frequent words: at most ``size``, and only words seen twice.

    The cut lies between classes of similar counts, of which there are a few hundred whatever the corpus,
    so equal counts are never split and nothing but the dictionary is collected.
    """
    level = F.floor(F.log2(F.col("n")) * 16)
    seen = counts.filter((F.col("n") > 1) & (F.col("word") != F.lit(END)))
    classes = sorted(seen.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"])
    total, least = 0, None
    for row in classes:
        total += row["count"]
        if total > size:
            break
        least = row["level"]
    chosen = seen.filter(level >= least).collect() if least is not None else []
    chosen = sorted((bytes(r["word"]), r["n"]) for r in chosen)
    ends = counts.filter(F.col("word") == F.lit(END)).first()
    words, n = [w for w, _ in chosen] + [END], [c for _, c in chosen] + [ends["n"] if ends else 0]
    return Code(words, n, tokens - sum(n))


def encode(rows: DataFrame, known) -> DataFrame:
    """``rows`` (key, text, held_out, bytes) with token ids and the words to be spelled in place of the text, and a number.

    Counting, fitting and scoring all read this table, so texts are split and looked up once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(known.value, SLOT_BITS)
        for batch in batches:
            for some in slices(batch, 1, SPLIT_BYTES):
                ids, sizes, words, rare = stream.tokens(some.column(1))
                at, rare_at = (np.concatenate([[0], np.cumsum(n)]).astype(np.int32) for n in (4 * sizes, rare))
                coded = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(ids)])
                spelled = pa.ListArray.from_arrays(pa.array(rare_at), words)
                yield pa.RecordBatch.from_arrays(
                    [coded, spelled, some.column(0).cast(pa.int64()), some.column(2), some.column(3).cast(pa.int64())],
                    ["ids", "spelled", "key", "held_out", "bytes"],
                )

    made = rows.select("key", "text", "held_out", "bytes").mapInArrow(run, "ids binary, spelled array<binary>, key long, held_out boolean, bytes long")
    return settle(made.withColumn("row", F.monotonically_increasing_id()))


def context_counts(texts: DataFrame, known, slot_bits: int) -> np.ndarray:
    """Counts of 0 and 1 in every slot, summed over all training texts: shape (orders, slots, 2).

    Tasks add up their own slots and hand over the parts of the table they touched; parts
    are summed on Spark. A part's counts are halved until they fit 16 bits.
    """
    slots = 1 << slot_bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(known.value, slot_bits)
        table = np.zeros((ORDERS, slots * 2), np.uint32)
        tokens_seen, one = np.zeros(len(stream.code.counts), np.int64), np.uint32(1)
        for group in _groups(batches, 10_000):
            for _, _, (ids, one_before, two_before, _, spelled, _) in Group(stream, [d for _, _, d in group]).stretches(10_000, len(group)):  # long ones in parts
                s, y, kind, _ = stream.slots(ids, one_before, two_before, None, spelled, None)
                np.add.at(tokens_seen, ids, 1)
                coded = len(y) - np.count_nonzero(kind)
                for k in range(ORDERS):
                    at, bit = (s[k], y) if k else (s[k][coded:], y[coded:])
                    at *= 2
                    at += bit
                    np.add.at(table[k], at, one)
        # the place in the code tree alone: a token's path as often as the token
        ids = np.flatnonzero(tokens_seen)
        lengths, step = stream.code.tokens.paths(ids)
        np.add.at(table[0], step, np.repeat(tokens_seen[ids].astype(np.uint32), lengths))
        parts = table.reshape(-1, 2 * min(_PART, slots))
        touched = np.flatnonzero(parts.any(1))
        for p in touched.tolist():
            yield pa.RecordBatch.from_arrays(
                [pa.array([p], pa.int32()), pa.array([zstandard.compress(parts[p].tobytes(), 1)], pa.binary())], ["part", "data"]
            )

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(2 * min(_PART, slots), np.uint64)
        for data in rows["data"]:
            total += np.frombuffer(zstandard.decompress(data), np.uint32)
        pair = total.reshape(-1, 2)
        over = np.maximum(0, np.ceil(np.log2(np.maximum(pair.max(1), 1) / 65535.0))).astype(np.uint64)
        small = (pair >> over[:, None]).astype("<u2")
        return pd.DataFrame({"part": [rows["part"].iat[0]], "data": [zstandard.compress(small.tobytes(), 1)]})

    made = texts.select("ids", "spelled").mapInArrow(count, "part int, data binary")
    table = np.zeros((ORDERS * slots // min(_PART, slots), 2 * min(_PART, slots)), "<u2")
    for row in made.groupBy("part").applyInPandas(add, "part int, data binary").collect():  # at most the table
        table[row["part"]] = np.frombuffer(zstandard.decompress(row["data"]), "<u2")
    table = table.reshape(ORDERS, slots * 2)
    # the dictionary's words once each, so that spelling is learned where few words are rare
    none, words, stream = np.zeros(0, np.int64), known.value.words[:-1], Stream(known.value, slot_bits)
    for at in range(0, len(words), 10_000):
        some = words[at : at + 10_000]
        s, y, _, _ = stream.slots(none, none, none, none, some, np.zeros(len(some), np.int64))
        for k in range(ORDERS):
            where, n = np.unique(s[k] * 2 + y, return_counts=True)
            table[k][where] = np.minimum(table[k][where] + n, 65535)
    return table.reshape(ORDERS, slots, 2)


class Mixer:
    """Log odds of the slots and how much they have seen, from the broadcast counts.

    A slot takes 16 bits, so that more of the table stays near the processor: the odds in steps of
    1 / 680, and two bits that say whether it has seen nothing, one or two, up to 15 or more bits.
    """

    def __init__(self, table: np.ndarray):
        self.packed = []
        for pair in table:
            odds = np.log((pair[:, 1] + np.float32(_PRIOR)) / (pair[:, 0] + np.float32(_PRIOR)))
            seen = np.searchsorted([1, 3, 16], pair.sum(1, dtype=np.int32), side="right").astype(np.int16)
            odds *= _ODDS_UNIT
            self.packed.append(np.rint(odds, out=odds).astype(np.int16) * np.int16(4) + seen)

    def inputs(self, slots, kind):
        found = [self.packed[k].take(slots[k], mode="clip") for k in range(ORDERS)]
        x = [(v >> 2).astype(np.float32) * np.float32(1 / _ODDS_UNIT) for v in found]
        return x, kind + ((found[2] & 3) * 4 + (found[1] & 3))


def start_weights() -> np.ndarray:
    """Bias and one weight per predictor for each gate, before any fit: the shortest context alone."""
    weights = np.zeros((_GATES, ORDERS + 1))
    weights[:, 1] = 1.0
    return weights


def one_task(sample: DataFrame) -> DataFrame:
    """The few chosen texts in one task, in a fixed order; all tasks look for them."""
    return sample.select("text").repartition(1).sortWithinPartitions("text")


def _without_itself(table: np.ndarray) -> list[np.ndarray]:
    """By order, for each slot and bit: 4 * step of the log odds + how much is seen, from the counts less that bit."""
    codes = []
    for pair in table:
        code = np.empty((len(pair), 2), np.uint8)
        for y in (0, 1):
            less = pair.astype(np.int32)
            less[:, y] -= less[:, y] > 0
            odds = np.log((less[:, 1] + np.float32(_PRIOR)) / (less[:, 0] + np.float32(_PRIOR)))
            step = np.clip(np.rint(odds / np.float32(_FIT_STEP)), -_FIT_SIDE, _FIT_SIDE).astype(np.int32) + _FIT_SIDE
            code[:, y] = step * 4 + np.searchsorted([1, 3, 16], less.sum(1), side="right")
        codes.append(code.ravel())
    return codes


def input_counts(texts: DataFrame, known, codes_known, slot_bits: int) -> DataFrame:
    """(cell, n): how often each combination of inputs, gate and bit occurs in all bits of the training texts.

    A cell is kind, order 2, order 1 (7 bits each), order 0 (5 bits) and the bit: at most 2 million, whatever the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, codes, one = Stream(known.value, slot_bits), [codes_known.value[0] >> 2, *codes_known.value[1:]], np.uint32(1)
        seen = np.zeros(1 << 21, np.uint32)
        for group in _groups(batches, 10_000):
            for _, _, (ids, one_before, two_before, _, spelled, _) in Group(stream, [d for _, _, d in group]).stretches(10_000, len(group)):
                s, y, kind, _ = stream.slots(ids, one_before, two_before, None, spelled, None)
                cell = kind >> 4
                for k, bits in ((2, 7), (1, 7), (0, 5)):
                    at = s[k]
                    at *= 2
                    at += y
                    cell <<= bits
                    cell |= codes[k].take(at, mode="clip")
                cell <<= 1
                cell |= y
                np.add.at(seen, cell, one)
        cells = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(seen[cells].astype(np.int64))], ["cell", "n"])

    return texts.select("ids", "spelled").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def fit_weights(counted: DataFrame) -> np.ndarray:
    """Weights by Newton steps of a logistic regression per gate on ``input_counts``."""
    got = counted.toArrow()  # at most the cells
    cell, n = (got.column(i).to_numpy().astype(np.int64) for i in (0, 1))
    order = np.argsort(cell)
    cell, n = cell[order], n[order].astype(np.float64)
    y, zero, one, two = cell & 1, cell >> 1 & 31, cell >> 6 & 127, cell >> 13 & 127
    x = np.column_stack([np.ones(len(cell)), *((v - _FIT_SIDE) * _FIT_STEP for v in (zero, one >> 2, two >> 2))])
    gate, weights = (cell >> 20) * 16 + (two & 3) * 4 + (one & 3), start_weights()
    for g in np.unique(gate).tolist():
        own = gate == g
        xg, yg, ng = x[own], y[own], n[own]
        for _ in range(20):
            p = 1 / (1 + np.exp(-np.clip(xg @ weights[g], -30, 30)))
            # held near the start where a gate has few bits
            slope = xg.T @ (ng * (yg - p)) - 5.0 * (weights[g] - start_weights()[g])
            curve = (xg * (ng * p * (1 - p))[:, None]).T @ xg + 5.0 * np.eye(ORDERS + 1)
            change = np.clip(np.linalg.solve(curve, slope), -1, 1)
            weights[g] += change
            if np.abs(change).max() < 1e-6:
                break
    return weights


def score(docs: DataFrame, training, key: str = "doc_id", dictionary: int = DICTIONARY, slot_bits: int = SLOT_BITS, rate: float = RATE) -> DataFrame:
    """``key``, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each row of ``docs``.

    ``training`` is a boolean column: the rows to learn from. score is the model's log10 probability of the text's words and
    end, base_score that of smoothed word counts. Null text has no words but an end; with no
    training rows all counts are 0. Repeated rows are scored alike; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col("text").cast("binary").alias("text"), (~training).alias("held_out"))
    counts = word_counts(rows.filter(~F.col("held_out")))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    known = spark.sparkContext.broadcast(build_code(counts, total, dictionary))  # at most the dictionary
    coded = encode(rows.withColumn("bytes", F.octet_length("text")), known)
    train = coded.filter(~F.col("held_out"))
    table = context_counts(train, known, slot_bits)  # at most the slots, as are both broadcasts
    codes = spark.sparkContext.broadcast(_without_itself(table))
    weights = spark.sparkContext.broadcast(fit_weights(input_counts(train, known, codes, slot_bits)))
    codes.unpersist()
    mixer_known = spark.sparkContext.broadcast(Mixer(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, mixer = Stream(known.value, slot_bits), mixer_known.value
        code = stream.code
        base = np.log10(code.counts + 1.0)
        found = code.counts > 0
        # two weights are one complex number, so that one look-up and one sum serve both
        paired = [np.ascontiguousarray(weights.value[:, k : k + 2].astype(np.float32)).view(np.complex64).ravel() for k in (0, 2)]
        for group in _groups(batches):
            own = [d for _, _, d in group]
            w = [np.tile(v, len(own)) for v in paired]
            logs = np.zeros(len(own))
            for low, high, tokens in Group(stream, own).stretches(STRETCH, WIDTH):
                s, y, kind, who = stream.slots(*tokens)
                x, gate = mixer.inputs(s, kind)
                at = who * _GATES + gate
                own_w = [v[low * _GATES : high * _GATES] for v in w]
                low_w, high_w = (v.take(at, mode="clip") for v in own_w)
                mix = low_w.real + low_w.imag * x[0]
                mix += high_w.real * x[1]
                mix += high_w.imag * x[2]
                sign = y.astype(np.float32) * 2 - 1
                odds = np.exp(-np.clip(mix * sign, -30, 30))  # of being wrong
                logs[low:high] -= np.bincount(who, np.log(odds + 1), high - low)
                off = sign * (odds / (1 + odds)) * np.float32(rate)
                low_w.real, low_w.imag = off, off * x[0]
                high_w.real, high_w.imag = off * x[1], off * x[2]
                for v, change in zip(own_w, (low_w, high_w)):
                    np.add.at(v, at, change)
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array([b.column(c)[i].as_py() for b, i, _ in group], kind) for c, kind in ((2, pa.int64()), (3, pa.int64()), (4, pa.bool_()))),
                    pa.array([len(d.ids) for d in own], pa.int64()),
                    pa.array([int(found[d.ids].sum()) for d in own], pa.int64()),
                    pa.array([float(base[d.ids].sum()) for d in own]),
                    pa.array(logs / np.log(10)),
                    pa.array([b.column(5)[i].as_py() or 0 for b, i, _ in group], pa.int64()),
                ],
                ["row", "key", "held_out", "n_tokens", "coded", "base", "score", "bytes"],
            )

    scored = settle(
        coded.select("ids", "spelled", "row", "key", "held_out", "bytes").mapInArrow(
            run, "row long, key long, held_out boolean, n_tokens long, coded long, base double, score double, bytes long"
        )
    )
    rare = (
        coded.select("row", F.explode("spelled").alias("word")).join(counts, "word")
        .groupBy("row").agg(F.count(F.lit(1)).alias("rare"), F.sum(F.log10(F.col("n") + 1)).alias("rare_base"))
    )
    base = F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))
    return scored.join(rare, "row", "left").select(
        F.col("key").alias(key), "held_out", "n_tokens",
        (F.col("coded") + F.coalesce("rare", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
        F.try_divide(-F.col("score") * F.log2(F.lit(10.0)), F.col("bytes")).alias("bits_per_byte"),
    )
