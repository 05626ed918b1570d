"""Byte-pair vocabularies learned from a corpus.

The corpus is read once, into counts of distinct words. Merging is one long chain of decisions, each by the counts of
all words, so a Spark job for each merge would be thousands of jobs. Instead a round takes a level: pairs that occur
less often can't be merged before all pairs have come down to it, so every word is cut where such a pair stands. The parts
are short and many words share them; counted over all words they come to the driver, which merges them one by one as
long as the best pair is at the level at least. Those are the merges that all words would give: a pair at a cut comes
from one pair of the round's start, so it occurs no more often than that one, as long as each piece is made in one way only.
A run in which a piece is made in a second way is checked on all words. If the parts are too many for
the driver, the level is raised. Level and run length change the number of rounds, never the rules.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from texteval.functions.text import tokens
from texteval.session import delete_stored, stored

Pair = tuple[str, str]

# The word-start mark, reserved pieces in id order, and coverage.
WORD_START = "▁"
RESERVED = ["<pad>", "<s>", "</s>", "<unk>", "<SEP>"]
UNKNOWN = "<unk>"
COVERAGE = 0.9995

#: Room on the driver for parts of words, in words of so many symbols, and exact pair counts and merges of one round.
HEAD_WORDS, WORD_SYMBOLS = 250_000, 16
LEADING_PAIRS = 50_000
AHEAD = 16_384
#: A round goes down to this share of the highest count, or less far: half of the pairs are left out until the parts fit.
DEPTH = 64
#: Changed counts, or parts, that a task holds at once.
HELD_CHANGES = 200_000


def word_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(word, cnt) over several text columns; words carry a start mark."""
    words = F.explode(F.flatten(F.array(*[tokens(F.col(c), "whitespace") for c in cols])))
    return (
        df.select(words.alias("w"))
        .groupBy(F.concat(F.lit(WORD_START), F.col("w")).alias("word"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def kept_characters(words: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The most frequent characters that together make up ``coverage`` of the text.

    An alphabet has at most the 1.1 million code points, far fewer in use.
    """
    chars = (
        words.select("cnt", F.explode(F.split("word", "")).alias("ch"))
        .filter(F.col("ch") != "")
        .groupBy("ch").agg(F.sum("cnt").alias("cnt"))
    )
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy(F.desc("cnt"), "ch").rowsBetween(Window.unboundedPreceding, -1)
    return (
        chars.withColumns(
            {"before": F.coalesce(F.sum("cnt").over(before), F.lit(0)), "all": F.sum("cnt").over(everything)}
        )
        .filter(F.col("before") < F.col("all") * coverage)
        .select("ch", "cnt")
    )


def spelled(words: DataFrame, alphabet: list[str] | None = None) -> DataFrame:
    """Words as space-separated symbols; characters outside the alphabet become unknown."""
    symbols = F.array_remove(F.split("word", ""), "")
    if alphabet is not None:
        known = F.array(*[F.lit(c) for c in alphabet])
        symbols = F.transform(
            symbols, lambda c: F.when(F.array_contains(known, c), c).otherwise(F.lit(UNKNOWN))
        )
    return words.withColumn("symbols", F.concat(F.lit(" "), F.array_join(symbols, " "), F.lit(" ")))


def pair_counts(spelt: DataFrame) -> DataFrame:
    """How often each pair of neighbouring symbols occurs, weighted by word count."""
    s = F.split(F.trim("symbols"), " ")
    pairs = F.transform(
        F.sequence(F.lit(0), F.size(s) - 2),
        lambda i: F.struct(F.get(s, i).alias("a"), F.get(s, i + 1).alias("b")),
    )
    return (
        spelt.filter(F.size(s) > 1)
        .select("cnt", F.explode(pairs).alias("p"))
        .filter((F.col("p.a") != UNKNOWN) & (F.col("p.b") != UNKNOWN))
        .groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b"))
        .agg(F.sum("cnt").alias("cnt"))
    )


def _joined(symbols: list[str], pair: Pair) -> list[str]:
    """Each occurrence of the pair as one symbol, from the left."""
    out, i = [], 0
    while i < len(symbols):
        if symbols[i : i + 2] == list(pair):
            out.append(symbols[i] + symbols[i + 1])
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def _pairs(symbols: list[str]) -> Iterator[Pair]:
    return (p for p in zip(symbols, symbols[1:]) if UNKNOWN not in p)


class _Merger:
    """Merging one by one on counted parts of words, for pairs that occur ``least`` times or more.

    The parts lie in one array of symbol numbers; 0 stands between parts and for the unknown piece. Symbols of a part are
    linked, and a merge touches only the places of its pair. ``made`` are the pieces of earlier merges. ``sure`` ends
    with a piece that was there before, whose pairs may come together from places that have been counted apart.
    """

    def __init__(self, parts: pa.Array, counts: np.ndarray, least: int, made: set[str]):
        lists = pc.split_pattern(parts, " ")
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        self.counts, self.least, self.made, self.sure = counts, least, made, True
        self.pieces = [UNKNOWN, *coded.dictionary.to_pylist()]
        self.ids = {piece: i for i, piece in enumerate(self.pieces)}
        n = len(coded) + len(sizes) + 1
        part = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        at = np.arange(len(coded)) + part + 1
        self.symbol, self.part = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.symbol[at], self.part[at] = coded.indices.to_numpy() + 1, part
        self.before, self.after = np.arange(-1, n - 1, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32)
        self.before[0] = self.after[-1] = 0
        self.count: dict[tuple[int, int], int] = {}
        self.places: dict[tuple[int, int], list[np.ndarray]] = {}
        self.queue: list[tuple] = []
        at = np.flatnonzero((self.symbol[:-1] > 0) & (self.symbol[1:] > 0)).astype(np.int32)
        wide = len(self.pieces)
        for key, cnt, here in self._grouped(at, self.symbol[at].astype(np.int64) * wide + self.symbol[at + 1]):
            if cnt >= least:
                self._gained((key // wide, key % wide), cnt, here)

    def _grouped(self, at: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Each key with the count of its places and the places."""
        if len(at):
            order = np.argsort(keys, kind="stable")
            at, keys = at[order], keys[order]
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            counts, ends = np.add.reduceat(self.counts[self.part[at]], starts).tolist(), [*starts[1:].tolist(), len(at)]
            for key, cnt, start, end in zip(keys[starts].tolist(), counts, starts.tolist(), ends):
                yield key, cnt, at[start:end]

    def _gained(self, pair: tuple[int, int], cnt: int, places: np.ndarray) -> None:
        self.count[pair] = now = self.count.get(pair, 0) + cnt
        self.places.setdefault(pair, []).append(places)
        heapq.heappush(self.queue, (-now, *(self.pieces[i] for i in pair), pair))

    def _lost(self, pair: tuple[int, int], cnt: int) -> None:
        if pair in self.count:
            self.count[pair] -= cnt

    def best(self) -> tuple[int, int] | None:
        """The most frequent pair, of equal ones the smallest; counts that have sunk since go back into the queue."""
        while self.queue:
            cnt, a, b, pair = heapq.heappop(self.queue)
            now = self.count.get(pair, 0)
            if now == -cnt:
                return pair
            if self.least <= now < -cnt:
                heapq.heappush(self.queue, (-now, a, b, pair))
        return None

    def merge(self, pair: tuple[int, int]) -> None:
        """All places of the pair, from the left."""
        (a, b), symbol, after, before = pair, self.symbol, self.after, self.before
        piece = self.pieces[a] + self.pieces[b]
        if self.least > 1 and (piece in self.ids or piece in self.made):
            self.sure = False
        c = self.ids.setdefault(piece, len(self.pieces))
        if c == len(self.pieces):
            self.pieces.append(piece)
        first = np.concatenate(self.places.pop(pair))
        first = first[symbol[first] == a]
        first = first[symbol[after[first]] == b]
        if a == b:  # of a row of equal symbols, the first and second, third and fourth, and so on
            first, turn = np.sort(first), np.arange(len(first))
            begins = np.concatenate(([True], after[first[:-1]] != first[1:]))
            first = first[(turn - np.maximum.accumulate(np.where(begins, turn, 0))) % 2 == 0]
        second = after[first]
        right, left = after[second], before[first]
        old = symbol[right]
        symbol[second], symbol[first] = -1, c
        after[first], before[right] = right, first
        new, left = symbol[right], left[symbol[left] > 0]  # on the left of some is one of the others: found on that one's right
        for y, cnt, _ in self._grouped(second[old > 0], old[old > 0]):
            self._lost((b, y), cnt)
        for x, cnt, places in self._grouped(left, symbol[left]):
            self._lost((x, a), cnt)
            if c and cnt >= self.least:
                self._gained((x, c), cnt, places)
        for y, cnt, places in self._grouped(first[new > 0], new[new > 0]):
            if c and cnt >= self.least:
                self._gained((c, y), cnt, places)
        del self.count[pair]

    def propose(self, merges: int) -> list[Pair]:
        run: list[Pair] = []
        while len(run) < merges and (pair := self.best()) is not None:
            run.append((self.pieces[pair[0]], self.pieces[pair[1]]))
            self.merge(pair)
        return run


def _steps(run: list[Pair]) -> dict[Pair, list[int]]:
    steps: dict[Pair, list[int]] = {}
    for step, pair in enumerate(run):
        steps.setdefault(tuple(pair), []).append(step)
    return steps


def _replayed(symbols: list[str], steps: dict[Pair, list[int]]) -> Iterator[tuple[int, list[str]]]:
    """The word after each merge of the run that changes it, with the merge's number."""
    done = -1
    while True:
        following = [(s, p) for p in zip(symbols, symbols[1:]) for s in steps.get(p, ()) if s > done]
        if not following:
            return
        done, pair = min(following)
        symbols = _joined(symbols, pair)
        yield done, symbols


def _changes(table: DataFrame, run: list[Pair]) -> DataFrame:
    """(a, b, step, change): by how much each merge of the run changes each pair's count; step -1 is the count before it."""
    sent = table.sparkSession.sparkContext.broadcast(run)

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, held = _steps(sent.value), Counter()

        def handed_over() -> pa.RecordBatch:
            keys, change = list(held), list(held.values())
            held.clear()
            a, b, step = ([k[i] for k in keys] for i in range(3))
            return pa.RecordBatch.from_arrays(
                [pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(step, pa.int32()), pa.array(change, pa.int64())],
                ["a", "b", "step", "change"],
            )

        for batch in batches:
            for symbols, cnt in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for a, b in _pairs(symbols):
                    held[a, b, -1] += cnt
                for step, merged in _replayed(symbols, steps):
                    for a, b in _pairs(symbols):
                        held[a, b, step] -= cnt
                    for a, b in _pairs(merged):
                        held[a, b, step] += cnt
                    symbols = merged
                if len(held) > HELD_CHANGES:
                    yield handed_over()
        if held:
            yield handed_over()

    found = table.select("symbols", "cnt").mapInArrow(replay, "a string, b string, step int, change long")
    return found.groupBy("a", "b", "step").agg(F.sum("change").alias("change")).filter("change <> 0")


class _Turns:
    """The proposed pairs with their exact counts at their turns, to be asked which turn another pair would have taken."""

    def __init__(self, run: list[Pair], counts: list[int]):
        self.pairs = sorted(set(run))
        self.wide = 2 * len(self.pairs) + 3
        key = np.array([c * self.wide - self._place(p) for p, c in zip(run, counts)], dtype=np.int64)
        self.least = [key]  # least[k][t]: smallest of 2**k turns from t on
        while len(self.least[-1]) > 1 << (len(self.least) - 1):
            half = 1 << (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def _place(self, pair: Pair) -> int:
        at = bisect_left(self.pairs, pair)
        return 2 * at + (at < len(self.pairs) and self.pairs[at] == pair)

    def first_lost(self, pair: Pair, count: int, start: int, end: int) -> int | None:
        """The first turn from ``start`` to before ``end`` at which the pair with that count comes before the proposed one."""
        mine, t = count * self.wide - self._place(pair), start
        for k in range(len(self.least) - 1, -1, -1):
            while t + (1 << k) <= len(self.least[0]) and self.least[k][t] >= mine:
                t += 1 << k
        return t if t < end else None


def _gaining(changes: DataFrame, done: int, end: int) -> DataFrame:
    """(a, b, now, bound): each pair's count after step ``done``, and the most it can come to before step ``end``."""
    now = F.sum(F.when(F.col("step") <= done, F.col("change")).otherwise(0))
    gains = F.sum(F.when((F.col("step") > done) & (F.col("step") < end), F.greatest("change", F.lit(0))).otherwise(0))
    return changes.groupBy("a", "b").agg(now.alias("now"), (now + gains).alias("bound"))


def _agreed(changes: DataFrame, run: list[Pair]) -> int:
    """How many merges of the run, whose changes these are, are those that merging one by one would choose."""
    spark = changes.sparkSession
    turns = spark.createDataFrame([(t, *p) for t, p in enumerate(run)], "turn int, a string, b string")
    at_turn = (
        changes.join(F.broadcast(turns), ["a", "b"]).filter(F.col("step") < F.col("turn"))
        .groupBy("turn").agg(F.sum("change").alias("cnt"))
    )
    known = {r.turn: r.cnt for r in at_turn.collect()}
    counts = [known.get(t, 0) for t in range(len(run))]
    if 0 in counts:
        run, counts = run[: counts.index(0)], counts[: counts.index(0)]
    least, n, sent = min(counts, default=0), len(run), spark.sparkContext.broadcast((run, counts))
    by_step = Window.partitionBy("a", "b").orderBy("step")
    # a pair that can't come to the least count is ahead of none
    may = _gaining(changes, -1, n).filter(F.col("bound") >= least).select("a", "b")
    holding = may.join(changes, ["a", "b"]).select(
        "a", "b", F.sum("change").over(by_step).alias("cnt"), (F.col("step") + 1).alias("start"),
        (F.coalesce(F.lead("step").over(by_step), F.lit(n - 1)) + 1).alias("end"),
    ).filter((F.col("cnt") >= least) & (F.col("start") < n))

    def lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, first = _Turns(*sent.value), []
        for batch in batches:
            for a, b, cnt, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                turn = asked.first_lost((a, b), cnt, start, min(end, n))
                if turn is not None:
                    first = [min([turn, *first])]
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32())], ["turn"])

    turn = holding.mapInArrow(lost, "turn int").agg(F.min("turn")).first()[0] if n else None
    return n if turn is None else turn


def _merged(symbols: list[str], turn: Callable[[Pair, int], int | None]) -> list[str]:
    """The symbols after merging, the pair of the smallest turn first, from the left.

    ``turn`` has a pair, and the turn at which it came up (-1 at the start). Symbols form a linked list; a queue holds
    the neighbours that have a turn, so a word of n characters takes n log n steps. Entries whose symbols have changed since
    are skipped.
    """
    symbols: list[str | None] = list(symbols)
    before, after = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))

    def entry(left: int, done: int) -> tuple | None:
        right = after[left] if left >= 0 else len(symbols)
        if right >= len(symbols) or (at := turn((symbols[left], symbols[right]), done)) is None:
            return None
        return at, left, symbols[left], symbols[right]

    queue = [e for e in (entry(left, -1) for left in range(len(symbols))) if e]
    heapq.heapify(queue)
    while queue:
        done, left, a, b = heapq.heappop(queue)
        right = after[left]
        if symbols[left] != a or right >= len(symbols) or symbols[right] != b:
            continue
        symbols[left], symbols[right] = a + b, None
        after[left] = after[right]
        if after[right] < len(symbols):
            before[after[right]] = left
        for e in (entry(before[left], done), entry(left, done)):
            if e:
                heapq.heappush(queue, e)
    return [x for x in symbols if x is not None]


def _after(table: DataFrame, run: list[Pair]) -> DataFrame:
    """The word table with the run's merges done, without the words that are one piece now."""
    sent = table.sparkSession.sparkContext.broadcast(run)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = _steps(sent.value)

        def turn(pair: Pair, done: int) -> int | None:
            return next((step for step in steps.get(pair, ()) if step > done), None)

        for batch in batches:
            words = [_merged(symbols, turn) for symbols in batch.column(0).to_pylist()]
            merged = pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), batch.column(1)], ["symbols", "cnt"])
            yield merged.filter(pa.array([len(symbols) > 1 for symbols in words], pa.bool_()))

    return table.mapInArrow(merge, "symbols array<string>, cnt long")


def _parts(table: DataFrame, pairs: set[Pair]) -> DataFrame:
    """(symbols, cnt): the words cut between neighbours that are none of the pairs, without parts of one symbol."""
    sent = table.sparkSession.sparkContext.broadcast(pairs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linked, held = sent.value, Counter()

        def handed_over() -> pa.RecordBatch:
            parts, cnt = [part.split(" ") for part in held], list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.list_(pa.string())), pa.array(cnt, pa.int64())], ["symbols", "cnt"])

        for batch in batches:
            for symbols, cnt in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = 0
                for end, pair in enumerate(zip(symbols, [*symbols[1:], None]), 1):
                    if pair not in linked:
                        if end - start > 1:
                            held[" ".join(symbols[start:end])] += cnt
                        start = end
                if len(held) > HELD_CHANGES:
                    yield handed_over()
        if held:
            yield handed_over()

    found = table.select("symbols", "cnt").mapInArrow(cut, "symbols array<string>, cnt long")
    return found.groupBy("symbols").agg(F.sum("cnt").alias("cnt"))


def _proposed(table: DataFrame, head_words: int, ahead: int, made: set[str]) -> tuple[list[Pair], bool]:
    """The next merges, and whether they are sure to be those of all words; none if no pair is left. The first one is sure."""
    spelt = table.select(F.concat(F.lit(" "), F.array_join("symbols", " "), F.lit(" ")).alias("symbols"), "cnt")
    leading = pair_counts(spelt).orderBy(F.desc("cnt"), "a", "b").limit(LEADING_PAIRS + 1).toArrow().to_pydict()
    pairs, counts = list(zip(leading["a"], leading["b"])), leading["cnt"]
    if not pairs:
        return [], True
    least, sure = max(1, counts[0] // DEPTH), True
    if len(pairs) > LEADING_PAIRS:  # pairs as frequent as the first that is left out may be left out too
        sure = counts[-1] < counts[0]
        least = max(least, counts[-1] + 1) if sure else counts[0]
    cut, parts = table, None
    try:
        while True:
            linked = {pair for pair, cnt in zip(pairs, counts) if cnt >= least}
            parts = stored(_parts(cut, linked))
            size = parts.agg(F.sum(F.size("symbols"))).first()[0]
            if size <= head_words * WORD_SYMBOLS or least == counts[0]:
                break
            if cut is not table:
                delete_stored(cut)
            least, cut, parts = min(max(least + 1, counts[len(linked) // 2]), counts[0]), parts, None
        held = parts.select(F.array_join("symbols", " ").alias("part"), "cnt").toArrow()
    finally:
        for own in (cut, parts):
            if own is not None and own is not table:
                delete_stored(own)
    merger = _Merger(held["part"].combine_chunks(), held["cnt"].to_numpy(), least, made)
    run = merger.propose(ahead)
    return run, sure and merger.sure


def _rounds(table: DataFrame, head_words: int, ahead: int) -> Iterator[list[Pair]]:
    """Runs of merges of the stored word table, until no pair is left; the last tables are deleted."""
    made: set[str] = set()
    try:
        while True:
            run, sure = _proposed(table, head_words, ahead, made)
            if not run:
                return
            if not sure:
                changes = stored(_changes(table, run))
                try:
                    run = run[: _agreed(changes, run)]
                finally:
                    delete_stored(changes)
            yield run
            made.update(a + b for a, b in run)
            following = stored(_after(table, run))
            delete_stored(table)
            table = following
    finally:
        delete_stored(table)


def _word_table(df: DataFrame, cols: list[str], coverage: float) -> tuple[list[str], DataFrame]:
    """The alphabet and the stored table of the words' symbols; the texts are read once."""
    words = stored(word_counts(df, cols))
    try:
        alphabet = [r["ch"] for r in kept_characters(words, coverage).collect()]
        return alphabet, stored(spelled(words, alphabet).select(F.split(F.trim("symbols"), " ").alias("symbols"), "cnt"))
    finally:
        delete_stored(words)


def learn_bpe(
    df: DataFrame, cols: list[str], merges: int, coverage: float = COVERAGE,
    head_words: int = HEAD_WORDS, ahead: int = AHEAD,
) -> list[Pair]:
    """Merge rules in order, learned from the rows of ``df`` (pass the train split only).

    The most frequent pair is merged first; ties go to the smaller pair. Null texts have no words; an empty table has no
    rules. ``head_words`` (room on the driver) and ``ahead`` change the number of rounds, not the rules.
    """
    _, table = _word_table(df, cols, coverage)
    rules: list[Pair] = []
    for run in _rounds(table, head_words, min(ahead, merges)):
        rules += run
        if len(rules) >= merges:
            break
    return rules[:merges]


def learn_vocabulary(
    df: DataFrame, cols: list[str], size: int, coverage: float = COVERAGE,
    head_words: int = HEAD_WORDS, ahead: int = AHEAD,
) -> tuple[list[Pair], list[str]]:
    """(rules, alphabet) of a vocabulary of ``size`` pieces: reserved ones, merged ones, single characters.

    Two pairs may give one piece; it counts once. A corpus with too few pairs gives a smaller vocabulary.
    """
    alphabet, table = _word_table(df, cols, coverage)
    wanted, rules, pieces = size - len(RESERVED) - len(alphabet), [], set()
    if wanted <= 0:
        delete_stored(table)
        return [], alphabet
    for run in _rounds(table, head_words, min(ahead, wanted)):
        for a, b in run:
            if len(pieces) < wanted:
                rules.append((a, b))
                pieces.add(a + b)
        if len(pieces) >= wanted:
            break
    return rules, alphabet


def vocabulary(rules: list[Pair], alphabet: list[str]) -> dict[str, int]:
    """Piece to id: reserved pieces, merged pieces in order, then single characters."""
    pieces = [*RESERVED, *dict.fromkeys(a + b for a, b in rules), *sorted(alphabet)]
    return {piece: i for i, piece in enumerate(dict.fromkeys(pieces))}


def split_word(word: str, rank: dict[Pair, int]) -> list[str]:
    """Pieces of a word: the earliest rule that fits is applied first, from the left."""
    return _merged(list(word), lambda pair, _: rank.get(pair))


def _encoder(df: DataFrame, rules: list[Pair], ids: dict[str, int] | None):
    """Texts' word lists to pieces, or to ids; the rules are as many as the vocabulary's pieces."""
    rank: dict[Pair, int] = {}
    for pair in rules:
        rank.setdefault(tuple(pair), len(rank))
    sent = df.sparkSession.sparkContext.broadcast((rank, ids))

    def of_word(word: str) -> list:
        rank, ids = sent.value
        pieces = split_word(WORD_START + word, rank)
        if ids is None:
            return pieces
        unknown, out = ids[UNKNOWN], []
        for piece in pieces:
            i = ids.get(piece, unknown)
            if i != unknown or out[-1:] != [unknown]:  # a run of unknown characters is one id
                out.append(i)
        return out

    def encode(texts: pd.Series) -> pd.Series:
        seen: dict[str, list] = {}
        return pd.Series([
            [x for word in words for x in (seen[word] if word in seen else seen.setdefault(word, of_word(word)))]
            for words in texts
        ], dtype=object)

    return F.pandas_udf(encode, "array<string>" if ids is None else "array<int>")


def encode_bpe(df: DataFrame, col: str, rules: list[Pair], name: str = "pieces") -> DataFrame:
    """Pieces of each word of a text column."""
    return df.withColumn(name, _encoder(df, rules, None)(tokens(F.col(col), "whitespace")))


def encode_ids(df: DataFrame, col: str, rules: list[Pair], alphabet: list[str], name: str = "ids") -> DataFrame:
    """Ids of the pieces of a text column; characters outside the alphabet have the unknown piece's id."""
    return df.withColumn(name, _encoder(df, rules, vocabulary(rules, alphabet))(tokens(F.col(col), "whitespace")))
