"""Spelling variants: words one edit apart, found by FM-index search schemes, and the forms they lead to.

Of a word and a word one edit away, the halves before or after the edit are equal. So one scheme matches the first half
exactly and extends over the second with one error, the other starts from the second half; the
first reads the delimited vocabulary backwards, the second forwards. A match is an interval of suffix ranks, narrowed by
one symbol at a time in the Burrows-Wheeler transform.

The vocabulary is dealt by those halves: a word stands with every half that a word one edit away could look for, and asks
where its own halves are. Each shard holds an index of bounded size; a half that too many words share is
cut into parts, which all its words ask.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texteval.llm.shared import discard, settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of letters once A-Z are lower case.
RUNS = "[a-zÀ-ÿ]+"
SLIP = 199
LEAST_LENGTH, LEAST_COUNT = 6, 5
RATIO = 5
#: Words of one part of a half, and rows of one shard.
PART_WORDS = 5_000
SHARD_ROWS = 40_000


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): runs of letters of at least six code points that occur five times or more.

    One run in 199, chosen by the checksum of its document and itself, loses the code point the
    checksum names. Null texts have no run; a null doc_id counts as empty.
    """
    checksum = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    cut = (F.col("h") % F.char_length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), cut), F.substring("run", cut + 2, F.char_length("run")))
    return (
        # outer: else the optimizer adds a filter on the array's size, which splits the text once more
        docs.select("doc_id", F.explode_outer(
            F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUNS), F.lit(0))
        ).alias("run"))
        .filter(F.char_length("run") >= LEAST_LENGTH)
        .withColumn("h", checksum)
        .select(F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run")).alias("word"))
        .filter(F.char_length("word") >= LEAST_LENGTH)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= LEAST_COUNT)
    )


class SuffixRanks:
    """Burrows-Wheeler transform of delimited words, read by intervals of suffix ranks."""

    END, MARK = 0, 1

    def __init__(self, words: list[str]):
        body = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), dtype=np.uint32)
        self.alphabet, symbol = np.unique(body, return_inverse=True)
        text = np.append(symbol + 1, self.END).astype(np.int64)
        self.n = len(text)
        self.order = self._sorted(text)
        self.before = text[self.order - 1]
        # symbols with their ranks, in order: a search here counts smaller symbols and earlier equal ones at once
        self.steps = np.sort(self.before * (self.n + 1) + np.arange(self.n))
        self.word = np.cumsum(text == self.MARK) - 1

    def _sorted(self, text: np.ndarray) -> np.ndarray:
        """Suffixes in order, by doubling the sorted length until all differ."""
        rank, length = text, 1
        while True:
            following = np.zeros(self.n, dtype=np.int64)
            following[:-length] = rank[length:] + 1
            key = rank * (self.n + 2) + following
            order = np.argsort(key, kind="stable")
            ahead = key[order]
            rank = np.empty(self.n, dtype=np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(ahead[1:] != ahead[:-1])])
            if rank[order[-1]] == self.n - 1:
                return order
            length *= 2

    def encode(self, words: list[str]) -> np.ndarray:
        """Symbols of words of one length, last first; unknown ones get a symbol that never occurs."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, len(self.alphabet) + 1)[:, ::-1]

    def extend(self, states: tuple, symbol) -> tuple:
        """States (who, low, high) preceded by a symbol each; those without an occurrence go."""
        who, low, high = states
        key = symbol * (self.n + 1)
        low, high = np.searchsorted(self.steps, key + low), np.searchsorted(self.steps, key + high)
        some = high > low
        return who[some], low[some], high[some]

    def branches(self, states: tuple) -> tuple[tuple, np.ndarray]:
        """States preceded by every letter that occurs before them, and the letters.

        States of one length are disjoint or equal intervals, so reading their rows is linear in the index.
        """
        who, low, high = states
        lows, which, own = np.unique(low, return_index=True, return_inverse=True)
        highs = high[which]
        size = highs - lows
        row = np.repeat(lows - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        pair = np.unique(np.repeat(np.arange(len(lows)), size) * (self.n + 1) + self.before[row])
        node, letter = np.divmod(pair, self.n + 1)
        node, letter = node[letter > self.MARK], letter[letter > self.MARK]
        _, low, high = self.extend((node, lows[node], highs[node]), letter)
        first = np.searchsorted(node, np.arange(len(lows)))
        count = np.bincount(node, minlength=len(lows))[own]
        child = np.repeat(first[own] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        return (np.repeat(who, count), low[child], high[child]), letter[child]

    def distinct(self, parts: list[tuple]) -> tuple:
        who, low, high = (np.concatenate(x) for x in zip(*parts))
        wide = self.n + 1
        key = np.unique((who * wide + low) * wide + high)
        return key // wide // wide, key // wide % wide, key % wide

    def one_error(self, asked: list[str], exact: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``asked``, place in the words) of words one edit apart whose last ``exact`` code points agree.

        ``asked`` are words of one length. A path keeps no error or one; equal paths are merged at each step.
        """
        symbols = self.encode(asked)
        who = np.arange(len(asked))
        zero = self.extend((who, np.zeros_like(who), np.full_like(who, self.n)), self.MARK)
        for t in range(exact):
            zero = self.extend(zero, symbols[zero[0], t])
        one = tuple(x[:0] for x in zero)
        for t in range(exact, symbols.shape[1]):
            symbol = symbols[:, t]
            more, letter = self.branches(zero)
            changed = letter != symbol[more[0]]
            one = self.distinct([
                self.extend(one, symbol[one[0]]),
                tuple(x[changed] for x in more),        # another letter
                zero,                                   # a letter less
                self.extend(more, symbol[more[0]]),     # a letter more
            ])
            zero = self.extend(zero, symbol[zero[0]])
        last, _ = self.branches(zero)
        who, low, _ = self.extend(self.distinct([one, last]), self.MARK)
        return who, self.word[self.order[low]]


def _halves(words: DataFrame) -> DataFrame:
    """(kind, half, word, n, asks): a word with each half a neighbour may ask for, and with its own.

    ``a`` rows hold first halves, ``z`` rows second halves. A word of L code points asks for its first
    L div 2 and for the rest; neighbours have one code point less, as many, or one more.
    """
    length = F.char_length("word")

    def of(other: Column) -> list[Column]:
        first = F.floor(other / 2).cast("int")
        asks = other == length
        rest = other - first
        return [
            F.struct(F.lit("a").alias("kind"), F.substring("word", F.lit(1), first).alias("half"), asks.alias("asks")),
            F.struct(F.lit("z").alias("kind"), F.substring("word", length - rest + 1, rest).alias("half"), asks.alias("asks")),
        ]

    rows = F.explode(F.array(*of(length - 1), *of(length), *of(length + 1)))
    return (
        words.select("word", "n", rows.alias("r")).select("word", "n", "r.*")
        .groupBy("kind", "half", "word", "n").agg(F.max("asks").alias("asks"))
    )


def _search(shard: pd.DataFrame) -> pd.DataFrame:
    """(word, near, near_n) of one shard: one kind, rows held by the index and rows that ask."""
    turn = slice(None, None, -1 if shard["kind"].iloc[0] == "a" else 1)
    held = shard[shard["held"]].drop_duplicates("word").sort_values("word")
    words, n = held["word"].tolist(), held["n"].to_numpy()
    index = SuffixRanks([w[turn] for w in words])
    by_length = defaultdict(list)
    for w in sorted(set(shard.loc[shard["asks"], "word"])):
        by_length[len(w)].append(w)
    made = []
    for length, asked in by_length.items():
        exact = length // 2 if turn.step == -1 else length - length // 2
        who, at = index.one_error([w[turn] for w in asked], exact)
        made += zip((asked[i] for i in who.tolist()), (words[i] for i in at.tolist()), n[at].tolist())
    return pd.DataFrame(made, columns=["word", "near", "near_n"])


def near_words(words: DataFrame, part_words: int = PART_WORDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(word, near, near_n): all ordered pairs of ``words`` (word, n) one edit apart, each once.

    Words are distinct, not null and of two code points or more; an empty table gives no rows. The time of a search
    grows with the word's length, not with the index.
    """
    halves = settle(_halves(words))
    large = settle(
        halves.groupBy("kind", "half").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > part_words)
        .select("kind", "half", F.ceil(F.col("rows") / part_words).cast("int").alias("parts"))
    )
    shards = max(1, -(-halves.count() // shard_rows))
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("word"), parts).cast("int")
    asked_in = F.when(F.col("asks"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array("own"))
    dealt = (
        halves.join(large, ["kind", "half"], "left")
        .withColumn("own", own)
        .select("*", F.explode(asked_in).alias("part"))
        .select(
            "kind", "word", "n", "asks", (F.col("part") == F.col("own")).alias("held"),
            F.pmod(F.xxhash64("half", "part"), F.lit(shards)).alias("shard"),
        )
    )
    found = dealt.groupBy("kind", "shard").applyInPandas(_search, "word string, near string, near_n long")
    return found.groupBy("word", "near").agg(F.first("near_n").alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms of ``forms`` (word, form) lead in the end.

    Each round doubles the way: counts grow fivefold by step, so there is no cycle and few rounds.
    """
    current = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        following = settle(current.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
        ))
        discard(current)
        if following.filter("moved").isEmpty():
            return following.select("word", "root")
        current = following.select("word", "root")
        current._scratch = following._scratch


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs`` (doc_id, text).

    The form is the near word of largest n, of equal ones the first in code-point order, if it is five times as frequent.
    Repeated rows count as often as they stand, other columns are ignored, an empty table gives no rows. Whole texts
    are read; a word's search costs steps in proportion to its length.
    """
    words = settle(vocabulary(docs))
    near = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best")
    )
    chosen = F.coalesce(-F.col("best.rank") >= RATIO * F.col("n"), F.lit(False))
    led = settle(words.join(near, "word", "left").select(
        "word", F.when(chosen, F.col("best.near")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(chosen, -F.col("best.rank")).alias("form_n"),
    ))
    ends = roots(led.filter("form is not null"))
    return led.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
