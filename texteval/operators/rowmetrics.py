"""Scores of a generated text against its reference, per row and per corpus.

A row's score needs only the row, so texts are tokenised and compared in Arrow
batches where they are, whole, and no token is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from texteval.functions.numbers import steady_round
from texteval.functions.porter import stem
from texteval.functions.text import (
    LITERALS_13A, NOT_ASCII_WORD, NOT_WORD, RULES_13A, approx_tokens, parse_time,
)
from texteval.operators.joins import with_rates

# Weights of the alignment score and constants of the accounts.
METEOR_ALPHA, METEOR_BETA, METEOR_GAMMA = 0.9, 3.0, 0.5
SMOOTH_NUMERATOR = 0.1
SYSTEM_PROMPT_TOKENS = 45
GRAMS_PER_KWH = 475.0
DEFAULT_RATES = {"price_in": 0.0, "price_out": 0.0, "kwh_per_token": 2e-7}
DEFAULT_SECONDS = 1.5
# Shortest word the overlap score stems.
STEM_LONGER_THAN = 3


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, one machine word per 64 tokens of ``a``.

    Bit i of ``rows`` is 0 when the score grows at token i of ``a`` (Hyyrö 2004).
    """
    places: dict = {}
    for i, token in enumerate(a):
        places[token] = places.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    rows = full
    for token in b:
        hit = places.get(token)
        if hit:
            shared = rows & hit
            rows = ((rows + shared) | (rows - shared)) & full
    return len(a) - rows.bit_count()


# Bytes of text handled at a time inside a batch; a single longer row is handled alone.
CHUNK_BYTES = 1 << 20


def arrow_tokens(texts: pa.Array, scheme: str) -> pa.Array:
    """The token schemes of ``functions.text.tokens`` for a batch; no tokens become null."""
    texts = pc.fill_null(texts, "")
    if scheme == "rouge":
        texts = pc.replace_substring_regex(pc.utf8_lower(texts), NOT_ASCII_WORD, " ")
    elif scheme == "unicode":
        texts = pc.replace_substring_regex(pc.utf8_lower(texts), NOT_WORD, " ")
    elif scheme == "13a":
        for old, new in LITERALS_13A:
            texts = pc.replace_substring(texts, old, new)
        texts = pc.binary_join_element_wise(" ", texts, " ", "")
        for pattern, spaced in RULES_13A:
            texts = pc.replace_substring_regex(texts, pattern, spaced.replace("$", "\\"))
    elif scheme != "whitespace":
        raise ValueError(f"unknown token scheme {scheme!r}")
    texts = pc.utf8_trim_whitespace(texts)
    return pc.utf8_split_whitespace(pc.if_else(pc.equal(texts, ""), None, texts))


def _chunks(p: pa.Array, r: pa.Array, scheme: str) -> Iterator[tuple]:
    """Slices of a batch: (words, ids, lengths of p, lengths of r) for about CHUNK_BYTES of text.

    ``ids`` number the distinct words of the slice; they list all of p, then all of r.
    """
    size = sum(np.asarray(pc.fill_null(pc.binary_length(x), 0)).astype(np.int64) for x in (p, r))
    ends = np.cumsum(size)
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, "right")))
        lists = [arrow_tokens(x.slice(start, stop - start), scheme) for x in (p, r)]
        coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
        ids = np.asarray(coded.indices).astype(np.int64)
        size_p, size_r = (np.asarray(pc.fill_null(pc.list_value_length(x), 0)).astype(np.int64) for x in lists)
        yield coded.dictionary.to_pylist(), ids, size_p, size_r
        start = stop


def _struct(**columns: list) -> pa.Array:
    arrays = [pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in columns.values()]
    return pa.StructArray.from_arrays(arrays, list(columns))


def _longs(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


def _row_lists(ids: np.ndarray, size_p: np.ndarray, size_r: np.ndarray) -> Iterator[tuple[list, list]]:
    """The two id lists of each row."""
    ep, er = np.cumsum(size_p), size_p.sum() + np.cumsum(size_r)
    for e, n, f, m in zip(ep, size_p, er, size_r):
        yield ids[e - n : e].tolist(), ids[f - m : f].tolist()


def _classes(words: list, form: Callable[[str], str]) -> np.ndarray:
    """For each word the number of its form; words with the same form share it."""
    return pd.factorize(np.array([form(w) for w in words], dtype=object))[0].astype(np.int64)


def _stem_long(word: str) -> str:
    return stem(word) if len(word) > STEM_LONGER_THAN else word


def _lcs(scheme: str, form: Callable[[str], str] | None):
    """UDF: common subsequence and lengths of both token lists."""

    @F.arrow_udf(_longs("lcs", "pred_len", "ref_len"))
    def lengths(p: pa.Array, r: pa.Array) -> pa.Array:
        lcs, in_p, in_r = [], [], []
        for words, ids, size_p, size_r in _chunks(p, r, scheme):
            if form is not None and words:
                ids = _classes(words, form)[ids]
            lcs.append(np.array([common_subsequence(a, b) for a, b in _row_lists(ids, size_p, size_r)], np.int64))
            in_p.append(size_p)
            in_r.append(size_r)
        return _struct(lcs=lcs, pred_len=in_p, ref_len=in_r)

    return lengths


def rouge_l(
    df: DataFrame,
    pred: str = "generated",
    ref: str = "reference",
    name: str = "ROUGE_L",
    stem_words: bool = False,
    scheme: str = "rouge",
) -> DataFrame:
    """F-measure of the longest common token subsequence, over whole texts."""
    out = df.withColumn("__s", _lcs(scheme, _stem_long if stem_words else None)(pred, ref))
    lcs = F.col("__s.lcs").cast("double")
    precision, recall = lcs / F.col("__s.pred_len"), lcs / F.col("__s.ref_len")
    f = F.when(lcs > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    return out.withColumn(name, F.round(f, 4)).drop("__s")


def _clipped(ids: np.ndarray, size_p: np.ndarray, size_r: np.ndarray) -> list[np.ndarray]:
    """Clipped n-gram matches per row for n = 1 to 4."""
    rows, n_p = len(size_p), int(size_p.sum())
    row = np.repeat(np.r_[np.arange(rows), np.arange(rows)], np.r_[size_p, size_r])
    side = np.repeat(np.arange(2), [n_p, len(ids) - n_p])
    left = np.concatenate([np.arange(n, 0, -1) for n in np.r_[size_p, size_r]]) if len(ids) else ids
    gram, out = ids, []
    for n in range(1, 5):
        if n > 1:
            # a gram of n tokens is the one of n - 1 tokens and the token after it
            following = np.r_[ids[n - 1 :], np.zeros(min(n - 1, len(ids)), np.int64)][: len(ids)]
            gram = pd.factorize(gram * (ids.max(initial=0) + 1) + following)[0].astype(np.int64)
        whole = left >= n
        width = gram.max(initial=0) + 1
        codes, kinds = pd.factorize(row[whole] * width + gram[whole])
        in_p = side[whole] == 0
        have = np.bincount(codes[in_p], minlength=len(kinds))
        want = np.bincount(codes[~in_p], minlength=len(kinds))
        out.append(np.bincount(kinds // width, np.minimum(have, want), rows).astype(np.int64))
    return out


BLEU_COUNTS = ["m1", "m2", "m3", "m4", "pred_len", "ref_len"]


def _gram_matches(scheme: str):
    """UDF: clipped matches and lengths of both token lists."""

    @F.arrow_udf(_longs(*BLEU_COUNTS))
    def matches(p: pa.Array, r: pa.Array) -> pa.Array:
        columns: dict = {name: [] for name in BLEU_COUNTS}
        for _, ids, size_p, size_r in _chunks(p, r, scheme):
            for name, values in zip(BLEU_COUNTS, [*_clipped(ids, size_p, size_r), size_p, size_r]):
                columns[name].append(values)
        return _struct(**columns)

    return matches


def bleu_stats(df: DataFrame, pred: str = "generated", ref: str = "reference", scheme: str = "13a") -> DataFrame:
    """Sufficient statistics of BLEU per row: m1..m4, t1..t4, pred_len, ref_len."""
    out = df.withColumn("__g", _gram_matches(scheme)(pred, ref))
    size = F.col("__g.pred_len")
    cols = {name: F.col(f"__g.{name}") for name in BLEU_COUNTS}
    cols |= {f"t{n}": F.greatest(size - (n - 1), F.lit(0)) for n in range(1, 5)}
    return out.withColumns(cols).drop("__g")


def bleu_score(smoothing: str | None = None) -> Column:
    """BLEU-4 from the statistics columns; ``m1`` gives an empty match a small numerator."""
    logs = []
    for n in range(1, 5):
        m, t = F.col(f"m{n}").cast("double"), F.col(f"t{n}")
        if smoothing == "m1":
            m = F.when(m == 0, F.lit(SMOOTH_NUMERATOR)).otherwise(m)
            t = F.greatest(t, F.lit(1))
        logs.append(F.log(m / t))
    mean_log = (logs[0] + logs[1] + logs[2] + logs[3]) / 4
    shorter = F.col("pred_len") < F.col("ref_len")
    brevity = F.when(shorter, F.exp(1 - F.col("ref_len") / F.col("pred_len"))).otherwise(F.lit(1.0))
    some = (F.col("m1") > 0) if smoothing == "m1" else (F.col("m4") > 0)
    return F.when(some & (F.col("pred_len") > 0), brevity * F.exp(mean_log)).otherwise(F.lit(0.0))


def bleu(
    df: DataFrame,
    pred: str = "generated",
    ref: str = "reference",
    name: str = "BLEU",
    smoothing: str | None = None,
    scheme: str | None = None,
) -> DataFrame:
    """Sentence BLEU-4; without smoothing it is 0 when any n-gram order has no match."""
    scheme = scheme or ("whitespace" if smoothing else "13a")
    scored = bleu_stats(df, pred, ref, scheme).withColumn(name, F.round(bleu_score(smoothing), 4))
    return scored.select(*[c for c in df.columns if c != name], name)


def corpus_bleu(df: DataFrame, by: list[str], pred: str = "generated", ref: str = "reference") -> DataFrame:
    """BLEU of a corpus: summed statistics, one brevity penalty."""
    names = [f"{k}{n}" for k in "mt" for n in range(1, 5)] + ["pred_len", "ref_len"]
    sums = bleu_stats(df, pred, ref).groupBy(*by).agg(*[F.sum(c).alias(c) for c in names])
    return sums.select(*by, "pred_len", "ref_len", steady_round(bleu_score(), 4).alias("corpus_bleu"))


def alignment_score(stages: list[tuple[list, list]]) -> float:
    """Harmonic mean of precision and recall, lowered by how scattered the matches are.

    Each stage gives the two texts in one form (word, stem, synonym class). Equal
    forms not yet paired are paired, the last of one text with the last of the other.
    """
    pair: dict = {}
    taken: set = set()
    for hyp, ref in stages:
        free: dict = {}
        for j, word in enumerate(ref):
            if j not in taken:
                free.setdefault(word, []).append(j)
        for i in range(len(hyp) - 1, -1, -1):
            spots = free.get(hyp[i])
            if spots and i not in pair:
                pair[i] = spots.pop()
                taken.add(pair[i])
    matches = len(pair)
    if not matches:
        return 0.0
    spots = sorted(pair.items())
    chunks = 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(spots, spots[1:]))
    p, r = matches / len(stages[0][0]), matches / len(stages[0][1])
    mean = p * r / (METEOR_ALPHA * p + (1 - METEOR_ALPHA) * r)
    return (1 - METEOR_GAMMA * (chunks / matches) ** METEOR_BETA) * mean


def meteor(
    df: DataFrame,
    pred: str = "generated",
    ref: str = "reference",
    name: str = "METEOR",
    stem_words: bool = True,
    synonyms: dict[str, str] | None = None,
    scheme: str = "13a",
) -> DataFrame:
    """Alignment score over exact, stemmed and (optionally) synonym matches.

    ``synonyms`` maps a word to the name of its synonym class.
    """
    table = dict(synonyms or {})
    forms = [stem] if stem_words else []
    if table:
        forms.append(lambda w: table.get(w, w))

    @F.arrow_udf(T.DoubleType())
    def score(h: pa.Array, r: pa.Array) -> pa.Array:
        out = []
        for words, ids, size_h, size_r in _chunks(h, r, scheme):
            coded = [ids, *[_classes(words, form)[ids] for form in forms if words]]
            rows = zip(*[_row_lists(c, size_h, size_r) for c in coded])
            out += [alignment_score(stages) for stages in rows]
        return pa.array(out, pa.float64())

    value = score(F.lower(pred), F.lower(ref))
    return df.withColumn(name, F.round(F.coalesce(value, F.lit(0.0)), 4))


# Tokens of one side that are compared with a block of the other at a time.
MATCHED = 512


def block_width(vectors: DataFrame, item: str, block: int) -> float:
    """How many positions hold about ``block`` tokens where a side of more tokens is densest; positions may have gaps."""
    sides = vectors.groupBy(item, "side").agg(F.count("pos").alias("n"), (F.max("pos") - F.min("pos") + 1).alias("span"))
    gaps = sides.filter(F.col("n") > block).agg(F.min(F.col("span") / F.col("n"))).first()[0]
    return block * max(1.0, gaps or 1.0)


def greedy_cosine_f1(vectors: DataFrame, item: str = "item_id", block: int = 4096) -> DataFrame:
    """Greedy embedding match per item: precision, recall and F1.

    ``vectors`` is (item, side in candidate/reference, pos, vec). Every token
    takes its best cosine on the other side. Sides are cut into blocks of about
    ``block`` tokens; a pair of blocks returns one maximum per token, so no token pair
    leaves a task and a long item is spread over its block pairs. A token goes to
    as many pairs as the other side has blocks.
    """
    width = block_width(vectors, item, block)
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    # a vector without length has cosine 0 with any other
    unit = F.transform("vec", lambda x: F.coalesce(F.try_divide(x.cast("double"), length), F.lit(0.0)))
    placed = vectors.withColumns({"__unit": unit, "__block": F.floor(F.col("pos") / F.lit(width))})
    blocks = placed.groupBy(item, "side", "__block").agg(
        F.collect_list(F.struct("pos", F.col("__unit").alias("vec"))).alias("rows")
    )
    # which blocks meet is settled by their numbers; vectors then go to pairs of blocks, never to an item as a whole
    numbers = placed.select(item, "side", "__block").distinct().groupBy(item).agg(
        *[F.collect_list(F.when(F.col("side") == s, F.col("__block"))).alias(s) for s in ("candidate", "reference")]
    )
    meet = numbers.select(item, F.explode("candidate").alias("__a"), "reference").select(item, "__a", F.explode("reference").alias("__b"))
    left, right = (
        meet.withColumnRenamed(own, "__block").join(
            blocks.filter(F.col("side") == side).select(item, "__block", F.col("rows").alias(name)), [item, "__block"],
        ).withColumnRenamed("__block", own)
        for side, own, name in (("candidate", "__a", "cand"), ("reference", "__b", "ref"))
    )
    pairs = left.join(right, [item, "__a", "__b"])
    kind = vectors.schema[item].dataType.simpleString()

    def best(batches):
        for batch in batches:
            for key, cand, ref in zip(batch[item], batch["cand"], batch["ref"]):
                a = np.array([row["vec"] for row in cand])
                b = np.array([row["vec"] for row in ref])
                best_a, best_b = [], np.full(len(b), -np.inf)
                for start in range(0, len(a), MATCHED):
                    cosines = a[start : start + MATCHED] @ b.T
                    best_a.append(cosines.max(1))
                    np.maximum(best_b, cosines.max(0), out=best_b)
                for side, rows, top in (("candidate", cand, np.concatenate(best_a)), ("reference", ref, best_b)):
                    yield pd.DataFrame(
                        {item: key, "side": side, "pos": [row["pos"] for row in rows], "best": top}
                    )

    per_token = (
        pairs.mapInPandas(best, f"{item} {kind}, side string, pos long, best double")
        .groupBy(item, "side", "pos").agg(F.max("best").alias("best"))
    )
    sides = per_token.groupBy(item).agg(
        F.avg(F.when(F.col("side") == "candidate", F.col("best"))).alias("p"),
        F.avg(F.when(F.col("side") == "reference", F.col("best"))).alias("r"),
    )
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")))
    return sides.select(
        item,
        steady_round("p", 4).alias("precision"),
        steady_round("r", 4).alias("recall"),
        steady_round(F.coalesce(f1, F.lit(0.0)), 4).alias("f1"),
    )


def corpus_means(df: DataFrame, by: list[str], scores: list[str]) -> DataFrame:
    """Mean of each row score per corpus."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), *[steady_round(F.avg(s), 4).alias(f"mean_{s}") for s in scores]
    )


def cost_and_co2(
    df: DataFrame,
    rates: DataFrame,
    prompt_tokens: int = SYSTEM_PROMPT_TOKENS,
    grams_per_kwh: float = GRAMS_PER_KWH,
    min_tokens: int = 0,
    key: str = "model",
) -> DataFrame:
    """Token counts, cost in USD and CO2 in grams per row."""
    t_in = approx_tokens(F.col("input"), "quarter", min_tokens) + prompt_tokens
    t_out = approx_tokens(F.col("generated"), "quarter", min_tokens)
    counted = df.withColumns({"Tokens_Input": t_in, "Tokens_Output": t_out})
    rated = with_rates(counted, rates, DEFAULT_RATES, key)
    cost = F.col("Tokens_Input") * F.col("price_in") + F.col("Tokens_Output") * F.col("price_out")
    co2 = (F.col("Tokens_Input") + F.col("Tokens_Output")) * F.col("kwh_per_token") * grams_per_kwh
    return rated.withColumns({"Coste_USD": steady_round(cost, 8), "CO2_gramos": steady_round(co2, 6)}).drop(*DEFAULT_RATES)


def with_seconds(df: DataFrame, col: str = "seconds", default: float = DEFAULT_SECONDS) -> DataFrame:
    """Time column as a number; unreadable times get the default."""
    return df.withColumn("Time_seconds", parse_time(F.col(col), default))
