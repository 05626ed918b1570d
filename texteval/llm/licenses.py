"""License notices by an exact set-similarity join of text blocks with notice templates.

A template is the set of words of one printed notice. Texts are cut into blocks: windows of twice
a scale's words, one every scale, so each run of up to ``scale`` words lies whole in a block. A block meets a
template if it holds at least ``THRESHOLD`` of the template's words. The join is exact: tokens are ordered by
their document frequency in the corpus, rarest first, and

* prefix filter: a pair that meets the threshold shares a token of the template's prefix,
* length filter: a block with fewer template words than the template needs is no partner,
* positional filter: what may follow the first shared token must still reach the need,

and every candidate left is counted. Only built-in functions run on the main path.
"""

from __future__ import annotations

import re
from fractions import Fraction
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of anything but the ASCII characters that are no digit or lower-case letter; the complement is seven times slower in Java.
WORDS = r"[0-9a-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
THRESHOLD = Fraction(9, 10)
LEAST_SCALE = 8
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices as the licenses print them.
TEMPLATES: list[tuple[str, str]] = [
    ("agpl", "GNU Affero General Public License"),
    ("apache-2.0", "Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
            "following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "CC BY-NC"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial"),
    ("cc-by-sa", "CC BY-SA"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike"),
    ("cc0", "has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("gpl-2.0", "GNU General Public License, version 2"),
    ("gpl-3.0", "GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "GNU Lesser General Public License"),
    ("mit", "under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the Software"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any "
                 "means, without the prior written permission of the publisher"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
                 "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
]


def _prepared(templates: list[tuple[str, str]], threshold: Fraction) -> list[dict]:
    """Token set, scale and need of each template."""
    made = []
    for k, (label, notice) in enumerate(templates):
        found = re.findall(r"[0-9a-z]+", notice.translate(str.maketrans(UPPER, LOWER)))
        scale = LEAST_SCALE
        while scale < len(found):
            scale *= 2
        tokens = sorted(set(found))
        made.append({"template": k, "label": label, "tokens": tokens, "scale": scale, "need": ceil(threshold * len(tokens))})
    return made


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORDS), F.lit(0))


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def token_order(docs: DataFrame, tokens: list[str]) -> list[str]:
    """``tokens`` from rare to common by the documents that hold them; as many rows as tokens come to the driver."""
    # outer: else the optimizer adds a filter on the array's size, which splits the text once more
    held = docs.select(F.explode_outer(F.array_intersect(_texts(tokens), words_of(F.col("text")))).alias("token"))
    count = {r.token: r.n for r in held.filter("token is not null").groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(tokens, key=lambda t: (count.get(t, 0), t))


def _blocks(scale: int, prefixes: list[str], universe: list[str], least: int) -> Column:
    """The blocks of ``__words`` that hold a prefix token, each with its template words from rare to common."""
    # get() is one look-up; slice() would walk the whole text for each block
    window = lambda i: F.transform(
        F.sequence(i, F.least(i + 2 * scale, F.size("__words")) - 1), lambda k: F.get("__words", k)
    )
    starts = F.sequence(F.lit(0), F.greatest(F.size("__words") - 1, F.lit(0)), F.lit(scale))
    held = F.filter(starts, lambda i: F.arrays_overlap(window(i), _texts(prefixes)))
    return F.transform(
        F.when(F.arrays_overlap("__words", _texts(prefixes)), held),
        lambda i: F.struct(
            F.lit(scale).alias("scale"), i.alias("start"), F.array_intersect(_texts(universe), window(i)).alias("tokens"),
            F.lit(least).alias("least"),
        ),
    )


def find_blocks(
    docs: DataFrame, keys: list[str | Column],
    templates: list[tuple[str, str]] = TEMPLATES, threshold: Fraction = THRESHOLD,
) -> DataFrame:
    """All pairs of a text block and a template that meet the threshold.

    Rows: keys, start_word and end_word (exclusive) of the block, label, template (its number), overlap and
    containment. Null and empty texts have no block, repeated rows are found once each, other columns are
    ignored, an empty table gives no rows; a text of n words makes about n / 8 blocks of bounded size.
    """
    made = _prepared(templates, threshold)
    order = token_order(docs, sorted({t for m in made for t in m["tokens"]}))
    rank = {t: i for i, t in enumerate(order)}
    index, cut = [], []
    for scale in sorted({m["scale"] for m in made}):
        own = [m for m in made if m["scale"] == scale]
        universe = sorted({t for m in own for t in m["tokens"]}, key=rank.get)
        least, prefixes = min(m["need"] for m in own), set()
        for m in own:
            by_rank = sorted(m["tokens"], key=rank.get)
            prefix = by_rank[: len(by_rank) - m["need"] + 1]
            prefixes.update(prefix)
            index += [(scale, t, i, m["template"], m["label"], m["need"], by_rank) for i, t in enumerate(prefix)]
        cut.append(_blocks(scale, sorted(prefixes), universe, least))
    blocks = (
        docs.select(*keys, words_of(F.col("text")).alias("__words"))
        .withColumn("__blocks", F.flatten(F.filter(F.array(*cut), lambda b: b.isNotNull())))
    )
    names = [c for c in blocks.columns if c not in ("__words", "__blocks")]
    end = F.least(F.col("__b.start") + 2 * F.col("__b.scale"), F.col("__n")).alias("__end")
    blocks = blocks.select(*names, F.size("__words").alias("__n"), F.explode_outer("__blocks").alias("__b")).filter("__b is not null")
    # the block's own prefix: a partner shares one of its first |B| - need + 1 tokens too
    shared = blocks.select(
        *names, "__b", end,
        F.posexplode(F.slice("__b.tokens", F.lit(1), F.greatest(F.size("__b.tokens") - F.col("__b.least") + 1, F.lit(0)))).alias("__j", "__token"),
    )
    # one row a prefix token of each template: bounded by the template list
    known = docs.sparkSession.createDataFrame(
        index, "__scale int, __t string, __i int, template int, label string, __need int, __tokens array<string>"
    )
    pairs = shared.join(F.broadcast(known), (F.col("__b.scale") == F.col("__scale")) & (F.col("__token") == F.col("__t")))
    size, wanted = F.size("__b.tokens"), F.size("__tokens")
    common = F.array_intersect("__tokens", "__b.tokens")
    return (
        pairs.filter(size >= F.col("__need"))
        .filter(F.least(size - F.col("__j"), wanted - F.col("__i")) >= F.col("__need"))
        .withColumn("__common", common)
        # a pair counts at its first shared token only
        .filter((F.element_at("__common", 1) == F.col("__token")) & (F.size("__common") >= F.col("__need")))
        .select(
            *names, F.col("__b.start").cast("long").alias("start_word"), F.col("__end").cast("long").alias("end_word"),
            "label", "template", F.size("__common").alias("overlap"), (F.size("__common") / wanted).alias("containment"),
        )
    )


def _phrase_starts(words: str) -> Column:
    """Start and label of each place where a phrase's words stand consecutively."""
    def named(i: Column) -> Column:
        label = F.lit(None).cast("string")
        for phrase, name in PHRASES.items():
            stands = F.lit(True)
            for k, part in enumerate(phrase.split(" ")):
                stands = stands & (F.get(F.col(words), i + k) == part)
            label = F.when(stands, F.lit(name)).otherwise(label)
        return F.struct(i.alias("start"), label.alias("label"))

    firsts = [p.split(" ")[0] for p in PHRASES]
    places = F.transform(F.sequence(F.lit(0), F.size(words) - 1), named)
    found = F.filter(places, lambda p: p["label"].isNotNull())
    return F.when(F.arrays_overlap(F.col(words), _texts(firsts)), found)


def scan(docs: DataFrame, keys: list[str], templates: list[tuple[str, str]] = TEMPLATES, threshold: Fraction = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs`` (keys and text): base places, labels and score.

    ``score`` is 1 for a base phrase, else the largest containment of a template that was met, else 0. Null text
    counts as empty: no words, no places, empty labels, score 0. Repeated rows give equal rows, other columns
    are left out, an empty table gives no rows. What is met depends on the text alone, so it is summed by the text's
    digest and joined back on that; texts themselves are not moved.
    """
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    met = (
        find_blocks(docs, [digest.alias("__digest")], templates, threshold)
        .groupBy("__digest")
        .agg(F.collect_set("label").alias("__met"), F.max("containment").alias("__most"))
    )
    base = (
        docs.select(*keys, digest.alias("__digest"), words_of(F.col("text")).alias("__words"))
        .withColumn("__found", _phrase_starts("__words"))
        .select(
            *keys, "__digest",
            F.size("__words").cast("long").alias("n_words"),
            F.coalesce(F.size("__found"), F.lit(0)).cast("long").alias("n_base"),
            F.array_min("__found.start").cast("long").alias("first_word"),
            F.array_max("__found.start").cast("long").alias("last_word"),
            F.coalesce(F.array_sort(F.array_distinct("__found.label")), F.array().cast("array<string>")).alias("__base"),
        )
    )
    return base.join(met, "__digest", "left").select(
        *keys, "n_words", "n_base", "first_word", "last_word",
        F.array_join("__base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("__base", F.coalesce("__met", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("__base") > 0, F.lit(1.0)).otherwise(F.coalesce("__most", F.lit(0.0))).alias("score"),
    )
