"""Token ids of whole texts, word by word from a bounded cache.

The tokenizer drops white space and never joins across it, so the ids of a text
are the ids of its blank-separated words, and those of a word the ids of its runs of letters and of
symbols and of its digits. Arrow splits many texts at once, names each of their distinct words once and finds
those seen before in one array.
Texts with a blank that ``split`` and the tokenizer may see differently are encoded in one piece.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Blanks beyond space, tab, line feed and carriage return, and the mark put between words.
UNUSUAL = [*map(chr, (1, 0x0B, 0x0C, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))]
UNUSUAL_ASCII = [c for c in UNUSUAL if c.isascii()]
_UNUSUAL_CLASS = "[" + "".join(rf"\x{{{ord(c):x}}}" for c in UNUSUAL) + "]"
MARK = "\x01"
CACHED_WORDS = 100_000
LONGEST_CACHED = 64
#: Words of earlier texts that are kept, in arrays (about 40 MB when full); all are forgotten when full.
STORED_WORDS = 750_000
#: Bytes of text whose words are looked up at once.
TEXT_BYTES = 4 << 20
#: Words whose normal form and cuts are plain: printable ASCII but the apostrophe, and Latin-1 letters.
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(rf"[{_LATIN}0-9!-&(-~]+")
UNIT = re.compile(rf"[{_LATIN}]+|[0-9]|[^{_LATIN}0-9]+")
_PROBES = ("Straße", "ÀÉÎÕÜ,&&&", "x1.22-b", "<|endoftext|>")


class WordIds:
    """Little-endian unsigned 32-bit ids of texts; the cache forgets all words when full."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        (mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        names = self.tokenizer.get_vocab()
        self.is_mark, self.ends_word = (np.zeros(max(names.values()) + 1, dtype=bool) for _ in range(2))
        self.is_mark[mark] = True
        self.ends_word[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {}
        self._forget()
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # its own cache costs more than it saves on words not seen before
        latin = "".join(map(chr, range(0xDF, 0x100))).replace("÷", "")
        self.as_bytes = str.maketrans({c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in latin})
        # a tokenizer with other rules encodes all its words in full
        self.by_unit = all(self._plain([w]) == [self.whole(w)] for w in _PROBES)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _plain(self, words: list[str]) -> list[bytes]:
        """Ids of plain words, from those of their units; units are cached."""
        made, units, tokenize = [], self.cache, self.model.tokenize
        for word in words:
            parts = []
            for unit in UNIT.findall(word.lower()):
                ids = units.get(unit)
                if ids is None:
                    tokens = tokenize(unit if unit.isascii() else unit.translate(self.as_bytes))
                    ids = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
                    self._keep(unit, ids)
                parts.append(ids)
            made.append(parts[0] if len(parts) == 1 else b"".join(parts))
        return made

    def _keep(self, word: str, ids: bytes) -> None:
        if len(word) <= LONGEST_CACHED:
            if len(self.cache) >= CACHED_WORDS:
                self.cache.clear()
            self.cache[word] = ids

    def _new_words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words not seen before."""
        plain = [w for w in words if PLAIN.fullmatch(w)] if self.by_unit else []
        if len(plain) == len(words):
            return self._plain(words)
        made = dict(zip(plain, self._plain(plain)))
        made |= self._others([w for w in words if w not in made])
        return [made[w] for w in words]

    def _others(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words by the whole tokenizer.

        A word of letters only is one unit for it, and its last id is marked as a word end;
        other words are separated by the mark and cut at the mark's id.
        """
        plain = [w for w in words if w.isalpha()]
        made = self._cut(plain, " ".join(plain), self.ends_word)
        if made is None:
            plain, made = [], {}
        rest = [w for w in words if w not in made] if len(made) < len(words) else []
        if rest:
            made |= self._cut(rest, f" {MARK} ".join([*rest, ""]), self.is_mark, 1)
        return made

    def _cut(self, words: list[str], text: str, cuts, drop: int = 0) -> dict[str, bytes] | None:
        if not words:
            return {}
        ids = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (np.flatnonzero(cuts[ids]) + 1).tolist()
        if len(ends) != len(words):
            return None
        raw = ids.tobytes()
        return {w: raw[4 * a : 4 * (b - drop)] for w, a, b in zip(words, [0, *ends], ends)}

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        # looking for one character is much faster than for a class of them
        if any(c in text for c in (UNUSUAL_ASCII if text.isascii() else UNUSUAL)):
            return self.whole(text)
        return b"".join(self._words(text.split()))

    def _words(self, words: list[str]) -> list[bytes]:
        ids = list(map(self.cache.get, words))
        if None in ids:
            new = list({w for w, x in zip(words, ids) if x is None})
            fresh = dict(zip(new, self._new_words(new)))
            ids = [x if x is not None else fresh[w] for w, x in zip(words, ids)]
            for w, x in fresh.items():
                self._keep(w, x)
        return ids

    def of_texts(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, ``end`` after each; those of text i are between bounds i and i + 1."""
        odd = pc.fill_null(pc.match_substring_regex(texts, _UNUSUAL_CLASS), False).to_numpy(zero_copy_only=False)
        wholes = [self.whole(text) for text in texts.filter(pa.array(odd)).to_pylist()]
        if wholes:
            texts = pc.if_else(pa.array(odd), pa.scalar("", texts.type), texts)
        lists = pc.ascii_split_whitespace(texts)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        words = lists.flatten()
        real = pc.greater(pc.binary_length(words), 0)  # blanks at either end leave an empty word there
        owner = np.repeat(np.arange(len(texts)), sizes)[real.to_numpy(zero_copy_only=False)]
        named = words.filter(real).dictionary_encode()
        length, first, ids = self._stored(named.dictionary)
        tail = [*wholes, struct.pack("<I", end)]
        length = np.concatenate([length, [len(x) // 4 for x in tail]])
        first = np.concatenate([first, len(ids) + np.cumsum(length[-len(tail) :]) - length[-len(tail) :]])
        ids = np.concatenate([ids, np.frombuffer(b"".join(tail), "<u4")])
        # each text is its words, or one entry for the whole, and the end
        ends = np.cumsum(np.bincount(owner, minlength=len(texts)) + odd + 1)
        entry = np.full(ends[-1] if len(ends) else 0, len(length) - 1)
        entry[np.arange(len(owner)) + (np.cumsum(odd + 1) - odd - 1)[owner]] = named.indices.to_numpy()
        entry[ends[odd] - 2] = len(named.dictionary) + np.arange(len(wholes))
        n = length.take(entry)
        stop = np.cumsum(n)
        at = np.repeat(first.take(entry) - stop + n, n)
        at += np.arange(len(at))
        return ids.take(at), np.concatenate([[0], stop[ends - 1]])

    def _stored(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many ids each distinct word has, where they begin, and all ids."""
        if len(self.store) >= STORED_WORDS:
            self._forget()
        found = pc.index_in(words, self.store)
        missing = found.is_null()
        place = pc.fill_null(found, 0).to_numpy()
        new = np.flatnonzero(missing.to_numpy(zero_copy_only=False))
        length, first, ids = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), self.ids
        if len(self.store):
            length, first = (self.starts[place + 1] - self.starts[place]).astype(np.int64), self.starts[place].astype(np.int64)
        if len(new):
            fresh = words.filter(missing)
            long = pc.greater(pc.binary_length(fresh), 4 * LONGEST_CACHED).to_numpy(zero_copy_only=False)
            order = np.argsort(long, kind="stable")  # words that are not kept come last
            new, fresh, kept = new[order], fresh.take(pa.array(order)), len(new) - np.count_nonzero(long)
            made = self._new_words(fresh.to_pylist())
            n = np.array([len(x) // 4 for x in made])
            stop = len(ids) + np.cumsum(n)
            length[new], first[new] = n, stop - n
            ids = np.concatenate([ids, np.frombuffer(b"".join(made), "<u4")])
            if kept:
                self.store = pa.concat_arrays([self.store, fresh.slice(0, kept)])
                self.starts = np.concatenate([self.starts, stop[:kept].astype(np.int32)])
                self.ids = ids[: stop[kept - 1]]
        return length, first, ids

    def _forget(self) -> None:
        self.store, self.starts, self.ids = pa.array([], pa.string()), np.zeros(1, np.int32), np.zeros(0, "<u4")


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One cache per worker process and tokenizer file."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]
