"""Secret scans through nested encodings.

A worklist holds layers of a text. Each layer is scanned, then every decoder makes new layers of
it: percent escapes, character escapes, two-byte characters, base64 (also wrapped over lines), and
compressed streams in any decoded bytes. No layer is dropped for what it looks like: bytes that are
not UTF-8 become the characters of their values. It ends when no decoder finds anything new; a layer whose
content was seen before at the same place is not taken again, so cycles end. Spans found in a layer are mapped
back through the layers above it to code points of the text: escapes map one by one, a base64 run
or a compressed stream maps as a whole.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Order in which spans of one start are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(
    r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})"
    r"|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});"
)
#: An escape whose own first character is escaped again and again: any number of such layers is one step.
DEEP = re.compile(
    r"%(?:25){2,}(?=[0-9A-Fa-f]{2})|\\(?:u005[cC]){2,}(?=u[0-9A-Fa-f]{4})|\\(?:x5[cC]){2,}(?=x[0-9A-Fa-f]{2})|&(?:#38;){2,}(?=#[xX0-9])"
)
DEEP_HINTS = ("%2525", "\\u005", "\\x5", "&#38;#38;")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: A line break, as it is or as an escape, with the indent after it; a base64 run over several lines.
_BREAK = r"[\x20\t]*(?:\r\n?|\n|(?:\\r)?\\n)[\x20\t>]*"
BREAK = re.compile(_BREAK)
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16,}}+(?:{_BREAK}[A-Za-z0-9+/_-]{{16,}}+)*+(?:{_BREAK}[A-Za-z0-9+/_-]++)?+={{0,2}}")
#: A stretch of two-byte characters of the ASCII range, in either byte order.
WIDE = re.compile(r"\0?(?:[^\0]\0){3,}[^\0]?")
BYTES = re.compile(r"[\0-\xff]+")
#: How compressed streams begin: gzip, zlib, bzip2, xz, Zstandard.
MAGIC = re.compile(rb"(\x1f\x8b\x08)|(x[\x01\x5e\x9c\xda])|(BZh[1-9](?:1AY&SY|\x17rE8P\x90))|(\xfd7zXZ\0)|(\x28\xb5\x2f\xfd)")
MAGIC_TEXT = re.compile(MAGIC.pattern.decode("latin-1"))
#: A longer unpacked layer is read in windows of so many bytes, each half over the one before.
LAYER_BYTES = 64 << 20


class Layer:
    """A decoded text and where its characters come from in the layer above.

    ``cuts`` are the positions at which a piece begins; ``origin`` has for each piece its first and
    last-plus-one position above, and whether its characters map one to one. ``data`` are the bytes of a
    layer that maps as a whole; without them, characters below 256 are bytes if the layer is ``bytewise``.
    """

    bytewise = True

    def __init__(self, text: str, above: Layer | None = None, cuts: list[int] = (), origin: list[tuple] = (), data: bytes | None = None):
        self.text, self.above, self.cuts, self.origin, self.data = text, above, cuts, origin, data

    def span(self, start: int, end: int) -> tuple[int, int]:
        layer = self
        while layer.above is not None:
            i, j = bisect_right(layer.cuts, start) - 1, bisect_right(layer.cuts, end - 1) - 1
            a, _, one = layer.origin[i]
            c, d, last_one = layer.origin[j]
            start = a + (start - layer.cuts[i] if one else 0)
            end = c + (end - layer.cuts[j]) if last_one else d
            layer = layer.above
        return start, end


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets written openly in a text."""
    found = []
    small = text.lower()
    if any(key in small for key in ("password", "passwd", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def _rewritten(layer: Layer, pieces: list[tuple[int, int, str]]) -> Layer:
    """The layer with each (start, end, replacement); one replacement stands for its whole source."""
    out, cuts, origin, at, length = [], [], [], 0, 0
    for start, end, new in [*pieces, (len(layer.text), len(layer.text), "")]:
        for a, b, piece, one in ((at, start, layer.text[at:start], True), (start, end, new, False)):
            if piece:
                out.append(piece)
                cuts.append(length)
                origin.append((a, b, one))
                length += len(piece)
        at = end
    return Layer("".join(out), layer, cuts, origin)


def _percent(layer: Layer) -> Iterator[Layer]:
    if "%" in layer.text:
        pieces, single = [], []
        for m in PERCENT.finditer(layer.text):
            data, at = bytes.fromhex(m[0].replace("%", "")), m.start()
            single += [(at + 3 * i, at + 3 * i + 3, chr(b)) for i, b in enumerate(data)]
            for char in data.decode(errors="surrogateescape"):
                lone = "\udc80" <= char <= "\udcff"
                width = 3 if lone else 3 * len(char.encode())
                pieces.append((at, at + width, chr(ord(char) - 0xDC00) if lone else char))
                at += width
        if pieces:
            made = _rewritten(layer, pieces)
            made.bytewise = len(single) == len(pieces)
            yield made
        if len(single) > len(pieces):  # the bytes as they are may be a compressed stream
            yield _rewritten(layer, single)


def _escapes(layer: Layer) -> Iterator[Layer]:
    if "\\" in layer.text or "&#" in layer.text:
        pieces: list[tuple[int, int, str]] = []
        high = None
        for m in ESCAPE.finditer(layer.text):
            code = int(next(g for g in m.groups() if g), 10 if m[6] else 16)
            if high and high[1] == m.start() and 0xDC00 <= code < 0xE000:
                pieces.append((high[0], m.end(), chr(0x10000 + ((high[2] - 0xD800) << 10) + code - 0xDC00)))
            elif code < 0x110000 and not 0xD800 <= code < 0xE000:
                pieces.append((m.start(), m.end(), chr(code)))
            high = (m.start(), m.end(), code) if 0xD800 <= code < 0xDC00 else None
        if pieces:
            yield _rewritten(layer, pieces)


def _wide(layer: Layer) -> Iterator[Layer]:
    if layer.above is not None and "\0" in layer.text:
        pieces = []
        for m in WIDE.finditer(layer.text):
            start, end = m.span()
            if layer.data is not None:  # maps as a whole anyway
                pieces.append((start, end, m[0].replace("\0", "")))
            else:
                big = m[0][0] == "\0"
                pieces += [(i, min(i + 2, end), layer.text[i + big]) for i in range(start, end - big, 2)]
        if pieces:
            yield _rewritten(layer, pieces)


def _text(data: bytes) -> str:
    """UTF-8; a byte that is none is the character of its value."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        return re.sub("[\udc80-\udcff]", lambda m: chr(ord(m[0]) - 0xDC00), data.decode(errors="surrogateescape"))


def _stream(data: memoryview, at: int, kind: int) -> Iterator[bytes]:
    """Content of the compressed stream at ``at``, in pieces; returns where it ends, or None if it breaks off."""
    errors, step, limit = (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError), 1 << 16, (1 << 20,)
    if kind <= 2:
        unpack = zlib.decompressobj(31 if kind == 1 else 15)
    elif kind == 3:
        unpack = bz2.BZ2Decompressor()
    elif kind == 4:
        unpack = lzma.LZMADecompressor()
    else:
        import zstandard

        unpack, errors, step, limit = zstandard.ZstdDecompressor().decompressobj(), (*errors, zstandard.ZstdError), 1 << 10, ()
    try:
        while at < len(data) and not unpack.eof:
            part = data[at : at + step]
            at += len(part)
            while True:
                content = unpack.decompress(part, *limit)
                if content:
                    yield content
                part = unpack.unconsumed_tail if kind <= 2 else b""
                if unpack.eof or not part and not (limit and len(content) >= limit[0]) and (kind in (1, 2, 5) or unpack.needs_input):
                    break
    except errors:
        return None
    return at - len(unpack.unused_data) if unpack.eof else None


def _unpacked(data: bytes) -> Iterator[tuple[int, int, bytes, bool | None]]:
    """(start, end, content, whether it ends there: None if it goes on, False if it breaks off) of the compressed streams in ``data``.

    Streams that follow each other directly are one content; a long content comes in windows.
    """
    view, m = memoryview(data), MAGIC.search(data)
    while m:
        start, held, fresh, some, end, streams = m.start(), bytearray(), False, False, m.start(), 0
        while m is not None and end is not None:
            at, pieces = end, _stream(view, m.start(), m.lastindex)
            while True:
                try:
                    held += next(pieces)
                except StopIteration as stop:
                    end = stop.value
                    break
                fresh = some = True
                while len(held) >= LAYER_BYTES:
                    yield start, len(data), bytes(held[:LAYER_BYTES]), None
                    del held[: LAYER_BYTES // 2]
                    fresh = len(held) > LAYER_BYTES // 2
            streams += end is not None
            m = MAGIC.match(data, end) if end is not None else None
        strong = streams > 0 or data[start] != 0x78 or start == 0 and some  # two bytes of zlib may stand anywhere
        if fresh or end is not None or strong:
            yield start, len(data) if end is None else end, bytes(held) if fresh else b"", True if end is not None else False if strong else None
        m = MAGIC.search(data, end if end is not None else max(start, at) + 1)


def _members(layer: Layer, ends: dict) -> Iterator[Layer]:
    """The contents of compressed streams in the bytes of a decoded layer; ``ends`` gets which spans were read to the end."""
    if layer.data is not None:
        blocks = [(None, layer.data)]
    elif layer.above is not None and layer.bytewise and MAGIC_TEXT.search(layer.text):
        blocks = [(m.start(), m[0].encode("latin-1")) for m in BYTES.finditer(layer.text)]
    else:
        blocks = []
    for at, data in blocks:
        for start, end, content, whole in _unpacked(data):
            start, end = (0, len(layer.text)) if at is None else (at + start, at + end)
            if whole is not None:
                span = layer.span(start, end)
                ends[span] = ends.get(span, False) or whole
            if content:
                yield Layer(_text(content), layer, [0], [(start, end, False)], content)


def _wrapped(text: str) -> Iterator[list[tuple[int, int]]]:
    """The lines (start, end) of base64 runs that go over several lines."""
    for m in WRAPPED.finditer(text):
        lines, at = [], m.start()
        for cut in BREAK.finditer(text, m.start(), m.end()):
            lines.append((at, cut.start()))
            at = cut.end()
        lines.append((at, m.end()))
        end, follows = m.end(), text[m.end() : m.end() + 1]
        # a short last line belongs to the run if it ends it, and not if it begins a sentence
        if len(lines) > 1 and text[end - 1] != "=" and follows in (" ", ",", ".") and sum(b - a for a, b in lines) % 4:
            lines.pop()
        i, alone = 0, False
        while i < len(lines):
            width, j = lines[i][1] - lines[i][0], i + 1
            while j < len(lines) and lines[j][1] - lines[j][0] == width:
                j += 1
            if j < len(lines) and lines[j][1] - lines[j][0] < width:
                j += 1
            if j - i > 1 and j - i < len(lines):
                yield lines[i:j]
            alone |= j - i == 1
            whole = j - i == len(lines)
            i = j
        if len(lines) > 1 and (alone or whole):
            yield lines


def _base64(layer: Layer) -> Iterator[Layer]:
    text, covered = layer.text, set()

    def decoded(lines: list[tuple[int, int]]) -> Layer:
        run = "".join(text[a:b] for a, b in lines).rstrip("=").replace("-", "+").replace("_", "/")
        run = run[:-1] if len(run) % 4 == 1 else run
        data = base64.b64decode(run + "=" * (-len(run) % 4))
        return Layer(_text(data), layer, [0], [(lines[0][0], lines[-1][1], False)], data)

    if "\n" in text or "\r" in text or "\\n" in text:
        for lines in _wrapped(text):
            if all((b - a) % 4 == 0 for a, b in lines[:-1]):  # holds what its lines hold
                covered.update(a for a, _ in lines)
            yield decoded(lines)
    for m in BASE64.finditer(text):
        if m.start() not in covered:
            layers = decoded([m.span()])
            yield layers
            if "/" in m[0] and not _readable(layers.text) and not MAGIC.match(layers.data):  # a path may hold encoded parts
                for p in re.finditer(r"[^/]{16,}", m[0]):
                    if p[0] != m[0]:
                        yield decoded([(m.start() + p.start(), m.start() + p.end())])


def _readable(text: str) -> bool:
    return sum(c.isprintable() or c.isspace() for c in text) >= 0.95 * len(text)


def _decoded(layer: Layer, ends: dict) -> Iterator[Layer]:
    if any(hint in layer.text for hint in DEEP_HINTS):
        deep = [(m.start(), m.end(), m[0][0]) for m in DEEP.finditer(layer.text)]
        if deep:  # the other escapes follow from the layer without them
            return itertools.chain([_rewritten(layer, deep)], _wide(layer), _base64(layer), _members(layer, ends))
    return itertools.chain(_percent(layer), _escapes(layer), _wide(layer), _base64(layer), _members(layer, ends))


def find(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """Open spans, all spans (start, kind, end), and the number of compressed streams that break off."""
    if not text:
        return [], [], 0
    base, ends, seen = sorted(scan(text)), {}, set()
    spans = set(base)
    work = [_decoded(Layer(text), ends)]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
        elif layer.text:
            content = layer.text if layer.data is None else layer.data
            if len(content) > 4096:
                content = hashlib.blake2b(content if layer.data is not None else content.encode("utf-8", "surrogatepass")).digest()
            key = (content, layer.span(0, len(layer.text)))  # equal content at another place holds other spans
            if key not in seen:
                seen.add(key)
                spans |= {(a, kind, b) for s, kind, e in scan(layer.text) for a, b in (layer.span(s, e),)}
                work.append(_decoded(layer, ends))
    # a part of a run may look broken where the run is read whole
    read = [span for span, whole in ends.items() if whole]
    broken = [(a, b) for (a, b), whole in ends.items() if not whole and not any(c <= a and b <= d for c, d in read)]
    return base, sorted(spans), len(broken)


def listing(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


_FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long, unread long, redacted string"


def scan_texts(docs: DataFrame, keys: list[str], mark: str | None = None) -> DataFrame:
    """``keys`` of each row of ``docs`` (and text) with its secrets.

    n_assign, n_access, n_hex count the open spans of the text; base_sha256 digests them;
    spans lists all spans, open and decoded, in code points. With ``mark``, redacted is the text with each
    maximal run of overlapping spans replaced by it. Null text is empty (redacted stays null); repeated
    rows get the same result; other columns are left alone; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cell in batch.column(1):
                text = cell.as_py()
                base, spans, unread = find(text)
                clean, at = [], 0
                for start, _, end in spans if mark is not None else ():
                    if start >= at:
                        clean += [text[at:start], mark]
                    at = max(at, end)
                redacted = "".join([*clean, text[at:]]) if mark is not None and text is not None else None
                rows.append((
                    *(sum(s[1] == k for s in base) for k in range(3)),
                    hashlib.sha256(listing(base).encode()).hexdigest(), listing(spans), len(spans), unread, redacted,
                ))
            names = [part.split()[0] for part in _FOUND.split(", ")]
            kinds = [pa.int64() if " long" in part else pa.string() for part in _FOUND.split(", ")]
            columns = list(zip(*rows)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["key", *names]
            )

    rows = docs.select(F.struct(*keys).alias("key"), "text")
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, {_FOUND}").select("key.*", *[p.split()[0] for p in _FOUND.split(", ")])


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with secrets in the text replaced; n_chars, if there, is counted again.

    All other columns stay as they are, whatever their names; null text stays null.
    """
    rest = [c for c in docs.columns if c != "text"]
    inner = docs.select(F.struct(*rest).alias("__rest"), "text")
    clean = scan_texts(inner, ["__rest"], mark).select("__rest.*", F.col("redacted").alias("__text"))
    counted = F.coalesce(F.length("__text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType) if "n_chars" in rest else None
    return clean.select(*[
        F.col("__text").alias(c) if c == "text" else counted.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns
    ])
