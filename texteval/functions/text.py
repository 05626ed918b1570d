"""Text clean-up, token counts and tokenisers as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and patterns the clean-up must agree with.
WHITESPACE = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
THINK_CLOSED = r"(?s)<think>.*?</think>"
THINK_OPEN = r"(?s)<think>.*"
REASONING_MARKS = r"(?is)<think>.*?</think>|</?think>"
ROLE_AND_TEMPLATE_MARKS = r"^\s*(?i:assistant)\s*(?:assistant)?|<\|im_start\|>\n?|<\|im_end\|>"
ERROR_PREFIX = "Error:"
FOOTER_PREFIX = "---"
ONLY_REASONING = "Error: modelo solo genero thinking sin respuesta"
EMPTY_ANSWER = "Error: modelo devolvio respuesta vacia"
EMPTY_GENERATION = "<vacio>"

# Literal replacements and punctuation rules of the 13a tokeniser, in order.
LITERALS_13A = [
    ("<skipped>", ""), ("-\n", ""), ("\n", " "),
    ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
]
RULES_13A = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" $1 "),
    (r"([^0-9])([\.,])", r"$1 $2 "),
    (r"([\.,])([^0-9])", r" $1 $2"),
    (r"([0-9])(-)", r"$1 $2 "),
]
# A formula within a line; what lies between the marks is read once.
INLINE_MATH = r"\$([^$\n]*+)\$"
NOT_ASCII_WORD = "[^a-z0-9]+"
NOT_WORD = r"[^\p{L}\p{N}]+"


def strip(col: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.regexp_replace(col, f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def single_line(col: Column, cr: str = "") -> Column:
    """Newlines become spaces, carriage returns become ``cr``; then trim."""
    return strip(flatten_lines(col, cr))


def flatten_lines(col: Column, cr: str = "") -> Column:
    return F.replace(F.replace(col, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(cr))


def ellipsis(col: Column, n: int) -> Column:
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit("..."))).otherwise(col)


def strip_think(col: Column, empty_marker: str | None = ONLY_REASONING) -> Column:
    """Drop closed reasoning blocks, then an unclosed one to the end."""
    text = strip(F.regexp_replace(col, THINK_CLOSED, ""))
    text = strip(F.regexp_replace(text, THINK_OPEN, ""))
    if empty_marker is None:
        return text
    return F.when(text == "", F.lit(empty_marker)).otherwise(text)


def clean_output(col: Column) -> Column:
    """Chat output without what the model's template and its reasoning left in it.

    Reasoning goes first, with tags that have lost their partner. Of what remains, a role label goes only at the very
    beginning, so one behind a template mark is text; a second label written straight after it goes too. Template marks go
    anywhere, an opening one with its line end. Blanks around the rest go.
    """
    return strip(F.regexp_replace(F.regexp_replace(col, REASONING_MARKS, ""), ROLE_AND_TEMPLATE_MARKS, ""))


def is_error(col: Column) -> Column:
    return F.startswith(col, F.lit(ERROR_PREFIX))


def is_footer(col: Column) -> Column:
    return F.startswith(col, F.lit(FOOTER_PREFIX))


def approx_tokens(col: Column, rule: str = "quarter", min_tokens: int = 0) -> Column:
    """Token estimate from the length: ``len // 4``, or ``ceil(len / 3.5)`` for a budget."""
    size = F.length(F.coalesce(col, F.lit("")))
    if rule == "quarter":
        estimate = F.floor(size / F.lit(4.0))
    elif rule == "budget":
        estimate = F.ceil(size / F.lit(3.5))
    else:
        raise ValueError(f"unknown token rule {rule!r}")
    return F.greatest(estimate.cast("long"), F.lit(min_tokens).cast("long"))


def tokens(col: Column, scheme: str = "rouge") -> Column:
    """Token array: ``rouge`` (ASCII), ``unicode``, ``whitespace`` or ``13a``."""
    text = F.coalesce(col, F.lit(""))
    if scheme == "rouge":
        parts = F.split(F.regexp_replace(F.lower(text), NOT_ASCII_WORD, " "), " ")
    elif scheme == "unicode":
        parts = F.split(F.regexp_replace(F.lower(text), NOT_WORD, " "), " ")
    elif scheme == "whitespace":
        parts = F.split(text, f"{WHITESPACE}+")
    elif scheme == "13a":
        for old, new in LITERALS_13A:
            text = F.replace(text, F.lit(old), F.lit(new))
        text = F.concat(F.lit(" "), text, F.lit(" "))
        for pattern, spaced in RULES_13A:
            text = F.regexp_replace(text, pattern, spaced)
        parts = F.split(text, f"{WHITESPACE}+")
    else:
        raise ValueError(f"unknown token scheme {scheme!r}")
    return F.array_remove(parts, "")


def _once(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of a value that is computed once, however often ``made`` names it."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def normalise_math(col: Column) -> Column:
    """Formulas in bracket form: ``$$`` pairs become blocks on lines of their own, ``$`` pairs of one line stay in it.

    Marks pair from the left. A block mark gets a line end towards text beside it, unless one is there or a single
    ``$`` follows. A mark without a partner stays as it is; null stays null.
    """

    def blocks(parts: Column) -> Column:
        def block(part: Column, i: Column) -> Column:
            last = F.size(parts) - 1
            mark = (
                F.when(i == 0, F.lit("")).when(i % 2 == 0, F.lit(r"\]"))
                .when(i < last, F.lit(r"\[")).otherwise(F.lit("$$"))
            )
            ahead = (i > 0) & (part != "") & ~F.substring(part, 1, 1).isin("\n", "$")
            behind = (i < last) & (part != "") & ~F.endswith(part, F.lit("\n"))
            line_end = lambda wanted: F.when(wanted, F.lit("\n")).otherwise(F.lit(""))
            inline = F.regexp_replace(part, INLINE_MATH, r"\\($1\\)")
            return F.concat(mark, line_end(ahead), inline, line_end(behind))

        return F.array_join(F.transform(parts, block), "")

    return _once(F.split(col, r"\$\$"), blocks)


def signature(*cols: Column) -> Column:
    """A short, fixed-width key for a pair of texts; shuffles carry this, not the texts."""
    return F.md5(F.concat_ws("\x1f", *[strip(F.coalesce(c, F.lit(""))) for c in cols]).cast("binary"))


def parse_time(col: Column, default: float = 1.5) -> Column:
    """Seconds from text; quotes and semicolons are ignored, nonsense becomes ``default``."""
    cleaned = strip(F.regexp_replace(col.cast("string"), '[";]', ""))
    return F.coalesce(cleaned.try_cast("double"), F.lit(float(default)))
