"""Labels for p-values and effect sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Significance stars and effect classes with their upper bounds.
STARS = [(0.001, "***"), (0.01, "**"), (0.05, "*")]
NO_STARS = "n.s."
EFFECTS = [(0.1, "nulo"), (0.3, "pequeño"), (0.5, "mediano")]
LARGEST_EFFECT = "grande"
TINY_P = 1e-300


def _ladder(col: Column, steps: list[tuple[float, str]], last: str) -> Column:
    out = None
    for bound, label in steps:
        test = col < F.lit(bound)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.when(col.isNotNull(), F.lit(last))


def p_stars(p: Column) -> Column:
    return _ladder(p, STARS, NO_STARS)


def effect_class(r: Column) -> Column:
    return _ladder(r, EFFECTS, LARGEST_EFFECT)


def p_label(p: Column, style: str = "global") -> Column:
    """Readable p-value: the global report shows small ones in scientific form."""
    plain = F.format_string("%.4f", p)
    if style == "global":
        return (
            F.when(p < F.lit(TINY_P), F.lit("< 1.0e-300"))
            .when(p < 0.001, F.format_string("%.2e", p))
            .when(p.isNotNull(), plain)
        )
    if style == "posthoc":
        return F.when(p < 0.001, F.lit("< 0.001")).when(p.isNotNull(), plain)
    raise ValueError(f"unknown style {style!r}")
