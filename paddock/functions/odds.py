"""Price and staking expressions.  All return ``Column``; no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROB_EPS = 1e-12

# fixed values: the price grammar of the source data
EVENS_PREFIXES = ("evs", "evens")
FRACTION_PATTERN = r"(\d+)\s*/\s*(\d+)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_half_even(x: Column, digits: int = 2) -> Column:
    """Round to ``digits`` with ties to even on the scaled double (``rint``)."""
    scale = float(10 ** digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def fractional_to_decimal(col) -> Column:
    """Fractional price string -> decimal odds.

    trim+lower; ``evs``/``evens`` prefix -> 2.0; else first ``n / d`` found
    anywhere -> round(n/d + 1, 2); anything else (and d = 0) -> null.
    """
    s = F.lower(F.trim(_c(col)))
    num = F.regexp_extract(s, FRACTION_PATTERN, 1).cast("double")
    den = F.regexp_extract(s, FRACTION_PATTERN, 2).cast("double")
    evens = s.startswith(EVENS_PREFIXES[0]) | s.startswith(EVENS_PREFIXES[1])
    return (
        F.when(s.isNull(), F.lit(None).cast("double"))
        .when(evens, F.lit(2.0))
        .when(s.rlike(FRACTION_PATTERN), round_half_even(F.try_divide(num, den) + F.lit(1.0), 2))
        .otherwise(F.lit(None).cast("double"))
    )


def clip_prob(col, lo: float = PROB_EPS, hi: float = 1.0 - PROB_EPS) -> Column:
    c = _c(col)
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def logit(col) -> Column:
    c = _c(col)
    return F.ln(c / (F.lit(1.0) - c))


def expected_value(p, d) -> Column:
    """p*(d-1) - (1-p) for decimal odds d."""
    p, d = _c(p), _c(d)
    return p * (d - F.lit(1.0)) - (F.lit(1.0) - p)


def kelly_fraction(p, d) -> Column:
    """max((d*p - 1)/(d - 1), 0); d = 1 gives 0."""
    p, d = _c(p), _c(d)
    return F.coalesce(F.greatest(F.try_divide(d * p - F.lit(1.0), d - F.lit(1.0)), F.lit(0.0)), F.lit(0.0))


def settle(wager, d, won) -> Column:
    """Per-bet profit: win w*(d-1), lose -w, no bet 0."""
    w, d, won = _c(wager), _c(d), _c(won)
    return (
        F.when(w > 0, F.when(won == 1, w * (d - F.lit(1.0))).otherwise(-w))
        .otherwise(F.lit(0.0))
    )
