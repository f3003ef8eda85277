"""Column expressions (JVM-side, codegen) and small driver-side math."""

from paddock.functions.odds import (
    clip_prob,
    expected_value,
    fractional_to_decimal,
    kelly_fraction,
    logit,
    settle,
)

__all__ = ["clip_prob", "expected_value", "fractional_to_decimal", "kelly_fraction", "logit", "settle"]
