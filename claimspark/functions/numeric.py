"""Column -> Column numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal or scientific number, optionally padded; rejects Java-only
# forms such as "1d" / "1f" / "0x1p3" that a cast to double would accept.
_NUMBER = "^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$"


# Doubles below this magnitude fit a bigint.
_BIGINT_LIMIT = 2.0 ** 63


def parse_count(c: Column | str) -> Column:
    """String -> double that fits a bigint, or null when it is not a plain number in that range."""
    c = F.col(c) if isinstance(c, str) else c
    as_double = F.when(c.rlike(_NUMBER), F.trim(c).try_cast("double"))
    return F.when(F.abs(as_double) < F.lit(_BIGINT_LIMIT), as_double)


def coerce_count(c: Column | str) -> Column:
    """String count -> bigint: non-numbers, NaN, infinities, values out of range and null become 0; fractions truncate."""
    return F.coalesce(parse_count(c), F.lit(0.0)).cast("bigint")


def safe_ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """num / den with a zero or null denominator giving `default` (ANSI-safe)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(default))


def softmax2(logit0: Column, logit1: Column) -> tuple[Column, Column]:
    """Two-class softmax, shifted by the larger logit for stability."""
    m = F.greatest(logit0, logit1)
    e0, e1 = F.exp(logit0 - m), F.exp(logit1 - m)
    return e0 / (e0 + e1), e1 / (e0 + e1)
