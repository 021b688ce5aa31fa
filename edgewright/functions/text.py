"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes that a knowledge-graph name may carry.
PREFIXES = ("/c/en/", "/c/", "/r/")


def clean_text(column: Column | str) -> Column:
    """Without a leading known prefix; ``_``, ``-`` and ``/`` become blanks, blanks are collapsed."""
    bare = F.regexp_replace(column, "^(" + "|".join(PREFIXES) + ")", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[_/-]", " "), r"\s+", " "))


def split_camel(column: Column | str) -> Column:
    """A blank between a lower-case letter or digit and the capital after it."""
    return F.regexp_replace(column, "([a-z0-9])([A-Z])", "$1 $2")


def content_hash(*columns: Column | str, bits: int = 256) -> Column:
    """SHA-2 of the values joined by a unit separator; nulls are empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns]), bits)


def combinations_of(n: Column, k: int) -> Column:
    """C(n, k) as a double, 0 for n < k."""
    out = F.lit(1.0)
    for i in range(k):
        out = out * (n - i) / (i + 1)
    return F.when(n >= k, F.round(out)).otherwise(0.0)


def clamp(x: Column, low: float, high: float) -> Column:
    """``x`` within low..high."""
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
