"""Deterministic orders and uniforms from MD5, the same on every engine."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_order(seed: int, *columns: Column | str) -> Column:
    """Text to order rows by as if at random: MD5 of ``seed-a-b-...``."""
    return F.md5(F.concat_ws("-", F.lit(seed), *columns))


def hash_text(seed: int, *values: int | str) -> str:
    """``hash_order`` of single values, none of them null."""
    return hashlib.md5("-".join(map(str, (seed, *values))).encode(), usedforsecurity=False).hexdigest()


def unit_hash(seed: int, *columns: Column | str) -> Column:
    """A number in [0, 1) from the first eight hexadecimal digits of the MD5."""
    return F.conv(F.substring(hash_order(seed, *columns), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
