"""Repeatable pseudo-random draws: the same key gives the same draw in every run and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGE = 1 << 32


def key(*parts: Column | str | int) -> Column:
    """``a:b:c`` text key of the given columns and constants."""
    cols = [F.lit(str(p)) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p) for p in parts]
    return F.concat_ws(":", *[c.cast("string") for c in cols])


def ticket(*parts: Column | str | int) -> Column:
    """Uniform hexadecimal text; the smallest ticket of a group is a uniform choice."""
    return F.md5(key(*parts))


def uniform(*parts: Column | str | int) -> Column:
    """Uniform double in [0, 1) with 32 bits."""
    return F.conv(F.substring(ticket(*parts), 1, 8), 16, 10).cast("bigint") / F.lit(float(_RANGE))


def below(p: float, *parts: Column | str | int) -> Column:
    """True with probability ``p``; compares hexadecimal prefixes, so no arithmetic per row."""
    if p <= 0.0:
        return F.lit(False)
    if p >= 1.0:
        return F.lit(True)
    return F.substring(ticket(*parts), 1, 8) < F.lit(f"{min(int(p * _RANGE), _RANGE - 1):08x}")
