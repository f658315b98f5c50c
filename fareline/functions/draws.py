"""Seeded pseudo-random columns that depend on the row only, never on partitioning or file order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hexadecimal digits are 52 bits, which a double holds exactly.
DRAW_DIGITS = 13
DRAW_RANGE = float(16**DRAW_DIGITS)


def priority(key: Column, seed: int) -> Column:
    """Uniform 128-bit priority of a row as hexadecimal text; text order is priority order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def unit_draw(key: Column, seed: int, name: str) -> Column:
    """Uniform draw in [0, 1) for the row ``key``; each ``name`` is an independent stream."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(name), key.cast("string")))
    digits = F.conv(F.substring(digest, 1, DRAW_DIGITS), 16, 10)
    return digits.cast("bigint").cast("double") / F.lit(DRAW_RANGE)


def uniform_draw(key: Column, seed: int, name: str, low: float, high: float) -> Column:
    return F.lit(low) + F.lit(high - low) * unit_draw(key, seed, name)


def integer_draw(key: Column, seed: int, name: str, low: int, high: int) -> Column:
    """Uniform integer in [low, high)."""
    return F.lit(low) + F.floor(F.lit(float(high - low)) * unit_draw(key, seed, name))


def gamma2_draw(key: Column, seed: int, name: str, scale: float) -> Column:
    """Gamma draw of shape 2: the sum of two exponential draws."""
    first = F.ln(1 - unit_draw(key, seed, f"{name}1"))
    second = F.ln(1 - unit_draw(key, seed, f"{name}2"))
    return F.lit(-scale) * (first + second)
