"""Numeric column helpers: keyed pseudo-random values, decibels, clipping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_MODULUS = 10007


def keyed_uniform(lo: float, hi: float, key: Column, idx: Column, a: int, b: int,
                  m: int = KEY_MODULUS) -> Column:
    """Deterministic value in [lo, hi) from (key, idx): ``pmod(a*key + b*idx, m) / m``
    scaled.  Replaces unseeded random draws so results do not depend on
    partitioning or retries."""
    # Reduced before the products, which then cannot overflow for any 64-bit key.
    small = lambda c: F.pmod(c.cast("long"), F.lit(m))
    u = F.pmod(small(key) * a + small(idx) * b, F.lit(m)) / F.lit(float(m))
    return F.lit(lo) + F.lit(hi - lo) * u


def db_to_gain(db: Column) -> Column:
    """Amplitude ratio of a gain in decibels: 10^(dB/20)."""
    return F.pow(F.lit(10.0), db / F.lit(20.0))


def gain_to_db(g: Column) -> Column:
    return F.lit(20.0) * F.log10(g)


def clip(x: Column, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))
