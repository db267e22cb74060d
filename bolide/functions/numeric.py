"""Scalar building blocks shared by all operators.

All of them are plain column expressions, so they stay inside whole-stage
code generation and can be pushed below joins and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Speed of light in m/s, pi as a double.
LIGHT_SPEED = 299792458.0
PI = 3.141592653589793
TWO_PI = 2 * PI

# Beyond this size a double has no digits left to round away.
_ROUND_LIMIT = 9.0e15

# Digits of the Roman numerals, ones to thousands.
_ROMAN_ONES = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
_ROMAN_TENS = ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]
_ROMAN_HUNDREDS = ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"]
_ROMAN_THOUSANDS = ["", "M", "MM", "MMM"]


def round_away(x: Column, digits: int) -> Column:
    """Round half away from zero; never yields a negative zero.

    Spark's own ``round`` goes through the decimal text of a double and
    engines disagree on ties such as 1.005, so the IEEE form is spelled out.
    """
    scale = float(10**digits)
    scaled = F.abs(x) * F.lit(scale)
    rounded = F.signum(x) * F.floor(scaled + F.lit(0.5)) / F.lit(scale) + F.lit(0.0)
    return F.when(scaled < F.lit(_ROUND_LIMIT), rounded).otherwise(x)


def hundredths(x: Column) -> Column:
    """Whole hundredths of ``x`` as a double, half away from zero."""
    return F.signum(x) * F.floor(F.abs(x) * F.lit(100.0) + F.lit(0.5)) + F.lit(0.0)


def wrap_angle(x: Column, period: float) -> Column:
    """Truncating remainder: the sign follows the angle."""
    return x % F.lit(period)


def is_true(condition: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(condition, F.lit(False))


def elapsed_seconds(later: Column, earlier: Column) -> Column:
    """Seconds between two timestamps, to the microsecond."""
    a = F.unix_micros(later.cast("timestamp"))
    b = F.unix_micros(earlier.cast("timestamp"))
    return (a - b) / F.lit(1e6)


def at_seconds(epoch: Column, seconds: Column) -> Column:
    """The timestamp ``seconds`` after ``epoch``."""
    micros = F.unix_micros(epoch.cast("timestamp")) + F.floor(
        seconds * F.lit(1e6) + F.lit(0.5)
    )
    return F.timestamp_micros(micros)


def seconds_of_day(age_s: Column) -> Column:
    """The part of an age that is within its last day."""
    return age_s % F.lit(86400.0)


def halved(mass: Column) -> Column:
    """Whole-number halving of a positive mass, as a long."""
    return F.shiftright(mass.cast("long"), 1)


def roman(n: Column) -> Column:
    """Roman numeral of 1..3999; null outside that range."""

    def digit(words: list[str], value: Column) -> Column:
        return F.element_at(F.array(*[F.lit(w) for w in words]), value.cast("int") + 1)

    whole = n.cast("long")
    text = F.concat(
        digit(_ROMAN_THOUSANDS, F.floor(whole / 1000) % 10),
        digit(_ROMAN_HUNDREDS, F.floor(whole / 100) % 10),
        digit(_ROMAN_TENS, F.floor(whole / 10) % 10),
        digit(_ROMAN_ONES, whole % 10),
    )
    return F.when(whole.between(1, 3999), text)


def is_close(a: Column, b: Column, rel: float = 1e-9) -> Column:
    """Relative closeness of two doubles."""
    return F.abs(a - b) <= F.lit(rel) * F.greatest(F.abs(a), F.abs(b))


def eta_signed(r: Column, v: Column) -> Column:
    """Distance over speed, negative when inbound, infinite at rest."""
    return F.when(v == 0, F.lit(float("inf"))).otherwise(r / F.when(v != 0, v))


def time_to_impact(r: Column, v: Column) -> Column:
    """Seconds until an inbound object reaches the origin, else infinite."""
    return F.when(v < 0, r / -F.when(v < 0, v)).otherwise(F.lit(float("inf")))
