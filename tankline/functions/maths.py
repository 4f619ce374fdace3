"""Numeric functions as Column expressions: parabola, growth factors, truncation, caps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Speed in km/h that the register's consumption is measured at, about.
BASE_SPEED = 63
# Grams of CO2 that a litre gives at most.
CO2_PER_LITRE = {"gasoline": 2392.0, "diesel": 2640.0}
LEAST_FUEL = 1e-8


def parabola(v: Column, s0: Column, y0: Column, s1: Column, y1: Column, s2: Column, y2: Column) -> Column:
    """The value at v of the parabola through three points, inside and outside their range; null where two speeds are
    equal or anything is null."""
    part = lambda y, s, a, b: F.try_divide(y * (v - a) * (v - b), (s - a) * (s - b))
    return part(y0, s0, s1, s2) + part(y1, s1, s0, s2) + part(y2, s2, s0, s1)


def linear_outside(v: Column, s0: Column, y0: Column, s1: Column, y1: Column, s2: Column, y2: Column) -> Column:
    """The parabola inside the range, and outside it the line through the two nearest points."""
    line = lambda sa, ya, sb, yb: ya + F.try_divide((v - sa) * (yb - ya), sb - sa)
    return F.when(v < s0, line(s0, y0, s1, y1)).when(v > s2, line(s1, y1, s2, y2)).otherwise(parabola(v, s0, y0, s1, y1, s2, y2))


def clamped(c: Column) -> Column:
    """No less than zero; null stays null."""
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def growth(per_km_start: Column, per_km_dest: Column) -> Column:
    """sqrt(dest / start) - 1; null where the start is zero or the quotient negative."""
    ratio = F.try_divide(per_km_dest, per_km_start)
    return F.when(ratio >= 0, F.sqrt(ratio) - 1)


def fuel_growth(consumption_start: Column, start: Column, consumption_dest: Column, dest: Column) -> Column:
    """How litres per km change from speed start to dest. Values are per hour; none or less at dest counts as almost none."""
    at_dest = F.try_divide(consumption_dest, dest)
    return growth(F.try_divide(consumption_start, start), F.when(at_dest <= 0, F.lit(LEAST_FUEL)).otherwise(at_dest))


def co2_growth(co2_start: Column, start: Column, co2_dest: Column, dest: Column) -> Column:
    """The same for CO2, of which less than none counts as none."""
    return growth(F.try_divide(clamped(co2_start), start), F.try_divide(clamped(co2_dest), dest))


def capped_co2(per_litre: Column, fuel: Column) -> Column:
    out = per_litre
    for name, most in CO2_PER_LITRE.items():
        out = F.when(fuel == name, F.least(out, F.lit(most))).otherwise(out)
    return out


def truncated(c: Column, places: int) -> Column:
    """c cut to so many decimals, not rounded, as text."""
    scale = 10**places
    return F.format_string(f"%.{places}f", F.signum(c) * F.floor(F.abs(c) * scale) / scale)
