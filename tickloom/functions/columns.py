"""Small Column helpers shared by the operators."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def non_zero(value: Column) -> Column:
    """NULL for zero, so that a division yields NULL."""
    return F.when(value != 0, value)


def clip(value: Column, lo: float, hi: float) -> Column:
    """Bound a value; NULL stays NULL."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(float(lo))), F.lit(float(hi))))


def flag(condition: Column) -> Column:
    """1.0 where the condition holds, else 0.0 (NULL counts as not holding)."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def truth(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def full(aggregate: Column, count: Column, minimum: int) -> Column:
    """An aggregate that is NULL until its frame holds `minimum` values."""
    return F.when(count >= minimum, aggregate)


# First hour (inclusive) and end hour (exclusive) of sessions 0..3; 4 is "off".
SESSION_HOURS = [(0, 2, 7), (1, 7, 12), (2, 12, 17), (3, 17, 21)]


def shifted_hour(time: Column, offset: int = 0) -> Column:
    return F.pmod(F.hour(time) + F.lit(offset), F.lit(24))


def session_id(time: Column, offset: int = 0) -> Column:
    hour = shifted_hour(time, offset)
    out = F.lit(4)
    for number, start, end in SESSION_HOURS:
        out = F.when((hour >= start) & (hour < end), F.lit(number)).otherwise(out)
    return out.cast("int")


def monday_zero(time: Column) -> Column:
    return F.weekday(time)


def hours_between(time: Column, start: int, end: int) -> Column:
    return (F.hour(time) >= start) & (F.hour(time) < end)


def easter(year: Column) -> Column:
    """Gregorian Easter Sunday of a year, in Gauss's form of the church calendar."""
    golden = F.pmod(year, F.lit(19))
    century = F.floor(year / 100)
    lunar = F.floor((century * 8 + 13) / 25)
    m = F.pmod(F.lit(15) + century - F.floor(century / 4) - lunar, F.lit(30))
    n = F.pmod(F.lit(4) + century - F.floor(century / 4), F.lit(7))
    moon = F.pmod(golden * 19 + m, F.lit(30))
    weekday = F.pmod(F.pmod(year, F.lit(4)) * 2 + F.pmod(year, F.lit(7)) * 4 + moon * 6 + n, F.lit(7))
    days = moon + weekday
    days = F.when((moon == 29) & (weekday == 6), days - 7).when(
        (moon == 28) & (weekday == 6) & (golden > 10), days - 7).otherwise(days)
    return F.date_add(F.make_date(year, F.lit(3), F.lit(22)), days.cast("int"))


def market_closed(day: Column) -> Column:
    """Weekends, 1 January, 25 December and Good Friday."""
    return (
        (F.weekday(day) >= 5)
        | ((F.month(day) == 1) & (F.dayofmonth(day) == 1))
        | ((F.month(day) == 12) & (F.dayofmonth(day) == 25))
        | (day == F.date_sub(easter(F.year(day)), 2))
    )


def wilson_lower(wins: Column, trades: Column, z: float) -> Column:
    p = wins / trades
    centre = p + z * z / (2 * trades)
    spread = z * F.sqrt(p * (1 - p) / trades + z * z / (4 * trades * trades))
    return F.when(trades > 0, (centre - spread) / (1 + z * z / trades))


def wilson_upper(wins: Column, trades: Column, z: float) -> Column:
    p = wins / trades
    centre = p + z * z / (2 * trades)
    spread = z * F.sqrt(p * (1 - p) / trades + z * z / (4 * trades * trades))
    return F.when(trades > 0, (centre + spread) / (1 + z * z / trades))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def two_sided_z(confidence: float) -> float:
    return NormalDist().inv_cdf(0.5 + confidence / 2)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function to about 1e-15.

    Near zero the Taylor series of the integral is summed in nested form; in the tails
    the continued fraction of Mills' ratio is used.
    """
    a = F.abs(x)
    down = F.sequence(F.lit(60), F.lit(1), F.lit(-1))
    series = F.aggregate(down, F.lit(1.0), lambda s, k: 1 + s * a * a / (2 * k + 1))
    density = F.exp(-a * a / 2) / math.sqrt(2 * math.pi)
    fraction = F.aggregate(down, a.cast("double"), lambda s, k: a + k / s)
    upper = F.when(a < 3, 0.5 - density * a * series).otherwise(density / fraction)
    return F.when(x >= 0, 1 - upper).otherwise(upper)
