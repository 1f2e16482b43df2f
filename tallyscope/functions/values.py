"""Number, time and relation column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_DAY = 86_400_000_000


def to_number(c: Column) -> Column:
    """Double, null where the value is not a number."""
    return c.try_cast("double")


def epoch_time(c: Column, in_millis: bool) -> Column:
    """Timestamp of numeric seconds or milliseconds."""
    return F.timestamp_millis(c.cast("long")) if in_millis else F.timestamp_seconds(c)


def month_id(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def month_number(month: Column) -> Column:
    return F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int")


def relation(sender: Column, receiver: Column, managers: list[Column], teammates: Column) -> Column:
    """What the receiver is to the sender, first rule that holds."""
    is_manager = reduce(lambda a, b: a | b, [F.coalesce(m == receiver, F.lit(False)) for m in managers])
    return (
        F.when(receiver.isNull() | (receiver == ""), "sin_dato")
        .when(receiver == sender, "mismo_usuario")
        .when(is_manager, "manager_del_emisor")
        .when(F.coalesce(F.array_contains(teammates, receiver), F.lit(False)), "companero_equipo")
        .otherwise("otro")
    )


def tenure_years(ts: Column, hired: Column) -> Column:
    """Whole days between, in years of 365.25 days, rounded half to even."""
    days = F.floor((F.unix_micros(ts) - F.unix_micros(hired)) / MICROS_DAY)
    return F.bround(days / F.lit(365.25), 2)


def is_round(amount: Column, bases: tuple[int, ...]) -> Column:
    """A multiple of any base, within 1e-9."""
    rest = [F.pmod(amount, F.lit(float(b))) for b in bases]
    return F.coalesce(reduce(lambda a, b: a | b, [(r < 1e-9) | (F.abs(b - r) < 1e-9) for r, b in zip(rest, bases)]), F.lit(False))


def nearest_threshold(amount: Column, thresholds: tuple[float, ...]) -> Column:
    """struct(distance, threshold) of the nearest; ties go to the smaller threshold."""
    return F.array_min(F.array(*[F.struct(F.abs(amount - t).alias("distance"), F.lit(t).alias("threshold")) for t in thresholds]))


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(float(MICROS_DAY))


def tier_by_cuts(score: Column, critical: Column, high: Column, medium: Column) -> Column:
    """Tier of a score against three cuts; null cuts are never reached."""
    return F.when(score >= critical, "CRITICO").when(score >= high, "ALTO").when(score >= medium, "MEDIO").otherwise("BAJO")


def fixed_tier(score: Column) -> Column:
    """P26."""
    return tier_by_cuts(score, F.lit(4.7), F.lit(3.2), F.lit(1.8))


TIER_ORDER = ("CRITICO", "ALTO", "MEDIO", "BAJO")


def tier_rank(tier: Column) -> Column:
    """K2: sort rank of a tier."""
    return F.array_position(F.array(*[F.lit(t) for t in TIER_ORDER]), tier)


def directed_pair(a: Column, b: Column) -> Column:
    return F.concat_ws("→", a, b)


def undirected_pair(a: Column, b: Column) -> Column:
    """The smaller of the two concatenations."""
    return F.least(F.concat_ws("|", a, b), F.concat_ws("|", b, a))


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar (the anonymous algorithm)."""
    div = lambda x, y: F.floor(x / y).cast("int")
    golden, century, rest = year % 19, div(year, 100), year % 100
    skipped = div(century, 4)
    moon = (19 * golden + century - skipped - div(century - div(century + 8, 25) + 1, 3) + 15) % 30
    weekday = (32 + 2 * (century % 4) + 2 * div(rest, 4) - moon - rest % 4) % 7
    shift = div(golden + 11 * moon + 22 * weekday, 451)
    days = moon + weekday - 7 * shift + 114
    return F.make_date(year, div(days, 31), days % 31 + 1)


def nth_monday(year: Column, month: int, n: int) -> Column:
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(F.next_day(F.date_sub(first, F.lit(1)), "Mon"), F.lit(7 * (n - 1)))
