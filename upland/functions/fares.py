"""Trip prices as Column expressions: one rule for every tariff.

A tariff is a row: what the start costs and how many steps of the way it covers, how long a step is and what each further
one costs, what a minute costs at which speed, and to what coin the total is rounded.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from upland.functions.geo import col, quarter, round2


@dataclass(frozen=True)
class Tariff:
    start: float | Column
    per_step: float | Column
    step_m: float = 1000.0
    covered: int = 0             # steps that the start pays for
    per_minute: float = 0.0
    kmh: float = 20.0
    quarters: bool = False       # the total is rounded to 25 centavos, once
    plain_start: bool = False    # the start is shown as it is, not rounded like the total


# Fixed values of the fare guides.
TRADITIONAL = Tariff(start=13.0, per_step=1.8, covered=4, quarters=True, plain_start=True)   # start and step come with each route
MODERN = Tariff(start=17.0, per_step=2.0, covered=4, quarters=True)
MODERN_DISCOUNTED = Tariff(start=13.6, per_step=1.6, covered=4, quarters=True)
TAXI = Tariff(start=45.0, per_step=3.5, step_m=250.0, per_minute=2.0)
MODERN_VALID_UNTIL = "2026-06-30"

MONEY = ("start", "way", "wait")


def price(km, tariff: Tariff) -> Column:
    """struct(distance_km, fare, breakdown); the breakdown maps MONEY to pesos that add up to the fare, and steps and
    minutes to what was counted. A started step or half a minute counts whole."""
    km = col(km)
    as_column = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    start, per_step = as_column(tariff.start), as_column(tariff.per_step)
    steps = F.greatest(F.ceil(km * 1000.0 / tariff.step_m).cast("double") - tariff.covered, F.lit(0.0))
    minutes = F.floor(km * 60.0 / tariff.kmh + 0.5).cast("double") if tariff.per_minute else F.lit(0.0)
    wait = round2(minutes * tariff.per_minute)
    coin = quarter if tariff.quarters else round2
    fare = coin(start + (steps * per_step if tariff.quarters else round2(steps * per_step)) + wait)
    shown = round2(start) if tariff.plain_start else coin(start)
    amounts = {"start": shown, "way": round2(fare - shown - wait), "wait": wait, "steps": steps, "minutes": minutes}
    return F.struct(round2(km).alias("distance_km"), fare.alias("fare"), F.create_map(*[x for k, v in amounts.items() for x in (F.lit(k), v)]).alias("breakdown"))


def traditional_fare(km, base, per_km) -> Column:
    return price(km, replace(TRADITIONAL, start=col(base), per_step=col(per_km)))


def modern_fare(km, discounted: bool = False) -> Column:
    return price(km, MODERN_DISCOUNTED if discounted else MODERN)


def taxi_fare(km) -> Column:
    return price(km, TAXI)


def money_parts(breakdown) -> Column:
    """The peso amounts of a breakdown, without what was counted."""
    return F.map_filter(col(breakdown), lambda k, v: k.isin(*MONEY))


def guide_lapsed(ts, valid_until: str = MODERN_VALID_UNTIL) -> Column:
    """True once the UTC date is after the guide's last valid day (session zone UTC)."""
    return F.to_date(col(ts)) > F.lit(valid_until).cast("date")
