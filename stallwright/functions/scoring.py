"""Scores and decays as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
# Weights of the parts of a recommendation's score.
RECOMMENDATION_WEIGHTS = {"relevance": 100, "similarity": 40, "popularity": 18, "quality": 14, "freshness": 8, "context": 35}


def unit(x: Column) -> Column:
    """Clamped to 0..1; null and NaN count as 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))))


def linear_decay(age_us: Column, days: float, floor: float = 0.0) -> Column:
    """From 1 now to 0 after ``days``; the future counts as now, less than ``floor`` as nothing."""
    value = F.when(age_us <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - age_us / (days * DAY_US)))
    return F.when(value < floor, 0.0).otherwise(value)


def exponential_decay(age_us: Column, half_life_days: float = 14, floor: float = 0.01) -> Column:
    """Halved every ``half_life_days``; the future counts as now, less than ``floor`` as nothing."""
    value = F.when(age_us <= 0, F.lit(1.0)).otherwise(F.pow(F.lit(0.5), age_us / (half_life_days * DAY_US)))
    return F.when(value < floor, 0.0).otherwise(value)


def decay(method: Column, age_us: Column, half_life_days: float = 14, floor: float = 0.01) -> Column:
    """By name: ``LINEAR`` over twice the half-life, else exponential."""
    return F.when(method == "LINEAR", linear_decay(age_us, 2 * half_life_days, floor)).otherwise(exponential_decay(age_us, half_life_days, floor))


def _counted(n: Column, unit_: str, tail: str = "") -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {unit_}{tail}")).otherwise(F.lit(f" {unit_}s{tail}")))


def age_label(age_us: Column) -> Column:
    """An age in the largest unit of which it has one."""
    minutes = F.floor(age_us / 60_000_000)
    hours, days, months = F.floor(minutes / 60), F.floor(minutes / 1440), F.floor(minutes / 43200)
    label = F.when(minutes < 60, _counted(minutes, "minute")).when(hours < 24, _counted(hours, "hour")).when(days < 30, _counted(days, "day")).when(months < 12, _counted(months, "month")).otherwise(_counted(F.floor(months / 12), "year"))
    return F.when(age_us.isNull() | (minutes < 1), F.lit("just now")).otherwise(label)


def ago(age_us: Column) -> Column:
    """A time by its distance from now."""
    minutes = F.floor(age_us / 60_000_000)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    weeks, months = F.floor(days / 7), F.floor(days / 30)
    label = F.when(minutes < 1, F.lit("just now")).when(minutes < 60, _counted(minutes, "minute", " ago")).when(hours < 24, _counted(hours, "hour", " ago")).when(days == 1, F.lit("yesterday")).when(days < 7, _counted(days, "day", " ago"))
    return label.when(weeks < 5, _counted(weeks, "week", " ago")).when(months < 12, _counted(months, "month", " ago")).otherwise(_counted(F.floor(days / 365), "year", " ago"))


def is_new(age_us: Column, days: int = 30) -> Column:
    return F.coalesce((age_us >= 0) & (age_us < days * DAY_US), F.lit(False))


def within(start: Column, end: Column, now: Column) -> Column:
    """Whether now lies in [start, end); an open side is no bound."""
    return F.coalesce(start <= now, F.lit(True)) & F.coalesce(now < end, F.lit(True))


def half_up(n: Column, d: Column) -> Column:
    """n / d to the nearest whole number, halves away from zero, in whole numbers only."""
    size = F.floor((F.abs(n) * 2 + d).cast("decimal(38,0)") / (d * 2)).cast("bigint")
    return F.when(d > 0, F.when(n < 0, -size).otherwise(size))


def basis_points(amount: Column, points: Column) -> Column:
    """A share of an amount given in ten-thousandths."""
    return half_up(amount * points, F.lit(10_000).cast("bigint"))


def percent_off(before: Column, after: Column) -> Column:
    """Whole percent, 0 to 100, that ``after`` is below ``before``; null without a price before."""
    return F.when((before > 0) & (after <= before), half_up((before - after) * 100, before))


def shown_discount(price: Column, before: Column) -> Column:
    """Whole percent off as shown on a card; null below 1, above 99 or without a higher former price."""
    percent = percent_off(before, price)
    return F.when(percent.between(1, 99) & (price < before), percent)


def freshness(age_us: Column, days: float = 90) -> Column:
    """Linear decay; an unknown age is not fresh."""
    return F.coalesce(linear_decay(age_us, days), F.lit(0.0))


def quality(rating: Column, ratings: Column) -> Column:
    """The rating's share of five stars, drawn to zero while few rated; 0.35 if nobody did."""
    known = F.nanvl(rating, F.lit(None).cast("double"))
    return F.when(known.isNull() | (F.coalesce(ratings, F.lit(0)) == 0), F.lit(0.35)).otherwise(known / 5 * (ratings / (ratings + 10)))


def review_volume(ratings: Column) -> Column:
    return F.least(F.lit(10.0), F.lit(3.33) * F.log10(F.coalesce(ratings, F.lit(0)) + 1))


def discount_depth(price: Column, before: Column) -> Column:
    """The share taken off, at most 0.9; 0 without a higher former price."""
    return F.when((before > 0) & (price < before), F.least(F.lit(0.9), (before - price) / before)).otherwise(F.lit(0.0))


def price_band(price: Column) -> Column:
    """The decade a price lies in, as ``low-high``; null unless positive."""
    low = F.pow(F.lit(10.0), F.length(price.cast("string")) - 1).cast("bigint")
    return F.when(price > 0, F.concat_ws("-", low.cast("string"), (low * 10).cast("string")))


def price_affinity(price: Column, low: Column, high: Column) -> Column:
    """1 inside the band; falling at 0.6 of the relative distance below it and at all of it above."""
    below, above = F.greatest(F.lit(0.0), 1 - F.lit(0.6) * (low - price) / low), F.greatest(F.lit(0.0), 1 - (price - high) / high)
    return F.when((price >= low) & (price <= high), F.lit(1.0)).when((price < low) & (low > 0), below).when((price > high) & (high > 0), above).otherwise(F.lit(0.0))


def recommendation_score(**parts: Column) -> Column:
    """Weighted sum of the given parts, each clamped to 0..1, to four places."""
    return F.round(sum((unit(x) * RECOMMENDATION_WEIGHTS[k] for k, x in parts.items()), F.lit(0.0)), 4)


def trend_blend(trend: Column, popularity: Column, momentum: float = 0.75) -> Column:
    return F.round(trend * momentum + popularity * (1 - momentum), 4)


def cold_start(age_us: Column, rating: Column, ratings: Column, resemblance: Column, days: int = 14, least: int = 5) -> Column:
    """What is knowable of a product without history: rating (of ``least`` ratings or more), newness, likeness to popular ones."""
    known = F.when(F.nanvl(rating, F.lit(None).cast("double")).isNotNull() & (ratings >= least), rating / 5 * (ratings / (ratings + 10))).otherwise(0.0)
    newness = F.greatest(F.lit(0.0), 1 - F.greatest(age_us, F.lit(0)) / (days * DAY_US))
    return F.round(unit(known * 0.5 + newness * 0.3 + resemblance * 0.2), 4)


def repeated(count: Column, exponent: float = 0.6) -> Column:
    """Repetitions count less and less."""
    return F.when(count > 0, F.pow(count.cast("double"), F.lit(exponent))).otherwise(0.0)


def band_middle(band: Column) -> Column:
    """The geometric middle of a ``low-high`` band, 0 if it isn't one."""
    low, high = (F.regexp_extract(band, "^([0-9]+)-([0-9]+)$", k).try_cast("double") for k in (1, 2))
    return F.coalesce(F.when((low > 0) & (high > 0), F.floor(F.sqrt(low * high) + 0.5)), F.lit(0)).cast("bigint")


def stock_label(available: Column) -> Column:
    return F.when(available <= 0, "none").when(available <= 5, "few").when(available <= 25, "some").otherwise("many")


# The weights of the dimensions of an interest.
DIMENSION_WEIGHTS = {"CATEGORY": 1.0, "BRAND": 0.7, "PRODUCT_TYPE": 0.5, "ATTRIBUTE": 0.45, "PRICE_BAND": 0.35, "PRODUCT": 0.3}
# Sizes in order.
SIZES = ["XS", "S", "M", "L", "XL", "XXL", "XXXL"]


def size_place(size: Column) -> Column:
    """Sizes in their order, anything else last."""
    place = F.array_position(F.array(*(F.lit(x) for x in SIZES)), F.upper(size))
    return F.when(place > 0, place).otherwise(999)
